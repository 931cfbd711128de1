"""Operator 2, n-gram Jaccard join with adaptive multi-match prefixes, and the groups that its links make.

Sets of five-word shingles link when 100 * intersection >= 80 * union. Tokens
(shingle hashes) have one global order: those counted often go last, by count,
the others go by hash. In that order the first n - ceil(0.8 n) + l tokens of
two linked documents share at least l tokens, so each document picks its own l
by estimated candidate cost, posts that prefix, and a pair needs as many shared
prefix tokens as the smaller of its two l.

No group is expanded into pairs, and a token of very many documents is dealt
out in parts. Equal sets are one class from the start. Then
every token links its documents to one leader only, the verified links are
closed to components, and only pairs of different components are looked at
again, with the size bound and the position bound applied inside the join:
prefix tokens that nobody else posted can't match where their document's prefix
ends before its partner's, so the larger of the two documents' bounds holds for
a pair. Bounds and counts only leave out pairs that can't link, so the
components are those of the full join.

The count order needs only be the same everywhere, not right: counts come from
lossy counting of every set in every task, and at most HOT_TOKENS of them are
broadcast (12 bytes each); tokens beyond go by hash, which costs time only.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, by_ids, components, discard, mix, read_table, shingle_sets, small_arrow_batches, stored

THRESHOLD = 80  # percent
HOT_TOKENS = 1_000_000
HOT_COUNT = 16
MOST_MATCHES = 8
COUNTED = 1_000_000  # entries of a task's token counts; beyond, those counted least often are dropped to half as many
SPLIT = 20_000  # documents that may meet at one token in one task; hotter tokens are dealt out in parts
HEAD = 32  # tokens of a document that its postings carry


def _profile(batches):
    """Rows of documents (id, n, digest) and, at the end of each task, of its tokens counted twice or more."""
    names = ["doc_id", "n", "d1", "d2", "token", "df"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
    tokens, counts, fresh, size = np.zeros(0, np.uint64), np.zeros(0, np.int64), [], 0

    def merge():
        new, n = np.unique(np.concatenate(fresh), return_counts=True)
        both, inverse = np.unique(np.concatenate([tokens, new]), return_inverse=True)
        total = np.bincount(inverse, np.concatenate([counts, n]), len(both)).astype(np.int64)
        if len(both) <= COUNTED:
            return both, total
        least = max(1, int(np.partition(total, len(both) - COUNTED // 2)[len(both) - COUNTED // 2]))  # rises with what the task has seen
        return both[total > least], total[total > least]

    for batch in batches:
        n, d1, d2 = [], [], []
        for s in shingle_sets(batch.column(1)):
            n.append(len(s))
            a, b = np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64)
            d1.append(int(a))
            d2.append(int(b))
            if len(s):
                fresh.append(s)
                size += len(s)
            if size > COUNTED:
                tokens, counts = merge()
                fresh, size = [], 0
        none = pa.nulls(len(n), pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *(pa.array(x, pa.int64()) for x in (n, d1, d2)), none, none], names)
    if fresh:
        tokens, counts = merge()
    tokens, counts = tokens[counts > 1], counts[counts > 1]
    none = pa.nulls(len(tokens), pa.int64())
    yield pa.RecordBatch.from_arrays([none] * 4 + [pa.array(tokens.view(np.int64)), pa.array(counts)], schema=pa.schema(list(zip(names, kinds, strict=True))))


def prefix_length(n: int, matches: int) -> int:
    return min(n, n - -(-THRESHOLD * n // 100) + matches)


def matches_for(df: np.ndarray, n: int) -> int:
    """The l of least estimated cost: postings read with the prefix of l, plus sets compared. df: counts of the tokens in order, 1 if unknown.

    At most (sum of counts) / l documents can share l of the prefix tokens.
    """
    most = min(MOST_MATCHES, -(-THRESHOLD * n // 100))
    ends = [prefix_length(n, m) for m in range(1, most + 1)]
    heavy = np.cumsum(df[: ends[-1]] - 1)
    if not heavy[-1]:
        return 1
    cost = [heavy[e - 1] + n * heavy[e - 1] / m for m, e in enumerate(ends, 1)]
    return int(np.argmin(cost)) + 1


def _postings(hot):
    def run(batches):
        tokens, counts = hot.value
        for batch in batches:
            ids = batch.column(0).to_pylist()
            out, parts, meta, sizes, who = [], [], [], [], []
            for i, s in enumerate(shingle_sets(batch.column(1))):
                n = len(s)
                if not n:
                    continue
                df = np.ones(n, np.int64)
                if len(tokens):
                    at = np.minimum(np.searchsorted(tokens, s), len(tokens) - 1)
                    df = np.where(tokens[at] == s, counts[at], 1)
                    order = np.argsort(df, kind="stable")
                    s, df = s[order], df[order]
                m = matches_for(df, n)
                k = prefix_length(n, m)
                out.append(s[:k])
                who.append(ids[i])
                sizes.append(k)
                part = int(mix(np.array([who[-1]], np.int64).view(np.uint64))[0] >> np.uint64(1))
                parts.append(np.where(df[:k] > SPLIT, part % (df[:k] // SPLIT + 1), -1))
                meta.append((n << 36) + (np.arange(1, k + 1) << 8) + m)
            if out:
                columns = [pa.array(np.concatenate(out).view(np.int64)), pa.array(np.concatenate(parts).astype(np.int32)), pa.array(np.repeat(np.array(who, np.int64), sizes)), pa.array(np.concatenate(meta))]
                yield pa.RecordBatch.from_arrays(columns, ["token", "part", "doc", "meta"])

    return run


def _sets(batches):
    """Rows of id, text and any further columns with the text's set instead of the text."""
    for batch in batches:
        sets = list(shingle_sets(batch.column(1)))
        at = np.cumsum([0, *map(len, sets)])
        values = pa.array(np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64))
        tokens = pa.ListArray.from_arrays(pa.array(at, pa.int32()), values)
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), tokens, *batch.columns[2:]], ["doc", "tokens", *batch.schema.names[2:]])


def verified(pairs: DataFrame, docs: DataFrame, name: str) -> DataFrame:
    """The pairs (a, b) whose sets reach the threshold, stored.

    Where their number allows it the pairs are broadcast to the documents b, so a set is first shuffled on its way to a; else all
    three sides meet by shuffles.
    """
    pairs = stored(pairs, "pairs")
    sets = lambda ids: by_ids(docs, ids.distinct(), "left_semi").mapInArrow(_sets, "doc long, tokens array<long>")
    if pairs.count() <= BROADCAST_IDS:
        named = docs.join(F.broadcast(pairs.select(F.col("b").alias("doc_id"), "a")), "doc_id").select("doc_id", "text", "a")
        one = named.mapInArrow(_sets, "doc long, tokens array<long>, a long").withColumnsRenamed({"doc": "b", "tokens": "tb"})
    else:
        one = pairs.join(sets(pairs.select(F.col("b").alias("doc_id"))).withColumnsRenamed({"doc": "b", "tokens": "tb"}), "b")
    both = one.join(sets(pairs.select(F.col("a").alias("doc_id"))).withColumnsRenamed({"doc": "a", "tokens": "ta"}), "a")
    common = F.size(F.array_intersect("ta", "tb"))
    union = F.size("ta") + F.size("tb") - common
    out = stored(both.where(100 * common >= THRESHOLD * union).select("a", "b"), name)
    discard(pairs)
    return out


def enough(n_a, n_b):
    """Least intersection of two linked sets: i >= t / (100 + t) * (n_a + n_b)."""
    return THRESHOLD * (n_a + n_b) / (100 + THRESHOLD) - 1e-6


def may_link():
    """Whether postings a and b of one token are the first common ones of two documents that may link.

    A pair is formed at its first common token: no token before it in one head
    stands before it in the other. What is common then lies from there on, so 1
    plus the shorter rest bounds the intersection. Past a head, the number of
    shared tokens so far bounds what came before instead.
    """
    a, b = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}"))
    fits = (a("token") == b("token")) & (a("component") < b("component"))
    fits &= (a("n") * 100 >= b("n") * THRESHOLD) & (b("n") * 100 >= a("n") * THRESHOLD)
    rest = F.least(a("n") - a("pos"), b("n") - b("pos"))
    before = F.when((a("q") <= HEAD) & (b("q") <= HEAD), F.lit(1)).otherwise(F.least(a("q"), b("q")))
    fits &= before + rest >= enough(a("n"), b("n"))
    fits &= ~F.arrays_overlap(F.slice(a("head"), F.lit(1), (a("q") - 1).cast("int")), F.slice(b("head"), F.lit(1), (b("q") - 1).cast("int")))
    need = enough(a("n"), b("n"))
    # Of two prefixes one ends first in the global order; its tokens that don't match here match nowhere in the other document.
    # The other's may stand behind that end, so only the larger of the two bounds holds for the pair.
    fits &= F.greatest(a("rest") + a("k"), b("rest") + b("k")) >= need
    matches = F.size(F.array_intersect(a("head"), b("head")))
    whole = (a("k") <= HEAD) & (b("k") <= HEAD)
    return fits & (~whole | ((matches >= F.least(a("ell"), b("ell"))) & (F.greatest(a("rest"), b("rest")) + matches >= need)))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id (smallest id reachable by links).

    Ids are integers, one a document. Null, empty and blank texts have no
    shingles and stand alone; rows without an id take part only through a class
    of equal texts and get a null component where the class has no id. Repeated
    rows each come back. Other columns are ignored.
    """
    spark = docs.sparkSession
    small_arrow_batches(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    profile = stored(docs.mapInArrow(_profile, "doc_id long, n long, d1 long, d2 long, token long, df long"), "profile")
    rows = profile.where("n is not null").select("doc_id", "n", "d1", "d2")
    classes = stored(rows.where("n > 0").groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("rep")), "classes")
    others = rows.where("n = 0").select("doc_id").union(rows.join(classes, ["n", "d1", "d2"]).where("doc_id <> rep").select("doc_id"))
    others = stored(others.where("doc_id is not null").distinct(), "others")
    singles = by_ids(docs.where("doc_id is not null"), others, "left_anti")

    counted = profile.where("token is not null").groupBy("token").agg(F.sum("df").alias("df")).where(F.col("df") >= HOT_COUNT)
    hot = counted.orderBy(F.desc("df"), "token").limit(HOT_TOKENS).toPandas()
    tokens, counts = hot["token"].to_numpy(np.int64).view(np.uint64), hot["df"].to_numpy(np.int64)
    order = np.argsort(tokens)
    shared = spark.sparkContext.broadcast((tokens[order], counts[order].astype(np.int64)))

    # One exchange by token and part serves both the aggregate and the join: all columns take part in either.
    # part is -1 but for hot tokens.
    postings = singles.mapInArrow(_postings(shared), "token long, part int, doc long, meta long").repartition("token", "part")
    pos, size = F.shiftright("meta", 8).bitwiseAND((1 << 28) - 1), F.shiftright("meta", 36)
    # Of a token's documents the one that posted it earliest leads: it has the fewest tokens of its own.
    early = F.shiftleft(pos, 34) + F.pmod(F.xxhash64("doc"), F.lit(1 << 34))
    lead = F.min(F.struct(early.alias("early"), F.col("doc").alias("leader"), size.alias("leader_n"))).alias("lead")
    per_part = postings.groupBy("token", "part").agg(lead, F.count("*").alias("posted"), F.min(size).alias("least"), F.max("part").alias("dealt"))
    # Parts of a hot token agree on one leader; hot tokens are some of the HOT_TOKENS broadcast ones, so their number is bounded.
    # The filter asks an aggregate, so that it stays above the exchange and the exchange serves here too.
    whole = per_part.where("dealt >= 0").groupBy("token").agg(F.min("lead").alias("lead_all"), F.sum("posted").alias("posted_all"), F.min("least").alias("least_all"))
    per_part = per_part.join(F.broadcast(whole), "token", "left").select("token", "part", *[F.coalesce(f"{c}_all", c).alias(c) for c in ("lead", "posted", "least")])
    per_part = per_part.where("posted > 1").select("token", "part", "least", "lead.leader", "lead.leader_n")
    shared_tokens = postings.join(per_part, ["token", "part"]).withColumns({"n": size, "pos": pos, "ell": F.col("meta").bitwiseAND(255)})
    shared_tokens = stored(shared_tokens.drop("meta", "part"), "postings")

    stars = shared_tokens.where("doc <> leader").groupBy(F.col("leader").alias("a"), F.col("doc").alias("b")).agg(F.count("*").alias("k"), F.first("n").alias("n"), F.first("leader_n").alias("leader_n"))
    alike = (F.col("n") * 100 >= F.col("leader_n") * THRESHOLD) & (F.col("leader_n") * 100 >= F.col("n") * THRESHOLD)
    stars = stars.where(alike & (F.col("k") >= F.least(F.col("n") / 20, F.lit(8))))  # others are left to the second look
    links = verified(stars.select("a", "b"), docs, "links")
    first = components(links)
    discard(links, others)

    # Second look: pairs of different components. q: a token's place among those of its document that others posted too.
    ranked = shared_tokens.join(first.withColumnRenamed("node", "doc"), "doc", "left").withColumn("component", F.coalesce("component", "doc"))
    ranked = stored(ranked.withColumn("q", F.row_number().over(Window.partitionBy("doc").orderBy("pos", "token"))), "ranked", replaces=shared_tokens)
    # rest + k, with the tokens out that nobody else posted, bounds an intersection only for the document whose prefix ends first.
    head = F.transform(F.array_sort(F.collect_list(F.when(F.col("q") <= HEAD, F.struct("q", "token")))), lambda x: x["token"])  # at most HEAD of one document
    prefix = F.least(F.col("n"), F.col("n") - F.floor((THRESHOLD * F.col("n") + 99) / 100) + F.col("ell"))
    heads = ranked.groupBy("doc", "n", "ell").agg(head.alias("head"), F.max("q").alias("k")).select("doc", "head", "k", (F.col("n") - prefix).alias("rest"))
    heads = stored(heads, "heads")
    least = F.greatest(F.col("least"), THRESHOLD * F.col("n") / 100)
    own = ranked.where(F.col("q") + F.col("n") - F.col("pos") >= enough(F.col("n"), least))
    # A pair needs one document whose bound is enough, so a token needs one too; the other document may have any.
    own = own.join(heads.select("doc", "k", "rest"), "doc").withColumn("bound", F.col("rest") + F.col("k") >= enough(F.col("n"), least))
    own = stored(own.select("token", "doc", "n", "pos", "ell", "q", "component", "k", "rest", "bound"), "own", replaces=ranked)
    mine = own
    mixed = own.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.max("bound").alias("bound")).where("lo < hi and bound").select("token")
    own = own.join(mixed, "token", "left_semi").join(heads.select("doc", "head"), "doc")
    candidates = own.alias("a").join(own.alias("b"), may_link()).select(F.col("a.doc").alias("a"), F.col("b.doc").alias("b")).distinct()
    more = verified(candidates, docs, "more")
    discard(mine, heads)
    final = first if not more.take(1) else components(first.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more))
    discard(more)
    by_class = classes.join(final.withColumnRenamed("node", "rep"), "rep", "left").select("n", "d1", "d2", F.coalesce("component", "rep").alias("component_id"))
    out = rows.join(by_class, ["n", "d1", "d2"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", F.when(F.col("n") == 0, F.col("doc_id"))).alias("component_id"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each component: the smallest id. Rows without an id stay."""
    groups = near_groups(docs, id_col, text_col)
    gone = stored(groups.where("doc_id <> component_id").select(F.col("doc_id").alias(id_col)).distinct(), "near-copies")
    return by_ids(docs, gone, "left_anti", id_col)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(read_table(spark, sf_dir, "documents"))

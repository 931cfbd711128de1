"""Joins beyond plain equality: containment, progressive keys, similarity, listing ladders."""

from __future__ import annotations

import difflib
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import ahocorasick
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions.scalars import normal_name, slug, slug_candidates
from ..shipping import ship_package
from ..sources.store import written

#: Watch names that one automaton holds, about, and names that a task scans at a time.
BLOCK, CHUNK = 100_000, 50_000


def _automaton(words: Iterable[str]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for x in words:
        found.add_word(x, x)
    found.make_automaton()
    return found


def _chunks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The frames in lots of at least CHUNK rows, but for the last."""
    held, rows = [], 0
    for x in frames:
        held, rows = [*held, x], rows + len(x)
        if rows >= CHUNK:
            yield pd.concat(held)
            held, rows = [], 0
    if held:
        yield pd.concat(held)


def _scanner(block: Broadcast[list[str]]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Of frames (id, n) the pairs (id, w) in which one of n and w contains the other, for the watch names w of the block.

    Names are read once by the automaton of the block; the block's names are read by one of each chunk for those that lie within them.
    """

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        whole = _automaton(block.value) if block.value else None
        for chunk in _chunks(frames):
            if whole is None or not len(chunk):
                continue
            texts = chunk["n"].unique()
            met = [(n, w) for n in texts for w in {w for _, w in whole.iter(n)}]
            within = _automaton(texts)
            met += [(n, w) for w in block.value for n in {n for _, n in within.iter(w)} if n != w]
            yield chunk.merge(pd.DataFrame(met, columns=["n", "w"]).astype(object), on="n")[["id", "w"]]

    return scan


def watch_matches(names: DataFrame, watch: DataFrame, block: int = BLOCK) -> DataFrame:
    """names(id, name) with the watch names that their normal form contains or is contained in: id, matches (sorted).

    The watch list goes to the tasks in blocks of about `block` names, as many as it takes; each block's automaton reads every name once where
    it lies, so neither list is too long and names aren't shuffled before they match. Names without letters or digits match nothing.
    """
    spark = names.sparkSession
    ship_package(spark)
    n = names.select("id", normal_name("name").alias("n")).where("n <> ''")
    w = written(watch.select(F.col("name").alias("watch"), normal_name("name").alias("w")).where("w <> ''").distinct(), "watch")
    keys = w.select("w").distinct()
    blocks = max(1, -(-keys.count() // block))
    kind = names.schema["id"].dataType.simpleString()
    of = lambda i: [r.w for r in keys.where(F.pmod(F.xxhash64("w"), F.lit(blocks)) == i).collect()]
    met = reduce(DataFrame.unionAll, [n.mapInPandas(_scanner(spark.sparkContext.broadcast(of(i))), f"id {kind}, w string") for i in range(blocks)])
    return met.join(w, "w").groupBy("id").agg(F.array_join(F.sort_array(F.collect_set("watch")), ",").alias("matches"))


def progressive_key(companies: DataFrame, index: DataFrame) -> DataFrame:
    """companies(id, name) to index(key): the exact slug, else the longest run of its leading words (two or more), else the first key that holds its first three words.

    Candidate keys are exploded with their rank, so every step is an equi join;
    the last looks keys up by their own leading three words.
    """
    s = companies.select("id", slug("name").alias("s")).where("s <> ''").withColumn("parts", F.split("s", "-"))
    lead = s.select("id", F.explode(F.sequence(F.size("parts"), F.least(F.lit(2), F.size("parts")), F.lit(-1))).alias("k"), "parts").select("id", (F.size("parts") - F.col("k")).alias("rank"), F.array_join(F.slice("parts", 1, F.col("k")), "-").alias("key"))
    exact = lead.join(index.select("key"), "key")
    head = s.select("id", F.array_join(F.slice("parts", 1, 3), "-").alias("head"))
    keys = index.select("key", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.size(F.split("key", "-")) - 2, F.lit(1))), lambda i: F.array_join(F.slice(F.split("key", "-"), i, 3), "-")))).alias("head"))
    loose = head.join(keys, "head").select("key", "id", F.lit(1000).alias("rank"))
    return exact.select("key", "id", "rank").unionByName(loose).groupBy("id").agg(F.min_by("key", F.struct("rank", "key")).alias("key"))


def segment_pairs(names: DataFrame, keys: DataFrame, edits: str, most_edits: str, shortest: str, longest: str) -> DataFrame:
    """Pairs of names(s) and keys(key), both distinct, that may be within `edits` edits of each other: every pair that is, and few others.

    Of a key cut into more segments than there are edits one at least is left whole, and pairs meet only by such a segment. Taking the
    first i with at most i edits up to the end of segment i, that segment is whole, exactly i edits stand before it and the others behind,
    so in the name it is moved by at most i, and by at most what is left of the edits from where the difference of the lengths would have it.
    edits is SQL of ls and lk, the lengths of name and key; most_edits of lk, the most for any ls, below lk; shortest and longest of ls, the
    range of lk.
    """
    at = "cast(i * lk div n AS int)"
    size = f"(cast((i + 1) * lk div n AS int) - {at})"
    cut = keys.where("key <> ''").withColumn("lk", F.length("key")).withColumn("n", F.expr(f"cast({most_edits} AS int) + 1"))
    index = cut.withColumn("i", F.explode(F.expr("sequence(0, n - 1)"))).select("key", "lk", "i", F.expr(f"substr(key, {at} + 1, {size})").alias("segment"))
    probes = (
        names.where("s <> ''").withColumn("ls", F.length("s")).withColumn("lk", F.explode(F.expr(f"sequence(cast(greatest({shortest}, 1) AS int), cast({longest} AS int))")))
        .withColumn("n", F.expr(f"cast({most_edits} AS int) + 1")).withColumn("e", F.expr(f"cast({edits} AS int)")).where("e >= abs(ls - lk)")
        .withColumn("i", F.explode(F.expr("sequence(0, least(e, n - 1))")))
        .withColumn("low", F.expr(f"greatest(-i, ls - lk - (e - i), -{at})")).withColumn("high", F.expr(f"least(i, ls - lk + (e - i), ls - {size} - {at})")).where("low <= high")
        .withColumn("shift", F.explode(F.expr("sequence(low, high)"))).select("s", "lk", "i", F.expr(f"substr(s, {at} + shift + 1, {size})").alias("segment")).distinct()
    )
    return probes.join(index, ["lk", "i", "segment"]).select("s", "key").distinct()


def _best(pairs: DataFrame, most: int, ties: Column | str) -> DataFrame:
    """The `most` best keys of each text s: companies of one name share them, so no more than these meet the companies."""
    return pairs.withColumn("best", F.row_number().over(Window.partitionBy("s").orderBy(F.desc("similarity"), ties))).where(F.col("best") <= most)


def similar_keys(companies: DataFrame, index: DataFrame, least: float = 0.7, most: int = 5) -> DataFrame:
    """Keys with an edit similarity of at least `least` (above 0.5), the best `most` each. Pairs meet by a segment of the key."""
    if not 0.5 < least <= 1:
        raise ValueError("least must be above 0.5 and at most 1")
    edits = f"floor({1 - least} * greatest(ls, lk) + 1e-9)"
    names = companies.select("id", slug("name").alias("s"))
    pairs = segment_pairs(names.select("s").distinct(), index.select("key").distinct(), edits, f"floor({(1 - least) / least} * lk + 1e-9)", f"ceil({least} * ls - 1e-9)", f"floor(ls / {least} + 1e-9)")
    longest = F.greatest(F.length("s"), F.length("key"))
    near = F.expr(f"levenshtein(s, key, cast(floor({1 - least} * greatest(length(s), length(key)) + 1e-9) AS int)) >= 0")
    x = pairs.where(near).withColumn("similarity", 1 - F.levenshtein("s", "key") / longest).where(F.col("similarity") >= least)
    x = names.join(_best(x, most, "key"), "s")
    return x.withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("similarity"), "key"))).where(F.col("place") <= most).select("id", "key", "similarity", "place")


@F.pandas_udf(DoubleType())
def matched_share(a: pd.Series, b: pd.Series) -> pd.Series:
    """Twice the letters in matching blocks, found longest first, over the letters of both."""
    matcher, last, out = difflib.SequenceMatcher(), None, []
    for x, y in zip(a, b, strict=True):
        if y != last:
            matcher.set_seq2(y)
            last = y
        matcher.set_seq1(x)
        out.append(matcher.ratio())
    return pd.Series(out, dtype="float64")


def close_matches(companies: DataFrame, index: DataFrame, least: float = 0.7, most: int = 5) -> DataFrame:
    """companies(id, name) to keys of index(key): the direct candidates that are keys, in their order; for companies without one, the `most`
    keys of the largest share of matching blocks with the longest candidate, at least `least`, ties by the later key: id, key, similarity, place.

    Matching blocks are a common subsequence, so letters that don't match must be inserted or deleted, and the edit distance of a pair is at
    most their number. Pairs meet by a segment of the key that so many edits leave whole; what the distance itself then rules out never
    goes to Python. least must be above 2/3, or so many letters may differ that no segment need be left.
    """
    if not 2 / 3 < least <= 1:
        raise ValueError("least must be above 2/3 and at most 1")
    ship_package(companies.sparkSession)
    keys = index.select("key").distinct()
    tried = companies.select("id", F.posexplode(slug_candidates("name")).alias("rank", "key"))
    direct = tried.join(keys, "key").select("id", "key", F.lit(1.0).alias("similarity"), F.row_number().over(Window.partitionBy("id").orderBy("rank")).alias("place"))
    longest = tried.groupBy("id").agg(F.max_by("key", F.struct(F.length("key"), -F.col("rank"))).alias("s"))
    left = longest.join(direct.select("id").distinct(), "id", "left_anti")
    edits = f"floor({1 - least} * (ls + lk) + 1e-9)"
    reach = (2 - least) / least  # the longer text over the shorter, where one holds all letters of the other
    pairs = segment_pairs(left.select("s").distinct(), keys, edits, f"least(floor({2 * (1 - least) / least} * lk + 1e-9), lk - 1)", f"ceil(ls / {reach} - 1e-9)", f"floor(ls * {reach} + 1e-9)")
    pairs = pairs.where(F.expr(f"levenshtein(s, key, cast(floor({1 - least} * (length(s) + length(key)) + 1e-9) AS int)) >= 0"))
    scored = pairs.withColumn("similarity", matched_share("key", "s")).where(F.col("similarity") >= least)
    fuzzy = left.join(_best(scored, most, F.desc("key")).withColumnRenamed("best", "place"), "s")  # one s an id
    return direct.unionByName(fuzzy.select("id", "key", "similarity", "place"))


#: Kinds of events and the days around the day asked about, from and to.
EVENT_WINDOWS = {"board meeting": (0, 30), "corporate action": (0, 30), "announcement": (-7, 0)}
BUCKET_DAYS = 32


def event_windows(events: DataFrame, owned: DataFrame, days: DataFrame, windows: dict[str, tuple[int, int]] = EVENT_WINDOWS) -> DataFrame:
    """events(kind, symbol, date, ...) of owned(symbol) that lie in their kind's window around each day of days(as_of): as_of beside the events' columns.

    Days and events meet in a 32-day bucket of the time axis, so the join is one of equality; a day takes part in the buckets that its
    kind's window touches, and only there. Kinds without a window, symbols nobody owns and null dates give no rows.
    """
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(a).alias("low"), F.lit(b).alias("high")) for k, (a, b) in windows.items()])
    number = lambda d: F.floor(F.unix_date(d) / BUCKET_DAYS)
    spans = days.select("as_of").distinct().select("as_of", F.explode(kinds).alias("w")).select("as_of", "w.kind", F.date_add("as_of", F.col("w.low")).alias("first"), F.date_add("as_of", F.col("w.high")).alias("last"))
    spans = spans.withColumn("bucket", F.explode(F.sequence(number("first"), number("last"))))
    mine = events.join(owned.select("symbol").distinct(), "symbol", "left_semi").withColumn("bucket", number("date"))
    return mine.join(spans, ["kind", "bucket"]).where(F.col("date").between(F.col("first"), F.col("last"))).drop("bucket", "first", "last")


#: The order in which listings are tried: exchange and suffix.
LADDER = (("NSE", "-EQ"), ("NSE", ""), ("BSE", "-EQ"), ("BSE", ""), ("NSE", "-SM"), ("BSE", "-SM"))


def resolved(tickers: DataFrame, master: DataFrame) -> DataFrame:
    """tickers(ticker) to the first rung of the ladder that master(exchange, name, token) has; X.NS and X.BO stay on their exchange."""
    t = tickers.select("ticker", F.upper(F.regexp_replace("ticker", r"(?i)\.(NS|BO)$", "")).alias("raw"), F.when(F.col("ticker").rlike(r"(?i)\.NS$"), "NSE").when(F.col("ticker").rlike(r"(?i)\.BO$"), "BSE").alias("only"))
    rungs = F.array(*[F.struct(F.lit(i).alias("rank"), F.lit(e).alias("exchange"), F.lit(x).alias("suffix")) for i, (e, x) in enumerate(LADDER)])
    c = t.select("ticker", "raw", "only", F.explode(rungs).alias("r")).where("only is null or only = r.exchange").select("ticker", "r.rank", "r.exchange", F.concat("raw", "r.suffix").alias("name"))
    return c.join(master, ["exchange", "name"]).groupBy("ticker").agg(F.min_by("exchange", "rank").alias("exchange"), F.min_by("token", "rank").alias("token"))

"""Operator 12, target-distribution importance resampling, its features taken by an overlapped regex scan.

Separators are collapsed to single spaces, so every n-gram is a span of the
text as it stands. One pattern a length, with lookarounds for the words' ends,
is searched with overlaps: each match is an n-gram of its own, and its bytes go
to CRC-32 without being cut into words and joined again.

The scan runs once. Its buckets are stored a document, counted by Spark, and
looked up in the gains of all buckets, a list whose length is a parameter. The
draw takes the highest of weight plus Gumbel noise, which is sampling without
replacement in proportion to exp(weight); places come from ranges of the scores.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import by_ids, read_table, small_arrow_batches, stored

BUCKETS, SEED, LEAST_WORDS, PERCENT, GRAMS = 10_000, 2024, 20, 10, (1, 1)
#: A-Z to a-z, digits and bytes beyond ASCII stay, all else is a separator.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_GAPS = regex.compile(rb" {2,}")
_WORD = rb"[^ ]+"


def normalised(text: str | None) -> bytes:
    """Lower-cased words, one space between two."""
    return _GAPS.sub(b" ", (text or "").encode().translate(_FOLD)).strip(b" ")


def gram_patterns(grams: tuple[int, int]) -> list:
    """One pattern for each number of words; a match begins and ends where words do."""
    least, most = grams
    if not 1 <= least <= most:
        raise ValueError("grams must be (least, most) with 1 <= least <= most")
    return [regex.compile(rb"(?<![^ ])" + rb" ".join([_WORD] * k) + rb"(?![^ ])") for k in range(least, most + 1)]


def gram_buckets(text: bytes, patterns: list, buckets: int) -> list[int]:
    """The bucket of each n-gram of a normalised text, repeats included."""
    crc = zlib.crc32
    return [crc(m[0]) % buckets for p in patterns for m in p.finditer(text, overlapped=True)]


def features(docs: DataFrame, text_col: str = "text", buckets: int = BUCKETS, grams: tuple[int, int] = GRAMS) -> DataFrame:
    """docs with n_words and features (the bucket of each n-gram) in place of the text; clashing columns are replaced."""
    small_arrow_batches(docs.sparkSession)
    rows = [c for c in docs.columns if c.lower() not in {"n_words", "features", text_col.lower()}]
    docs = docs.select(*rows, F.col(text_col).alias("__text"))
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields[:-1]]

    def scan(batches):
        patterns = gram_patterns(grams)
        for batch in batches:
            found, words, start, size = [], [], 0, 0

            def flush(stop):
                ends = np.cumsum([0, *map(len, found)], dtype=np.int32)
                flat = np.concatenate([np.array(f, np.int32) for f in found]) if found else np.zeros(0, np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
                return pa.RecordBatch.from_arrays([*batch.slice(start, stop - start).columns[:-1], pa.array(words, pa.int64()), lists], [*rows, "n_words", "features"])

            for i, text in enumerate(batch.column(len(rows))):
                t = normalised(text.as_py())
                found.append(gram_buckets(t, patterns, buckets))
                words.append(t.count(b" ") + 1 if t else 0)
                size += len(found[-1])
                if size >= 1 << 20:
                    yield flush(i + 1)
                    found, words, start, size = [], [], i + 1, 0
            if found or not batch.num_rows:
                yield flush(batch.num_rows)

    return docs.mapInArrow(scan, ", ".join([*kinds, "n_words long", "features array<int>"]))


def _counts(features: DataFrame) -> DataFrame:
    return features.select(F.explode("features").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))


def bucket_gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket, gain: floor(1000 ln) of the smoothed target frequency over the smoothed source frequency, for every bucket.

    source and target are results of features(). A side without features has uniform frequencies.
    """
    spark = source.sparkSession
    both = _counts(source).select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t")).unionByName(
        _counts(target).select("bucket", F.lit(0).cast("long").alias("s"), F.col("n").alias("t"))
    ).unionByName(spark.range(buckets).select(F.col("id").cast("int").alias("bucket"), F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("t")))
    counts = both.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    everything = Window.partitionBy()  # one row a bucket
    total = lambda c: F.sum(c).over(everything).cast("double")
    ratio = (F.col("t") + 1.0) * (total("s") + buckets) / ((F.col("s") + 1.0) * (total("t") + buckets))
    return counts.select("bucket", F.floor(1000 * F.log(ratio)).cast("long").alias("gain"))


def _weights(features: DataFrame, gains: list[int]) -> DataFrame:
    """features with n_features and weight, the floored mean of its gains (none: 0), in place of the buckets."""
    rows = [c for c in features.columns if c != "features"]
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in features.schema.fields if f.name != "features"]
    values = np.array(gains, np.int64)

    def weigh(batches):
        for batch in batches:
            lists = batch.column(len(rows))
            ends = lists.offsets.to_numpy().astype(np.int64)
            sums = np.concatenate([[0], np.cumsum(values[lists.values.to_numpy()[: ends[-1]]])])
            n = np.diff(ends)
            mean = (sums[ends[1:]] - sums[ends[:-1]]) // np.maximum(n, 1)  # numpy's // floors
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rows)], pa.array(n), pa.array(mean)], [*rows, "n_features", "weight"])

    return features.select(*rows, "features").mapInArrow(weigh, ", ".join([*kinds, "n_features long", "weight long"]))


def gumbel(id_col: str, seed: int) -> Column:
    """floor(-1000 ln(-ln u)) with u from a hash of seed and id, the same in every run."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def ranked(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """df with rank, the place from 1 of its first n rows in an order over the whole table; null for the others.

    Ranges of the order are sorted on their own and stored with each row's place
    in its range; one count a range tells what stands before it.
    """
    ranges = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__spot", F.monotonically_increasing_id())
    ranges = stored(ranges, "ranges").withColumn("__range", F.shiftright("__spot", 33))
    counts = ranges.groupBy("__range").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))  # one row a range
    counts = counts.select("__range", F.coalesce(before, F.lit(0)).alias("__before"))
    place = F.col("__before") + F.col("__spot").bitwiseAND((1 << 33) - 1) + 1
    return ranges.join(F.broadcast(counts), "__range").withColumn("rank", F.when(place <= n, place)).drop("__spot", "__range", "__before")


def resample(
    docs: DataFrame,
    target: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_text: str = "text",
    percent: int = PERCENT,
    least_words: int = LEAST_WORDS,
    grams: tuple[int, int] = GRAMS,
    buckets: int = BUCKETS,
    seed: int = SEED,
) -> DataFrame:
    """One row per document: id, n_words, n_features, weight, score, rank (1, 2, 3 ... of the drawn, else null).

    Of the N documents with at least least_words words, floor(percent * N / 100)
    are drawn: highest score first, ties to the smaller id. Null and empty texts
    have no features and weight 0. A row without an id has no score and is not
    counted in N. Repeated rows are scored and drawn each on their own. An empty
    target makes all target frequencies equal. Other columns are ignored; an
    empty table gives no rows.
    """
    if not 0 <= percent <= 100:
        raise ValueError("percent must be 0 to 100")
    rows = features(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "text", buckets, grams)
    rows = stored(rows, "buckets")
    wanted = features(target.select(F.col(target_text).alias("text")), "text", buckets, grams)
    gains = [r.gain for r in bucket_gains(rows, wanted, buckets).orderBy("bucket").collect()]  # `buckets` numbers
    scored = _weights(rows, gains).withColumn("score", F.col("weight") + gumbel("doc_id", seed))
    scored = stored(scored, "scores", replaces=rows)
    able = (F.col("n_words") >= least_words) & F.col("score").isNotNull()
    n = percent * scored.where(able).count() // 100
    drawn = ranked(scored.where(able), n, F.desc("score"), F.asc("doc_id"), F.desc("n_features"))
    out = drawn.unionByName(scored.where(~able).withColumn("rank", F.lit(None).cast("long")))
    return out.select(F.col("doc_id").alias(id_col), "n_words", "n_features", "weight", "score", "rank")


def importance_sample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The drawn documents with all their columns; options are those of resample(). Rows of one id are drawn together."""
    drawn = resample(docs, target, id_col, **options).where("rank is not null").select(id_col).distinct()
    return by_ids(docs, stored(drawn, "drawn"), "left_semi", id_col)


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


OP12_SQL = r"""
WITH RECURSIVE bits AS (
  SELECT i AS n, i AS c, 0 AS k FROM range(256) r(i)
  UNION ALL SELECT n, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY n) AS tab FROM bits WHERE k = 8),
fold AS (
  SELECT 'd' AS side, doc_id AS id, coalesce(text, '') AS text FROM documents
  UNION ALL SELECT 'b', item_id, coalesce(text, '') FROM benchmark),
split AS (
  SELECT side, id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS words FROM fold),
grams AS (SELECT side, id, unnest(words) AS w FROM split),
hashed AS (
  SELECT w, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(octet_length(encode(w))), lambda i: ('0x' || substr(hex(encode(w)), 2 * i + 1, 2))::BIGINT)),
                            lambda c, b: xor(c >> 8, tab[xor(c & 255, b) + 1])), 4294967295::BIGINT) % 10000 AS bucket
  FROM (SELECT DISTINCT w FROM grams), crc),
n AS (SELECT h.bucket, count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 'b') AS t FROM grams JOIN hashed h USING (w) GROUP BY 1),
total AS (SELECT coalesce(sum(s), 0)::DOUBLE AS s, coalesce(sum(t), 0)::DOUBLE AS t FROM n),
gain AS (SELECT bucket, floor(1000 * ln((n.t + 1.0::DOUBLE) * (total.s + 10000) / ((n.s + 1.0::DOUBLE) * (total.t + 10000))))::BIGINT AS gain FROM n, total),
weight AS (
  SELECT id AS doc_id, count(*) AS n_features, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM grams JOIN hashed USING (w) JOIN gain USING (bucket) WHERE side = 'd' GROUP BY 1),
scored AS (
  SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM documents LEFT JOIN weight USING (doc_id)),
able AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT scored.doc_id, n_features, weight, score, CASE WHEN place <= 10 * n // 100 THEN place END AS rank FROM scored LEFT JOIN able USING (doc_id)
"""

"""What several operators of this subpackage share: stored intermediate results, connected components, word shingles."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship_package
from ..sources.store import shared_folder

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bounds of one Arrow batch that Python tasks get, in rows and bytes.
ARROW_BOUNDS = {"spark.sql.execution.arrow.maxRecordsPerBatch": 2048, "spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20}


def stored(df: DataFrame, name: str, replaces: DataFrame | None = None) -> DataFrame:
    """df, written to the shared folder as Parquet and read again: lineage ends there and lost executors cost nothing.

    replaces: an earlier result of this function that df was made of and nothing else needs; its folder goes once df is written.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tidemark-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if replaces is not None:
        discard(replaces)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete the folders of results of stored() that no later result reads."""
    for df in frames:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._stored_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def small_arrow_batches(spark: SparkSession) -> None:
    """What every Python stage here needs: Arrow batches of bounded rows and bytes, and this package on the workers.

    Spark reads the bounds when a query runs, so they are lowered for the session; a caller's lower ones stay.
    """
    ship_package(spark)
    for key, most in ARROW_BOUNDS.items():
        have = spark.conf.get(key, None)
        if not (have and have.isdigit() and 0 < int(have) <= most):
            spark.conf.set(key, str(most))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Ids of 8 bytes that may be broadcast; beyond, Spark shuffles.
BROADCAST_IDS = 2_000_000


def by_ids(docs: DataFrame, ids: DataFrame, how: str, id_col: str = "doc_id") -> DataFrame:
    """Semi or anti join by an id; the ids are broadcast, so that no text moves, when their count allows it."""
    small = ids.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if small else ids, id_col, how)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def held_out(doc_id: str, mod: int, remainder: int) -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % mod == remainder, F.lit(False))


def components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """Smallest reachable id of every node of edges(a, b): columns node, component.

    Alternating large-star and small-star steps: every step is a min-aggregation
    by node and a join back, so hot nodes are combined before the shuffle and
    split by AQE in the join. Self loops and nulls are ignored; the number of
    rounds grows with the logarithm of the longest chain.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = stored(e, name)
    state = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # Every node keeps a link to the smallest of its neighbours.
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(low)
        e = stored(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name, replaces=e)
        new = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(new) == state:
            break
        state = tuple(new)
    return e.select(F.col("u").alias("node"), F.col("v").alias("component"))


# ---- word shingles, whole Arrow batches at a time -------------------------------------------

WORDS = 5
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Spans of more bytes are hashed one by one with BLAKE2.
LONG_SPAN = 256
_TAIL = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def span_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of buf[start:end], equal for equal bytes wherever they stand.

    Eight bytes a step, each step a bijection that is not linear in what came before, so no shape of
    words collides by construction, as it does for sums of powers modulo 2^64.
    """
    size = end - start
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(buf) + 1, np.uint64, padded, strides=(1,))  # the eight bytes from each place on
    h = mix(size.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    rows = np.flatnonzero(size <= LONG_SPAN)
    for k in range(0, LONG_SPAN, 8):
        rows = rows[size[rows] > k]
        if not len(rows):
            break
        h[rows] = mix(h[rows] ^ (eight[start[rows] + k] & _TAIL[np.minimum(size[rows] - k, 8)]))
    for i in np.flatnonzero(size > LONG_SPAN).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(padded[start[i] : end[i]], digest_size=8).digest(), "little")
    return h


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the offsets of each; null counts as empty."""
    blobs = [b"" if x is None else x for x in texts.cast(pa.binary()).to_pylist()]
    offsets = np.zeros(len(blobs) + 1, np.int64)
    np.cumsum([len(b) for b in blobs], out=offsets[1:])
    return np.frombuffer(b"".join(blobs), np.uint8), offsets


def blocks(texts: pa.Array, block: int = 1_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Bytes and offsets of runs of whole texts of about `block` bytes; a longer text is a block of its own."""
    raw, offsets = utf8(texts)
    at = 0
    while at < len(offsets) - 1:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + block, side="right")) - 1)
        yield raw[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each text the place of its first."""
    gap = np.ones(len(raw) + 1, bool)
    gap[:-1] = _SPACE[raw]
    before = np.ones(len(raw) + 1, bool)
    before[1:] = gap[:-1]
    before[offsets] = True  # a word ends where its text ends
    start = np.flatnonzero(~gap & before)
    after = gap.copy()
    after[offsets] = True
    end = np.flatnonzero(after[1:] & ~gap[:-1]) + 1
    return start, end, np.searchsorted(start, offsets)


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, A-Z lower-cased, and for each text the place of its first."""
    start, end, first = word_spans(raw, offsets)
    words = span_hashes(FOLD[raw], start, end) if len(start) else np.zeros(0, np.uint64)
    return words, first


_COEFFICIENTS = mix(np.arange(1, WORDS + 1, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its runs of five words (fewer words: of all of them; none: empty)."""
    for raw, offsets in blocks(texts):
        yield from _block_sets(raw, offsets)


def _block_sets(raw: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    words, first = word_hashes(raw, offsets)
    runs = mix(sum(words[i : max(0, len(words) - WORDS + 1) + i] * _COEFFICIENTS[i] for i in range(WORDS))) if len(words) >= WORDS else words
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= WORDS:
            s = np.sort(runs[a : b - WORDS + 1])
            yield s[np.append(True, s[1:] != s[:-1])]
        elif b > a:  # one shingle of k < 5 words: k takes part, so that no longer run equals it
            yield mix((words[a:b] * _COEFFICIENTS[: b - a]).sum(keepdims=True) + np.uint64(b - a))
        else:
            yield words[:0]

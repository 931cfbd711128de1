"""Operator 11, periodic run detection: recursive frequency splitting, then a lag scan of what is left.

A run of exponent 4 holds each of its words at least 4 times. So a word with
fewer occurrences in a segment is in no run of that segment and splits it; its
parts hold still fewer words, and the splitting goes on until no part has such
a word. Whether a word is too rare in a segment is told from the places of its
nearest occurrences, without counting, and a segment is searched from both ends
at once, so all splits together cost n log n. A maximal run never crosses a
split.

Surviving segments are scanned lag by lag. A run of period q and exponent 4 or
more holds four places in a row whose numbers are multiples of q, all with one
word, so a lag looks at one word in q; only where four agree are the words
between compared. Lags go upwards: a stretch inside a run of a smaller period
repeats that run and is passed over.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, small_arrow_batches

LEAST_LENGTH, LEAST_EXPONENT = 6, 4
#: A task's results go out once they hold so many bytes of text.
FLUSH_BYTES = 4 << 20

Run = tuple[int, int, int]  # start, length, period
Edit = Callable[[object, list[bytes]], list[bytes]]


def _neighbours(ids: np.ndarray, k: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For j = 0 .. k - 1 the places of the j-th occurrence of each word before it (none: -1) and after it (none: n)."""
    n = len(ids)
    order = np.argsort(ids, kind="stable")
    by_word = ids[order]
    before, after = [np.arange(n)], [np.arange(n)]
    for j in range(1, k):
        same = by_word[j:] == by_word[:-j]
        earlier, later = order[:-j][same], order[j:][same]
        b, a = np.full(n, -1), np.full(n, n)
        b[later], a[earlier] = earlier, later
        before.append(b)
        after.append(a)
    return before, after


def split(ids: np.ndarray, least_length: int = LEAST_LENGTH, exponent: int = LEAST_EXPONENT) -> Iterator[tuple[int, int]]:
    """Segments (from, to) of at least least_length words, each of which occurs in its segment `exponent` times or more."""
    if len(ids) < least_length:
        return
    before, after = _neighbours(ids, exponent)

    def rare(segment: tuple[int, int], lo: int, hi: int) -> np.ndarray:
        """Places from lo to hi whose word has fewer than `exponent` occurrences in the segment."""
        enough = np.zeros(hi - lo, bool)
        for j in range(exponent):  # j occurrences before it and the others after it
            enough |= (before[j][lo:hi] >= segment[0]) & (after[exponent - 1 - j][lo:hi] < segment[1])
        return np.flatnonzero(~enough) + lo

    work = [(0, len(ids))]
    while work:
        lo, hi = segment = work.pop()
        step, cuts, done = 256, [], 0
        while not len(cuts) and done < hi - lo:  # from both ends: the price is that of the smaller part
            a, b = lo + done, hi - done
            if b - a <= 2 * step:
                cuts, done = rare(segment, a, b) if b > a else [], hi - lo
            else:
                cuts, done = np.concatenate([rare(segment, a, a + step), rare(segment, b - step, b)]), done + step
            step *= 2
        if not len(cuts):
            yield segment
            continue
        edges = np.concatenate([[lo - 1], cuts, [hi]])
        long = np.flatnonzero(np.diff(edges) > least_length)
        work += [(int(edges[i]) + 1, int(edges[i + 1])) for i in long]


def _agreeing(equal_from: int, words: np.ndarray, q: int, step: int) -> int:
    """How many places from equal_from on, in steps of +1 or -1, hold the word that stands q later."""
    n, size, found = len(words), 32, 0
    at = equal_from
    while True:
        if step > 0:
            stop = min(at + size, n - q)
            if stop <= at:
                return found
            differs = words[at:stop] != words[at + q : stop + q]
        else:
            stop = max(at - size + 1, 0)
            if at < 0:
                return found
            differs = (words[stop : at + 1] != words[stop + q : at + 1 + q])[::-1]
        first = int(differs.argmax())
        if differs[first]:
            return found + first
        found += len(differs)
        at += step * len(differs)
        size *= 2


def lag_scan(words: np.ndarray, least_length: int = LEAST_LENGTH, exponent: int = LEAST_EXPONENT) -> list[Run]:
    """All maximal runs of a segment, each with its smallest period, in order of period."""
    n, runs = len(words), []
    inside = np.zeros(n, np.int64)  # the end of the furthest run that holds a place
    for q in range(1, n // exponent + 1):
        marks = words[::q]
        same = marks[1:] == marks[:-1]
        span = len(same) - exponent + 2
        four = same[:span].copy()
        for j in range(1, exponent - 1):
            four &= same[j : j + span]
        at = np.flatnonzero(four) * q
        last = (exponent - 1) * q
        if len(at):
            at = at[inside[at] <= at + last]
        for j in range(1, 8):  # a run that holds the four places agrees everywhere between them
            if not len(at):
                break
            probe = at + j * (last - q) // 8
            at = at[words[probe] == words[probe + q]]
        for a in at.tolist():
            if inside[a] > a + last:
                continue
            ahead = _agreeing(a, words, q, 1)
            if ahead <= last - q:
                continue
            start = a - _agreeing(a - 1, words, q, -1)
            end = a + ahead + q
            if end - start >= max(least_length, exponent * q):
                runs.append((start, end - start, q))
                np.maximum(inside[start:end], end, out=inside[start:end])
    return runs


def find_runs(ids: np.ndarray, least_length: int = LEAST_LENGTH, exponent: int = LEAST_EXPONENT) -> list[Run]:
    """Maximal runs (start, length, period) of a sequence of word numbers, by start, then period.

    exponent (3 or more) times the smallest period, and least_length words, are the least length of a run.
    """
    if exponent < 3 or least_length < 1:
        raise ValueError("exponent must be 3 or more and least_length 1 or more")
    runs = []
    for lo, hi in split(ids, least_length, exponent):
        runs += [(lo + start, length, q) for start, length, q in lag_scan(ids[lo:hi], least_length, exponent)]
    return sorted(runs, key=lambda r: (r[0], r[2]))


def collapse(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """Words that stand in no run, or among the first `period` words of every run that holds them."""
    if not runs:
        return words
    drop = np.zeros(len(words), bool)
    for start, length, q in runs:
        drop[start + q : start + length] = True
    return [words[i] for i in np.flatnonzero(~drop).tolist()]


def periodic_runs(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH, exponent: int = LEAST_EXPONENT, edit: Edit | None = None
) -> DataFrame:
    """One row per document: doc_id, runs array<struct<start, length, period>> (longs, by start, then period), collapsed text.

    Words are separated by ASCII white space and compared as they are. A run is a
    stretch of consecutive words with smallest period q and length of at least
    max(least_length, exponent * q) that no neighbouring word extends. `collapsed`
    keeps the words that no run holds after its first q, joined by one space.
    edit(id, words), if given, changes a document's words first. Null and empty
    texts have no words, no runs and an empty collapsed text; repeated rows and
    rows without an id are treated each on their own; other columns are ignored;
    an empty table gives no rows. A very long text costs about its words times
    their logarithm and lies in one task, as it is one value.
    """
    small_arrow_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def detect(batches):
        for batch in batches:
            ids, found, kept, size = [], [], [], 0

            def flush(id_type):
                runs = [[{"start": s, "length": n, "period": q} for s, n, q in r] for r in found]
                return pa.RecordBatch.from_arrays([pa.array(ids, id_type), pa.array(runs, run_type), pa.array(kept, pa.string())], ["doc_id", "runs", "collapsed"])

            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = (text.as_py() or "").encode().split()
                if edit is not None:
                    words = edit(doc_id, words)
                numbers: dict[bytes, int] = {}
                sequence = np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64)
                runs = find_runs(sequence, least_length, exponent)
                ids.append(doc_id)
                found.append(runs)
                kept.append(b" ".join(collapse(words, runs)).decode())
                size += len(kept[-1])
                if size >= FLUSH_BYTES:
                    yield flush(batch.schema.types[0])
                    ids, found, kept, size = [], [], [], 0
            yield flush(batch.schema.types[0])

    return rows.mapInArrow(detect, f"doc_id {kind}, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string")


def with_made_run(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The query's rule: every tenth document, by the checksum of its id, goes on with repeats of a stretch of its own."""
    h, n = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1, len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the runs and of the collapsed text of every document."""
    found = periodic_runs(read_table(spark, sf_dir, "documents"), edit=with_made_run)

    def better(best, r):
        """r, where its exact length / period is greater; the earlier of equal ones stays, as runs are in order."""
        return F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best)

    best = F.aggregate("runs", F.get("runs", F.lit(-1)), better)
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.when(F.size("runs") > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise("")
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )

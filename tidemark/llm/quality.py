"""Operator 1, quality classifier: Naive Bayes support vectors.

Indicators of hashed byte n-grams are scaled by the log-count ratio of the two
classes; a linear hinge-loss model on the scaled, length-normalised indicators
is fit by dual coordinate descent, and its margins are turned into
probabilities by a logistic curve fit on rows the model has not seen. The fit
uses at most `max_rows` labelled rows (those of smallest id hash, a bound that
does not grow); scoring is one pass over all whole texts with the 1 MB model
broadcast.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, held_out, read_table, small_arrow_batches, word_hashes

DIM_BITS, MAX_ROWS, EPOCHS, COST, SMOOTHING = 18, 6000, 12, 4.0, 1.0
LIMIT = 0.3


#: Features for the share of words that repeat the word before them: by powers of two of the share.
REPEATS = 8


def grams(texts: pa.Array) -> Iterator[np.ndarray]:
    """For each text its distinct hashed byte bigrams and trigrams, and one or more for word bigrams of one word twice.

    None for null and for texts of one byte or less.
    """
    seen = np.zeros(1 << DIM_BITS, np.int64)
    for raw, offsets in blocks(texts):
        b = raw.astype(np.uint32)
        words, first = word_hashes(raw, offsets)
        twice = np.concatenate([[0, 0], np.cumsum(words[1:] == words[:-1])])
        for k, (lo, hi) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
            t = b[lo:hi]
            pair = t[:-1] | t[1:] << np.uint32(8)
            three = pair[:-1] | t[2:] << np.uint32(16)
            h = np.concatenate([pair + np.uint32(1 << 24), three]) * np.uint32(2654435761) >> np.uint32(32 - DIM_BITS)
            at = np.arange(len(h))
            seen[h] = at  # of equal features the last place wins
            h = h[seen[h] == at]
            n = int(first[k + 1] - first[k])
            same = int(twice[first[k + 1]] - twice[first[k] + 1]) if n > 1 else 0
            if same:
                level = min(REPEATS - 1, int(np.log2(n / same)))
                h = np.append(h, (1 << DIM_BITS) + np.arange(level, REPEATS))
            yield h


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def score(self, rows: Iterator[np.ndarray]) -> list[float]:
        out = []
        for ids in rows:
            margin = (self.weights[ids].sum(dtype=np.float64) / np.sqrt(len(ids)) if len(ids) else 0.0) + self.bias
            out.append(float(1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -500, 500)))))
        return out


def log_count_ratios(rows: list[np.ndarray], labels: np.ndarray, dim: int) -> np.ndarray:
    counts = np.full((2, dim), SMOOTHING)
    for ids, y in zip(rows, labels, strict=True):
        counts[int(y), ids] += 1
    counts /= counts.sum(1, keepdims=True)
    return np.log(counts[1] / counts[0])


def dual_descent(rows: list[np.ndarray], labels: np.ndarray, scale: np.ndarray, epochs: int = EPOCHS, cost: float = COST, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights and bias of min |w|^2 / 2 + cost * sum hinge, one dual variable at a time; the bias is a constant feature.

    The cost of the rarer class is raised so that both classes weigh the same.
    """
    sign = np.where(labels > 0, 1.0, -1.0)
    share = [max(1, (sign == s).sum()) for s in (-1.0, 1.0)]
    most = cost * np.where(sign > 0, len(sign) / 2 / share[1], len(sign) / 2 / share[0])
    w, bias, alpha = np.zeros(len(scale)), 0.0, np.zeros(len(rows))
    values = [scale[ids] / np.sqrt(max(1, len(ids))) for ids in rows]
    norms = np.array([v @ v + 1.0 for v in values])
    random = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in random.permutation(len(rows)):
            ids, v, y = rows[i], values[i], sign[i]
            slack = y * (w[ids] @ v + bias) - 1
            new = min(max(alpha[i] - slack / norms[i], 0.0), most[i])
            step = (new - alpha[i]) * y
            if step:
                alpha[i] = new
                w[ids] += step * v
                bias += step
    return w, bias


def logistic_curve(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve of margins, by damped Newton steps with a small ridge."""
    a, b = 1.0, 0.0
    x = np.stack([margins, np.ones(len(margins))], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -50, 50)))
        grad = x.T @ (p - labels) + 1e-3 * np.array([a, b])
        hess = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        a, b = a - np.clip(step[0], -2, 2), b - np.clip(step[1], -2, 2)
    return float(max(a, 1e-3)), float(b)


def fit(rows: list[np.ndarray], labels: np.ndarray) -> Model:
    """Without both classes among the rows, the model says the share of class 1 (0.5 without rows)."""
    dim = (1 << DIM_BITS) + REPEATS
    if len(set(labels.tolist())) < 2:
        share = min(max(float(labels.mean()) if len(labels) else 0.5, 1e-6), 1 - 1e-6)
        return Model(np.zeros(dim), 0.0, 1.0, float(np.log(share / (1 - share))))
    part = np.arange(len(rows)) % 4
    margins = np.zeros(len(rows))
    for k in range(2):  # two folds of a quarter each are enough rows for the curve
        own = part != k
        some = [r for r, o in zip(rows, own, strict=True) if o]
        if len(set(labels[own].tolist())) < 2:
            continue
        scale = log_count_ratios(some, labels[own], dim)
        w, bias = dual_descent(some, labels[own], scale)
        for i in np.flatnonzero(~own):
            margins[i] = w[rows[i]] @ scale[rows[i]] / np.sqrt(max(1, len(rows[i]))) + bias
    slope, shift = logistic_curve(margins[part < 2], labels[part < 2].astype(float))
    scale = log_count_ratios(rows, labels, dim)
    w, bias = dual_descent(rows, labels, scale)
    return Model((w * scale).astype(np.float32), bias, slope, shift)


#: Longer texts, in bytes, are not taken into the rows that a model is fit on; they are scored like all others.
MAX_TRAIN_BYTES = 32_768


def labelled_features(docs: DataFrame, labels: DataFrame, label: str, features: Callable, max_rows: int, keep_out, variants: Callable | None = None, wide: bool = False):
    """Features and labels of at most max_rows labelled rows, those of the smallest id hash; bounded in rows and bytes, so the driver may hold them.

    variants(text) gives changed copies of a text; the result's third part then holds for each copy the place of its row and its features.
    wide: features are of 64 bits, else of 32.
    """
    chosen = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~keep_out).select("doc_id", F.col(label).cast("int").alias("label")).distinct()
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(max_rows)
    kind, array = ("long", pa.int64()) if wide else ("int", pa.int32())
    names = ["doc_id", "label", "copy", "ids"]

    def run(batches):
        for batch in batches:
            texts, own = batch.column(1), np.arange(batch.num_rows)
            copy = np.zeros(batch.num_rows, np.int32)
            if variants is not None:
                more = [(i, t) for i, text in enumerate(texts.to_pylist()) for t in variants(text or "")]
                texts = pa.concat_arrays([texts, pa.array([t for _, t in more], texts.type)])
                own = np.concatenate([own, np.array([i for i, _ in more], np.int64)])
                copy = np.concatenate([copy, np.arange(1, len(more) + 1, dtype=np.int32)])
            rows = [np.asarray(r) for r in features(texts)]
            at = np.cumsum([0, *map(len, rows)])
            flat = np.concatenate(rows) if rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(own)), batch.column(2).take(pa.array(own)), pa.array(copy), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat.astype(array.to_pandas_dtype())))], names)

    rows = docs.select("doc_id", "text").where(F.coalesce(F.octet_length("text"), F.lit(0)) <= MAX_TRAIN_BYTES).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "label")
    table = rows.mapInArrow(run, f"doc_id long, label int, copy int, ids array<{kind}>").orderBy("doc_id", "label", "copy").toArrow()
    ids = table["ids"].combine_chunks()
    if isinstance(ids, pa.ChunkedArray):
        ids = pa.concat_arrays(ids.chunks) if ids.num_chunks else pa.array([], pa.list_(array))
    at, flat = ids.offsets.to_numpy(), ids.values.to_numpy()
    every = [flat[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
    copy, y = table["copy"].to_numpy(), table["label"].to_numpy().astype(int)
    place = np.cumsum(copy == 0) - 1
    swaps = [(int(place[i]), every[i]) for i in np.flatnonzero(copy > 0)]
    return [every[i] for i in np.flatnonzero(copy == 0)], y[copy == 0], swaps


def scored(docs: DataFrame, model, features: Callable, hold, limit: float = LIMIT) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.score(features(batch.column(1))), pa.float64())], ["doc_id", "score"])

    rows = docs.select("doc_id", "text")
    out = rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")
    return out.select("doc_id", hold.alias("held_out"), "score", (F.col("score") >= limit).cast("int").alias("predicted"))


def quality_scores(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted.

    Only labels of rows that are not held out are learnt from. Null and empty
    texts have no features and get the score of the bias. Every row is scored
    on its whole text alone, so ties and repeats agree; other columns are
    ignored. Without usable labels all scores are one constant.
    """
    small_arrow_batches(docs.sparkSession)
    hold = held_out("doc_id", 5, 0)
    rows, y, _ = labelled_features(docs, labels, "quality", grams, max_rows, hold)
    return scored(docs, fit(rows, y), grams, hold)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without those predicted 0. Rows without an id are kept or dropped by their text as well."""
    small_arrow_batches(docs.sparkSession)
    hold = held_out("doc_id", 5, 0)
    rows, y, _ = labelled_features(docs, labels, "quality", grams, MAX_ROWS, hold)
    shared = docs.sparkSession.sparkContext.broadcast(fit(rows, y))
    place = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            scores = np.array(shared.value.score(grams(batch.column(place))))
            yield batch.filter(pa.array(scores >= LIMIT))

    return docs.mapInArrow(run, docs.schema)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))

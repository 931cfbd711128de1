"""Operator 9, toxicity: a logistic model of words, regularised by counterfactuals.

Identity terms are swapped for others in the labelled texts; beside the logistic
loss the model pays for every change of a labelled text's score under a swap,
measured on the swapped text's own features, so that naming a group moves no
score. Its features are words and word beginnings of six bytes, each also at two
levels of its share of the text's words; those count whose log-odds between the
labelled classes stand out, and all that a swap changes. Features are whole
hashes of 64 bits, hence a new word never looks like a known one. The fit takes
at most `max_rows` labelled rows, a bound that does not grow; every whole text
is scored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import FOLD, blocks, held_out, mix, read_table, small_arrow_batches, span_hashes, word_spans
from .quality import labelled_features, scored

MAX_ROWS, MIN_Z, RIDGE, SWAP_PENALTY, STEPS = 8000, 3.0, 1e-3, 5.0, 300
#: Terms whose mention alone says nothing about toxicity; a caller may give others.
IDENTITY_TERMS = (
    "women", "men", "woman", "man", "girls", "boys", "gay", "lesbian", "straight", "transgender", "queer",
    "black", "white", "asian", "african", "latino", "arab", "european", "american",
    "muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic",
    "immigrants", "refugees", "foreigners", "disabled", "blind", "deaf", "old", "young",
)
_LETTERS = np.full(256, 32, np.uint8)
_LETTERS[128:] = np.arange(128, 256)
_LETTERS[[*range(65, 91), *range(97, 123)]] = [*range(65, 91), *range(97, 123)]


#: Word beginnings of so many bytes, and the shares of a text's words (one in so many) from which a feature has its further levels.
BEGINNING, LEVELS = 6, (256, 128)
#: Swapped copies of each labelled text that names an identity term.
SWAPS = 3


def words(texts: pa.Array) -> Iterator[np.ndarray]:
    """For each text its distinct features as int64: words, beginnings of longer words, and both by their share. Punctuation and digits part words. None for null."""
    for raw, offsets in blocks(texts):
        letters = FOLD[_LETTERS[raw]]
        start, end, first = word_spans(letters, offsets)
        whole = span_hashes(letters, start, end)
        long = np.flatnonzero(end - start > BEGINNING)
        begun = mix(span_hashes(letters, start[long], start[long] + BEGINNING) ^ np.uint64(BEGINNING))
        long_first = np.searchsorted(long, first)
        for a, b, c, d in zip(first[:-1].tolist(), first[1:].tolist(), long_first[:-1].tolist(), long_first[1:].tolist(), strict=True):
            ids, n = np.unique(np.concatenate([whole[a:b], begun[c:d]]), return_counts=True)
            yield np.concatenate([ids, *(mix(ids[n * share >= b - a] + np.uint64(share)) for share in LEVELS)]).view(np.int64)


def swapper(terms: tuple[str, ...], swaps: int = SWAPS) -> Callable[[str], list[str]]:
    """A function that gives copies of a text with its identity terms swapped for others, term by term in turn; none where it names no term."""
    place = {t.lower(): i for i, t in enumerate(terms)}
    pattern = re.compile(r"(?<![A-Za-z\x80-\U0010FFFF])(" + "|".join(map(re.escape, sorted(place, key=len, reverse=True))) + r")(?![A-Za-z\x80-\U0010FFFF])", re.IGNORECASE)

    def run(text: str) -> list[str]:
        if len(place) < 2 or not pattern.search(text):
            return []
        steps = {1 + k * (len(terms) - 1) // swaps for k in range(swaps)}
        return [pattern.sub(lambda m, k=k: terms[(place[m[1].lower()] + k) % len(terms)], text) for k in sorted(steps)]

    return run


@dataclass
class Model:
    vocabulary: np.ndarray  # sorted
    weights: np.ndarray
    bias: float

    def score(self, rows: Iterator[np.ndarray]) -> list[float]:
        out = []
        for ids in rows:
            z = self.bias
            if len(ids) and len(self.vocabulary):
                at = np.minimum(np.searchsorted(self.vocabulary, ids), len(self.vocabulary) - 1)
                z += float(self.weights[at[self.vocabulary[at] == ids]].sum())
            out.append(float(1 / (1 + np.exp(-np.clip(z, -500, 500)))))
        return out


def standing_out(flat: np.ndarray, owner: np.ndarray, labels: np.ndarray, least: float) -> np.ndarray:
    """Hashes whose smoothed log-odds between the classes are at least `least` standard errors from nothing."""
    vocabulary, at = np.unique(flat, return_inverse=True)
    of_one = np.bincount(at, labels[owner], len(vocabulary))
    of_none = np.bincount(at, 1.0 - labels[owner], len(vocabulary))
    n1, n0 = labels.sum(), len(labels) - labels.sum()
    odds = np.log((of_one + 0.5) / (n1 - of_one + 0.5)) - np.log((of_none + 0.5) / (n0 - of_none + 0.5))
    error = np.sqrt(1 / (of_one + 0.5) + 1 / (n1 - of_one + 0.5) + 1 / (of_none + 0.5) + 1 / (n0 - of_none + 0.5))
    return vocabulary[(np.abs(odds) >= least * error) & (of_one + of_none >= 3)]


def fit(rows: list[np.ndarray], labels: np.ndarray, swapped: list[tuple[int, np.ndarray]] = (), penalty: float = SWAP_PENALTY) -> Model:
    """swapped: of each swapped copy the place of its row and its features. Without both classes among the rows the score is the share of class 1 (0.5 without rows)."""
    y = labels.astype(float)
    if len(set(labels.tolist())) < 2:
        share = min(max(float(y.mean()) if len(y) else 0.5, 1e-6), 1 - 1e-6)
        return Model(np.zeros(0, np.int64), np.zeros(0), float(np.log(share / (1 - share))))
    # What a swap takes away (-1) and brings in (1), feature by feature.
    gone = [np.setdiff1d(rows[i], ids) for i, ids in swapped]
    come = [np.setdiff1d(ids, rows[i]) for i, ids in swapped]
    sizes = [len(g) + len(c) for g, c in zip(gone, come, strict=True)]
    changed = np.concatenate([np.zeros(0, np.int64), *(x for g, c in zip(gone, come, strict=True) for x in (g, c))])
    sign = np.concatenate([np.zeros(0), *(np.repeat((-1.0, 1.0), (len(g), len(c))) for g, c in zip(gone, come, strict=True))])
    pair = np.repeat(np.arange(len(sizes)), sizes)
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    flat = np.concatenate(rows)
    vocabulary = np.union1d(standing_out(flat, owner, y, MIN_Z), changed)
    at = np.minimum(np.searchsorted(vocabulary, flat), len(vocabulary) - 1) if len(vocabulary) else np.zeros(len(flat), int)
    known = vocabulary[at] == flat if len(vocabulary) else np.zeros(len(flat), bool)
    at, owner = at[known], owner[known]
    moved = np.searchsorted(vocabulary, changed)
    w, bias = np.zeros(len(vocabulary)), float(np.log(y.mean() / (1 - y.mean())))
    square, square_b = np.full(len(w), 1e-8), 1e-8
    for _ in range(STEPS):
        z = np.bincount(owner, w[at], len(rows)) + bias
        error = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y) / len(y)
        grad = np.bincount(at, error[owner], len(w)) + RIDGE / len(y) * w
        if len(sizes):
            change = np.bincount(pair, sign * w[moved], len(sizes))  # of each swap, in the score's logit
            grad += 2 * penalty / len(sizes) * np.bincount(moved, sign * change[pair], len(w))
        square += grad * grad
        square_b += error.sum() ** 2
        w -= 0.5 * grad / np.sqrt(square)
        bias -= 0.5 * error.sum() / np.sqrt(square_b)
    return Model(vocabulary, w, bias)


def toxicity_scores(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, terms: tuple[str, ...] = IDENTITY_TERMS) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted.

    Only labels of rows that are not held out are learnt from. Null, empty and
    wordless texts get the score of the bias. Ties and repeats agree, very long
    texts are scored whole; other columns are ignored; an empty table gives no
    rows; without usable labels all scores are one constant. Where the labelled
    texts name no identity term there is nothing to swap and nothing to pay.
    """
    small_arrow_batches(docs.sparkSession)
    hold = held_out("doc_id", 4, 2)
    rows, y, swapped = labelled_features(docs, labels, "toxic", words, max_rows, hold, swapper(terms), wide=True)
    return scored(docs, fit(rows, y, swapped), words, hold)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))

"""Operator 4, packing: harmonic packing in every task on its own.

Lengths fall into reciprocal-capacity classes: a document of L tokens is of
class k = floor(capacity / L), and each bin of class k takes exactly k whole
documents. What such a bin has left over, less than one more document of its
class, is filled with pieces cut from other documents: first from those longer
than the capacity, which must be cut anyway and otherwise fill sequences of
their own, and where too many bins wait, from the next document that comes. So
most documents that fit stay whole and full bins have no padding. The open bins
that a task has at its end, fewer than its classes, are joined whole into
sequences, largest first, and the emptiest of these are cut to fill the others;
only the last sequence of a task is short.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import text_blocks, vocabulary
from .common import read_table, small_arrow_batches

CAPACITY, END_ID = 2048, 1
#: Capacities of room in waiting bins, and of tokens in them and in long documents, that a task holds at most.
WAITING, HELD = 16, 256


Piece = tuple[object, int, np.ndarray, int]  # id, start, token ids, tokens of the whole document


class Packer:
    """Pieces of one task. It holds one open bin a class, waiting bins with at most WAITING capacities of room and HELD of tokens, and WAITING capacities of long documents.

    Where either bound of the waiting bins is reached, the next document is cut to fill them.
    """

    def __init__(self, capacity: int, task: int) -> None:
        self.capacity, self.next_id = capacity, task << 32
        self.open: dict[int, list[Piece]] = {}
        self.waiting: list[tuple[int, list[Piece]]] = []  # bins with all their documents, and the room in them
        self.room = self.held = 0  # room and tokens of the waiting bins
        self.long: list[Piece] = []
        self.long_tokens = 0
        self.rows: list[tuple] = []

    def _emit(self, pieces: list[Piece]) -> None:
        offset = 0
        for doc_id, start, ids, total in pieces:
            self.rows.append((doc_id, start, len(ids), zlib.crc32(ids), total, self.next_id, offset))
            offset += len(ids)
        self.next_id += 1

    def add(self, doc_id, ids: np.ndarray) -> None:
        piece = (doc_id, 0, ids, len(ids))
        if len(ids) > self.capacity:
            self.long.append(piece)
            self.long_tokens += len(ids)
        elif self.room >= WAITING * self.capacity or self.held >= HELD * self.capacity:
            self.long.append(piece)
            self.long_tokens += len(ids)
        else:
            k = self.capacity // len(ids)
            bin_ = self.open.setdefault(k, [])
            bin_.append(piece)
            if len(bin_) == k:
                del self.open[k]
                self._close(bin_)
        while self.waiting and self.long_tokens >= self.waiting[-1][0]:
            room, bin_ = self.waiting.pop()
            self.room -= room
            self.held -= self.capacity - room
            self._emit(bin_ + self._cut(room))
        while self.long_tokens >= WAITING * self.capacity:
            self._emit(self._cut(self.capacity))

    def _close(self, bin_: list[Piece]) -> None:
        room = self.capacity - sum(len(p[2]) for p in bin_)
        if room:
            self.waiting.append((room, bin_))
            self.room += room
            self.held += self.capacity - room
        else:
            self._emit(bin_)

    def _cut(self, tokens: int) -> list[Piece]:
        """So many tokens of the documents that are cut, or all that are left of them."""
        out = []
        while tokens and self.long:
            doc_id, start, ids, total = self.long[-1]
            part = ids[:tokens]
            out.append((doc_id, start, part, total))
            tokens -= len(part)
            self.long_tokens -= len(part)
            if len(part) < len(ids):
                self.long[-1] = (doc_id, start + len(part), ids[len(part) :], total)
            else:
                self.long.pop()
        return out

    def finish(self) -> None:
        bins = [(room, b) for room, b in self.waiting]
        loose = sorted((p for b in self.open.values() for p in b), key=lambda p: -len(p[2]))
        for p in loose:  # first fit, longest first
            for i, (room, b) in enumerate(bins):
                if room >= len(p[2]):
                    bins[i] = (room - len(p[2]), [*b, p])
                    break
            else:
                bins.append((self.capacity - len(p[2]), [p]))
        bins.sort(key=lambda b: b[0])
        at = 0
        while at < len(bins):
            room, b = bins[at]
            while self.long_tokens < room and len(bins) - 1 > at:  # the emptiest bin is cut up
                more = bins.pop()[1]
                self.long += more
                self.long_tokens += sum(len(p[2]) for p in more)
            self._emit(b + self._cut(room))
            at += 1
        while self.long:
            self._emit(self._cut(self.capacity))


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its token ids and then end_id, so null and empty texts give
    one piece of one token. Every id lies in exactly one piece; pieces fill a
    sequence gaplessly from offset 0. sequence_id is unique over all tasks, not
    gapless. Repeated rows are packed each on their own; other columns are
    ignored; an empty table gives no rows.
    """
    small_arrow_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches):
        vocab = vocabulary(path)
        packer = Packer(capacity, TaskContext.get().partitionId())
        id_type = pa.int64()

        def flush():
            columns = list(zip(*packer.rows, strict=True)) or [()] * 7
            packer.rows = []
            return pa.RecordBatch.from_arrays([pa.array(columns[0], id_type), *(pa.array(c, pa.int64()) for c in columns[1:])], names)

        for batch in batches:
            id_type = batch.schema.types[0]
            doc_ids = batch.column(0).to_pylist()
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in text_blocks(texts):
                ids, at = vocab.encode(texts[a:b])
                ids = ids.astype("<u4")
                for i, (lo, hi) in enumerate(zip(at[:-1], at[1:], strict=True)):
                    packer.add(doc_ids[a + i], np.append(ids[lo:hi], np.uint32(end_id)).astype("<u4"))
                if len(packer.rows) > 4096:
                    yield flush()
        packer.finish()
        yield flush()

    return rows.mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{n} long" for n in names[1:]))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))

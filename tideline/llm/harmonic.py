"""Harmonic packing of token sequences: a class of lengths for each reciprocal of the capacity, a fixed number of pieces a bin.

A length in (C/(k+1), C/k] belongs to class k, and a bin of that class holds k pieces of it. Documents may be cut, so they are cut to the
upper ends of classes: into pieces of C, then by the binary digits of the rest into C/2, C/4, ... 1 token (classes 2, 4, ... C), the
largest first. k pieces of length C/k fill a bin exactly, and a bin needs nothing but its own class's next k pieces, so each
worker fills bins from the documents it reads, without a shuffle, a global order or a word to another worker.

Of each class a worker holds the pieces of the bin that is not full, fewer than C in each class. What is left of all classes at its end
is laid out by falling length: the lengths divide each other, so that fills further bins without a gap, and the last of them is cut into
sequences of a power of two (at most log2 C a worker), which need no padding either.

Defined results: a null or empty text is the end id alone (one token); rows with equal or null doc_id are all packed, each on its
own; sequence numbers are those of the worker's partition and differ between partitions; an empty table gives an empty result; columns
other than doc_id and text are not read. The capacity is a power of two.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tideline.llm.common import slices, texts
from tideline.llm.tokens import encoder

CAPACITY, END_ID = 2048, 1
FIELDS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def cuts(n: int, capacity: int = CAPACITY) -> list[int]:
    """Lengths of the pieces of n tokens, each the upper end of a class."""
    rest = n % capacity
    return [capacity] * (n // capacity) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


class Bins:
    """Bins of one worker; `put` and `rest` give (piece, sequence, offset) of pieces whose place is settled."""

    def __init__(self, capacity: int, first: int):
        self.capacity, self.next = capacity, first
        self.open: dict[int, list] = {}

    def put(self, piece: tuple, length: int):
        held = self.open.setdefault(length, [])
        held.append(piece)
        if len(held) * length == self.capacity:
            yield from ((p, self.next, k * length) for k, p in enumerate(held))
            self.open[length] = []
            self.next += 1

    def rest(self):
        left = sum(length * len(held) for length, held in self.open.items())
        size = at = 0
        for length in sorted(self.open, reverse=True):
            for p in self.open[length]:
                if at == size:
                    size = min(self.capacity, 1 << left.bit_length() - 1)
                    at, self.next = 0, self.next + 1
                yield p, self.next - 1, at
                at += length
                left -= length
        self.open = {}


def pack(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of every piece of every row of docs."""
    if capacity < 1 or capacity & capacity - 1:
        raise ValueError("the capacity is a power of two")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        coder, end = encoder(vocabulary, words=True), np.array([END_ID], "<u4").tobytes()
        bins, id_type = Bins(capacity, TaskContext.get().partitionId() << 40), None

        def rows(placed):
            pieces = [(*p, s, o) for p, s, o in placed]
            columns = zip(*pieces, strict=True) if pieces else [[]] * len(FIELDS)
            return pa.RecordBatch.from_arrays([pa.array(c, id_type if k == 0 else pa.int64()) for k, c in enumerate(columns)], FIELDS)

        for b in slices(batches):
            id_type, placed = b.schema.field("doc_id").type, []
            for doc_id, got in zip(b.column("doc_id").to_pylist(), coder.encode(texts(b)), strict=True):
                ids = memoryview(got + end)
                n, at = len(ids) // 4, 0
                for length in cuts(n, capacity):
                    placed += bins.put((doc_id, at, length, zlib.crc32(ids[4 * at : 4 * (at + length)]), n), length)
                    at += length
            yield rows(placed)
        if id_type is not None:
            yield rows(bins.rest())

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")

"""Packing of token sequences into as few bins as it can: dominance reduction, then best fit.

Lengths are at most the capacity (2,048), so the instance is a histogram with at most 2,048 rows however many documents there
are; that histogram is all the driver sees. On it, sizes are taken in falling order and the small sets that provably dominate
every other way to fill a bin with that size are fixed for good (Martello and Toth's criterion): a size nothing fits beside; a
pair that fills the bin; and where no three others fit beside the size, a pair whose partner is the largest that fits and weighs at
least any two that fit together, or the triple of the largest that fits and the best other if no two above that other fit. What
is left is packed best-fit decreasing, a whole class of equal sizes at a time: bins that look alike are one group with a count,
so groups grow with the capacity, not with the data. The plan comes back as runs of bins for ranges of ranks within a size, and
each piece finds its place from its size and its rank among equal sizes (numbered in salted runs, no global sort).

Defined results: a null or empty text is the end id alone (one token); rows with equal or null doc_id are all packed, each on
its own; an empty table gives an empty result; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import bisect
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import numbered, slices, stage, texts
from tideline.llm.tokens import END_ID, encoder

CAPACITY = 2048


def pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None, room: int | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): ids and end id of each document, cut so that only the first piece is short.
    `room`: bytes of a generation of the encoder's store."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        coder, end = encoder(vocabulary, room=room), np.array([END_ID], "<u4").tobytes()
        for b in slices(batches):
            row, piece, start, length, crc = [], [], [], [], []
            for i, got in enumerate(coder.encode(texts(b))):
                ids = memoryview(got + end)
                n = len(ids) // 4
                at = 0
                for k in range(-(-n // capacity)):
                    to = n - (-(-n // capacity) - 1 - k) * capacity
                    row.append(i), piece.append(k), start.append(at), length.append(to - at), crc.append(zlib.crc32(ids[4 * at : 4 * to]))
                    at = to
            ids = b.column("doc_id").take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                                             ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def dominated(count: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Sets fixed by dominance as (sizes, how many bins); `count` keeps what is left."""
    fixed = []

    def fix(sizes: tuple[int, ...], times: int) -> None:
        fixed.append((sizes, times))
        for s in sizes:
            count[s] -= times
            if not count[s]:
                del count[s]

    for s in sorted(count, reverse=True):
        while count.get(s):
            others = sorted(k for k in count if k != s or count[s] > 1)
            room = capacity - s
            fits = others[: bisect.bisect_right(others, room)]
            if not fits:
                fix((s,), count[s] if s > room else 1)
                continue
            best, beside = fits[-1], {k: count[k] - (k == s) for k in fits}
            if best < room and len(three := _smallest(fits, beside, 3)) == 3 and sum(three) <= room:
                break  # three others fit: their worth is not compared, so this size is left to best fit
            pair = _best_pair(fits, beside, room) if best < room else 0
            if pair <= best:
                chosen = (s, best)
            else:
                third = pair - best
                above = _smallest([k for k in fits if k > third], beside, 2)
                if not beside.get(third, 0) > (third == best) or (len(above) == 2 and sum(above) <= room):
                    break  # some other two are not dominated: left to best fit
                chosen = (s, best, third)
            fix(chosen, min(count[k] // chosen.count(k) for k in chosen))
    return fixed


def _smallest(sizes: list[int], count: dict[int, int], n: int) -> list[int]:
    """The n smallest items of rising sizes, fewer if there are not so many."""
    out: list[int] = []
    for k in sizes:
        out += [k] * min(count[k], n - len(out))
        if len(out) == n:
            break
    return out


def _best_pair(sizes: list[int], count: dict[int, int], room: int) -> int:
    """Largest sum of two of the sizes within room; 0 if no two fit."""
    i, j, best = 0, len(sizes) - 1, 0
    while i <= j:
        total = sizes[i] + sizes[j]
        if total > room or (i == j and count[sizes[i]] < 2):
            j -= 1
        else:
            best = max(best, total)
            i += 1
    return best


def solve(count: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, ...]], int]:
    """Runs (size, first rank, bins, items a bin, first bin, offset) that place every item, and the number of bins."""
    count, runs, rank, bins = dict(count), [], dict.fromkeys(count, 0), 0
    room: dict[int, list[tuple[int, int]]] = {}  # residual capacity: groups (first bin, bins)
    order: list[int] = []  # residuals in use, rising

    def put(left: int, first: int, n: int) -> None:
        if left and n:
            if left not in room:
                bisect.insort(order, left)
            room.setdefault(left, []).append((first, n))

    def place(size: int, first: int, n: int, each: int, offset: int) -> None:
        runs.append((size, rank[size], n, each, first, offset))
        rank[size] += n * each

    for sizes, times in dominated(count, capacity):
        if len(set(sizes)) == 1:
            place(sizes[0], bins, times, len(sizes), 0)
        else:
            for k, s in enumerate(sizes):
                place(s, bins, times, 1, sum(sizes[:k]))
        put(capacity - sum(sizes), bins, times)
        bins += times
    for size in sorted(count, reverse=True):
        left = count[size]
        while left:
            at = bisect.bisect_left(order, size)
            if at < len(order):
                free = order[at]
                first, n = room[free].pop()
                if not room[free]:
                    del room[free], order[at]
            else:
                free, first, n = capacity, bins, -(-left // (capacity // size))
                bins += n
            each = free // size
            full = min(n, left // each)
            if full:
                place(size, first, full, each, capacity - free)
                put(free - each * size, first, full)
                left -= full * each
            if full < n:
                if 0 < left < each:
                    place(size, first + full, 1, left, capacity - free)
                    put(free - left * size, first + full, 1)
                    left, full = 0, full + 1
                put(free, first + full, n - full)
    return runs, bins


def pack(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None, room: int | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of every row of docs."""
    parts = stage(pieces(docs, capacity, vocabulary, room), "pieces")
    count = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    runs, _ = solve(count, capacity)
    table = np.array(sorted(runs), np.int64).reshape(-1, 6)
    salt = 16 + max(count.values(), default=0) // 250_000
    ranked = numbered(parts, ["length"], [F.col("doc_id"), F.col("piece"), F.col("start"), F.col("ids_crc32")], salt, "_rank")
    key = table[:, 0] << 44 | table[:, 1]
    fields = parts.columns

    def run(batches):
        for b in batches:
            size, rank = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "_rank"))
            _, first_rank, _, each, first_bin, offset = table[np.searchsorted(key, size << 44 | rank, side="right") - 1].T
            turn, place = np.divmod(rank - first_rank, each)
            out = [b.column(c) for c in fields] + [pa.array(first_bin + turn), pa.array(offset + place * size)]
            yield pa.RecordBatch.from_arrays(out, [*fields, "sequence_id", "offset"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in parts.schema)
    return ranked.select(*fields, "_rank").mapInArrow(run, f"{kinds}, sequence_id long, offset long")

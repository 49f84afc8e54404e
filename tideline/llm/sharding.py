"""Shards of near equal bytes: a minimax contiguous partition of atomic groups, in DataFrame operations only.

Groups are equal texts, ordered by a 64-bit hash of the text (texts that collide stay together too). A group larger than an even
share of what is left takes a shard of its own, in front; the rest is cut into contiguous shards by searching the smallest capacity
that a greedy pass can keep to. The order is never brought to one place: sizes are summed over hash prefixes (4,096 of them). A
capacity that a greedy pass over whole prefixes keeps to is enough; one that fails even if prefixes of several groups could be cut
anywhere is too small. A capacity between is settled by summing again, with six more bits, only prefixes that its own first cuts may
fall into, one for each shard at most in a round. So the result is the optimum over single groups, a round brings the driver 64 sums for
each shard at most, and it holds 4,096 and some 1,024 for each shard (sums of settled capacities are given up beyond that), whatever
the sizes of the groups.

Law `bytes` holds. Slots are numbered in salted runs inside a shard.

Defined results: a null text counts 0 bytes and is grouped with empty ones; rows with equal or null doc_id are placed each; an empty
table gives an empty result; shards may stay empty if there are fewer groups; columns other than doc_id and text are not read.
"""

from __future__ import annotations

from bisect import bisect_right
from functools import reduce
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import numbered, stage, text_of

SHARDS, OVERHEAD = 40, 16
FIRST_BITS, MORE_BITS = 12, 6


def sized(docs: DataFrame) -> DataFrame:
    text = text_of()
    return docs.select("doc_id", (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("_hash"))


def greedy(starts: list[int], shards: int, capacity: int) -> list[int] | None:
    """Units at which shards begin if each takes as many units as its capacity holds; None if they do not suffice.
    starts: bytes before each unit, and the total."""
    cuts, at, n = [], 0, len(starts) - 1
    for _ in range(shards):
        cuts.append(at)
        at = max(at, bisect_right(starts, starts[at] + capacity) - 1)
        if at >= n:
            return cuts
    return None


def least_capacity(starts: list[int], shards: int, low: int) -> int:
    """Smallest capacity from `low` on that a greedy pass keeps to."""
    high = max(low, starts[-1])
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if greedy(starts, shards, middle) else (middle + 1, high)
    return low


def furthest(starts: list[int], one: list[bool], shards: int, capacity: int) -> list[int] | None:
    """Bytes at which shards begin if units of several groups could be cut anywhere: no cut of single groups gets further.
    None if even so the shards do not suffice."""
    cuts, at, n = [], 0, len(starts) - 1
    for _ in range(shards):
        cuts.append(at)
        reach = at + capacity
        k = bisect_right(starts, reach) - 1
        if k >= n:
            return cuts
        at = max(at, starts[k]) if one[k] else reach
    return None


def proven_least(starts: list[int], one: list[bool], shards: int, low: int, high: int) -> int:
    """Smallest capacity in low to high that `furthest` does not rule out."""
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if furthest(starts, one, shards, middle) is not None else (middle + 1, high)
    return low


def in_question(starts: list[int], one: list[bool], shards: int, capacity: int) -> list[int]:
    """Units of several groups that the first cuts of this capacity may fall into, as many as there are shards at most. Up to
    the first of them cuts are known, so it is one unit."""
    found: list[int] = []
    at, reach, n = 0, 0, len(starts) - 1
    for _ in range(shards):
        at = max(at, bisect_right(starts, starts[at] + capacity) - 1)
        k = bisect_right(starts, reach + capacity) - 1
        reach = starts[n] if k >= n else max(reach, starts[k]) if one[k] else reach + capacity
        for u in range(max(at, found[-1] + 1 if found else 0), min(k, n - 1) + 1):
            if len(found) == shards:
                return found
            if not one[u]:
                found.append(u)
        if at >= n:
            break
    return found


def _sums(groups: DataFrame, spans: list[tuple[int | None, int | None, int]]) -> list[tuple[int, int, bool, int]]:
    """(first hash, bytes, whether it is one group, bits) of each prefix of `bits` bits within spans (from, before, bits), in order."""
    inside = lambda lo, hi: (F.lit(True) if lo is None else F.col("_hash") >= lo) & (F.lit(True) if hi is None else F.col("_hash") < hi)
    bits = reduce(lambda x, s: F.when(inside(*s[:2]), s[2]).otherwise(x), spans, F.lit(None).cast("int"))
    rows = groups.where(reduce(lambda x, y: x | y, [inside(lo, hi) for lo, hi, _ in spans])).withColumn("bits", bits)
    prefix = F.call_function("shiftright", "_hash", 64 - F.col("bits"))
    found = rows.groupBy("bits", prefix.alias("p")).agg(F.sum("size").alias("n"), (F.min("_hash") == F.max("_hash")).alias("one"), F.min("_hash").alias("first"))
    return sorted((r["first"], r["n"], r["one"], r["bits"]) for r in found.collect())


def cut_points(groups: DataFrame, shards: int, largest: int) -> list[int]:
    """First hash of each shard but the first, over groups (_hash, size) ordered by hash."""
    coarse = units = _sums(groups, [(None, None, FIRST_BITS)])
    most = len(coarse) + 16 * shards * 2**MORE_BITS
    low, high, tried, cuts = 0, None, None, []
    while True:
        starts, one = [0, *accumulate(u[1] for u in units)], [u[2] for u in units]
        low = max(low, -(-starts[-1] // shards), largest)
        kept_to = least_capacity(starts, shards, low)
        if high is None or kept_to < high:
            high, cuts = kept_to, [units[k][0] for k in greedy(starts, shards, kept_to)[1:]]
        low = proven_least(starts, one, shards, low, high)
        if low >= high:
            return cuts
        if tried is None or not low <= tried < high:  # the last one is settled
            tried = (low + high) // 2
            if len(units) > most:
                units = coarse
                continue
        spans: list[tuple[int | None, int | None, int]] = []
        again = in_question(starts, one, shards, tried)
        for k in again:
            lo, hi, bits = units[k][0], units[k + 1][0] if k + 1 < len(units) else None, min(64, units[k][3] + MORE_BITS)
            if spans and spans[-1][1:] == (lo, bits):
                lo = spans.pop()[0]
            spans.append((lo, hi, bits))
        finer = _sums(groups, spans)
        gone = set(again)
        units = sorted([u for k, u in enumerate(units) if k not in gone] + finer)


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row of docs."""
    rows = stage(sized(docs), "sized")
    groups = rows.groupBy("_hash").agg(F.sum("size").alias("size"))
    total = rows.agg(F.sum("size")).first()[0] or 0
    top = [(r["_hash"], r["size"]) for r in groups.orderBy(F.desc("size"), "_hash").limit(shards + 1).collect()]
    alone: list[int] = []
    for key, n in top:
        if len(alone) == shards - 1 or n * (shards - len(alone)) <= total:
            break
        alone.append(key)
        total -= n
    largest = max((n for key, n in top if key not in alone), default=0)
    rest = groups.where(~F.col("_hash").isin(alone)) if alone else groups
    cuts = cut_points(rest, shards - len(alone), largest) if largest else []
    place = reduce(lambda x, key: x + (F.col("_hash") >= key).cast("int"), cuts, F.lit(len(alone)))
    for i, key in enumerate(alone):
        place = F.when(F.col("_hash") == key, i).otherwise(place)
    placed = rows.withColumn("shard", place.cast("int"))
    runs = 16 + rows.count() // (shards * 250_000)
    out = numbered(placed, ["shard"], [F.col("doc_id"), F.col("_hash")], runs, "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))

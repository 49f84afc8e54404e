"""SimHash near-duplicates through a hierarchical index in Gray order.

Fingerprints are sorted by Gray rank, so neighbours in the order share most of their leading bits. The sorted run is cut into
blocks, blocks into nodes and nodes into leaves; each keeps the bits that all its members share (`mask`) and their values
(`pattern`). Two groups whose shared bits differ in more than `radius` places hold no linked pair, and since a child shares at
least its parent's bits, the differences accumulate on the way down: blocks are paired by an equi-join on their leading bits
with up to `radius` of them flipped, then nodes, then leaves, then single fingerprints inside a task.

Nothing grows with the square of a group: equal fingerprints are one entry, block pairs move packed fingerprints, and a task
returns a spanning forest of the links it found. No state is collected or broadcast.

Defined results: a null or empty text has fingerprint 0 and links like any other; rows with equal or null doc_id are all kept
and each gets the component of its fingerprint; component_id is the smallest non-null doc_id of the component (null if it has
none); an empty table gives an empty result; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import LOWER, blob, components, forest, slices, stage, texts, width

BLOCK, NODE, LEAF = 16_384, 512, 16
SEED = 42
CHUNK = 1 << 16


def shingle_hashes(text: str, k: int) -> np.ndarray:
    """XXH64 of each run of k words (split at ASCII white space, A-Z lowered); one run if there are fewer words."""
    words = text.encode().translate(LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    runs = map(b" ".join, zip(*(words[i:] for i in range(k)), strict=False)) if len(words) >= k else [b" ".join(words)]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(r, SEED) for r in runs), np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """Bit i is set if over half of the hashes set it; as a signed 64-bit number."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), CHUNK):
        part = hashes[at : at + CHUNK].astype("<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * counts > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, k: int = 3) -> DataFrame:
    """(doc_id, text_hash, fp) of every row."""

    def run(batches):
        for b in slices(batches):
            fps = np.fromiter((fingerprint(shingle_hashes(t, k)) for t in texts(b)), np.int64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_hash"), pa.array(fps)], ["doc_id", "text_hash", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, f"doc_id {kind}, text_hash long, fp long")


def gray_rank(fp: Column) -> Column:
    """Place of a fingerprint in Gray order, with the sign bit turned so that signed comparison orders it."""
    for n in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, n))
    return fp.bitwiseXOR(F.lit(-(1 << 63)))


def blocks(fps: DataFrame, bits: int, size: int = BLOCK) -> DataFrame:
    """(block, prefix, mask, pattern, packed): runs of at most `size` distinct fingerprints with equal leading `bits`."""
    parts = width(fps.sparkSession)
    ordered = fps.select("fp", gray_rank(F.col("fp")).alias("rank")).repartitionByRange(parts, "rank").sortWithinPartitions("rank")

    def run(batches):
        held: list[np.ndarray] = []

        def cut(last: bool):
            nonlocal held
            fp = np.concatenate(held) if held else np.empty(0, np.uint64)
            lead = fp >> np.uint64(64 - bits) if bits else np.zeros(len(fp), np.uint64)
            edges = [0, *(np.nonzero(lead[1:] != lead[:-1])[0] + 1).tolist(), len(fp)]
            out, keep = [], 0
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                end = hi if last or hi < len(fp) else lo + (hi - lo) // size * size
                out += [(int(lead[at]), fp[at : min(at + size, end)]) for at in range(lo, end, size)]
                keep = end
            held = [fp[keep:]]
            if out:
                both = [(np.bitwise_and.reduce(m), np.bitwise_or.reduce(m)) for _, m in out]
                yield pa.RecordBatch.from_arrays([
                    pa.array([int(m[0].astype(np.int64)) for _, m in out], pa.int64()), pa.array([p for p, _ in out], pa.int64()),
                    pa.array(np.array([~(a ^ o) for a, o in both], np.uint64).view(np.int64)), pa.array(np.array([a for a, _ in both], np.uint64).view(np.int64)),
                    pa.array([blob(m) for _, m in out], pa.binary())], ["block", "prefix", "mask", "pattern", "packed"])

        for b in batches:
            held.append(b.column("fp").to_numpy(zero_copy_only=False).view(np.uint64))
            if sum(map(len, held)) >= 4 * size:
                yield from cut(False)
        yield from cut(True)

    return ordered.select("fp").mapInArrow(run, "block long, prefix long, mask long, pattern long, packed binary")


def flips(bits: int, radius: int) -> list[int]:
    """All numbers of `bits` bits with at most `radius` set."""
    return [sum(1 << i for i in c) for n in range(min(bits, radius) + 1) for c in combinations(range(bits), n)]


def lead_bits(entries: int, radius: int) -> int:
    """Leading bits that blocks are paired by: about one block for each value, and no more than 4,096 flips of it. Fewer bits
    pair more blocks for the masks to prune; the links found are the same."""
    bits = max(4, math.ceil(math.log2(max(2, entries / BLOCK))))
    while bits > 4 and sum(math.comb(bits, n) for n in range(min(bits, radius) + 1)) > 4096:
        bits -= 1
    return bits


def _tree(fp: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Mask and pattern of each run of `size` fingerprints; fp is padded to a multiple of it."""
    m = fp.reshape(-1, size)
    low, high = np.bitwise_and.reduce(m, axis=1), np.bitwise_or.reduce(m, axis=1)
    return ~(low ^ high), low


def _near(xs: tuple, ys: tuple, i: np.ndarray, j: np.ndarray, radius: int) -> np.ndarray:
    return np.bitwise_count((xs[1][i] ^ ys[1][j]) & xs[0][i] & ys[0][j]) <= radius


def linked(x: np.ndarray, y: np.ndarray, radius: int, same: bool = False):
    """Batches (i, j) of places with x[i] and y[j] at most `radius` bits apart, found by descent; `same`: only i < j."""
    pad = lambda v: np.concatenate([v, np.repeat(v[-1:], -len(v) % NODE)])
    px, py = pad(x), pad(y)
    (nx, ny), (lx, ly) = ((_tree(px, n), _tree(py, n)) for n in (NODE, LEAF))
    fan, side = NODE // LEAF, np.arange(LEAF)
    for ni in range(len(nx[0])):
        nj = np.arange(ni if same else 0, len(ny[0]))
        nj = nj[_near(nx, ny, np.full(len(nj), ni), nj, radius)]
        if not len(nj):
            continue
        li, lj = (a.ravel() for a in np.meshgrid(np.arange(ni * fan, (ni + 1) * fan), (nj[:, None] * fan + np.arange(fan)).ravel(), indexing="ij"))
        if same:
            li, lj = li[li <= lj], lj[li <= lj]
        ok = _near(lx, ly, li, lj, radius)
        li, lj = li[ok], lj[ok]
        for at in range(0, len(li), 4096):
            i, j = (li[at : at + 4096, None] * LEAF + side)[:, :, None], (lj[at : at + 4096, None] * LEAF + side)[:, None, :]
            hit = np.bitwise_count(px[i] ^ py[j]) <= radius
            g, a, b = np.nonzero(hit)
            a, b = li[at + g] * LEAF + a, lj[at + g] * LEAF + b
            real = (a < len(x)) & (b < len(y)) & ((a < b) if same else True)
            if real.any():
                yield a[real], b[real]


def links(fps: DataFrame, radius: int) -> DataFrame:
    """(a, b): links that span the components of all distinct fingerprints (column fp) at most `radius` bits apart."""
    spark, parts = fps.sparkSession, width(fps.sparkSession)
    bits = lead_bits(fps.count(), radius)
    tree = stage(blocks(fps, bits), "gray")
    flip = F.explode(F.array([F.lit(x).cast("long") for x in flips(bits, radius)]))
    probe = tree.select(F.col("block").alias("a"), F.col("mask").alias("ma"), F.col("pattern").alias("pa"), "prefix", flip.alias("flip"))
    probe = probe.select("a", "ma", "pa", F.col("prefix").bitwiseXOR(F.col("flip")).alias("key"))
    shared = F.col("pa").bitwiseXOR(F.col("pattern")).bitwiseAND(F.col("ma")).bitwiseAND(F.col("mask"))
    pairs = probe.join(tree, F.col("key") == F.col("prefix")).where((F.col("a") <= F.col("block")) & (F.bit_count(shared) <= radius))
    pairs = stage(pairs.select("a", F.col("block").alias("b")), "pairs")
    load = lambda c: tree.select(F.col("block").alias(c), F.col("packed").alias(f"p{c}"))
    loaded = pairs.join(load("a"), "a").join(load("b"), "b").repartition(parts, "a", "b")

    def run(batches):
        for batch in slices(batches, 16):
            for a, b, pa_, pb in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "pa", "pb")), strict=True):
                x, y = np.frombuffer(pa_, np.uint64), np.frombuffer(pb, np.uint64)
                n, shift = len(x), 0 if a == b else len(x)
                size = n if a == b else n + len(y)
                i, j = np.empty(0, np.int64), np.empty(0, np.int64)
                for more_i, more_j in linked(x, y, radius, a == b):
                    i, j = forest(size, np.concatenate([i, more_i]), np.concatenate([j, more_j + shift]))
                both = (x if a == b else np.concatenate([x, y])).view(np.int64)
                if len(i):
                    yield pa.RecordBatch.from_arrays([pa.array(both[i]), pa.array(both[j])], ["a", "b"])

    return loaded.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, k: int = 3, radius: int = 3) -> DataFrame:
    """(doc_id, text_hash, fp, component_id) of every row of docs (doc_id, text)."""
    marks = stage(fingerprints(docs, k), "marks")
    fps = stage(marks.groupBy("fp").agg(F.min("doc_id").alias("first")), "fps")
    label = components(links(fps, radius)).withColumnRenamed("node", "fp")
    grouped = fps.join(label, "fp", "left").select("fp", "first", F.coalesce("label", "fp").alias("label"))
    least = stage(grouped.groupBy("label").agg(F.min("first").alias("component_id")), "least")  # a plain side, so a hot label can be split
    named = grouped.join(least, "label").select("fp", "label", "component_id")
    return marks.join(named, "fp").select("doc_id", "text_hash", "fp", "component_id", "label")


def keep_one(docs: DataFrame, k: int = 3, radius: int = 3) -> DataFrame:
    """docs with one row of each component: that of the smallest doc_id (null last), the least text hash among equal ones."""
    found = near_duplicates(docs, k, radius)
    rank = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash")
    kept = found.groupBy("label").agg(F.min(rank).alias("kept"))
    key = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    kept = kept.select(key("kept.doc_id").alias("_gray_key"), F.col("kept.text_hash").alias("_gray_text"))
    rows = docs.withColumns({"_gray_key": key("doc_id"), "_gray_text": F.xxhash64("text")})
    one = rows.join(kept, ["_gray_key", "_gray_text"], "left_semi").dropDuplicates(["_gray_key", "_gray_text"])
    return one.select(*docs.columns)

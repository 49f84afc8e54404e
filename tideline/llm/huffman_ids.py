"""Token ids in files of canonical, length-limited Huffman code, in independent blocks with bit-offset checkpoints.

Files are a folder of three Parquet tables, so any store that Spark writes to will do:
  code/    id, bits: code length of every id that occurs (canonical, so lengths say all)
  blocks/  part, block, first (ids of the part before it), n, docs (what it holds of which document), checkpoints (bit offset of
           every `STRIDE`-th id, little-endian unsigned 32 bits), payload (bits, most significant first)
Parts are ranges of doc_id in order, blocks count up in a part, documents follow in ascending doc_id and may cross blocks.

Writing: documents are dealt once into ranges of doc_id at sampled quantiles and sorted inside, encoded, and staged as raw blocks;
global counts (one row an id) give the code by package-merge; each block is then coded by itself. Reading decodes a block from all its
checkpoints at once, a table look-up for each id, and checksums of documents that cross blocks are combined. Everything after the one
shuffle of texts works on a block at a time, so memory is a block and a lost task costs a few blocks.

Defined results: a null or empty text is the end id alone; null doc_id comes last, rows with equal doc_id are ordered by text hash and
each is a document; an empty table gives an empty folder of tables; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm.common import by_ranges, slices, stage, texts, width
from tideline.llm.tokens import END_ID, encoder

BLOCK_IDS, STRIDE = 65_536, 256
LIMIT = 16
DOCS = "docs array<struct<doc_id: {}, place: int, before: long, n: int>>"


def raw_blocks(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(part, block, first, n, docs, ids, tally): ids and end id of all documents in order, as blocks of little-endian unsigned 32 bits; and
    from each task a row of part -1 whose tally holds (id, count) pairs of little-endian unsigned 64 bits."""
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    ordered = by_ranges(docs, 3 * width(spark)).repartition(width(spark), "range")
    ordered = ordered.sortWithinPartitions("range", F.col("doc_id").asc_nulls_last(), "text_hash").select("range", "doc_id", "text")

    def run(batches):
        coder, end = encoder(vocabulary), np.array([END_ID], "<u4").tobytes()
        part, block, first, place, held, parts = None, 0, 0, 0, bytearray(), []
        rows: list[tuple] = []
        total = np.zeros(coder.ids, np.int64)

        def close():
            nonlocal block, first, held, parts, total
            n = min(len(held) // 4, BLOCK_IDS)
            inside, left, taken = [], [], 0
            for doc_id, at, before, size in parts:
                here = min(size, n - taken)
                if here:
                    inside.append({"doc_id": doc_id, "place": at, "before": before, "n": here})
                    taken += here
                if here < size:
                    left.append((doc_id, at, before + here, size - here))
            ids = bytes(held[: 4 * n])
            total += np.bincount(np.frombuffer(ids, "<u4"), minlength=len(total))
            rows.append((part, block, first, n, inside, ids, None))
            held, parts, block, first = held[4 * n :], left, block + 1, first + n

        def flush(kind_of_id):
            doc = pa.list_(pa.struct([("doc_id", kind_of_id), ("place", pa.int32()), ("before", pa.int64()), ("n", pa.int32())]))
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), doc, pa.binary(), pa.binary()]
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["part", "block", "first", "n", "docs", "ids", "tally"])
            rows.clear()
            return out

        id_type = None
        for b in slices(batches):
            id_type = b.schema.field("doc_id").type
            for at, doc_id, ids in zip(b.column("range").to_pylist(), b.column("doc_id").to_pylist(), coder.encode(texts(b)), strict=True):
                if at != part:
                    while held:
                        close()
                    part, block, first, place = at, 0, 0, 0
                parts.append((doc_id, place, 0, len(ids) // 4 + 1))
                held += ids + end
                place += 1
                while len(held) >= 4 * BLOCK_IDS:
                    close()
            if rows:
                yield flush(id_type)
        while held:
            close()
        used = np.nonzero(total)[0]
        if len(used):
            rows.append((-1, 0, 0, 0, [], b"", np.stack([used, total[used]], axis=1).astype("<u8").tobytes()))
            yield flush(id_type)

    return ordered.mapInArrow(run, f"part int, block int, first long, n int, {DOCS.format(kind)}, ids binary, tally binary")


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most `limit` bits by package-merge; counts are positive."""
    n = len(counts)
    if n < 3:
        return np.ones(n, np.int64)
    limit = max(limit, int(n - 1).bit_length())
    order = np.argsort(counts, kind="stable")
    weight = counts[order].astype(np.float64)
    level, is_leaf = weight, [np.ones(n, bool)]
    for _ in range(limit - 1):
        pairs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([weight, pairs])
        turn = np.argsort(both, kind="stable")
        level = both[turn]
        is_leaf.append(turn < n)
    lengths, take = np.zeros(n, np.int64), 2 * n - 2
    for leaf in reversed(is_leaf):  # of the cheapest `take` items, leaves lengthen a code, packages open into two items below
        leaves = int(leaf[:take].sum())
        lengths[:leaves] += 1
        take = 2 * (take - leaves)
    out = np.empty(n, np.int64)
    out[order] = lengths
    return out


class Code:
    """Canonical code of ids with given lengths."""

    def __init__(self, ids: np.ndarray, bits: np.ndarray):
        order = np.lexsort((ids, bits))
        self.ids, self.bits = ids[order].astype(np.int64), bits[order].astype(np.int64)
        self.longest = int(self.bits[-1]) if len(ids) else 1
        span = 1 << (self.longest - self.bits)
        start = np.cumsum(span) - span
        self.code = np.zeros(int(self.ids.max(initial=0)) + 1, np.uint64)
        self.length = np.zeros(len(self.code), np.int64)
        self.code[self.ids], self.length[self.ids] = (start >> (self.longest - self.bits)).astype(np.uint64), self.bits
        full = 1 << self.longest
        self.symbol_at, self.bits_at = np.zeros(full, np.uint32), np.ones(full, np.int64)
        used = int(span.sum())
        self.symbol_at[:used], self.bits_at[:used] = np.repeat(self.ids, span), np.repeat(self.bits, span)

    def pack(self, ids: np.ndarray) -> tuple[bytes, bytes]:
        """(payload, checkpoints) of a block."""
        bits = self.length[ids]
        ends = np.cumsum(bits)
        starts = ends - bits
        words = np.zeros(int(ends[-1] + 63) // 64 + 1, np.uint64)
        word, over = starts >> 6, (starts & 63) + bits - 64
        code = self.code[ids]
        high = np.where(over > 0, code >> np.maximum(over, 0).astype(np.uint64), code << np.maximum(-over, 0).astype(np.uint64))
        first = np.nonzero(np.concatenate([[True], word[1:] != word[:-1]]))[0]
        words[word[first]] = np.bitwise_or.reduceat(high, first)
        cross = np.nonzero(over > 0)[0]
        words[word[cross] + 1] |= code[cross] << (64 - over[cross]).astype(np.uint64)
        return words.astype(">u8").tobytes()[: int(ends[-1] + 7) // 8], starts[::STRIDE].astype("<u4").tobytes()

    def unpack(self, blocks: list[tuple[bytes, bytes, int]]) -> list[np.ndarray]:
        """Ids of blocks (payload, checkpoints, n): every checkpoint of every block is a lane, and lanes step together."""
        base, lanes, data = 0, [], []
        for payload, checkpoints, _ in blocks:
            lanes.append(np.frombuffer(checkpoints, "<u4").astype(np.int64) + 8 * base)
            data.append(payload)
            base += len(payload)
        raw = np.frombuffer(b"".join(data) + bytes(STRIDE * 4 + 8), np.uint8)
        window = np.ndarray((len(raw) - 7,), ">u8", raw, strides=(1,))
        at = np.concatenate(lanes)
        out = np.empty((STRIDE, len(at)), np.uint32)
        mask, shift, last = np.uint64((1 << self.longest) - 1), 64 - self.longest, 8 * (len(window) - 1)
        for k in range(STRIDE):
            seen = (window[at >> 3].astype(np.uint64) >> (shift - (at & 7)).astype(np.uint64)) & mask
            seen = seen.astype(np.int64)
            out[k] = self.symbol_at[seen]
            at = np.minimum(at + self.bits_at[seen], last)
        ids, result, lane = out.T.reshape(-1), [], 0
        for k, (_, _, n) in enumerate(blocks):
            result.append(ids[lane * STRIDE : lane * STRIDE + n])
            lane += len(lanes[k])
        return result


def write(docs: DataFrame, path: str, vocabulary: str | None = None) -> None:
    spark = docs.sparkSession
    raw = stage(raw_blocks(docs, vocabulary), "raw-ids", compression="zstd")

    def tally(batches):
        for b in slices(batches, 64):
            for pairs in b.column("tally").to_pylist():
                found = np.frombuffer(pairs, "<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(found[:, k])) for k in (0, 1)], ["id", "n"])

    counts = raw.where("part = -1").select("tally").mapInArrow(tally, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()  # a row for each id of the vocabulary
    raw = raw.where("part >= 0").drop("tally")
    ids = counts["id"].to_numpy(np.int64)
    code = Code(ids, code_lengths(counts["n"].to_numpy(np.int64)))
    table = pd.DataFrame({"id": code.ids, "bits": code.bits.astype(np.int32)})
    spark.createDataFrame(table, "id long, bits int").coalesce(1).write.parquet(f"{path}/code")
    head = ["part", "block", "first", "n", "docs"]

    def pack(batches):
        for b in slices(batches, 64):
            done = [code.pack(np.frombuffer(i, "<u4").astype(np.int64)) for i in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in head), *(pa.array(c, pa.binary()) for c in (zip(*done, strict=True) if done else ([], [])))], [*head, "payload", "checkpoints"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in raw.schema if f.name in head)
    raw.mapInArrow(pack, f"{fields}, payload binary, checkpoints binary").write.parquet(f"{path}/blocks")


POLYNOMIAL = 0xEDB88320


def _times(a: int, b: int) -> int:
    """Product of two polynomials modulo the CRC polynomial, bits reflected."""
    out, bit = 0, 1 << 31
    while bit:
        if a & bit:
            out ^= b
        bit >>= 1
        b = b >> 1 ^ POLYNOMIAL if b & 1 else b >> 1
    return out


def joined_crc(parts: list[tuple[int, int]]) -> int:
    """CRC-32 of the concatenation of pieces (crc, bytes)."""
    total = 0
    for crc, n in parts:
        shift, power, left = 1 << 31, 1 << 23, n  # x to the 0, x to the 8
        while left:
            if left & 1:
                shift = _times(shift, power)
            power, left = _times(power, power), left >> 1
        total = _times(shift, total) ^ crc
    return total


def _combined(pieces: pd.Series) -> pd.Series:
    return pd.Series([joined_crc([(p["crc"], 4 * p["n"]) for p in sorted(each, key=lambda p: p["before"])]) for each in pieces], dtype="int64")


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files alone."""
    table = spark.read.parquet(f"{path}/code").toPandas()
    code = Code(table["id"].to_numpy(np.int64), table["bits"].to_numpy(np.int64))
    blocks = spark.read.parquet(f"{path}/blocks")
    kind = blocks.schema["docs"].dataType.elementType["doc_id"].dataType.simpleString()
    names = ["part", "place", "doc_id", "before", "at", "n", "crc"]

    def run(batches):
        for b in slices(batches, 32):
            part, first, n, docs, payload, checkpoints = (b.column(c).to_pylist() for c in ("part", "first", "n", "docs", "payload", "checkpoints"))
            rows = []
            for p, f, inside, ids in zip(part, first, docs, code.unpack(list(zip(payload, checkpoints, n, strict=True))), strict=True):
                raw, at = memoryview(ids.astype("<u4").tobytes()), 0
                for d in inside:
                    rows.append((p, d["place"], d["doc_id"], d["before"], f + at, d["n"], zlib.crc32(raw[4 * at : 4 * (at + d["n"])])))
                    at += d["n"]
            kinds = [pa.int32(), pa.int32(), b.schema.field("docs").type.value_type.field("doc_id").type, pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    pieces = blocks.select("part", "first", "n", "docs", "payload", "checkpoints").mapInArrow(run, f"part int, place int, doc_id {kind}, before long, at long, n int, crc long")
    ends = blocks.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect()  # a row for each part
    sizes = np.array([r["n"] for r in ends], np.int64)
    base = spark.createDataFrame([(r["part"], int(at)) for r, at in zip(ends, np.cumsum(sizes) - sizes, strict=True)], "part int, base long")
    whole = pieces.groupBy("part", "place").agg(
        F.first("doc_id").alias("doc_id"), F.min("at").alias("at"), F.sum("n").alias("n_tokens"), F.collect_list(F.struct("before", "n", "crc")).alias("pieces"))
    one = F.size("pieces") == 1
    combine = F.pandas_udf(_combined, "long")
    crc = F.when(one, F.col("pieces")[0]["crc"]).otherwise(combine(F.when(one, F.slice("pieces", 1, 0)).otherwise(F.col("pieces"))))
    return whole.join(F.broadcast(base), "part").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", crc.alias("ids_crc32"))

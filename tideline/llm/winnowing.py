"""Document fingerprints by winnowing, and how they change when a text is edited.

Every run of k code points is hashed (polynomial, by doubling), the smallest hash of each window of `window` consecutive runs is
chosen, the rightmost of equal ones, and kept with its position. So any passage of k + window - 1 code points or more that two
texts share leaves a common hash in both, wherever it stands.

A text's successor (next lower doc_id) is needed beside it. Documents are cut into ranges of doc_id at sampled quantiles; each
range also gets the first document of the range after it (one row a range), so one shuffle of the texts and a sort inside the
ranges put every document next to its successor, and a task streams through its rows with one document held.

Defined results: a null or empty text has the empty fingerprint; a text shorter than k has the hash of the whole text; two empty
fingerprints are alike (1), an empty and another are not (0); null doc_id comes last, rows with equal doc_id are ordered by text
hash, and each is a document; a lone document is its own successor; an empty table gives an empty result; columns other than
doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import by_ranges, slices, width

K, WINDOW = 16, 48
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def run_hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """Mixed polynomial hash of each run of k codes; of the whole if there are fewer."""
    k = min(k, len(codes))
    if not k:
        return np.empty(0, np.uint64)
    power, h, n, out, done = _BASE, codes.astype(np.uint64) + np.uint64(1), 1, None, 0
    while True:
        if k & n:  # append this block of n codes to what stands before it
            part = h[done:]
            out = part if out is None else out[: len(part)] * np.uint64(power) + part[: len(out)]
            done += n
        if 2 * n > k:
            break
        h = h[:-n] * np.uint64(power) + h[n:]
        power, n = power * power & _MASK, 2 * n
    out = out[: len(codes) - k + 1].copy()
    out ^= out >> np.uint64(31)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(29)
    return out


def winnow(codes: np.ndarray, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, positions) chosen from a text."""
    h = run_hashes(codes, k)
    window = min(window, len(h))
    if not window:
        return h, np.empty(0, np.int64)

    def right_least(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.where(h[b] <= h[a], b, a)  # b lies to the right of a

    best, n = np.arange(len(h)), 1
    while 2 * n <= window:
        best, n = right_least(best[:-n], best[n:]), 2 * n
    if n < window:
        best = right_least(best[: len(h) - window + 1], best[window - n :])
    chosen = best[np.concatenate([[True], best[1:] != best[:-1]])]
    return h[chosen], chosen


def packed(chosen: tuple[np.ndarray, np.ndarray]) -> str:
    """Leading half of each hash and its position, 8 hexadecimal digits each, in text order."""
    hashes, places = chosen
    return ((hashes & np.uint64(0xFFFFFFFF00000000)) | places.astype(np.uint64)).astype(">u8").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets of hashes."""
    x, y = np.unique(a), np.unique(b)
    if not len(x) or not len(y):
        return float(len(x) == len(y))
    common = len(np.intersect1d(x, y, assume_unique=True))
    return common / (len(x) + len(y) - common)


def in_order(docs: DataFrame, ranges: int) -> DataFrame:
    """(range, halo, doc_id, text_hash, text) by range, each in falling doc_id and followed by the first row of the next range."""
    spark = docs.sparkSession
    ranged = by_ranges(docs, ranges).withColumn("range", -F.col("range"))
    heads = ranged.groupBy("range").agg(F.max(F.struct("doc_id", "text_hash")).alias("head")).orderBy("range").collect()  # one row a range
    pairs = list(pairwise([*heads, *heads[:1]]))
    schema = f"to int, head_id {docs.schema['doc_id'].dataType.simpleString()}, head_hash long"
    after = spark.createDataFrame([(a["range"], b["head"]["doc_id"], b["head"]["text_hash"]) for a, b in pairs], schema)
    is_head = ranged["doc_id"].eqNullSafe(after["head_id"]) & (ranged["text_hash"] == after["head_hash"])
    both = ranged.join(F.broadcast(after), is_head, "left")
    own, halo = F.struct(F.col("range"), F.lit(0).alias("halo")), F.struct(F.col("to").alias("range"), F.lit(1).alias("halo"))
    copies = both.withColumn("_to", F.explode(F.when(F.col("to").isNull(), F.array(own)).otherwise(F.array(own, halo))))
    dealt = copies.select("_to.range", "_to.halo", "doc_id", "text_hash", "text").repartition(width(spark), "range")
    return dealt.sortWithinPartitions("range", "halo", F.col("doc_id").desc_nulls_last(), F.col("text_hash").desc())


def edited_fingerprints(docs: DataFrame, k: int = K, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next): each text against itself with its
    second half overwritten by the start of its successor, and against the successor."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    fields = [("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]

    def run(batches):
        held = None
        for b in slices(batches, 200):
            ids, done = [], []
            for where, halo, doc_id, text in zip(*(b.column(c).to_pylist() for c in ("range", "halo")), b.column("doc_id"), b.column("text").to_pylist(), strict=True):
                if held and held[0] != where:
                    held = None  # a further halo row of the range before
                if halo and held is None:
                    continue
                codes = codes_of(text)
                chosen = winnow(codes, k, window)
                if held:
                    _, own_id, own_text, own_codes, own = held
                    n, half = len(own_text), len(own_text) // 2
                    other = winnow(np.concatenate([own_codes[: n - half], codes[:half]]), k, window)
                    edited = own_text[: n - half] + text[:half]
                    ids.append(own_id)
                    done.append((n, hashlib.sha256(edited.encode()).hexdigest(), packed(own), packed(other), likeness(own[0], other[0]), likeness(own[0], chosen[0])))
                held = None if halo else (where, doc_id, text, codes, chosen)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(ids, b.schema.field("doc_id").type), *(pa.array(c, f[1]) for c, f in zip(zip(*done, strict=True), fields, strict=True))], ["doc_id", *(f[0] for f in fields)])

    ordered = in_order(docs, 3 * width(docs.sparkSession)).select("range", "halo", "doc_id", "text")
    return ordered.mapInArrow(run, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")

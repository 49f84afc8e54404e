"""Near-duplicate embeddings through spherical-cap filters of a random product code.

The coordinates are dealt into three blocks with a small random code each; a filter is one code word from every block, so a few dozen
words span thousands of directions; four such codes are independent. A vector's filters are all directions it exceeds a threshold against; they are list-decoded block
by block, dropping every prefix that even the best rest cannot lift over the threshold. Vectors that are close exceed the same
directions, so only vectors of one (label, filter) are compared, and every pair that is compared is verified by its cosine in double
precision. A pair that shares several filters counts at the smallest of them.

Equal vectors are one entry with a count. A (label, filter) with more than `CELL` entries is cut into chunks that meet pairwise in
cells, so a task holds two chunks however hot the label. A cell returns a count for each entry and a spanning forest of its links,
never the pairs.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and vectors without label, link with nothing;
vectors of different lengths are not compared; every row is returned, rows with equal or null vec_id as vectors of their own;
component_id is the smallest non-null vec_id of the component; kept tells whether it is the row's own; an empty table gives an empty
result; columns other than vec_id, embedding and label are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import components, forest, slices, stage, width

COSINE = 0.93
CODES, BLOCKS, WORDS, THRESHOLD, FEWEST, SEED = 4, 3, 12, 2.7, 8, 11
CELL = 2048


def codes_for(dims: int) -> list[list[tuple[np.ndarray, np.ndarray]]]:
    """Independent product codes; of each, the coordinates and the code words (rows of length 1 / sqrt(blocks)) of every block."""
    rng, out = np.random.default_rng([SEED, dims]), []
    for _ in range(CODES):
        blocks = []
        for part in np.array_split(rng.permutation(dims), min(BLOCKS, dims)):
            words = rng.standard_normal((WORDS, len(part)))
            blocks.append((part, words / (np.linalg.norm(words, axis=1, keepdims=True) * np.sqrt(min(BLOCKS, dims)))))
        out.append(blocks)
    return out


def exceeded(unit: np.ndarray, codes: list, threshold: float = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """(row, filter), by row, of every direction that a row's unit vector exceeds `threshold` standard deviations of."""
    least = threshold / np.sqrt(unit.shape[1])
    rows, numbers = [], []
    for c, blocks in enumerate(codes):
        scores = [unit[:, part] @ words.T for part, words in blocks]
        best_rest = np.cumsum([s.max(axis=1) for s in scores[::-1]], axis=0)[::-1]
        row, number, total = np.arange(len(unit)), np.full(len(unit), c), np.zeros(len(unit))
        for k, s in enumerate(scores):
            total = total[:, None] + s[row]
            rest = best_rest[k + 1][row][:, None] if k + 1 < len(scores) else 0.0
            i, j = np.nonzero(total + rest >= least)
            row, number, total = row[i], number[i] * WORDS + j, total[i, j]
        rows.append(row)
        numbers.append(number)
    row, number = np.concatenate(rows), np.concatenate(numbers)
    order = np.argsort(row, kind="stable")
    return row[order], number[order]


def entries(vectors: DataFrame) -> DataFrame:
    """Rows with `node`, the hash of label and vector; null where the row links with nothing."""
    v = F.col("embedding")
    finite = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf"))) & F.exists(v, lambda x: x != 0)
    fit = F.coalesce(v.isNotNull() & F.col("label").isNotNull() & finite, F.lit(False))
    return vectors.select("vec_id", "label", "embedding", F.when(fit, F.xxhash64("label", "embedding")).alias("node"))


def caps_of(unit: np.ndarray, codes: list) -> tuple[np.ndarray, np.ndarray]:
    """(row, filter), by row: what exceeds `THRESHOLD`; a row with fewer than `FEWEST` goes on with a lower one, so that vectors
    that lie between the directions meet as well."""
    rows, numbers, left, threshold = [], [], np.arange(len(unit)), THRESHOLD
    while len(left):
        row, number = exceeded(unit[left], codes, threshold)
        enough = np.bincount(row, minlength=len(left)) >= (FEWEST if threshold > 0 else 0)
        rows.append(left[row[enough[row]]])
        numbers.append(number[enough[row]])
        left, threshold = left[~enough], threshold - 0.25
    row, number = np.concatenate([*rows, np.empty(0, np.int64)]), np.concatenate([*numbers, np.empty(0, np.int64)])
    order = np.argsort(row, kind="stable")
    return row[order], number[order]


def component_type(vectors: DataFrame) -> str:
    return "<f4" if vectors.schema["embedding"].dataType.elementType.simpleString() == "float" else "<f8"


def filtered(distinct: DataFrame) -> DataFrame:
    """(label, dims, filter, node, times, vector, filters) for each direction that a vector exceeds."""
    kind, kept = distinct.schema["label"].dataType.simpleString(), component_type(distinct)

    def run(batches):
        codes: dict[int, list] = {}
        for b in slices(batches, 2000):
            lists = b.column("embedding")
            lengths = np.diff(lists.offsets.to_numpy())
            flat = np.asarray(lists.flatten().to_numpy(zero_copy_only=False), np.float64)
            starts = np.concatenate([[0], np.cumsum(lengths)])
            for dims in np.unique(lengths).tolist():
                codes[dims] = codes.get(dims) or codes_for(dims)
                rows = np.nonzero(lengths == dims)[0]
                given = flat[starts[rows][:, None] + np.arange(dims)]
                unit = given / np.abs(given).max(axis=1, keepdims=True)
                unit /= np.linalg.norm(unit, axis=1, keepdims=True)
                row, number = caps_of(unit, codes[dims])
                cut = np.searchsorted(row, np.arange(len(rows) + 1))
                packed = [number[cut[i] : cut[i + 1]].astype(np.int32).tobytes() for i in range(len(rows))]
                take = pa.array(rows[row])
                yield pa.RecordBatch.from_arrays(
                    [b.column("label").take(take), pa.array(np.full(len(row), dims, np.int32)), pa.array(number.astype(np.int32)), b.column("node").take(take), b.column("times").take(take),
                     pa.array([u.tobytes() for u in given.astype(kept)], pa.binary()).take(pa.array(row)), pa.array(packed, pa.binary()).take(pa.array(row))],
                    ["label", "dims", "filter", "node", "times", "vector", "filters"])

    return distinct.select("label", "node", "times", "embedding").mapInArrow(
        run, f"label {kind}, dims int, filter int, node long, times long, vector binary, filters binary")


def compare(own: int, chunk: np.ndarray, a: int, b: int, times: np.ndarray, vector: np.ndarray, filters: list[np.ndarray], least: float):
    """(linked vectors for each entry, forest) of the pairs of a cell whose smallest common filter is `own`."""
    n = len(times)
    vector = vector.astype(np.float64)
    vector /= np.abs(vector).max(axis=1, keepdims=True)
    vector /= np.linalg.norm(vector, axis=1, keepdims=True)
    hit = vector @ vector.T >= least
    hit &= (chunk[:, None] != chunk[None, :]) if a != b else True
    np.fill_diagonal(hit, False)
    if hit.any():
        smaller = [f[f < own] for f in filters]
        names, at = np.unique(np.concatenate(smaller), return_inverse=True) if any(map(len, smaller)) else (np.empty(0), np.empty(0, int))
        member = np.zeros((n, len(names)), np.float32)
        member[np.repeat(np.arange(n), [len(f) for f in smaller]), at] = 1
        hit &= member @ member.T == 0
    i, j = np.nonzero(np.triu(hit))
    return hit @ times, forest(n, i, j)


def near_vectors(vectors: DataFrame, least: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of vectors (vec_id, embedding, label)."""
    spark = vectors.sparkSession
    parts, kept = width(spark), component_type(vectors)
    rows = entries(vectors)
    named = stage(rows.select("vec_id", "node"), "vectors")
    distinct = rows.where("node is not null").groupBy("label", "embedding", "node").agg(F.count(F.lit(1)).alias("times"))
    caps = stage(filtered(distinct), "caps")
    sizes = caps.groupBy("label", "dims", "filter").agg(F.count(F.lit(1)).alias("n"))
    hot = stage(sizes.where(F.col("n") > CELL), "hot")  # its size is known when the join is planned
    dealt = caps.join(hot, ["label", "dims", "filter"], "left").withColumn("chunks", F.coalesce(F.ceil(F.col("n") / CELL), F.lit(1)).cast("int"))
    dealt = dealt.withColumn("chunk", F.pmod(F.col("node"), F.col("chunks")).cast("int"))
    cells = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda j: F.struct(F.least("chunk", j).alias("a"), F.greatest("chunk", j).alias("b")))
    key = ["label", "dims", "filter", "a", "b"]
    spread = dealt.withColumn("cell", F.explode(cells)).select("label", "dims", "filter", "cell.a", "cell.b", "chunk", "node", "times", "vector", "filters")
    spread = spread.repartition(parts, *key).sortWithinPartitions(*key)

    def run(batches):
        held, name = [], None

        def close():
            if len(held) < 2:
                return
            chunk, node, times, vector, filters = zip(*held, strict=True)
            node = np.array(node, np.int64)
            n, (i, j) = compare(name[2], np.array(chunk), name[3], name[4], np.array(times, np.int64), np.frombuffer(b"".join(vector), kept).reshape(len(node), -1), [np.frombuffer(f, np.int32) for f in filters], least)
            some = np.nonzero(n)[0]
            if len(some):
                none = np.zeros(len(i), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([node[some], node[i]])), pa.array(np.concatenate([node[some], node[j]])), pa.array(np.concatenate([n[some], none]))], ["a", "b", "n"])

        for batch in slices(batches, 2000):
            columns = [batch.column(c).to_pylist() for c in (*key, "chunk", "node", "times", "vector", "filters")]
            for *k, chunk, node, times, vector, filters in zip(*columns, strict=True):
                if k != name:
                    yield from close()
                    held, name = [], k
                held.append((chunk, node, times, vector, filters))
        yield from close()

    found = stage(spread.mapInArrow(run, "a long, b long, n long"), "links")
    links = found.groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("others"))
    label = components(found.select("a", "b"))
    each = named.where("node is not null").groupBy("node").agg(F.count(F.lit(1)).alias("times"), F.min("vec_id").alias("first"))
    each = each.join(links, "node", "left").join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least_id = stage(each.groupBy("label").agg(F.min("first").alias("smallest")), "least")  # a plain side, so a hot label can be split
    about = each.join(least_id, "label").select("node", (F.coalesce("others", F.lit(0)) + F.col("times") - 1).alias("links"), "smallest")
    out = named.join(about, "node", "left").select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("smallest", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))

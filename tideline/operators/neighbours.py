"""Exact nearest neighbours without pairing everything with everything.

Vectors are assigned to the nearest of a bounded set of pivots.  A query first searches its own cell, which bounds its
k-th distance; the triangle inequality then names the few other cells that can hold something closer.  Cells are cut
into chunks of bounded size, a task multiplies one chunk of history with the queries sent to it, measures exactly what the product
leaves in doubt, and emits at most ``k`` rows per query.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.scalars import ratio
from tideline.session import materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])

CHUNK = 20_000
TILE = 2_000
#: Queries that meet one chunk of history in one task.
PART = 50_000


def _stack(values: pd.Series) -> np.ndarray:
    return np.array([[np.nan if x is None else x for x in v] for v in values], dtype=float) if len(values) else np.zeros((0, 0))


def _distances(q: np.ndarray, h: np.ndarray, metric: str) -> np.ndarray:
    """Euclidean, or root mean square over the columns known on both sides (none in common: infinitely far)."""
    if metric == "euclid":
        return np.sqrt(((q[:, None, :] - h[None, :, :]) ** 2).sum(axis=2))
    diff = (q[:, None, :] - h[None, :, :]) ** 2
    used = np.isfinite(diff)
    n = used.sum(axis=2)
    return np.where(n > 0, np.sqrt(np.where(used, diff, 0.0).sum(axis=2) / np.maximum(n, 1)), np.inf)


def _closest(q: np.ndarray, h: np.ndarray, k: int, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, col, distance) of the k nearest of h for each row of q, ties by place in h; `own` marks pairs that do not count.

    Squared distances by one product of matrices name the candidates: all within twice its rounding error of the k-th. Only these are measured exactly.
    """
    if h.shape[1] == 0 or len(h) <= 4 * k or not (np.isfinite(q).all() and np.isfinite(h).all()):
        d = np.where(own, np.inf, _distances(q, h, "euclid"))
        order = np.argsort(d, axis=1, kind="stable")[:, :k]
        row, at = np.nonzero(np.isfinite(np.take_along_axis(d, order, axis=1)))
        return row, order[row, at], d[row, order[row, at]]
    centre = h.mean(axis=0)
    a, b = q - centre, h - centre
    aa, bb = (a * a).sum(axis=1), (b * b).sum(axis=1)
    rough = aa[:, None] + bb[None, :] - 2.0 * (a @ b.T)
    rough[own] = np.inf
    # products, sums and the shift to the centre: some dozens of roundings of numbers of this size
    spread = np.abs(q).max(axis=1) + np.abs(h).max()
    slack = (8.0 * (h.shape[1] + 8) * np.finfo(float).eps) * (aa + bb.max() + spread * spread * h.shape[1])
    bound = np.partition(rough, k - 1, axis=1)[:, k - 1] + 2.0 * slack
    row, col = np.nonzero(rough <= np.where(np.isfinite(bound), bound, np.finfo(float).max)[:, None])
    exact = np.empty(len(row))
    for s in range(0, len(row), TILE * 50):
        part = slice(s, s + TILE * 50)
        exact[part] = np.sqrt(((q[row[part]] - h[col[part]]) ** 2).sum(axis=1))
    order = np.lexsort((col, exact, row))
    row, col, exact = row[order], col[order], exact[order]
    first = np.searchsorted(row, np.arange(len(q)))
    keep = (np.arange(len(row)) - first[row] < k) & np.isfinite(exact)
    return row[keep], col[keep], exact[keep]


def _search(k: int, metric: str, timed: bool, id_dtype: str) -> Callable:
    def run(key: tuple, queries: pd.DataFrame, history: pd.DataFrame) -> pd.DataFrame:
        out, whole = [], None
        history = history.sort_values("hid", kind="stable")
        if timed:
            # queries go in order of time, and each few see only what is there by the last of them
            queries = queries[queries["qt"].notna()].sort_values("qt", kind="stable")
        for s in range(0, len(queries), TILE):
            some = queries.iloc[s : s + TILE]
            seen = history[(history["ht"] < some["qt"].iloc[-1]) & (history["ha"] <= some["qt"].iloc[-1])] if timed else history
            if not len(seen):
                continue
            if metric == "euclid" and not timed:
                if whole is None:
                    whole = _stack(seen["hv"]), seen["hid"].to_numpy()
                h, hid = whole
                # a product of so many queries with a chunk stays within some dozen MB
                step = max(1, TILE * 1000 // len(h))
                for at in range(0, len(some), step):
                    part = some.iloc[at : at + step]
                    row, col, d = _closest(_stack(part["qv"]), h, k, part["qid"].to_numpy()[:, None] == hid[None, :])
                    out.append(pd.DataFrame({"qid": part["qid"].to_numpy()[row], "hid": hid[col], "distance": d}))
                continue
            h, hid = _stack(seen["hv"]), seen["hid"].to_numpy()
            step = max(1, TILE * 500 // len(h))
            for at in range(0, len(some), step):
                part = some.iloc[at : at + step]
                d = _distances(_stack(part["qv"]), h, metric)
                d[part["qid"].to_numpy()[:, None] == hid[None, :]] = np.inf
                if timed:
                    d[seen["ht"].to_numpy()[None, :] >= part["qt"].to_numpy()[:, None]] = np.inf
                    d[seen["ha"].to_numpy()[None, :] > part["qt"].to_numpy()[:, None]] = np.inf
                order = np.argsort(d, axis=1, kind="stable")[:, :k]
                best = np.take_along_axis(d, order, axis=1)
                row, col = np.nonzero(np.isfinite(best))
                out.append(pd.DataFrame({"qid": part["qid"].to_numpy()[row], "hid": hid[order[row, col]], "distance": best[row, col]}))
        found = pd.concat(out) if out else pd.DataFrame([], columns=["qid", "hid", "distance"])
        return found.astype({"qid": id_dtype, "hid": id_dtype, "distance": "float64"})

    return run


def _cells(pivots: np.ndarray) -> Callable[[pd.Series], pd.Series]:
    def run(v: pd.Series) -> pd.Series:
        return pd.Series(list(_distances(_stack(v), pivots, "euclid")))

    run.__annotations__ = {"v": pd.Series, "return": pd.Series}
    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("qid").orderBy("distance", "hid")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _chunked(h: DataFrame) -> DataFrame:
    sizes = h.groupBy("cell").agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / CHUNK)).alias("chunks"))
    return h.join(sizes, "cell").withColumn("chunk", F.pmod(F.xxhash64("hid"), F.col("chunks")))


def _round(asks: DataFrame, h: DataFrame, k: int, metric: str, timed: bool, parts: int = 1) -> DataFrame:
    sizes = h.groupBy(F.col("cell").alias("_cell")).agg(F.max("chunks").alias("_chunks"))
    sent = asks.join(sizes, F.col("cell") == F.col("_cell")).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_chunks") - 1))).drop("_cell", "_chunks")
    # a cell that many queries ask goes to several tasks
    sent = sent.withColumn("part", F.pmod(F.xxhash64("qid"), F.lit(parts)).cast("int"))
    h = h.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    kind = dict(h.dtypes)["hid"]
    dtype = "int64" if kind == "bigint" else "object"
    return sent.groupBy("cell", "chunk", "part").cogroup(h.groupBy("cell", "chunk", "part")).applyInPandas(_search(k, metric, timed, dtype), f"qid {kind}, hid {kind}, distance double")


def nearest(history: DataFrame, queries: DataFrame, k: int, pivots: int = 256, metric: str = "euclid") -> DataFrame:
    """``k`` nearest history rows of each query: (qid, hid, distance, rank), ties by id; a row is not its own neighbour.

    ``history(hid, hv)`` and ``queries(qid, qv)`` hold vectors; with ``metric='rms'`` the vectors may contain NULLs, and
    ``ht``/``ha`` (prediction and availability times) limit history to ``ht < qt`` and ``ha <= qt``.  RMS over shared
    columns is no metric, so only time prunes there: every chunk of history sees every query that comes after its first row, still emitting ``k``.
    """
    timed = "qt" in queries.columns
    if metric != "euclid":
        if timed:
            # rows that no query can see go first; the rest lies in cells along the time at which it becomes available
            last = queries.agg(F.max("qt").alias("_last"))
            history = history.join(F.broadcast(last), (F.col("ht") < F.col("_last")) & (F.col("ha") <= F.col("_last"))).drop("_last")
        n, asked = history.count(), queries.count()
        cells, parts = max(1, math.ceil(n / CHUNK)), max(1, math.ceil(asked / PART))
        if not timed:
            h = _chunked(history.withColumn("cell", F.pmod(F.xxhash64("hid"), F.lit(cells)).cast("int")))
            return _best(_round(queries.withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(cells - 1)))), h, k, metric, timed, parts), k)
        at = history.select(F.col("ha").cast("double").alias("_at"))
        cuts = at.approxQuantile("_at", [i / cells for i in range(1, cells)], 0.1 / cells) if cells > 1 else []
        cell = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]).cast("array<double>"), lambda c: c <= F.col("ha").cast("double")))
        h = _chunked(history.withColumn("cell", cell))
        lows = h.groupBy(F.col("cell").alias("_c")).agg(F.min("ht").alias("_ht"), F.min("ha").alias("_ha"))
        asks = queries.join(F.broadcast(lows), (F.col("_ht") < F.col("qt")) & (F.col("_ha") <= F.col("qt"))).withColumnRenamed("_c", "cell").drop("_ht", "_ha")
        return _best(_round(asks, h, k, metric, timed, parts), k)
    centre = _stack(pd.Series([r[0] for r in history.orderBy(F.xxhash64("hid"), "hid").limit(pivots).select("hv").collect()]))
    near = F.pandas_udf(_cells(centre), "array<double>")
    lowest = lambda c: (F.array_position(c, F.array_min(c)) - 1).cast("int")
    h = history.withColumn("_d", near("hv")).withColumn("cell", lowest(F.col("_d")))
    h = materialize(h.select("hid", "hv", "cell", F.array_min("_d").alias("_r")))
    q = queries.withColumn("_d", near("qv")).withColumn("cell", lowest(F.col("_d")))
    q = materialize(q)
    chunked = _chunked(h.drop("_r"))
    first = materialize(_best(_round(q.select("qid", "qv", "cell"), chunked, k, metric, timed), k))
    reach = first.groupBy("qid").agg(F.max(F.when(F.col("rank") == k, F.col("distance"))).alias("_reach"))
    radius = h.groupBy("cell").agg(F.max("_r").alias("_radius")).select(F.col("cell").alias("_c"), "_radius")
    # only cells whose nearest possible point is within reach; the radius table has one row per pivot
    wide = q.join(reach, "qid", "left").select("qid", "qv", F.col("cell").alias("_own"), F.coalesce("_reach", F.lit(float("inf"))).alias("_reach"), F.posexplode("_d").alias("_c", "_dist"))
    asks = wide.join(radius, "_c").filter((F.col("_c") != F.col("_own")) & (F.col("_dist") - F.col("_radius") <= F.col("_reach") + 1e-9)).select("qid", "qv", F.col("_c").alias("cell"))
    second = _round(asks, chunked, k, metric, timed, max(1, math.ceil(q.count() / PART)))
    return _best(first.drop("rank").unionByName(second), k)


def vote(neighbours: DataFrame, labels: DataFrame, classes: Sequence[int]) -> DataFrame:
    """Inverse-distance class vote and the similarity of the nearest neighbour."""
    w = 1.0 / F.greatest("distance", F.lit(1e-6))
    j = neighbours.join(labels, "hid").withColumn("_w", w)
    share = lambda c: ratio(F.sum(F.when(F.col("label") == c, F.col("_w")).otherwise(0.0)), F.sum("_w"))
    return j.groupBy("qid").agg(*[share(c).alias(f"p{c}") for c in classes], F.min("distance").alias("nearest_distance"), (1.0 / (1.0 + F.min("distance"))).alias("nearest_similarity"))



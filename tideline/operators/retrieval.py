"""Conformal sets calibrated on the nearest matured earlier games of each case.

The pool of a case is the latest matured snapshot of each of the last ``pool`` other games by prediction time.  Such pools merge: the pool
of two stretches of time is the latest snapshot per game of both, cut to the last games again.  So the maturity axis is cut by the counts of
its instants into chunks of about equal row counts, each chunk gives its own pool, a tree of merges gives every chunk the pool it starts with,
and a chunk then walks its rows once.  No task holds more than a chunk and two pools, and nothing is paired with history.  Cases move once; facts are
first cut to those of their instant that a pool can hold.
"""

from __future__ import annotations

import bisect
import pickle
import sys
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.operators import ordered as O
from tideline.operators.evaluate import prediction_set
from tideline.operators.scan import tree_prefix
from tideline.session import stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])


#: Cases of one pool that are measured against it at once.
AT_ONCE = 512


class Pool:
    """Latest snapshot of each of the last ``size`` games, by (prediction time, case)."""

    def __init__(self, size: int, entries: Sequence[tuple] = ()):
        self.size, self.of, self.order = size, {}, []
        for e in entries:
            self.add(e)

    def add(self, entry: tuple) -> None:
        """entry: (prediction time, case, game, score, features)."""
        rank, game = entry[:2], entry[2]
        held = self.of.get(game)
        if held is not None:
            if rank <= held[:2]:
                return
            self.order.remove((held[:2], game))
        self.of[game] = entry
        bisect.insort(self.order, (rank, game))
        if len(self.order) > self.size:
            del self.of[self.order.pop(0)[1]]

    def others(self, game: str, n: int) -> list[tuple]:
        """The last n entries of other games, in order."""
        return [self.of[g] for _, g in self.order if g != game][-n:]

    def pack(self) -> bytes:
        return pickle.dumps([self.of[g] for _, g in self.order])


def _merge(size: int):
    def merge(a: bytes, b: bytes) -> bytes:
        return Pool(size, pickle.loads(a) + pickle.loads(b)).pack()
    return merge


def _entries(rows: pd.DataFrame):
    for r in rows.itertuples(index=False):
        yield (r.pt, r.case, r.game, r.score, tuple(r.features))


def _own_pool(keys: Sequence[str], size: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        first = rows.iloc[:1]
        facts = rows[rows["is_fact"]].sort_values(["pt", "case"]).drop_duplicates("game", keep="last").tail(size)
        return first.assign(state=[Pool(size, _entries(facts)).pack()])[[*keys, "seg", "state"]]
    return run


def conformal_of(pool: list[tuple], p: Sequence[float], features: Sequence[float], k: int) -> tuple[int, float, list[float]]:
    """(neighbours, distance of the nearest, p-values): scaled inside the pool, equal distances by time and case."""
    x = np.array([e[4] for e in pool], float)
    scale = x.std(axis=0)
    scale = np.where(np.isfinite(scale) & (scale > 1e-9), scale, 1.0)
    d = (((x - np.asarray(features, float)) / scale) ** 2).sum(axis=1)
    near = np.lexsort((np.arange(len(d)), np.round(d, 9)))[:k]
    scores = np.sort(np.clip([pool[i][3] for i in near], 0.0, 1.0))
    at = np.searchsorted(scores, 1.0 - np.asarray(p, float) - 1e-12, side="left")
    return len(near), float(np.sqrt(d[near[0]])), ((1.0 + len(near) - at) / (len(near) + 1.0)).tolist()


def conformal_of_many(pool: list[tuple], p: np.ndarray, features: np.ndarray, k: int) -> tuple[int, np.ndarray, np.ndarray]:
    """:func:`conformal_of` for many cases of one pool: rows of p and features are cases."""
    x = np.array([e[4] for e in pool], float)
    scale = x.std(axis=0)
    scale = np.where(np.isfinite(scale) & (scale > 1e-9), scale, 1.0)
    scores, n = np.clip([e[3] for e in pool], 0.0, 1.0), min(k, len(pool))
    near, pv = [], []
    for at in range(0, len(p), AT_ONCE):
        d = sum(((x[:, j] - features[at : at + AT_ONCE, j, None]) / scale[j]) ** 2 for j in range(x.shape[1]))
        rank = np.round(d, 9)
        last = np.partition(rank, n - 1, axis=1)[:, n - 1, None]
        closer, equal = rank < last, rank == last
        taken = closer | (equal & (np.cumsum(equal, axis=1) <= n - closer.sum(axis=1, keepdims=True)))
        near.append(np.sqrt(d[np.arange(len(d)), rank.argmin(axis=1)]))
        above = 1.0 - p[at : at + AT_ONCE] - 1e-12
        pv.append(np.stack([1.0 + (taken & ((scores >= above[:, c, None]) | np.isnan(scores))).sum(axis=1) for c in range(p.shape[1])], axis=1) / (n + 1.0))
    return n, np.concatenate(near), np.concatenate(pv)


def _walk(keys: Sequence[str], size: int, k: int, minimum: int, classes: int):
    names = ["case", "pool_count", "calibration_count", "nearest_distance", *[f"pv{i}" for i in range(classes)]]

    def run(rows: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        state = above["before"].iloc[0] if len(above) else None
        pool, out = Pool(size + 1, pickle.loads(state) if state is not None else ()), []
        rows = rows.sort_values("rn")
        fact = rows["is_fact"].to_numpy(bool)
        pt, case, game, score, p, features = (rows[c].tolist() for c in ("pt", "case", "game", "score", "p", "features"))
        edges = [0, *(np.flatnonzero(fact[1:] != fact[:-1]) + 1).tolist(), len(rows)] if len(rows) else [0]
        for lo, hi in zip(edges, edges[1:], strict=False):
            if fact[lo]:
                for i in range(lo, hi):
                    pool.add((pt[i], case[i], game[i], score[i], tuple(features[i])))
                continue
            # cases between two facts have one pool, but for those whose own game is in it
            for same in ([i for i in range(lo, hi) if game[i] not in pool.of], *([i] for i in range(lo, hi) if game[i] in pool.of)):
                others = pool.others(game[same[0]], size) if same else []
                if len(others) < minimum:
                    out += [(case[i], len(others), 0, None, *[None] * classes) for i in same]
                else:
                    n, near, pv = conformal_of_many(others, np.array([p[i] for i in same], float), np.array([features[i] for i in same], float), k)
                    out += [(case[i], len(others), n, d, *v) for i, d, v in zip(same, near.tolist(), pv.tolist(), strict=True)]
        return pd.DataFrame(out, columns=names)
    return run


def _axis(events: DataFrame, keys: Sequence[str], room: int) -> DataFrame:
    """The instants ``(keys, _t, _side)`` of a key, how many rows each has and the place ``_before`` it begins at; no more than ``room`` facts of one count."""
    at = [*keys, "_t", "_side"]
    instants = stored(events.groupBy(*at).agg(F.count(F.lit(1)).alias("_n")), "instants")
    weight = F.when(F.col("_side") == 1, F.col("_n")).otherwise(F.least(F.col("_n"), F.lit(room)))
    day = F.date_trunc("day", F.timestamp_micros("_t"))
    return stored(O.row_numbers(instants, keys, ["_t", "_side"], day, sums={"_before": weight}).select(*at, "_n", "_before"), "axis")


def _latest(facts: DataFrame, at: Sequence[str], room: int) -> DataFrame:
    """Facts without those that ``room`` other games of their instant outrank, which no pool can hold. Of games with one row only ranks move, the
    row of rank ``room`` being the bound of an instant; the others are first cut to their latest snapshot."""
    rank, latest = F.struct("pt", "case"), Window.partitionBy(*at).orderBy(F.col("pt").desc(), F.col("case").desc())
    crowded, of_many = F.col("_n") > room, F.xxhash64("game") == F.col("_h")
    many = stored(facts.groupBy(F.xxhash64("game").alias("_h")).agg(F.count(F.lit(1)).alias("_rows")).filter("_rows > 1").select("_h"), "many")
    told = not many.isEmpty()
    one = facts.join(many, of_many, "left_anti") if told else facts
    least = one.filter(crowded).select(*at, "pt", "case").withColumn("_rank", F.row_number().over(latest)).filter(F.col("_rank") == room)
    least = stored(least.select(*at, rank.alias("_least")), "least")
    kept = O.attach(one, least, at).filter(F.col("_least").isNull() | (rank >= F.col("_least"))).drop("_least")
    if not told:
        return kept
    rest = [c for c in facts.columns if c not in at and c not in ("game", "pt", "case")]
    again = facts.join(many, of_many, "left_semi").groupBy(*at, "game").agg(F.max(F.struct("pt", "case", *rest)).alias("_row")).select(*at, "game", "_row.*")
    again = again.withColumn("_rank", F.row_number().over(latest)).filter(F.col("_rank") <= room).drop("_rank")
    return kept.unionByName(again)


def retrieval_conformal(
    df: DataFrame, p: Sequence[str], y: str, features: Sequence[str], game: str, case: str, pred_time: str, mature_at: str,
    keys: Sequence[str] = (), alpha: float = 0.10, minimum: int = 30, pool: int = 200, k: int = 30, chunk: int = 8192, fan: int = 16,
) -> DataFrame:
    """``(case, pool_count, calibration_count, nearest_distance, pv*, set, set_size, action)`` of every row of ``df``.

    A case calibrates on the ``k`` nearest of its pool: games predicted strictly before it and matured by then, its own game out,
    the latest matured snapshot of each.  Fewer than ``minimum`` of them abstain.  ``case`` is unique and ordered; equal
    prediction times go by it.  An outcome before its prediction, a NULL game and a feature that is not finite are errors."""
    if not 0.0 < alpha < 1.0:
        raise ValueError("alpha must lie between 0 and 1")
    if not 2 <= minimum <= k <= pool:
        raise ValueError("2 <= minimum <= k <= pool is asked for")
    hit = F.element_at(F.array(*[F.col(c).cast("double") for c in p]), F.col(y).cast("int") + 1)
    wrong = F.when(F.col(mature_at) < F.col(pred_time), "an outcome cannot precede its prediction").when(
        F.coalesce(F.trim(F.col(game).cast("string")), F.lit("")) == "", "a game needs a name").when(
        ~F.forall(F.array(*[F.col(c).cast("double") for c in features]), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), "features must be finite")
    base = df.select(
        *keys, F.unix_micros(F.col(pred_time)).alias("pt"), F.unix_micros(F.col(mature_at)).alias("_m"), F.col(case).alias("case"),
        F.trim(F.col(game).cast("string")).alias("game"), F.array(*[F.col(c).cast("double") for c in p]).alias("p"), (1.0 - hit).alias("score"),
        F.array(*[F.col(c).cast("double") for c in features]).alias("features"), F.when(wrong.isNotNull(), F.raise_error(wrong).cast("boolean")).otherwise(F.lit(True)).alias("_ok"),
    ).where("_ok").drop("_ok")
    room = pool + 1
    # at one instant: facts that matured after they were predicted, then cases, then facts of that very instant
    fact = F.struct(F.col("_m").alias("_t"), F.when(F.col("_m") > F.col("pt"), 0).otherwise(2).alias("_side"))
    asked, known = F.struct(F.col("pt").alias("_t"), F.lit(1).alias("_side")), "score IS NOT NULL AND _m IS NOT NULL AND pt IS NOT NULL"
    cut = _axis(base.select(*keys, F.inline(F.array(asked, F.when(F.expr(known), fact)))).filter("_side IS NOT NULL"), keys, room)
    asks, facts = base.select("*", asked["_t"].alias("_t"), asked["_side"].alias("_side")), base.filter(known).select("*", fact["_t"].alias("_t"), fact["_side"].alias("_side"))
    at = [*keys, "_t", "_side"]
    facts = O.attach(facts, cut.filter("_side <> 1"), at)
    if not cut.filter((F.col("_side") != 1) & (F.col("_n") > room)).isEmpty():
        facts = _latest(facts, at, room)
    facts = stored(facts.select(*keys, F.floor(F.col("_before") / chunk).alias("seg"), F.lit(True).alias("is_fact"), F.col("_before").alias("rn"), "pt", "case", "game", "score", "features"), "facts")
    # cases of an instant share its place, and any of its chunks will do for one
    asks = O.attach(asks, cut.filter("_side = 1"), at).withColumn("seg", F.floor((F.col("_before") + F.pmod(F.xxhash64("case"), F.col("_n"))) / chunk))
    asks = asks.select(*keys, "seg", F.lit(False).alias("is_fact"), F.col("_before").alias("rn"), "pt", "case", "game", "p", "features")
    kinds = dict(asks.dtypes)
    head = "".join(f"{c} {kinds[c]}, " for c in keys)
    # every chunk that can hold a case, for those without facts
    ends = [F.floor((F.col("_before") + e) / chunk) for e in (F.lit(0), F.col("_n") - 1)]
    chunks = cut.filter("_side = 1").select(*keys, F.explode(F.sequence(*ends)).alias("seg")).distinct().withColumn("is_fact", F.lit(False))
    own = stored(facts.drop("rn").unionByName(chunks, allowMissingColumns=True).groupBy(*keys, "seg").applyInPandas(_own_pool(keys, room), f"{head}seg bigint, state binary"), "pools")
    before = tree_prefix(own, keys, _merge(room), fan=fan)
    by = asks.unionByName(facts, allowMissingColumns=True).groupBy(*keys, "seg")
    schema = f"case {kinds['case']}, pool_count bigint, calibration_count bigint, nearest_distance double, " + ", ".join(f"pv{i} double" for i in range(len(p)))
    out = by.cogroup(before.groupBy(*keys, "seg")).applyInPandas(_walk(keys, pool, k, minimum, len(p)), schema)
    return prediction_set(out, len(p), alpha)

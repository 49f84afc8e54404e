"""Experience ledger: revisions, strata, shrunk corrections learnt from matured outcomes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions import arrays as A
from tideline.operators import ordered as O
from tideline.session import stored


def revision_metadata(df: DataFrame, p: Sequence[str], game: str, cutoff: str, pid: str) -> DataFrame:
    """Compare each snapshot with the previous one of the same game: size of the change and outcome reversal."""
    spread, w = O.blocks(O.row_numbers(df, [game], [cutoff, pid]), [game])
    prev = spread.withColumn("_p", F.lag(F.struct(*p, F.col(pid).alias("_id"))).over(w))
    out = O.drop_halo(prev)
    now, old = [F.col(c) for c in p], [F.col(f"_p.{c}") for c in p]
    change = [F.abs(a - b) for a, b in zip(now, old, strict=True)]
    flipped = F.coalesce(A.arg_max_cols(now) != A.arg_max_cols(old), F.lit(False)) & F.col("_p").isNotNull()
    return out.withColumns({
        "revision_status": F.when(F.col("_p").isNull(), "INITIAL").otherwise("REVISED"), "previous_id": F.col("_p._id"),
        "revision_l1": A.add(change), "revision_max": F.when(F.col("_p").isNotNull(), F.greatest(*change)), "revision_outcome_changed": flipped,
    }).drop("_p", "rn")


# How specific each stratum scope is.
SPECIFICITY = {"target_regime_score": 4, "target_regime": 3, "target_score_regime": 3, "target_model": 3, "target_tag": 3, "target": 2, "global": 1}


def strata(target: Column, regime: Column, score_regime: Column, model: Column, tags: Column) -> Column:
    """All overlapping strata of a case as ``array<struct<scope, key, spec>>``; blank labels contribute none."""
    has = lambda *cs: _all([F.coalesce(c, F.lit("")) != "" for c in cs])
    one = lambda scope, key, cond: F.when(cond, F.struct(F.lit(scope).alias("scope"), key.alias("key"), F.lit(SPECIFICITY[scope]).alias("spec")))
    join = lambda *cs: F.concat_ws("|", *cs)
    fixed = F.array(
        one("global", F.lit("GLOBAL"), F.lit(True)), one("target", target, has(target)), one("target_regime", join(target, regime), has(target, regime)),
        one("target_score_regime", join(target, score_regime), has(target, score_regime)),
        one("target_regime_score", join(target, regime, score_regime), has(target, regime, score_regime)), one("target_model", join(target, model), has(target, model)))
    clean = F.array_distinct(F.filter(F.transform(tags, lambda t: F.trim(t)), lambda t: t != ""))
    tagged = F.transform(clean, lambda t: F.when(has(target), F.struct(F.lit("target_tag").alias("scope"), join(target, t).alias("key"), F.lit(3).alias("spec"))))
    return F.concat(fixed, F.coalesce(tagged, F.array().cast("array<struct<scope:string,key:string,spec:int>>")))


def by_stratum(df: DataFrame, *columns: str | Column) -> DataFrame:
    """One row per case and stratum it belongs to (strata that do not apply are NULL elements)."""
    return df.select(*columns, F.inline("strata")).filter(F.col("scope").isNotNull())


def _all(conds: Sequence[Column]) -> Column:
    out = F.lit(True)
    for c in conds:
        out = out & c
    return out


PRED, REAL = ("_p0", "_p1", "_p2"), ("_y0", "_y1", "_y2")


def _sums(p: Sequence[str], y: str) -> dict[str, Column]:
    out = {PRED[i]: F.col(c) for i, c in enumerate(p)}
    out.update({REAL[i]: (F.col(y) == i).cast("double") for i in range(3)})
    return out


def policy_build(cases: DataFrame, p: Sequence[str], y: str, cutoff: Column, minimum: int = 30, prior: float = 50.0) -> DataFrame:
    """Shrunk outcome rate minus mean prediction per stratum, from cases matured by the cutoff (latest per game).

    ``cases`` carries game_id, prediction_time, available_at, strata and the class columns.
    """
    from tideline.operators.prob import brier_cols, nll_cols

    matured = O.latest_by(cases.filter((F.col("available_at") <= cutoff) & (F.col("prediction_time") < cutoff)), ["game_id"], ["prediction_time"])
    sums = _sums(p, y)
    cols = [F.col(c) for c in p]
    long = by_stratum(matured, *[c.alias(n) for n, c in sums.items()], nll_cols(cols, F.col(y)).alias("_nll"), brier_cols(cols, F.col(y)).alias("_brier"))
    g = long.groupBy("scope", "key", "spec").agg(F.count(F.lit(1)).alias("rows"), *[F.sum(n).alias(n) for n in sums], F.avg("_nll").alias("mean_log_loss"), F.avg("_brier").alias("mean_brier"))
    top = g.filter(F.col("scope") == "global").select(F.lit(1).alias("_one"), *[(F.col(REAL[i]) / F.col("rows")).alias(f"_g{i}") for i in range(3)])
    j = g.filter(F.col("rows") >= minimum).withColumn("_one", F.lit(1)).join(top, "_one")
    shrunk = [(F.col(REAL[i]) + prior * F.col(f"_g{i}")) / (F.col("rows") + prior) for i in range(3)]
    return j.select("scope", "key", "spec", "rows", "mean_log_loss", "mean_brier", *[(s - F.col(PRED[i]) / F.col("rows")).alias(f"delta{i}") for i, s in enumerate(shrunk)])


def bounded_correct(p: Sequence[Column], delta: Sequence[Column], strength: float = 0.50, max_log_ratio: float = 0.35) -> list[Column]:
    """Additive calibration error applied as a bounded multiplicative correction, before renormalisation."""
    raw = []
    for c, d in zip(p, delta, strict=True):
        quotient = A.clip(A.clip(c + d, 1e-6, 1.0) / F.greatest(c, F.lit(1e-6)), 0.5, 2.0)
        raw.append(c * F.exp(strength * A.clip(F.log(quotient), -max_log_ratio, max_log_ratio)))
    return raw


def _choose(rows: DataFrame, qid: str) -> DataFrame:
    """Most specific stratum per case, then the one with most rows, then by name."""
    order = F.struct(-F.col("spec"), -F.col("rows"), "scope", "key")
    return rows.groupBy(qid).agg(F.min_by(F.struct("scope", "key", "rows", "delta0", "delta1", "delta2"), order).alias("_e"))


def _corrected(cases: DataFrame, best: DataFrame, qid: str, p: Sequence[str]) -> DataFrame:
    return _fixed(cases.join(best, qid, "left"), p)


def _fixed(j: DataFrame, p: Sequence[str]) -> DataFrame:
    """Rows with their chosen stratum ``_e`` (or none), corrected by it."""
    hit = F.col("_e").isNotNull()
    raw = bounded_correct([F.col(c) for c in p], [F.col(f"_e.delta{i}") for i in range(3)])
    # staged, so that the total is computed once
    j = j.withColumns({f"_raw{i}": F.when(hit, r).otherwise(F.col(c)) for i, (c, r) in enumerate(zip(p, raw, strict=True))})
    total = A.add([F.col(f"_raw{i}") for i in range(3)])
    return j.withColumns({**{f"learned_{c}": F.when(hit, F.col(f"_raw{i}") / total).otherwise(F.col(c)) for i, c in enumerate(p)},
                          "policy_source": F.when(hit, F.concat_ws(":", "_e.scope", "_e.key"))}).drop("_e", "_raw0", "_raw1", "_raw2")


def policy_apply(cases: DataFrame, policy: DataFrame, qid: str, p: Sequence[str]) -> DataFrame:
    """Correct each case with its best stratum of a frozen policy."""
    keys = by_stratum(cases, qid)
    return _corrected(cases, _choose(keys.join(policy.drop("spec"), ["scope", "key"]), qid), qid, p)


def policy_replay(cases: DataFrame, qid: str, p: Sequence[str], y: str, minimum: int = 30, prior: float = 50.0) -> DataFrame:
    """Each case corrected only with experience matured before its own cutoff.

    Matured sums per stratum are read from running totals on the time axis, once for all cases of the same time and strata (told apart by
    a 128-bit hash of them); no case meets its history row by row. A case's own game is taken out where the game has an earlier revision.
    """
    from tideline.operators.joins import matured_steps, matured_sums, revised_games

    sums = {"rows": F.lit(1), **_sums(p, y)}
    facts = cases.select("game_id", "prediction_time", "available_at", "strata", *[c.alias(n) for n, c in sums.items()])
    plain = {n: F.col(n) for n in sums}
    sig = {"_sig0": F.xxhash64("prediction_time", "strata"), "_sig1": F.xxhash64("strata", "prediction_time", F.lit(1))}
    signed = cases.withColumns(sig)
    kinds = signed.groupBy(*sig).agg(F.first("prediction_time").alias("prediction_time"), F.first("strata").alias("strata"))
    revised = revised_games(facts, "game_id")
    seen = matured_sums(by_stratum(kinds, *sig, "prediction_time"), facts,
                        ["scope", "key"], "prediction_time", "prediction_time", "available_at", plain, game="game_id", strata="strata", revised=revised)
    seen = seen.groupBy(*sig).agg(F.collect_list(F.struct("scope", "key", "spec", *sums)).alias("_seen"))
    again = F.col("game_id").eqNullSafe(F.col("_many"))
    some = facts.join(revised.select(F.col("game_id").alias("_many")), again, "left_semi")
    steps = matured_steps(some, ["scope", "key"], "prediction_time", "available_at", plain, "game_id", strata="strata", revised=revised)
    mine = steps.select("game_id", "_t", F.col("_c._under").alias("_own_under"), F.col("_c._sums").alias("_own"))
    own = O.as_of(some.select("game_id", "prediction_time").distinct(), mine, ["game_id"], "prediction_time", "_t", ["_t"], ["_own_under", "_own"])
    own = stored(own.filter(F.col("_own").isNotNull()), "own")
    j = O.attach(signed.join(seen, list(sig), "left"), own, ["game_id", "prediction_time"])
    here = lambda x: F.exists("_own_under", lambda u: (u["scope"] == x["scope"]) & (u["key"] == x["key"]))
    less = lambda x, n: x[n] - F.when(here(x), F.col("_own")[n]).otherwise(F.lit(0))
    others = F.transform("_seen", lambda x: F.struct(x["scope"].alias("scope"), x["key"].alias("key"), x["spec"].alias("spec"), *[less(x, n).alias(n) for n in sums]))
    j = j.withColumn("_seen", F.when(F.col("_own").isNull(), F.col("_seen")).otherwise(others))
    j = j.withColumn("_top", F.get(F.filter("_seen", lambda x: (x["scope"] == "global") & (x["rows"] > 0)), F.lit(0)))
    delta = lambda x, i: (x[REAL[i]] + prior * F.col("_top")[REAL[i]] / F.col("_top.rows")) / (x["rows"] + prior) - x[PRED[i]] / x["rows"]
    # most specific stratum, then the one with most rows, then by name
    found = F.transform(F.filter("_seen", lambda x: x["rows"] >= minimum), lambda x: F.struct(
        (-x["spec"]).alias("a"), (-x["rows"]).alias("b"), x["scope"].alias("scope"), x["key"].alias("key"), *[delta(x, i).alias(f"delta{i}") for i in range(3)]))
    j = j.withColumn("_e", F.when(F.col("_top").isNotNull(), F.array_min(found))).drop("_seen", "_own", "_own_under", "_top", *sig)
    return _fixed(j, p)


def policy_strata(cases: DataFrame, p: Sequence[str], y: str) -> DataFrame:
    """Rows, distinct games and sums of predicted and actual per stratum. Games of one row are counted where they stand; only the others
    are told apart stratum by stratum."""
    from tideline.operators.joins import revised_games

    sums = {f"pred{i}": F.col(PRED[i]) for i in range(3)} | {f"actual{i}": F.col(REAL[i]) for i in range(3)}
    own = cases.select("game_id", "strata", *[c.alias(n) for n, c in _sums(p, y).items()])
    revised = revised_games(cases.select("game_id"), "game_id").select(F.col("game_id").alias("_many"))
    again = F.col("game_id").eqNullSafe(F.col("_many"))
    named = F.transform("strata", lambda x: F.struct(x["scope"].alias("scope"), x["key"].alias("key")))
    # a stratum named twice is two rows of one game
    single = own.join(revised, again, "left_anti").select("game_id", *PRED, *REAL, named.alias("_all"), F.posexplode("strata").alias("_at", "_x")).filter(F.col("_x.scope").isNotNull())
    single = single.withColumns({"scope": F.col("_x.scope"), "key": F.col("_x.key"), "_new": F.array_position("_all", F.struct(F.col("_x.scope").alias("scope"), F.col("_x.key").alias("key"))) == F.col("_at") + 1})
    several = by_stratum(own.join(revised, again, "left_semi"), "game_id", *PRED, *REAL)
    count = lambda df, games: df.groupBy("scope", "key").agg(F.count(F.lit(1)).alias("rows"), games.alias("games"), *[F.sum(c).alias(n) for n, c in sums.items()])
    both = count(single, F.count(F.when(F.col("_new"), F.col("game_id")))).unionByName(count(several, F.count_distinct("game_id")))
    return both.groupBy("scope", "key").agg(*[F.sum(n).alias(n) for n in ("rows", "games", *sums)])


def shadow_reconcile(snapshots: DataFrame, results: DataFrame, p: Sequence[str], game: str, order: Sequence[str], keys: Mapping[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Metrics at snapshot grain and at canonical grain (latest snapshot per game), with the duplicate rate and coverage."""
    from tideline.operators.evaluate import classification_metrics

    j = snapshots.join(results, game, "left").withColumns(dict(keys))
    canonical = O.latest_by(j, [game], list(order))
    out = []
    for df in (j, canonical):
        cover = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("snapshots"), F.avg(F.col("y").isNotNull().cast("int")).alias("coverage"))
        out.append(cover.join(classification_metrics(df.filter(F.col("y").isNotNull()), p, "y", list(keys)), list(keys), "left"))
    return out[0], out[1]


def oos_blockers(
    df: DataFrame, p: Sequence[str], y: str, order: Sequence[str], prediction: str = "prediction_time", available: str = "available_at", matched: str = "pit_matched",
    keys: Sequence[str] = ("league",), minimum: int = 100,
) -> DataFrame:
    """``(keys, rows, blockers)``: what keeps a table of out-of-sample predictions from counting as evidence, comma-separated in a fixed order.

    ``order`` is the order in which the rows were delivered; prediction times must not fall along it.  ``matched`` says whether a row met its
    exact availability record; only then can ``available`` verify it."""
    from tideline.operators.timeline import row_features

    t, bad = F.col(prediction), lambda c: c.isNull() | F.isnan(c) | (c < 0) | (c == float("inf"))
    seen = row_features(df, keys, order, 1, lambda w: {"_before": F.lag(prediction).over(w)})
    some = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    invalid = F.lit(False)
    for c in p:
        invalid = invalid | bad(F.col(c).cast("double"))
    flags = seen.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), some(~F.coalesce(F.col(matched), F.lit(False))).alias("_join"), some(t.isNull()).alias("_time"), some(F.col("_before") > t).alias("_order"),
        some(F.col(available).isNull() | t.isNull() | (F.col(available) > t)).alias("_pit"), some(invalid).alias("_p"), some(F.col(y).isNull() | ~F.col(y).isin(list(range(len(p))))).alias("_y"))
    found = [("pit_join_incomplete", F.col("_join")), ("invalid_prediction_time", F.col("_time")), ("oos_not_chronological", F.col("_order") & ~F.col("_time")), ("insufficient_oos_rows", F.col("rows") < minimum),
             ("pit_not_verified", F.col("_pit")), ("invalid_probabilities", F.col("_p")), ("target_contract", F.col("_y"))]
    return flags.select(*keys, "rows", F.concat_ws(",", *[F.when(c, F.lit(n)) for n, c in found]).alias("blockers"))

"""Chronological evaluation: losses, calibration error, conformal sets, bootstrap, thresholds, gates."""

from __future__ import annotations

import itertools
import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions import arrays as A
from tideline.functions.scalars import ratio, reasons
from tideline.operators import ordered as O
from tideline.operators.prob import brier_cols, nll_cols

BINS = 10


def bin_of(conf: Column, bins: int = BINS) -> Column:
    """Equal-width bin, half-open except the last."""
    return F.least(F.floor(conf * bins), F.lit(bins - 1))


def _scored(df: DataFrame, p: Sequence[str], y: str, keep: Sequence[str]) -> DataFrame:
    cols = [F.col(c) for c in p]
    conf, hit = F.greatest(*cols), (A.arg_max_cols(cols) == F.col(y)).cast("int")
    return df.select(*keep, hit.alias("_hit"), conf.alias("_conf"), bin_of(conf).alias("_bin"), nll_cols(cols, F.col(y)).alias("_nll"),
                     brier_cols(cols, F.col(y)).alias("_brier"))


PARTIAL = ("_n", "_hit", "_conf", "_nll", "_brier")


def _partials() -> list[Column]:
    return [F.count(F.lit(1)).alias("_n"), *[F.sum(c).alias(c) for c in PARTIAL[1:]]]


def _finish(binned: DataFrame, keys: Sequence[str]) -> DataFrame:
    n = F.sum("_n")
    return binned.groupBy(*keys).agg(
        n.alias("rows"), (F.sum("_hit") / n).alias("accuracy"), (F.sum("_nll") / n).alias("log_loss"), (F.sum("_brier") / n).alias("brier"),
        (F.sum(F.abs(F.col("_conf") - F.col("_hit"))) / n).alias("ece"))


def classification_metrics(df: DataFrame, p: Sequence[str], y: str, keys: Sequence[str] = ()) -> DataFrame:
    """Rows, accuracy, log loss, multiclass Brier and calibration error per group.

    One shuffle carries at most ten partial rows per group and task; the bins are folded afterwards.
    """
    return _finish(_scored(df, p, y, keys).groupBy(*keys, "_bin").agg(*_partials()), keys)


def performance_hierarchy(df: DataFrame, p: Sequence[str], y: str, levels: Sequence[str]) -> DataFrame:
    """The same bundle at every roll-up level; ``level`` counts how many of the keys are set (real NULL keys stay apart)."""
    scored = _scored(df, p, y, levels)
    sets = [[*levels[:i], "_bin"] for i in range(len(levels), -1, -1)]
    g = scored.groupingSets([[F.col(c) for c in s] for s in sets], *levels, "_bin").agg(*_partials(), F.grouping_id().alias("_g"))
    codes = {sum(1 << (len(levels) - j) for j in range(i, len(levels))): i for i in range(len(levels) + 1)}
    level = F.lit(None).cast("int")
    for code, i in codes.items():
        level = F.when(F.col("_g") == code, i).otherwise(level)
    return _finish(g.withColumn("level", level), ["level", *levels])


def binary_metrics(df: DataFrame, p: Column, y: Column, keys: Sequence[str] = (), eps: float = 1e-9) -> DataFrame:
    """Accuracy, log loss, Brier and positive rate of P(yes)."""
    q = A.clip(p, eps, 1 - eps)
    hit = ((q >= 0.5).cast("int") == y).cast("int")
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), F.avg(hit).alias("accuracy"), F.avg(-(y * F.log(q) + (1 - y) * F.log(1 - q))).alias("log_loss"),
        F.avg(F.pow(q - y, 2.0)).alias("brier"), F.avg(y.cast("double")).alias("positive_rate"))


def score_metrics(df: DataFrame, ph: Column, pa: Column, ah: Column, aa: Column, keys: Sequence[str] = ()) -> DataFrame:
    """Errors of continuous score forecasts, exact and within-one rates."""
    eh, ea, et = F.abs(ph - ah), F.abs(pa - aa), ph + pa - ah - aa
    flag = lambda c: F.avg(c.cast("int"))
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), F.avg(eh).alias("mae_home"), F.avg(ea).alias("mae_away"), F.avg(F.abs(et)).alias("mae_total"),
        F.sqrt(F.avg(et * et)).alias("rmse_total"), flag((F.rint(ph) == ah) & (F.rint(pa) == aa)).alias("exact_rate"),
        flag((eh <= 1) & (ea <= 1)).alias("within_one_rate"))


def top4_metrics(df: DataFrame, scores: Column, probability: Column, actual: Column, keys: Sequence[str] = ()) -> DataFrame:
    top1 = (scores[0] == actual).cast("int")
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), F.avg(top1).alias("top1_hit_rate"), F.avg(F.array_contains(scores, actual).cast("int")).alias("top4_hit_rate"),
        F.avg(F.abs(probability - top1)).alias("top1_probability_mae"))


def horizon_bucket(minutes: Column) -> Column:
    return (F.when(minutes.isNull() | F.isnan(minutes) | (minutes < 0), "UNKNOWN").when(minutes < 30, "LT_30M").when(minutes < 60, "30_TO_60M")
            .when(minutes < 180, "1_TO_3H").when(minutes < 360, "3_TO_6H").otherwise("GE_6H"))


OUTCOMES = ("HOME_WIN", "DRAW", "AWAY_WIN")


def row_evaluation(df: DataFrame, p: Sequence[str], low_high: Column, boundary: int = 7) -> DataFrame:
    """Outcome, correctness, losses and LOW/HIGH verdict of every prediction joined to its result."""
    cols = [F.col(c) for c in p]
    y = F.when(F.col("home_score") > F.col("away_score"), 0).when(F.col("home_score") == F.col("away_score"), 1).otherwise(2)
    label = lambda i: F.array(*[F.lit(o) for o in OUTCOMES])[i]
    top, high = A.arg_max_cols(cols), (F.col("home_score") + F.col("away_score") >= boundary).cast("int")
    guess = (low_high >= 0.5).cast("int")
    return df.withColumns({
        "actual_outcome": label(y), "predicted_outcome": label(top), "outcome_correct": (top == y).cast("int"),
        "log_loss": nll_cols(cols, y), "brier": brier_cols(cols, y), "low_high_actual": high, "low_high_predicted": guess,
        "low_high_correct": (guess == high).cast("int")})


def target_bundle(df: DataFrame, p: Sequence[str], y: str, keys: Sequence[str] = (), thresholds: Sequence[float] = (0.60, 0.70, 0.80, 0.90)) -> DataFrame:
    """Coverage and accuracy above each confidence threshold."""
    cols = [F.col(c) for c in p]
    conf, hit = F.greatest(*cols), (A.arg_max_cols(cols) == F.col(y)).cast("int")
    aggs = [F.count(F.lit(1)).alias("rows")]
    for t in thresholds:
        tag = f"{round(t * 100)}"
        aggs += [F.avg((conf >= t).cast("int")).alias(f"coverage_{tag}"), F.avg(F.when(conf >= t, hit)).alias(f"accuracy_{tag}")]
    return df.groupBy(*keys).agg(*aggs)


def selective_prediction(df: DataFrame, hit: Column, risk: Column, threshold: float = 0.65, keys: Sequence[str] = ()) -> DataFrame:
    ok = risk < threshold
    return df.groupBy(*keys).agg(F.avg(ok.cast("int")).alias("coverage"), F.avg(F.when(ok, hit.cast("int"))).alias("selective_accuracy"))


def baseline_vs_base_rate(df: DataFrame, expected: Column, target: Column, keys: Sequence[str] = ()) -> DataFrame:
    hit = ((expected > 0.5).cast("int") == target).cast("int")
    return df.groupBy(*keys).agg(F.count(target).alias("n_samples"), F.avg(hit).alias("elo_accuracy"), F.avg(target).alias("base_rate"),
                                 (F.avg(hit) - F.avg(target)).alias("elo_improvement"))


def group_leaderboard(df: DataFrame, p: Sequence[str], y: str, key: str) -> DataFrame:
    return classification_metrics(df, p, y, [key])


def condition_accuracy(df: DataFrame, keys: Sequence[str], correct: Column) -> DataFrame:
    """Samples and accuracy per value of each condition, all conditions in one pass."""
    pairs = F.array(*[F.struct(F.lit(k).alias("condition"), F.coalesce(F.col(k).cast("string"), F.lit("unknown")).alias("value")) for k in keys])
    return df.select(correct.cast("int").alias("_c"), F.inline(pairs)).groupBy("condition", "value").agg(
        F.count(F.lit(1)).alias("samples"), F.avg("_c").alias("accuracy"))


def weakness_report(df: DataFrame, keys: Sequence[str], correct: Column, loss: Column, minimum: int = 30, worst: int = 10) -> DataFrame:
    """Worst groups by log loss for each key, groups below the minimum size left out."""
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).cast("string").alias("value")) for k in keys])
    g = df.select(correct.cast("int").alias("_c"), loss.alias("_l"), F.inline(pairs)).groupBy("key", "value").agg(
        F.count(F.lit(1)).alias("rows"), F.avg("_c").alias("accuracy"), F.avg("_l").alias("log_loss")).filter(F.col("rows") >= minimum)
    w = Window.partitionBy("key").orderBy(F.round("log_loss", 12).desc(), "value")
    return g.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= worst)


def period_of(df: DataFrame, keys: Sequence[str], order: Sequence[str], periods: int) -> DataFrame:
    """Chronological block number 0..periods-1 of equal row counts, without a single-task sort."""
    numbered = O.row_numbers(df, keys, order)
    size = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size"))
    both = O.attach(numbered, size, keys) if keys else numbered.withColumn("_one", F.lit(1)).join(size.withColumn("_one", F.lit(1)), "_one").drop("_one")
    return both.withColumn("period", F.floor((F.col("rn") - 1) * periods / F.col("_size")).cast("int")).drop("_size")


def period_losses(df: DataFrame, base: Column, cand: Column, keys: Sequence[str], order: Sequence[str], periods: int = 4) -> DataFrame:
    return period_of(df, keys, order, periods).groupBy(*keys, "period").agg(
        F.count(F.lit(1)).alias("rows"), F.avg(base).alias("baseline_log_loss"), F.avg(cand).alias("candidate_log_loss"))


def objective_priorities(summary: DataFrame, keys: Sequence[str], weakness: Mapping[str, Column]) -> DataFrame:
    """Weakness per objective and the one to focus on (largest, then name)."""
    rows = summary.select(*keys, F.inline(F.array(*[F.struct(F.lit(o).alias("objective"), w.alias("priority")) for o, w in weakness.items()])))
    focus = rows.groupBy(*keys).agg(F.max_by("objective", F.struct(F.round("priority", 12), "objective")).alias("focus"))
    return rows.join(focus, list(keys))


def time_split(df: DataFrame, fractions: Sequence[float], order: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Chronological window number: how many of the cut points ``int(n*fraction)`` the row lies beyond."""
    numbered = O.row_numbers(df, keys, order)
    size = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size"))
    both = O.attach(numbered, size, keys) if keys else numbered.withColumn("_one", F.lit(1)).join(size.withColumn("_one", F.lit(1)), "_one").drop("_one")
    window = A.add([(F.col("rn") > F.floor(F.round(F.col("_size") * f, 9))).cast("int") for f in fractions])
    return both.withColumn("window", window).drop("_size", "rn")


def date_split(df: DataFrame, day: str, fraction: float = 0.70) -> DataFrame:
    """DEV / HOLDOUT by local date: the first share of distinct dates is development."""
    days = df.select(day).distinct()
    numbered = O.row_numbers(days, [], [day], seg=F.trunc(F.col(day).cast("date"), "month"))
    size = days.agg(F.count(F.lit(1)).alias("_d")).withColumn("_one", F.lit(1))
    cut = F.greatest(F.lit(1), F.least(F.col("_d") - 1, F.floor(F.round(F.col("_d") * fraction, 9))))
    side = numbered.withColumn("_one", F.lit(1)).join(size, "_one").select(day, F.when(F.col("rn") <= cut, "DEV").otherwise("HOLDOUT").alias("split"))
    return df.join(side, day)


def draw_threshold_scan(df: DataFrame, day: str, p: str, hit: str, thresholds: Sequence[float], tie: str = "game_id") -> DataFrame:
    """Per threshold: daily top pick at or above it, its hit rate and Brier score.

    The daily pick does not depend on the threshold (it is the day's maximum), so only picks are compared with it.
    """
    pick = O.latest_by(df.select(day, p, hit, tie), [day], [F.col(p), tie])
    trial = pick.select("*", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold")).filter(F.col(p) >= F.col("threshold"))
    return trial.groupBy("threshold").agg(
        F.count(F.lit(1)).alias("slates"), F.avg(hit).alias("hit_rate"), F.avg(F.pow(F.col(p) - F.col(hit), 2.0)).alias("brier"), F.avg(p).alias("mean_probability"))


def conformal_pvalues(cal: DataFrame, test: DataFrame, p: Sequence[str], y: str, qid: str, group: str | None = None, minimum: int = 30) -> DataFrame:
    """``(1 + #{calibration score >= 1-p}) / (n+1)`` per class; a small group falls back to all calibration rows.

    Scores are counted per distinct value before they are ordered; thresholds enter the same running count with weight 0.
    """
    cols = [F.col(c) for c in p]
    hit = cols[-1]
    for i in range(len(p) - 2, -1, -1):
        hit = F.when(F.col(y) == i, cols[i]).otherwise(hit)
    own = F.col(group).cast("string") if group else F.lit("*")
    scores = cal.select(F.explode(F.array_distinct(F.array(own, F.lit("*")))).alias("_grp"), (1.0 - hit).alias("_v"))
    counted = scores.groupBy("_grp", "_v").agg(F.count(F.lit(1)).alias("_c"))
    sizes = counted.groupBy("_grp").agg(F.sum("_c").alias("_size"))
    asked = test.select(qid, own.alias("_own"), *p)
    big = sizes.filter(F.col("_size") >= minimum).select(F.col("_grp").alias("_own"), F.lit(True).alias("_big"))
    asked = asked.join(big, "_own", "left").withColumn("_grp", F.when(F.col("_big"), F.col("_own")).otherwise("*"))
    long = asked.select(qid, "_grp", F.col("_big").isNull().alias("fallback"), F.posexplode(F.array(*[1.0 - c for c in cols])).alias("_cls", "_v"))
    marks = counted.unionByName(long.select("_grp", "_v").distinct().withColumn("_c", F.lit(0).cast("bigint"))).groupBy("_grp", "_v").agg(F.sum("_c").alias("_c"))
    scanned = O.running_sums(marks, ["_grp"], ["_v"], {"_cum": F.col("_c")}, seg=O.value_segment("_v")).select("_grp", "_v", (F.col("_cum") - F.col("_c")).alias("_below"))
    found = long.join(scanned, ["_grp", "_v"]).join(sizes, "_grp")
    pv = found.withColumn("_p", (1.0 + F.col("_size") - F.col("_below")) / (F.col("_size") + 1.0))
    return pv.groupBy(qid).agg(F.max("fallback").alias("fallback"), *[F.max(F.when(F.col("_cls") == i, F.col("_p"))).alias(f"pv{i}") for i in range(len(p))])


def prediction_set(pv: DataFrame, k: int, alpha: float = 0.10) -> DataFrame:
    """Set size and SINGLE / SET / ABSTAIN action from p-values (NULL p-values belong to no set)."""
    inside = [F.coalesce((F.col(f"pv{i}") > alpha).cast("int"), F.lit(0)) for i in range(k)]
    size = A.add(inside)
    labels = F.array_compact(F.array(*[F.when(c == 1, F.lit(i)) for i, c in enumerate(inside)]))
    return pv.withColumns({"set": F.concat_ws(",", labels.cast("array<string>")), "set_size": size,
                           "action": F.when(size == 0, "ABSTAIN").when(size == 1, "SINGLE").otherwise("SET")})


def set_metrics(df: DataFrame, y: str, top: Column, keys: Sequence[str] = ()) -> DataFrame:
    single = F.col("set_size") == 1
    covered = F.array_contains(F.split("set", ","), F.col(y).cast("string"))
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_test"), F.avg(covered.cast("int")).alias("set_coverage"), F.avg("set_size").alias("mean_set_size"),
        F.avg(single.cast("int")).alias("singleton_rate"), F.avg(F.when(single, (top == F.col(y)).cast("int"))).alias("singleton_accuracy"),
        F.avg((F.col("set_size") == 0).cast("int")).alias("empty_rate"))


def quantile_conformal(cal: DataFrame, test: DataFrame, p: Sequence[str], y: str, alpha: float = 0.10) -> DataFrame:
    """Sets above a "higher" quantile of the calibration scores; the arg max always belongs to the set."""
    cols = [F.col(c) for c in p]
    hit = cols[-1]
    for i in range(len(p) - 2, -1, -1):
        hit = F.when(F.col(y) == i, cols[i]).otherwise(hit)
    counts = cal.select((1.0 - hit).alias("_v")).groupBy("_v").agg(F.count(F.lit(1)).alias("_c"))
    scanned = O.running_sums(counts, [], ["_v"], {"_cum": F.col("_c")}, seg=O.value_segment("_v"))
    n = counts.agg(F.sum("_c").alias("_n")).withColumn("_one", F.lit(1))
    level = F.least(F.lit(1.0), F.ceil((F.col("_n") + 1) * (1.0 - alpha)) / F.col("_n"))
    rank = F.ceil(F.round(level * (F.col("_n") - 1), 9))
    cut = scanned.withColumn("_one", F.lit(1)).join(n, "_one").agg(F.min(F.when(F.col("_cum") > rank, F.col("_v"))).alias("threshold")).withColumn("_one", F.lit(1))
    out = test.withColumn("_one", F.lit(1)).join(cut, "_one").drop("_one")
    top = A.arg_max_cols(cols)
    inside = [((c >= 1.0 - F.col("threshold") - 1e-12) | (top == i)).cast("int") for i, c in enumerate(cols)]
    labels = F.array_compact(F.array(*[F.when(c == 1, F.lit(str(i))) for i, c in enumerate(inside)]))
    return out.withColumns({"set": F.concat_ws(",", labels), "set_size": A.add(inside)})


def walk_forward_conformal(df: DataFrame, p: Sequence[str], y: str, qid: str, keys: Sequence[str], pred_time: str, mature_at: str,
                           alpha: float = 0.10, minimum: int = 30) -> DataFrame:
    """One conformal set per case from all earlier cases matured by its prediction time; a case counts only after it was predicted,
    so none calibrates on its own outcome.

    Counting matured scores above a threshold is a range count on the maturity axis, see
    :func:`tideline.operators.ordered.range_counts`.
    """
    cols = [F.col(c) for c in p]
    hit = cols[-1]
    for i in range(len(p) - 2, -1, -1):
        hit = F.when(F.col(y) == i, cols[i]).otherwise(hit)
    facts = df.select(*keys, F.greatest(F.col(mature_at), F.col(pred_time) + F.expr("INTERVAL 0.000001 SECOND")).alias("_ts"), (1.0 - hit).alias("_score"))
    # cases of the same key, time and probabilities ask the same
    same = [*keys, pred_time, *p]
    asks = df.select(*same).distinct().select(*same, F.posexplode(F.array(*[1.0 - c for c in cols], F.lit(-1.0))).alias("_cls", "_lo"))
    asks = asks.withColumns({"_ts": F.col(pred_time), "_hi": F.lit(2.0)})
    counts = O.range_counts(facts, asks, keys, "_ts", "_score", "_lo", "_hi", {"n": F.lit(1)})
    parts = O.attach(asks, counts, [*keys, "_ts", "_lo", "_hi"])
    wide = parts.groupBy(*same).agg(*[F.max(F.when(F.col("_cls") == i, F.col("n"))).alias(f"_n{i}") for i in range(len(p) + 1)])
    wide = O.attach(df.select(qid, *same), wide, same)
    n = F.col(f"_n{len(p)}")
    pv = wide.select(qid, n.alias("calibration_count"), *[F.when(n >= minimum, (1.0 + F.col(f"_n{i}")) / (n + 1.0)).alias(f"pv{i}") for i in range(len(p))])
    return prediction_set(pv, len(p), alpha)


def check_temporal_contract(cal: DataFrame, test: DataFrame) -> DataFrame:
    """One row of verdicts: calibration strictly before test, outcomes matured, inputs available in time."""
    c = cal.agg(F.max("prediction_time").alias("_cmax"), F.max("outcome_at").alias("_omax"), F.count(F.lit(1)).alias("calibration_rows"),
                F.max((F.col("available_at") > F.col("prediction_time")).cast("int")).alias("_late"),
                F.max((F.col("outcome_at") < F.col("prediction_time")).cast("int")).alias("_early")).withColumn("_one", F.lit(1))
    t = test.agg(F.min("prediction_time").alias("_tmin"), F.count(F.lit(1)).alias("test_rows"),
                 F.max((F.col("available_at") > F.col("prediction_time")).cast("int")).alias("_tlate")).withColumn("_one", F.lit(1))
    bad = reasons(("calibration_not_before_test", F.col("_cmax") >= F.col("_tmin")), ("calibration_input_late", F.col("_late") == 1),
                  ("outcome_before_prediction", F.col("_early") == 1), ("outcome_not_matured", F.col("_omax") >= F.col("_tmin")), ("test_input_late", F.col("_tlate") == 1))
    return c.join(t, "_one").select("calibration_rows", "test_rows", F.concat_ws(",", bad).alias("violations"))


#: Shares of Poisson(1) draws of at most 0, 1, 2, ... as far as 32 bits tell them apart.
POISSON = [sum(math.exp(-1) / math.factorial(i) for i in range(j + 1)) for j in range(12)]


def paired_block_bootstrap(df: DataFrame, base: Mapping[str, Column], cand: Mapping[str, Column], order: Sequence[str], block: int = 30,
                           replications: int = 400, seed: int = 42) -> DataFrame:
    """Confidence limits of metric differences from resampled chronological blocks.

    Rows are reduced to per-block sums first.  In each replicate a block counts a Poisson(1) number of times, read off a digest of
    (seed, replicate, block), so every block folds its share into all replicates by itself and only one partial sum per
    replicate and task is shuffled; sums are divided by the rows drawn.
    """
    numbered = O.row_numbers(df, [], order)
    diffs = {n: F.sum(base[n] - cand[n]).alias(n) for n in base}
    blocks = numbered.groupBy(F.floor((F.col("rn") - 1) / block).alias("_b")).agg(F.count(F.lit(1)).alias("_n"), *diffs.values())
    drawn = blocks.select("*", F.explode(F.sequence(F.lit(1), F.lit(replications))).alias("_rep"))
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col("_rep").cast("string"), F.lit(":"), F.col("_b").cast("string")))
    drawn = drawn.withColumn("_u", F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / 4294967296.0)
    drawn = drawn.withColumn("_m", A.add([(F.col("_u") >= c).cast("bigint") for c in POISSON]))
    reps = drawn.groupBy("_rep").agg(*[(F.sum(F.col(n) * F.col("_m")) / F.nullif(F.sum(F.col("_n") * F.col("_m")), F.lit(0))).alias(n) for n in base])
    long = reps.select(F.inline(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("v")) for n in base])))
    return long.groupBy("metric").agg(F.count(F.lit(1)).alias("replications"), F.percentile("v", F.lit(0.025)).alias("ci_low"), F.percentile("v", F.lit(0.975)).alias("ci_high"),
                                      F.avg((F.col("v") > 0).cast("int")).alias("p_improvement_positive"))


def disagreement(df: DataFrame, members: Mapping[str, Sequence[str]]) -> DataFrame:
    """Class agreement, entropy and mean pairwise distances of member probabilities, row by row (no self join)."""
    vecs = {m: A.vec(*c) for m, c in members.items()}
    k, n = len(next(iter(members.values()))), len(members)
    mean = [A.add([F.col(c[i]) for c in members.values()]) / n for i in range(k)]
    top = A.arg_max_cols(mean)
    agree = A.add([(A.arg_max_cols([F.col(x) for x in c]) == top).cast("double") for c in members.values()]) / n
    entropy = -A.add([m * F.log(F.greatest(m, F.lit(A.EPS))) for m in mean])
    pairs = list(itertools.combinations(members, 2))
    average = lambda f: A.add([f(vecs[a], vecs[b]) for a, b in pairs]) / len(pairs)
    return df.withColumns({
        "class_agreement": agree, "disagreement": 1.0 - agree, "entropy": entropy, "pair_l1": average(A.total_variation), "pair_l2": average(A.l2),
        "pair_js": average(A.js), "pair_kl": average(A.kl), "pair_cosine_distance": average(lambda a, b: 1.0 - A.cosine(a, b))})


def member_spread(df: DataFrame, members: Mapping[str, Sequence[str]], data_quality: Column, shift: Column, information: Column) -> DataFrame:
    """Uncertainty parts: member variance, entropy, mean absolute deviation, data, shift, information, and their sum."""
    k, n = len(next(iter(members.values()))), len(members)
    mean = [A.add([F.col(c[i]) for c in members.values()]) / n for i in range(k)]
    var = A.add([A.add([F.pow(F.col(c[i]) - mean[i], 2.0) for c in members.values()]) / n for i in range(k)]) / k
    dev = A.add([A.add([F.abs(F.col(c[i]) - mean[i]) for c in members.values()]) for i in range(k)]) / (k * n)
    parts = {"model_uncertainty": var, "entropy_uncertainty": -A.add([m * F.log(F.greatest(m, F.lit(A.EPS))) for m in mean]), "disagreement_uncertainty": dev,
             "data_uncertainty": 1.0 - A.clip(data_quality, 0.0, 1.0), "shift_uncertainty": A.clip(shift, 0.0, 1.0), "information_uncertainty": A.clip(information, 0.0, 1.0)}
    return df.withColumns({**parts, "total_uncertainty": A.add(list(parts.values()))})


def predictability(p: Sequence[Column], stability: Column, quality: Column, regime: Column, drift: Column, information: Column) -> Column:
    """Weighted predictability, separate from confidence."""
    import math

    h = -A.add([c * F.log(F.greatest(c, F.lit(A.EPS))) for c in p]) / math.log(len(p))
    unit = lambda c: A.clip(c, 0.0, 1.0)
    return unit(0.30 * (1 - h) + 0.15 * F.greatest(*p) + 0.20 * stability + 0.15 * unit(quality) + 0.10 * unit(regime)
                + 0.05 * (1 - unit(drift)) + 0.05 * (1 - unit(information)))


def predictability_calibration(df: DataFrame, score: Column, correct: Column, keys: Sequence[str] = (), minimum: int = 5) -> DataFrame:
    """Five-bin gap between mean predictability and realised correctness."""
    b = df.select(*keys, bin_of(score, 5).alias("bin"), score.alias("_s"), correct.cast("int").alias("_c"))
    return b.groupBy(*keys, "bin").agg(
        F.count(F.lit(1)).alias("n"), F.avg("_s").alias("mean_predictability"), F.avg("_c").alias("empirical_accuracy"),
        (F.avg("_c") - F.avg("_s")).alias("calibration_gap")).withColumn("eligible", F.col("n") >= minimum)


def predictability_series(df: DataFrame, p: Sequence[str], y: str, qid: str, keys: Sequence[str], ts: str, band: float = 0.10, prior: float = 10.0) -> DataFrame:
    """Smoothed accuracy of earlier cases with similar confidence (strictly earlier in time)."""
    cols = [F.col(c) for c in p]
    conf = F.greatest(*cols)
    facts = df.select(*keys, F.col(ts).alias("_ts"), conf.alias("_conf"), (A.arg_max_cols(cols) == F.col(y)).cast("int").alias("_ok"))
    asks = df.select(*keys, F.col(ts).alias("_ts"), qid, (conf - band).alias("_lo"), (conf + band).alias("_hi"))
    c = O.prior_range_counts(facts, asks, keys, "_ts", "_conf", "_lo", "_hi", qid, {"history_count": F.lit(1), "_hits": F.col("_ok")}, inclusive=False)
    return c.select(qid, "history_count", ((F.col("_hits") + prior / len(p)) / (F.col("history_count") + prior)).alias("history_accuracy"))


def ablation(df: DataFrame, variants: Mapping[str, Sequence[Column]], y: str, baseline: str) -> DataFrame:
    """Metrics of every variant and their difference from the baseline variant."""
    k = len(variants[baseline])
    long = df.select(y, F.inline(F.array(*[F.struct(F.lit(n).alias("variant"), *[c.alias(f"p{i}") for i, c in enumerate(cs)]) for n, cs in variants.items()])))
    m = classification_metrics(long, [f"p{i}" for i in range(k)], y, ["variant"])
    names = ("accuracy", "log_loss", "brier", "ece")
    base = m.filter(F.col("variant") == baseline).select(F.lit(1).alias("_one"), *[F.col(c).alias(f"_{c}") for c in names])
    return m.withColumn("_one", F.lit(1)).join(base, "_one").select("variant", "rows", *names, *[(F.col(c) - F.col(f"_{c}")).alias(f"delta_{c}") for c in names])


def error_attribution(df: DataFrame, signals: Mapping[str, Column]) -> DataFrame:
    """Ranked diagnostic signals; the primary one is the largest (ties by name)."""
    unit = lambda c: A.clip(c, 0.0, 1.0)
    pairs = F.array(*[F.struct(F.round(unit(c), 12).alias("v"), F.lit(n).alias("n")) for n, c in signals.items()])
    ranked = F.sort_array(pairs, asc=False)
    return df.withColumns({"primary": ranked[0]["n"], "primary_score": ranked[0]["v"], "ranking": F.concat_ws(",", F.transform(ranked, lambda x: x["n"]))})


# The promotion policy.
GATE_POLICY = {"min_rows": 200, "min_relative_log_loss": 0.03, "min_relative_brier": 0.01, "accuracy_target": 0.80, "max_accuracy_regression": 0.005}


# Bounds on the further evidence of a candidate.
EVIDENCE_POLICY = {"min_windows": 2, "min_ci_lower": 0.0, "min_positive_probability": 0.95, "min_periods": 2, "min_non_worse_fraction": 0.70,
                   "max_log_loss_regression": 0.005, "max_brier_regression": 0.005, "max_score_mae_regression": 0.0}


def candidate_gate(df: DataFrame, policy: Mapping[str, float] = GATE_POLICY, evidence: Sequence[str] = (),
                   bounds: Mapping[str, float] = EVIDENCE_POLICY) -> DataFrame:
    """Promotion verdict per candidate row ``(rows, base_*, cand_*)`` with the reasons that block it; NULL metrics block.

    ``evidence`` names further groups that must hold, each failing closed on NULL: ``rows`` (base_rows), ``windows`` (validation_windows),
    ``calibration`` (calibration_ok), ``pit`` (development_pit_ok, holdout_pit_ok), ``uncertainty`` (ci_lower, p_positive), ``periods``
    (periods, non_worse_periods), ``regression`` (tolerances on log loss and Brier) and ``score`` (base_score_mae, cand_score_mae).
    """
    rel = lambda m: ratio(F.col(f"base_{m}") - F.col(f"cand_{m}"), F.col(f"base_{m}"))
    missing = F.lit(False)
    for m in ("log_loss", "brier", "accuracy", "ece"):
        missing = missing | F.col(f"base_{m}").isNull() | F.col(f"cand_{m}").isNull()
    unless = lambda ok: ~F.coalesce(ok, F.lit(False))
    more = lambda m: F.col(f"cand_{m}") - F.col(f"base_{m}")
    further = {
        "rows": lambda: [("baseline_candidate_row_mismatch", unless(F.col("base_rows") == F.col("rows")))],
        "windows": lambda: [("insufficient_validation_windows", unless(F.col("validation_windows") >= bounds["min_windows"]))],
        "calibration": lambda: [("calibration_check_failed", unless(F.col("calibration_ok")))],
        "pit": lambda: [("development_pit_evidence_not_verified", unless(F.col("development_pit_ok"))), ("holdout_pit_evidence_not_verified", unless(F.col("holdout_pit_ok")))],
        "uncertainty": lambda: [("improvement_interval_failed", unless(F.col("ci_lower") > bounds["min_ci_lower"])),
                                ("improvement_probability_failed", unless(F.col("p_positive") >= bounds["min_positive_probability"]))],
        "periods": lambda: [("insufficient_evaluation_periods", unless(F.col("periods") >= bounds["min_periods"])),
                            ("too_few_periods_not_worse", unless(F.col("non_worse_periods") >= bounds["min_non_worse_fraction"] * F.col("periods")))],
        "regression": lambda: [("log_loss_regression", unless(more("log_loss") <= bounds["max_log_loss_regression"])), ("brier_regression", unless(more("brier") <= bounds["max_brier_regression"]))],
        "score": lambda: [("score_mae_regression", unless(more("score_mae") <= bounds["max_score_mae_regression"]))],
    }
    why = reasons(
        ("insufficient_locked_holdout_rows", F.col("rows") < policy["min_rows"]), ("non_finite_metric", missing),
        ("log_loss_improvement_too_small", rel("log_loss") < policy["min_relative_log_loss"]),
        ("brier_improvement_too_small", rel("brier") < policy["min_relative_brier"]),
        ("accuracy_regression", F.col("base_accuracy") - F.col("cand_accuracy") > policy["max_accuracy_regression"]), ("calibration_regression", F.col("cand_ece") > F.col("base_ece")),
        *[rule for name in evidence for rule in further[name]()])
    return df.withColumn("reasons", F.concat_ws(",", why)).withColumn("adopt", F.size(why) == 0)


def revision_value(prev: Sequence[Column], new: Sequence[Column], y: Column) -> dict[str, Column]:
    old, now = nll_cols(prev, y), nll_cols(new, y)
    shift = A.add([F.abs(a - b) for a, b in zip(prev, new, strict=True)]) / 2
    return {"old_logloss": old, "new_logloss": now, "logloss_improvement": old - now, "revision_better": now < old, "shift": shift}


def class_metrics(df: DataFrame, p: Sequence[str], y: str, index: int, keys: Sequence[str] = ()) -> DataFrame:
    """Recall and probability error of one class."""
    cols = [F.col(c) for c in p]
    real = (F.col(y) == index).cast("int")
    hit = ((A.arg_max_cols(cols) == index) & (F.col(y) == index)).cast("int")
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), (F.sum(hit) / F.greatest(F.lit(1), F.sum(real))).alias("recall"),
                                 F.avg(F.abs(cols[index] - real)).alias("probability_mae"))


def revision_metrics(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Revision rate, size and reversal share; the median is exact and counted by distinct value."""
    revised = F.col("revision_status") == "REVISED"
    base = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("eligible_rows"), F.sum(revised.cast("int")).alias("revised_rows"), F.avg(revised.cast("int")).alias("revision_rate"),
        F.avg(F.when(revised, F.col("revision_outcome_changed").cast("int"))).alias("outcome_reversal_rate"), F.avg(F.when(revised, F.col("revision_l1"))).alias("mean_l1"),
        F.max(F.when(revised, F.col("revision_l1"))).alias("maximum_l1"))
    med = O.exact_quantiles(df.filter(revised), keys, "revision_l1", {"median_l1": 0.5})
    return O.attach(base, med, keys) if keys else base.withColumn("_one", F.lit(1)).join(med.withColumn("_one", F.lit(1)), "_one", "left").drop("_one")


def timing_metrics(df: DataFrame, start: str, generated: str, cutoff: str, keys: Sequence[str] = (), required: float = 30.0) -> DataFrame:
    """On-time rate against the required lead, and lead statistics."""
    known = df.filter(F.col(start).isNotNull() & F.col(generated).isNotNull() & F.col(cutoff).isNotNull())
    lead = (F.unix_micros(start) - F.unix_micros(generated)) / 60e6
    planned = (F.unix_micros(start) - F.unix_micros(cutoff)) / 60e6
    k = known.withColumns({"_lead": lead, "_planned": planned})
    base = k.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("eligible_rows"), F.sum((F.col("_lead") >= required).cast("int")).alias("on_time_rows"), F.avg((F.col("_lead") >= required).cast("int")).alias("compliance_rate"),
        F.min("_lead").alias("min_lead"), F.max("_lead").alias("max_lead"), F.sum((F.col("_planned") < required).cast("int")).alias("scheduled_below_required"))
    return O.attach(base, O.exact_quantiles(k, keys, "_lead", {"median_lead": 0.5}), keys)

"""Probability tables: blending, calibration, routing, ranking, market lines."""

from __future__ import annotations

import itertools
import math

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions import arrays as A
from tideline.functions.scalars import reasons
from tideline.operators import ordered as O
from tideline.session import materialize

# 81 geometric temperatures from 0.35 to 6, and the fallback intensities.
TEMPERATURES = [0.35 * (6.0 / 0.35) ** (i / 80.0) for i in range(81)]
FALLBACK_LAMBDA = {"three_way": 2.35, "two_way": 4.55}


def nll_cols(p: Sequence[Column], y: Column, eps: float = 1e-12) -> Column:
    """-log of the probability of the realised class, from separate columns."""
    hit = p[-1]
    for i in range(len(p) - 2, -1, -1):
        hit = F.when(y == i, p[i]).otherwise(hit)
    return -F.log(F.least(F.greatest(hit, F.lit(eps)), F.lit(1.0)))


def brier_cols(p: Sequence[Column], y: Column) -> Column:
    return A.add([F.pow(c - F.when(y == i, 1.0).otherwise(0.0), 2.0) for i, c in enumerate(p)])


def temper_cols(p: Sequence[Column], t: Column | float, eps: float = 1e-15) -> list[Column]:
    inv = (F.lit(1.0) / t) if isinstance(t, Column) else F.lit(1.0 / t)
    raised = [F.pow(F.greatest(c, F.lit(eps)), inv) for c in p]
    total = A.add(raised)
    return [r / total for r in raised]


def fit_temperature(df: DataFrame, p: Sequence[str], y: str, keys: Sequence[str] = (), grid: Sequence[float] = TEMPERATURES, n: str | None = None) -> DataFrame:
    """Temperature with the smallest log loss per group (the first one among equals).

    The grid is unfolded inside the task and averaged with map-side combine, so the shuffle carries one row per group
    and temperature. ``n`` names a column of how many equal rows a row stands for.
    """
    logs = [F.log(F.greatest(F.col(c), F.lit(1e-15))).alias(f"_l{i}") for i, c in enumerate(p)]
    trial = df.select(*keys, y, (F.lit(1) if n is None else F.col(n)).alias("_n"), *logs).select("*", F.explode(F.array(*[F.lit(float(t)) for t in grid])).alias("t"))
    scaled = [F.col(f"_l{i}") / F.col("t") for i in range(len(p))]
    hit = scaled[-1]
    for i in range(len(p) - 2, -1, -1):
        hit = F.when(F.col(y) == i, scaled[i]).otherwise(hit)
    # -log softmax(log p / t)[y], never beyond -log(1e-15)
    loss = F.least(F.log(A.add([F.exp(x) for x in scaled])) - hit, F.lit(-math.log(1e-15)))
    scored = trial.select(*keys, "t", "_n", loss.alias("loss"))
    mean = F.avg("loss") if n is None else F.sum(F.col("loss") * F.col("_n")) / F.sum(F.when(F.col("loss").isNotNull(), F.col("_n")))
    losses = scored.groupBy(*keys, "t").agg(mean.alias("loss"))
    return losses.groupBy(*keys).agg(F.min_by("t", F.struct("loss", "t")).alias("temperature"), F.min("loss").alias("log_loss"))


def calibration_report(df: DataFrame, p: Sequence[str], y: str, temperature: Column, keys: Sequence[str] = ()) -> DataFrame:
    cols = [F.col(c) for c in p]
    raw, cal = nll_cols(cols, F.col(y), 1e-15), nll_cols(temper_cols(cols, temperature), F.col(y), 1e-15)
    return df.groupBy(*keys).agg(
        F.avg(raw).alias("raw_logloss"), F.avg(cal).alias("calibrated_logloss"), (F.avg(raw) - F.avg(cal)).alias("improvement"),
        F.count(F.lit(1)).alias("rows"))


def blend_cols(members: Sequence[Sequence[Column]], weights: Sequence[Column | float], mode: str = "linear") -> list[Column]:
    """Weighted mixture or geometric pool of class columns, renormalised; one row in, one row out."""
    w = [F.greatest(x if isinstance(x, Column) else F.lit(float(x)), F.lit(0.0)) for x in weights]
    z = A.add(w)
    classes = list(zip(*members, strict=True))
    floor = lambda c: F.greatest(c, F.lit(1e-12))
    if mode == "linear":
        raw = [A.add([wi / z * floor(c) for wi, c in zip(w, cls, strict=True)]) for cls in classes]
    elif mode == "log_pool":
        raw = [F.exp(A.add([wi / z * F.log(floor(c)) for wi, c in zip(w, cls, strict=True)])) for cls in classes]
    else:
        raise ValueError(f"unknown blend mode: {mode}")
    total = A.add(raw)
    return [r / total for r in raw]


def blend_long(preds: DataFrame, weight: str, keys: Sequence[str], p: Sequence[str]) -> DataFrame:
    """Linear blend of long predictions (one row per member): a grouped weighted sum."""
    sums = preds.groupBy(*keys).agg(*[F.sum(F.col(weight) * F.col(c)).alias(c) for c in p])
    total = A.add([F.col(c) for c in p])
    return sums.select(*keys, *[(F.col(c) / total).alias(c) for c in p])


def weight_grid(n: int, step: float) -> list[tuple[float, ...]]:
    """All weight vectors on the simplex with the given step."""
    units = round(1.0 / step)
    return [tuple(c / units for c in combo) for combo in itertools.product(range(units + 1), repeat=n) if sum(combo) == units]


def top_models(preds: DataFrame, p: Sequence[str], y: str, k: int = 3) -> DataFrame:
    """Members with the smallest log loss, ties by name."""
    losses = preds.groupBy("model").agg(F.avg(nll_cols([F.col(c) for c in p], F.col(y))).alias("log_loss"))
    return losses.orderBy("log_loss", "model").limit(k)


def fit_blend(df: DataFrame, members: Mapping[str, Sequence[str]], y: str, step: float = 0.25,
              grid: Sequence[float] = TEMPERATURES) -> dict:
    """Individually calibrated, constrained blend: the fitted numbers (one per member, plus the final temperature).

    Only grid averages reach the driver: one temperature per member, then one loss per (weights, temperature). Equal rows are one before
    the grids are unfolded, weighted by their number.
    """
    names = list(members)
    same = df.groupBy(y, *dict.fromkeys(c for m in names for c in members[m])).agg(F.count(F.lit(1)).alias("_same"))
    # few rows and much work on each: dealt out by number, which adaptive execution leaves alone
    same = materialize(same.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    p = [f"p{i}" for i in range(len(members[names[0]]))]
    long = same.select(y, "_same", F.inline(F.array(*[
        F.struct(F.lit(m).alias("model"), *[F.col(c).alias(x) for c, x in zip(members[m], p, strict=True)]) for m in names])))
    long = long.groupBy("model", y, *p).agg(F.sum("_same").alias("_same"))
    temps = {r["model"]: r["temperature"] for r in fit_temperature(long, p, y, ["model"], grid, "_same").collect()}
    calibrated = [temper_cols([F.col(c) for c in members[m]], temps[m]) for m in names]
    weights = weight_grid(len(names), step)
    w = F.array(*[F.struct(*[F.lit(x).alias(f"w{i}") for i, x in enumerate(v)]) for v in weights])
    wide = same.select(y, "_same", *[c.alias(f"_{m}_{i}") for m, cs in zip(names, calibrated, strict=True) for i, c in enumerate(cs)])
    mixed = wide.select("*", F.inline(w))
    k = len(members[names[0]])
    blended = blend_cols([[F.col(f"_{m}_{i}") for i in range(k)] for m in names], [F.col(f"w{i}") for i in range(len(names))])
    wcols = [f"w{i}" for i in range(len(names))]
    fitted = fit_temperature(mixed.select(y, "_same", *wcols, *[c.alias(f"b{i}") for i, c in enumerate(blended)]), [f"b{i}" for i in range(k)], y, wcols, grid, "_same")
    uniform = A.add([F.pow(F.col(c) - 1.0 / len(names), 2.0) for c in wcols])
    used = A.add([(F.col(c) > 0).cast("int") for c in wcols])
    best = fitted.orderBy(F.round("log_loss", 12), uniform, used, *wcols).limit(1).first()
    return {"models": names, "temperatures": [temps[m] for m in names], "weights": [best[c] for c in wcols],
            "final_temperature": best["temperature"], "log_loss": best["log_loss"]}


def apply_blend(spec: Mapping, members: Mapping[str, Sequence[str]]) -> list[Column]:
    """Class columns of a frozen blend; needs no labels."""
    parts = [temper_cols([F.col(c) for c in members[m]], t) for m, t in zip(spec["models"], spec["temperatures"], strict=True)]
    return temper_cols(blend_cols(parts, spec["weights"]), spec["final_temperature"])


def class_scale(p: Sequence[Column], index: int, m: Column | float) -> list[Column]:
    """Multiply one class and renormalise."""
    raw = [c * m if i == index else c for i, c in enumerate(p)]
    total = A.add(raw)
    return [r / total for r in raw]


def run_means(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg("home_score").alias("mean_home"), F.avg("away_score").alias("mean_away"))


def shared_lambda(df: DataFrame, h: Column, a: Column, keys: Sequence[str] = (), minimum: int = 25, cap: float = 1.25) -> DataFrame:
    """Mean product of residuals within 0..cap; 0 below the minimum number of rows."""
    n = F.count(h * a)
    return df.groupBy(*keys).agg(n.alias("n"), F.when(n >= minimum, A.clip(F.avg(h * a), 0.0, cap)).otherwise(0.0).alias("shared_lambda"))


def dispersion(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Method-of-moments size of a negative binomial; 1e6 (Poisson) when there is no over-dispersion or too little data."""
    mu, var, n = F.avg(value), F.var_samp(value), F.count(value)
    size = F.when((n < 8) | (var <= mu + 1e-9), 1e6).otherwise(A.clip(F.try_divide(mu * mu, var - mu), 0.25, 1e6))
    return df.groupBy(*keys).agg(mu.alias("mu"), size.alias("size"))


def market_threshold(line: Column) -> tuple[Column, Column]:
    """Largest LOW total and smallest HIGH total; an integer line leaves a gap of one for PUSH."""
    whole = line == F.floor(line)
    low = F.when(whole, line - 1).otherwise(F.floor(line))
    return low.cast("double"), F.when(whole, line + 1).otherwise(F.floor(line) + 1).cast("double")


def classify_total(total: Column, line: Column) -> Column:
    return F.when(total == line, "PUSH").when(total < line, "LOW").otherwise("HIGH")


def line_usable(df: DataFrame, cutoff: Column) -> DataFrame:
    """Contract violations of a market line and whether it may be used at the cutoff."""
    line, obs, avail, status = F.col("line"), F.col("observed_at"), F.col("available_at"), F.col("status")
    bad = reasons(
        ("status_invalid", ~status.isin("KNOWN", "MISSING", "UNAVAILABLE", "UNVERIFIABLE")),
        ("line_missing", (status == "KNOWN") & line.isNull()), ("line_out_of_range", (line < 0) | (line > 100)),
        ("line_not_half_point", F.abs(line * 2 - F.rint(line * 2)) > 1e-9), ("availability_missing", (status == "KNOWN") & avail.isNull()),
        ("available_before_observed", avail < obs))
    ok = (F.size("reasons") == 0) & (status == "KNOWN") & line.isNotNull() & (obs <= cutoff) & (avail <= cutoff)
    return df.withColumn("reasons", bad).withColumn("usable", F.coalesce(ok, F.lit(False)))


def low_high_labels(total: Column, line: float = 7.5) -> tuple[Column, Column]:
    """Realised LOW and HIGH flags, NULL exactly on the line."""
    on = total == line
    return F.when(~on, (total < line).cast("int")), F.when(~on, (total > line).cast("int"))


MIXES = ("TOP1", "TOP2_INVLOSS", "TOP3_INVLOSS", "TOP3_UNIFORM", "TOP3_POWER_0.5", "TOP3_POWER_1.5", "TOP3_POWER_2.0")
SHARED_SCALES = (0.0, 0.25, 0.5, 0.75, 1.0, 1.25)
MEAN_SHRINKS = (0.0, 0.05, 0.1, 0.2, 0.3)


def mix_weights(losses: Sequence[float], mode: str) -> list[float]:
    """Member weights of one mixing mode from member losses."""
    order = sorted(range(len(losses)), key=lambda i: (losses[i], i))
    if mode == "TOP1":
        return [1.0 if i == order[0] else 0.0 for i in range(len(losses))]
    if mode == "TOP3_UNIFORM":
        return [1.0 / len(losses)] * len(losses)
    keep = set(order[:2]) if mode == "TOP2_INVLOSS" else set(order)
    power = float(mode.rsplit("_", 1)[1]) if "POWER" in mode else 1.0
    raw = [max(x, 1e-9) ** -power if i in keep else 0.0 for i, x in enumerate(losses)]
    return [r / sum(raw) for r in raw]


def mix_variants(df: DataFrame, members: Mapping[str, tuple[str, str]], scales: Sequence[float] = SHARED_SCALES,
                 shrinks: Sequence[float] = MEAN_SHRINKS, modes: Sequence[str] = MIXES) -> DataFrame:
    """Score error of every (mix, shared scale, shrink) variant from one aggregate over the games.

    Member losses and the training means are one aggregate row; the games are then read once more, with one output row
    per mix and shrink (the shared scale changes the joint shape, not the means, so it is unfolded afterwards).
    """
    mae = lambda h, a: F.avg((F.abs(F.col(h) - F.col("home_score")) + F.abs(F.col(a) - F.col("away_score"))) / 2)
    stats = df.agg(*[mae(h, a).alias(m) for m, (h, a) in members.items()], F.avg("home_score").alias("mh"), F.avg("away_score").alias("ma"),
                   F.avg((F.col("home_score") - F.col("lam_h")) * (F.col("away_score") - F.col("lam_a"))).alias("cov")).first()
    losses = [stats[m] for m in members]
    variants = []
    for mode in modes:
        w = mix_weights(losses, mode)
        for s in shrinks:
            variants.append(F.struct(F.lit(mode).alias("model_mix"), F.lit(s).alias("mean_shrink"), *[F.lit(x).alias(f"w{i}") for i, x in enumerate(w)]))
    trial = df.select("home_score", "away_score", *[c for pair in members.values() for c in pair], F.inline(F.array(*variants)))
    lam = lambda side: A.add([F.col(f"w{i}") * A.clip(F.col(pair[side]), 0.05, 15.0) for i, pair in enumerate(members.values())])
    shrink = F.col("mean_shrink")
    lh = (1 - shrink) * lam(0) + shrink * F.lit(stats["mh"])
    la = (1 - shrink) * lam(1) + shrink * F.lit(stats["ma"])
    err = (F.abs(lh - F.col("home_score")) + F.abs(la - F.col("away_score"))) / 2
    scored = trial.groupBy("model_mix", "mean_shrink").agg(F.avg(err).alias("score_mae"))
    base = min(max(stats["cov"], 0.0), 1.25)
    return scored.select("model_mix", "mean_shrink", F.explode(F.array(*[F.lit(x) for x in scales])).alias("shared_scale"), "score_mae").withColumn(
        "shared", F.col("shared_scale") * base)


def variant_ranking(variants: DataFrame, metric: str, name: Column) -> DataFrame:
    """Best variant, number of finite ones, spread."""
    v = F.col(metric)
    finite = v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    good = variants.filter(finite)
    return good.agg(F.min_by(name, F.struct(F.round(v, 12), name)).alias("best_variant"), F.count(F.lit(1)).alias("finite_variant_count"),
                    (F.max(v) - F.min(v)).alias("primary_spread"))


def regime_labels(train: DataFrame, df: DataFrame, signals: Mapping[str, str], low: float = 0.33, high: float = 0.67) -> DataFrame:
    """``s_e_m`` keys from training quantile buckets of each signal; ``signals`` maps prefix to column."""
    out = df.withColumn("_one", F.lit(1))
    parts = []
    for prefix, col in signals.items():
        q = O.exact_quantiles(train, [], col, {f"_{prefix}_lo": low, f"_{prefix}_hi": high}).withColumn("_one", F.lit(1))
        out = out.join(q, "_one")  # one row: the two thresholds
        parts.append(F.concat(F.lit(prefix), F.when(F.col(col) < F.col(f"_{prefix}_lo"), 0).when(F.col(col) < F.col(f"_{prefix}_hi"), 1).otherwise(2)))
    drop = [f"_{p}_{e}" for p in signals for e in ("lo", "hi")]
    return out.withColumn("regime", F.concat_ws("_", *parts)).drop("_one", *drop)


def regime_weights(losses: DataFrame, minimum: int = 35, shrinkage: float = 80.0, edge: float = 0.03, power: float = 1.0) -> DataFrame:
    """Inverse-loss weights per regime from per-row member losses ``(regime, model, loss)``.

    Regime losses are shrunk to the global ones; the global weights apply unless the regime is large enough and its best
    adjusted loss beats the global best by the edge.
    """
    per = losses.groupBy("regime", "model").agg(F.sum("loss").alias("_s"), F.count(F.lit(1)).alias("_n"))
    overall = per.groupBy("model").agg((F.sum("_s") / F.sum("_n")).alias("_g"))
    j = per.join(overall, "model").withColumn("_a", F.col("_n") / (F.col("_n") + shrinkage)).withColumn(
        "_adj", F.col("_a") * F.col("_s") / F.col("_n") + (1 - F.col("_a")) * F.col("_g"))
    w = Window.partitionBy("regime")  # one row per member
    best, best_global = F.min("_adj").over(w), F.min("_g").over(w)
    special = (F.col("_n") >= minimum) & ((best_global - best) / F.greatest(best_global, F.lit(1e-9)) >= edge)
    used = j.withColumn("_used", F.when(special, F.col("_adj")).otherwise(F.col("_g"))).withColumn("_inv", 1 / F.pow(F.greatest("_used", F.lit(1e-6)), power))
    return used.select("regime", "model", F.col("_n").alias("rows"), (F.col("_inv") / F.sum("_inv").over(w)).alias("weight"))


def member_correlations(df: DataFrame, values: Mapping[str, Column], overlap: bool = False) -> DataFrame:
    """Pairwise correlation of per-row member columns in one aggregate over the games (undefined counts as 0)."""
    pairs = list(itertools.combinations(values, 2))
    aggs = [F.corr(values[a].cast("double"), values[b].cast("double")).alias(f"c{i}") for i, (a, b) in enumerate(pairs)]
    if overlap:
        aggs += [F.avg(((values[a] == 1) & (values[b] == 1)).cast("double")).alias(f"o{i}") for i, (a, b) in enumerate(pairs)]
    one = df.agg(*aggs)
    clean = lambda c: F.when(F.isnan(c) | c.isNull(), 0.0).otherwise(c)
    rows = [F.struct(F.lit(f"{a}::{b}").alias("pair"), clean(F.col(f"c{i}")).alias("correlation"),
                     *([F.col(f"o{i}").alias("overlap")] if overlap else [])) for i, (a, b) in enumerate(pairs)]
    return one.select(F.inline(F.array(*rows)))


def error_redundancy(correlations: DataFrame) -> DataFrame:
    """Mean correlation of each member with the others, within 0..1."""
    ends = correlations.select(F.explode(F.split("pair", "::")).alias("model"), "correlation")
    return ends.groupBy("model").agg(A.clip(F.avg("correlation"), 0.0, 1.0).alias("redundancy"))


def routing_weights(members: DataFrame, keys: Sequence[str], predictability: Column, disagreement: Column, concentration: float = 3.0) -> DataFrame:
    """Soft-max of -loss -1.5*risk +0.35*fit with a temperature from predictability and a small floor."""
    w = Window.partitionBy(*keys)  # one row per member
    temp = 0.35 + 0.9 * (1.0 - A.clip(predictability, 0.0, 1.0)) + F.when(disagreement > 0.35, 0.35).otherwise(0.0)
    score = (-F.col("loss") - 1.5 * A.clip(F.col("risk"), 0.0, 1.0) + 0.35 * F.col("fit")) / (temp * concentration)
    a = members.withColumn("_s", score)
    b = a.withColumn("_e", F.exp(F.col("_s") - F.max("_s").over(w)))
    n = F.count(F.lit(1)).over(w)
    floor = F.least(0.04 / n, 0.25 / n)
    return b.withColumn("weight", floor + (1.0 - floor * n) * F.col("_e") / F.sum("_e").over(w)).drop("_s", "_e")


def blend_run_share(lh: Column, la: Column, p_home: Column, p_away: Column, weight: float = 0.25) -> tuple[Column, Column]:
    """Move the run share toward the classifier's, within 0.15..0.85, keeping the total."""
    total = F.greatest(lh + la, F.lit(1e-6))
    share = (1 - weight) * lh / total + weight * p_home / F.greatest(p_home + p_away, F.lit(1e-9))
    share = A.clip(share, 0.15, 0.85)
    return total * share, total * (1 - share)


def structural_lambdas(h_gf: Column, h_ga: Column, a_gf: Column, a_ga: Column, mean_h: Column, mean_a: Column, h_fip: Column, a_fip: Column) -> tuple[Column, Column]:
    """Attack and defence intensities pulled to the means, adjusted for the opposing starter, within 0.8..6."""
    attack_h, attack_a = 0.65 * h_gf + 0.35 * mean_h, 0.65 * a_gf + 0.35 * mean_a
    against_h, against_a = 0.65 * a_ga + 0.35 * mean_h, 0.65 * h_ga + 0.35 * mean_a
    lh = (0.52 * attack_h + 0.48 * against_h) * F.exp(0.07 * (a_fip - 4.0)) * 1.035
    la = (0.52 * attack_a + 0.48 * against_a) * F.exp(0.07 * (h_fip - 4.0))
    return A.clip(lh, 0.8, 6.0), A.clip(la, 0.8, 6.0)


def fallback_lambdas(lh: Column, la: Column, draw_capable: Column) -> tuple[Column, Column]:
    base = F.when(draw_capable, FALLBACK_LAMBDA["three_way"]).otherwise(FALLBACK_LAMBDA["two_way"])
    return F.coalesce(lh, base), F.coalesce(la, base)


def shifted(p: Sequence[Column], shift: Column) -> list[Column]:
    """First class up, last class down, floored at 1e-6 and renormalised."""
    raw = [F.greatest(c + shift if i == 0 else c - shift if i == len(p) - 1 else c, F.lit(1e-6)) for i, c in enumerate(p)]
    total = A.add(raw)
    return [r / total for r in raw]


def scenario_forecast(df: DataFrame, p: Sequence[str], shifts: Mapping[str, float]) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(n).alias("scenario"), F.lit(float(s)).alias("_shift")) for n, s in shifts.items()])
    wide = df.select("*", F.inline(rows))
    return wide.withColumns({f"s_{c}": e for c, e in zip(p, shifted([F.col(c) for c in p], F.col("_shift")), strict=True)}).withColumn(
        "weight", F.lit(1.0 / len(shifts))).drop("_shift")


def prediction_trajectory(df: DataFrame, p: Sequence[str], momentum: Column, horizons: Sequence[int]) -> DataFrame:
    wide = df.select("*", F.explode(F.array(*[F.lit(h) for h in horizons])).alias("horizon"))
    drift = momentum * (1.0 - F.exp(-0.18 * F.col("horizon")))
    return wide.withColumns({f"t_{c}": e for c, e in zip(p, shifted([F.col(c) for c in p], drift), strict=True)})


def confidence(p: Sequence[Column]) -> tuple[Column, Column]:
    """Margin between the two largest probabilities and its HIGH / MEDIUM / LOW label."""
    ordered = F.sort_array(F.array(*p), asc=False)
    top, margin = ordered[0], ordered[0] - ordered[1]
    label = F.when((top >= 0.65) & (margin >= 0.15), "HIGH").when((top >= 0.55) & (margin >= 0.08), "MEDIUM").otherwise("LOW")
    return margin, label


def rank_events(df: DataFrame, keys: Sequence[str], home: str, draw: str, away: str, id_col: str = "game_id", seg: Column | None = None) -> DataFrame:
    """Winner ranking per slate: the larger of home and away (home on ties), descending, then id."""
    margin, label = confidence([F.col(home), F.col(draw), F.col(away)])
    tagged = df.withColumns({
        "winner": F.when(F.col(home) >= F.col(away), "home").otherwise("away"), "winner_probability": F.greatest(home, away),
        "confidence_margin": margin, "confidence_status": label})
    coarse = -F.floor(F.col("winner_probability") * 64) if seg is None else seg
    return O.row_numbers(tagged, keys, [F.col("winner_probability").desc(), F.col(id_col)], seg=coarse, out="winner_rank")


def top_k_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """First ``k`` rows per key; Spark limits each partition before the shuffle, so a hot key sends at most ``k`` per task."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= k)


def candidate_select(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Candidate with the best ``gain - cost - 0.5*risk`` per key, only when that is positive."""
    value = F.col("gain") - F.col("cost") - 0.5 * F.col("risk")
    best = df.withColumn("value", value).groupBy(*keys).agg(
        F.max_by("name", F.struct("value", "name")).alias("_name"), F.max("value").alias("_value"))
    return best.select(*keys, F.when(F.col("_value") > 0, F.col("_name")).alias("selected"), F.greatest("_value", F.lit(0.0)).alias("expected_net_value"))


def due_events(schedule: DataFrame, archived: DataFrame, key: str, now: Column, min_lead: float, scan_ahead: float) -> DataFrame:
    """Future events inside the lead window that have no archived prediction yet."""
    lead = (F.unix_micros("start_at") - F.unix_micros(now)) / 60e6
    inside = schedule.withColumn("lead_minutes", lead).filter((F.col("lead_minutes") > min_lead) & (F.col("lead_minutes") <= scan_ahead))
    return inside.join(archived.select(key), key, "left_anti")


def half_inning_baseline(games: DataFrame, label: str, keys: Sequence[str] = (), prior: float = 12.0, classes: int = 3) -> DataFrame:
    """Prior class probabilities before each instant from all earlier games, shrunk to uniform."""
    sums = {f"_c{i}": (F.col(label) == i).cast("int") for i in range(classes)}
    past = O.prior_sums(games, keys, "ts", sums)
    total = A.add([F.col(f"_c{i}") for i in range(classes)])
    return past.select(*keys, "ts", *[((F.col(f"_c{i}") + prior / classes) / (total + prior)).alias(f"prior_{i}") for i in range(classes)])



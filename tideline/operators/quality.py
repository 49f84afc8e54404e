"""Data quality, drift, and point-in-time audits: one aggregate row, or one row per violation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions import arrays as A
from tideline.functions.scalars import reasons
from tideline.operators import ordered as O

EPS = 1e-12


def _undefined(c: str, kind: str) -> Column:
    missing = F.col(c).isNull()
    return missing | F.isnan(c) if kind in ("double", "float") else missing


def data_quality(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Missing, duplicate and non-finite rates, score and PASS / WARN."""
    kinds = {f.name: f.dataType.typeName() for f in df.schema}
    cols = list(kinds)
    numeric = [c for c in cols if kinds[c] in ("double", "float", "integer", "long", "short", "byte")]
    missing = F.sum(A.add([_undefined(c, kinds[c]).cast("int") for c in cols]))
    # a NULL number is not finite either
    nonfinite = F.sum(A.add([(_undefined(c, kinds[c]) | F.coalesce(F.abs(F.col(c).cast("double")) == float("inf"), F.lit(False))).cast("int") for c in numeric])) if numeric else F.lit(0)
    one = df.agg(F.count(F.lit(1)).alias("rows"), missing.alias("_m"), nonfinite.alias("_x")).withColumn("_one", F.lit(1))
    distinct = df.groupBy(*keys).agg(F.lit(1).alias("_u")).agg(F.count(F.lit(1)).alias("_d")).withColumn("_one", F.lit(1))
    out = one.join(distinct, "_one").select(
        "rows", F.lit(len(cols)).alias("columns"), (F.col("_m") / (F.col("rows") * len(cols))).alias("missing_rate"), (1 - F.col("_d") / F.col("rows")).alias("duplicate_rate"),
        (F.col("_x") / (F.col("rows") * max(1, len(numeric)))).alias("nonfinite_rate"))
    score = A.clip(1.0 - 0.45 * F.col("missing_rate") - 0.30 * F.col("duplicate_rate") - 0.25 * F.col("nonfinite_rate"), 0.0, 1.0)
    return out.withColumn("score", score).withColumn("status", F.when(F.col("score") >= 0.80, "PASS").otherwise("WARN"))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Exact duplicate rows with their count, counted before the shuffle."""
    return df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")


def table_quality(df: DataFrame, numeric: Sequence[str], others: Sequence[str] = ()) -> DataFrame:
    """Per column: missing share, and the share beyond 5 IQR of the index quartiles (20 values or more)."""
    long = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v"), F.col(c).isNull().cast("int").alias("m")) for c in numeric],
                                      *[F.struct(F.lit(c).alias("column"), F.lit(None).cast("double").alias("v"), F.col(c).isNull().cast("int").alias("m")) for c in others])))
    counts = long.groupBy("column", "v").agg(F.count(F.lit(1)).alias("_n"), F.sum("m").alias("_m"))
    values = counts.filter(F.col("v").isNotNull())
    scanned = O.running_sums(values, ["column"], ["v"], {"_cum": F.col("_n")}, seg=O.value_segment("v"))
    size = counts.groupBy("column").agg(F.sum("_n").alias("rows"), F.sum("_m").alias("missing"), F.sum(F.when(F.col("v").isNotNull(), F.col("_n")).otherwise(0)).alias("_known"))
    j = scanned.join(size.select("column", "_known"), "column")
    quart = j.groupBy("column").agg(F.min(F.when(F.col("_cum") > F.floor(F.col("_known") / 4), F.col("v"))).alias("_q1"),
                                    F.min(F.when(F.col("_cum") > F.floor(3 * F.col("_known") / 4), F.col("v"))).alias("_q3"))
    iqr = F.col("_q3") - F.col("_q1")
    far = values.join(quart, "column").groupBy("column").agg(F.sum(F.when((iqr > 0) & ((F.col("v") < F.col("_q1") - 5 * iqr) | (F.col("v") > F.col("_q3") + 5 * iqr)), F.col("_n")).otherwise(0)).alias("_far"))
    out = size.join(far, "column", "left")
    share = F.coalesce(F.try_divide(F.col("_far"), F.col("_known")), F.lit(0.0))
    return out.select("column", "rows", "missing", (F.col("missing") / F.col("rows") > 0.20).alias("missing_over_20pct"), F.coalesce("_far", F.lit(0)).alias("outliers"),
                      ((F.col("_known") >= 20) & (share > 0.10)).alias("outliers_over_10pct"))


def feature_reliability(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Completeness, finite share of what is known, and stability per column combined into one score.

    NaN counts as missing. Infinite values lower the finite share; mean and deviation are then undefined, and such a column gets the
    score of no stability.
    """
    known = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in features}
    finite_only = {c: F.when(F.abs(x) < float("inf"), x) for c, x in known.items()}
    one = df.agg(F.count(F.lit(1)).alias("_n"), *[a for c in features for a in (
        F.count(known[c]).alias(f"{c}_k"), F.count(finite_only[c]).alias(f"{c}_f"), F.avg(finite_only[c]).alias(f"{c}_m"), F.stddev_pop(finite_only[c]).alias(f"{c}_s"))])
    rows = []
    for c in features:
        k, m, s = F.col(f"{c}_k"), F.col(f"{c}_m"), F.col(f"{c}_s")
        variability = F.when((k < 3) | (F.col(f"{c}_f") < k), 1.0).otherwise(A.clip(s / F.greatest(F.abs(m), F.lit(1.0)), 0.0, 1.0))
        finite = F.when(k > 0, F.col(f"{c}_f") / k).otherwise(0.0)
        rows.append(F.struct(F.lit(c).alias("feature"), A.clip(0.45 * k / F.col("_n") + 0.35 * finite + 0.20 * (1.0 - variability * 0.35), 0.0, 1.0).alias("reliability")))
    return one.select(F.inline(F.array(*rows)))


def source_reliability(success: Column, freshness: Column, consistency: Column, latency: Column) -> Column:
    return A.clip(0.35 * success + 0.25 * freshness + 0.25 * consistency + 0.15 * (1.0 - A.clip(latency, 0.0, 1.0)), 0.0, 1.0)


def combined_reliability(c: Mapping[str, Column]) -> Column:
    """Weighted reliability dimensions without outcomes (drift counts against)."""
    return A.clip(0.30 * c["reliability"] + 0.15 * c["freshness"] + 0.20 * c["completeness"] + 0.20 * c["consistency"] + 0.15 * (1.0 - c["drift"]), 0.0, 1.0)


def _moments(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    one = df.agg(*[a for c in columns for a in (F.count(c).alias(f"{c}_n"), F.avg(c).alias(f"{c}_mu"), F.stddev_pop(c).alias(f"{c}_sd"))])
    return one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"{c}_n").alias("n"), F.col(f"{c}_mu").alias("mu"), F.col(f"{c}_sd").alias("sd")) for c in columns])))


def drift(reference: DataFrame, current: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean shift in reference deviations over three, per feature, with the overall score and status on every row."""
    r, c = _moments(reference, columns), _moments(current, columns).withColumnsRenamed({"n": "n2", "mu": "mu2", "sd": "sd2"})
    j = r.join(c, "feature").filter("n >= 3 AND n2 >= 3")
    per = j.select("feature", A.clip(F.abs(F.col("mu2") - F.col("mu")) / (F.col("sd") + EPS) / 3.0, 0.0, 1.0).alias("drift"))
    total = per.agg(F.avg("drift").alias("score")).withColumn("_one", F.lit(1))
    return per.withColumn("_one", F.lit(1)).join(total, "_one").select("feature", "drift", "score", F.when(F.col("score") >= 0.33, "WARN").otherwise("PASS").alias("status"))


def ood(rows: DataFrame, reference: DataFrame, columns: Sequence[str], out: str = "ood") -> DataFrame:
    """Mean absolute z score over five against reference moments (one joined row of numbers)."""
    stats = reference.agg(*[a for c in columns for a in (F.avg(c).alias(f"_{c}_mu"), (F.stddev_pop(c) + EPS).alias(f"_{c}_sd"))]).withColumn("_one", F.lit(1))
    j = rows.withColumn("_one", F.lit(1)).join(stats, "_one")
    z = A.add([F.abs(F.col(c) - F.col(f"_{c}_mu")) / F.col(f"_{c}_sd") for c in columns]) / len(columns)
    return j.withColumn(out, A.clip(z / 5.0, 0.0, 1.0)).select(*rows.columns, out)


def regime_state(volatility: Column, trend: Column, shock: Column) -> Column:
    moving = F.abs(trend) >= 0.20
    return (F.when(shock >= 0.75, "information_shock").when((volatility >= 0.75) & moving, "high_vol_trend").when(volatility >= 0.75, "high_volatility")
            .when(moving, "trend").when(volatility <= 0.20, "low_volatility").otherwise("range"))


def violations(df: DataFrame, ids: Sequence[str], rules: Mapping[str, Column]) -> DataFrame:
    """One row per broken rule."""
    return df.select(*ids, F.explode(reasons(*rules.items())).alias("violation"))


SUSPICIOUS = ("actual", "outcome", "result", "final", "postgame", "future", "settled")


def pit_audit(df: DataFrame, ids: Sequence[str], prediction: str = "prediction_time", available: str = "available_at", label: str | None = None) -> DataFrame:
    """Row blockers of the point-in-time contract."""
    p, a = F.col(prediction), F.col(available)
    rules = {"invalid_prediction_time": p.isNull(), "available_at_missing": p.isNotNull() & a.isNull(), "available_at_after_prediction": a > p}
    if label:
        rules["label_available_before_or_at_prediction"] = F.col(label) <= p
    return violations(df, ids, rules)


def suspicious_columns(columns: Sequence[str], allowed: Sequence[str] = ("prediction_time", "available_at")) -> list[str]:
    """Column names that hint at postgame information (plan-time check)."""
    return sorted({c for c in columns if c not in allowed and any(t in c.lower() for t in SUSPICIOUS)})


def assert_no_future(df: DataFrame, cutoff: Column, available: str = "available_at") -> DataFrame:
    """The same rows; any availability after the cutoff fails the query."""
    late = F.coalesce(F.col(available) > cutoff, F.lit(False))
    return df.withColumn(available, F.when(late, F.raise_error(F.lit("row available after cutoff")).cast("timestamp")).otherwise(F.col(available)))


def availability_rules(side: str) -> dict[str, Column]:
    """Ordering rules of one side's announcement, publication, availability, retrieval and cutoff."""
    g = lambda n: F.col(f"{side}_starter_{n}")
    named = F.coalesce(F.col(f"{side}_starter"), F.lit("")) != ""
    cutoff, retrieved = F.col("prediction_cutoff"), F.col("retrieved_at")
    effective = F.when(g("announced_at").isNotNull(), F.coalesce(g("available_at"), g("announced_at")))
    return {
        f"{side}_announcement_unknown": g("announced_at").isNull() & (named | g("published_at").isNotNull() | g("available_at").isNotNull()),
        f"{side}_announced_after_cutoff": g("announced_at") > cutoff, f"{side}_announced_after_retrieval": g("announced_at") > retrieved,
        f"{side}_available_after_cutoff": effective > cutoff, f"{side}_available_after_retrieval": effective > retrieved,
        f"{side}_published_after_retrieval": g("published_at") > retrieved, f"{side}_published_after_announcement": g("published_at") > g("announced_at"),
        f"{side}_published_after_cutoff": g("published_at") > cutoff}


# States a line-up may be in.
LINEUP_STATES = ("CONFIRMED", "UNCONFIRMED", "UNAVAILABLE", "UNVERIFIABLE")


def validate_availability(df: DataFrame, ids: Sequence[str], states: Sequence[str] = LINEUP_STATES) -> DataFrame:
    rules = {"event_id_missing": F.col("event_id").isNull(), "retrieved_after_cutoff": F.col("retrieved_at") > F.col("prediction_cutoff")}
    rules["team_missing"] = (F.coalesce("home_team", F.lit("")) == "") | (F.coalesce("away_team", F.lit("")) == "")
    rules["lineup_status_invalid"] = ~F.coalesce(F.upper("lineup_status").isin(*states), F.lit(False))
    rules["revision_after_cutoff"] = F.col("revision_time") > F.col("prediction_cutoff")
    rules["revision_after_retrieval"] = F.col("revision_time") > F.col("retrieved_at")
    for side in ("home", "away"):
        rules.update(availability_rules(side))
    rules["lineup_not_pit_safe"] = (F.col("lineup_announced_at") > F.col("prediction_cutoff")) | (F.col("lineup_announced_at") > F.col("retrieved_at"))
    rules["confirmed_without_time"] = (F.upper("lineup_status") == "CONFIRMED") & F.col("lineup_announced_at").isNull()
    return violations(df, ids, rules)


def eligibility(df: DataFrame, official: Column, production_ok: Column, start: str = "event_start_at", cutoff: str = "prediction_cutoff") -> DataFrame:
    """Eligible flag and reasons: starters announced, event still ahead, official source, registry state."""
    why = []
    for side in ("home", "away"):
        named = F.coalesce(F.col(f"{side}_starter"), F.lit("")) != ""
        why += [(f"{side}_starter_not_confirmed", ~named), (f"{side}_starter_announcement_time_unverified", named & F.col(f"{side}_starter_announced_at").isNull())]
    why += [("event_start_time_missing", F.col(start).isNull()), ("event_already_started_or_not_future", F.col(start) <= F.col(cutoff)),
            ("starter_source_not_official", ~official), ("competition_not_production_eligible", ~production_ok)]
    codes = reasons(*why)
    return df.withColumn("reasons", F.concat_ws(",", codes)).withColumn("eligible", F.size(codes) == 0)


def validate_snapshots(df: DataFrame, leagues: Sequence[str], statuses: Sequence[str], ids: Sequence[str] = ("event_id",)) -> DataFrame:
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) == ""
    return violations(df, ids, {
        "identity_missing": blank("event_id") | blank("entity_id") | blank("source"), "league_unknown": ~F.col("league").isin(*leagues), "status_invalid": ~F.col("status").isin(*statuses),
        "retrieved_at_missing": F.col("retrieved_at").isNull(), "source_after_retrieval": F.col("source_timestamp") > F.col("retrieved_at"),
        "available_after_retrieval": F.col("available_at") > F.col("retrieved_at")})


def validate_ledger(df: DataFrame, ids: Sequence[str], times: Sequence[str], level: str | None = None, announced: str | None = None) -> DataFrame:
    """Text timestamps must be ISO with an offset; availability not after retrieval; evidence levels need their timestamp."""
    from tideline.functions.scalars import strict_timestamp

    rules = {f"{t}_not_iso_with_offset": F.col(t).isNotNull() & (F.trim(t) != "") & strict_timestamp(F.col(t)).isNull() for t in times}
    if {"available_at", "retrieved_at"} <= set(times):
        rules["available_after_retrieval"] = strict_timestamp(F.col("available_at")) > strict_timestamp(F.col("retrieved_at"))
    if level and announced:
        rules["announcement_without_timestamp"] = (F.upper(level) == "OFFICIAL_ANNOUNCEMENT") & F.col(announced).isNull()
    return violations(df, ids, rules)


def validate_predictions(df: DataFrame, ids: Sequence[str], p: Sequence[str], candidates: str = "candidates") -> DataFrame:
    cols = [F.col(c) for c in p]
    probs = F.transform(candidates, lambda c: c["probability"])
    falls = F.exists(F.sequence(F.lit(1), F.greatest(F.size(probs) - 1, F.lit(1))), lambda i: F.get(probs, i) > F.get(probs, i - 1))
    return violations(df, ids, {
        "probabilities_do_not_sum_to_one": F.abs(A.add(cols) - 1.0) > 1e-8, "probability_out_of_bounds": (F.least(*cols) < 0) | (F.greatest(*cols) > 1),
        "candidate_order": falls, "candidate_count": F.size(candidates) != 4, "created_before_cutoff": F.col("created_at") < F.col("cutoff"),
        "low_high_sum": F.abs(F.col("low") + F.col("high") - 1.0) > 1e-8})


def audit_prediction_store(df: DataFrame, key: str, required: Sequence[str], order: Sequence[tuple[str, str]]) -> DataFrame:
    """Counts of missing required fields, duplicate ids and broken time orders."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) == ""
    one = df.agg(F.count(F.lit(1)).alias("rows"), *[F.sum(blank(c).cast("int")).alias(f"missing_{c}") for c in required],
                 *[F.sum(F.coalesce((F.col(a) > F.col(b)).cast("int"), F.lit(0))).alias(f"{a}_after_{b}") for a, b in order]).withColumn("_one", F.lit(1))
    dup = df.groupBy(key).agg((F.count(F.lit(1)) - 1).alias("_x")).agg(F.sum("_x").alias("duplicate_ids")).withColumn("_one", F.lit(1))
    return one.join(dup, "_one").drop("_one")


def validate_targets(df: DataFrame, key: str, home: str, away: str, keys: Sequence[str] = ()) -> DataFrame:
    """Row, bad-score, duplicate and class counts per group."""
    h, a = F.col(home).cast("double"), F.col(away).cast("double")
    bad = h.isNull() | a.isNull() | F.isnan(h) | F.isnan(a) | (h < 0) | (a < 0)
    dup = df.groupBy(*keys, key).agg(F.count(F.lit(1)).alias("_c"), F.sum(bad.cast("int")).alias("_b"), F.sum((h > a).cast("int")).alias("_w"), F.sum((h == a).cast("int")).alias("_d"), F.sum((h < a).cast("int")).alias("_l"))
    return dup.groupBy(*keys).agg(F.sum("_c").alias("rows"), F.sum("_b").alias("bad_scores"), F.sum(F.col("_c") - 1).alias("duplicate_ids"), F.sum("_w").alias("home_wins"),
                                  F.sum("_d").alias("draws"), F.sum("_l").alias("away_wins"))


def adaptive_compute(predictability: Column, uncertainty: Column, failure: Column, ood_score: Column) -> tuple[Column, Column]:
    # ten digits decide a threshold, so that sums of short decimals land on the side they mean
    difficulty = F.round(A.clip(0.35 * (1.0 - predictability) + 0.25 * uncertainty + 0.25 * failure + 0.15 * ood_score, 0.0, 1.0), 10)
    level = (F.when((ood_score >= 0.90) | (uncertainty >= 0.92), "ABSTAIN").when(difficulty >= 0.70, "DEEP_COMPUTE").when(difficulty >= 0.45, "ENSEMBLE_RETRIEVAL").otherwise("STANDARD"))
    return difficulty, level


def prediction_policy(predictability: Column, ood_score: Column, failure: Column, information: Column, tail: Column) -> Column:
    return (F.when((ood_score >= 0.85) | (tail >= 0.90), "ABSTAIN").when(predictability <= 0.20, "SCENARIO").when(failure >= 0.75, "DEEP_COMPUTE")
            .when(information >= 0.05, "ADD_INFORMATION").when(predictability <= 0.42, "RETRIEVAL").otherwise("RECOMPUTE"))


def revision_policy(shift: Column, used: Column, budget: int) -> Column:
    return (F.when(((used >= budget) & (shift < 0.15)) | (shift < 0.03), "MAINTAIN").when(shift < 0.12, "MINOR_REVISION").otherwise("MAJOR_REVISION"))


def probability_safety(df: DataFrame, p: Sequence[str], keys: Sequence[str], order: Sequence[str], max_jump: float) -> DataFrame:
    """Rows whose probabilities leave [0, 1], do not sum to one, or jump too far from the previous row."""
    spread, w = O.blocks(O.row_numbers(df, keys, order), keys)
    jump = F.greatest(*[F.abs(F.col(c) - F.lag(c).over(w)) for c in p])
    out = O.drop_halo(spread.withColumn("jump", jump))
    cols = [F.col(c) for c in p]
    ok = (F.least(*cols) >= 0) & (F.greatest(*cols) <= 1) & (F.abs(A.add(cols) - 1) <= 1e-6) & (F.coalesce("jump", F.lit(0.0)) <= max_jump)
    return out.withColumn("safe", ok).drop("rn")


def maturity_contract(df: DataFrame, keys: Sequence[str], order: Sequence[str], prediction: str, outcome: str, seg: Column | None = None) -> DataFrame:
    """Counts of prediction times out of order and outcomes before their prediction."""
    spread, w = O.blocks(O.row_numbers(df, keys, order, seg), keys)
    back = (F.lag(prediction).over(w) > F.col(prediction)).cast("int")
    rows = O.drop_halo(spread.withColumn("_back", back))
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("_back"), F.lit(0)).alias("out_of_order"), F.sum((F.col(outcome) < F.col(prediction)).cast("int")).alias("outcome_before_prediction"))


def prediction_set_valid(values: Column, classes: Sequence[str]) -> Column:
    """Non-empty, unique, and only known classes."""
    known = F.array(*[F.lit(c) for c in classes])
    return (F.size(values) > 0) & (F.size(F.array_distinct(values)) == F.size(values)) & (F.size(F.array_except(values, known)) == 0)

"""Joins with declared cardinality, score repair, name resolution, neighbour votes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.operators import ordered as O
from tideline.session import stored


def unique_or_fail(df: DataFrame, keys: Sequence[str], what: str = "join key") -> DataFrame:
    """One row per key, or a failed query; the check is an aggregate with map-side combine inside the plan."""
    rest = [c for c in df.columns if c not in keys]
    checked = F.when(F.col("_n") == 1, F.col("_row")).otherwise(
        F.raise_error(F.concat(F.lit(f"duplicate {what}: "), F.concat_ws(",", *[F.col(k).cast("string") for k in keys]))))
    grouped = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct(*rest)).alias("_row"))
    return grouped.select(*keys, checked.alias("_row")).select(*keys, "_row.*")


def equi_left(left: DataFrame, right: DataFrame, keys: Sequence[str], cardinality: str = "many_to_one") -> DataFrame:
    """Left join whose declared cardinality is enforced on the checked sides."""
    right = unique_or_fail(right, keys, "right key")
    if cardinality == "one_to_one":
        left = unique_or_fail(left, keys, "left key")
    return left.join(right, list(keys), "left")


def reconcile(pred: DataFrame, result: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Full outer one-to-one match; ``match_status`` says which side is missing (never a silent miss)."""
    p = unique_or_fail(pred, keys, "prediction").withColumn("_p", F.lit(True))
    r = unique_or_fail(result, keys, "result").withColumn("_r", F.lit(True))
    status = (F.when(F.col("_p").isNull(), "RESULT_ONLY").when(F.col("_r").isNull(), "PREDICTION_ONLY").otherwise("MATCHED"))
    return p.join(r, list(keys), "full_outer").withColumn("match_status", status).drop("_p", "_r")


def semi_official(games: DataFrame, schedule: DataFrame, keys: Sequence[str]) -> DataFrame:
    return games.join(schedule.select(*keys), list(keys), "left_semi")


def repair_scores(games: DataFrame, official: DataFrame, secondary: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Local, then official, then secondary score; a game left without one fails the query."""
    def renamed(df: DataFrame, tag: str) -> DataFrame:
        return unique_or_fail(df, keys, tag).select(*keys, F.col("home_score").alias(f"{tag}_h"), F.col("away_score").alias(f"{tag}_a"))

    j = games.join(renamed(official, "official"), list(keys), "left").join(renamed(secondary, "secondary"), list(keys), "left")
    h = F.coalesce("home_score", "official_h", "secondary_h")
    a = F.coalesce("away_score", "official_a", "secondary_a")
    source = (F.when(F.col("home_score").isNotNull() & F.col("away_score").isNotNull(), "local")
              .when(F.col("official_h").isNotNull() & F.col("official_a").isNotNull(), "official").otherwise("secondary"))
    fail = F.raise_error(F.concat(F.lit("unresolved score: "), F.concat_ws(",", *[F.col(k).cast("string") for k in keys])))
    return j.withColumns({
        "score_source": source,
        "home_score": F.when(h.isNotNull(), h).otherwise(fail.cast("int")),
        "away_score": F.when(a.isNotNull(), a).otherwise(fail.cast("int")),
    }).drop("official_h", "official_a", "secondary_h", "secondary_a")


def score_conflicts(df: DataFrame, key: str, home: str, away: str) -> DataFrame:
    """One row per game, flagged when it carries more than one score (min and max instead of distinct counts)."""
    return df.filter(F.col(home).isNotNull() & F.col(away).isNotNull()).groupBy(key).agg(
        F.min(home).alias("home_score"), F.min(away).alias("away_score"),
        ((F.min(home) != F.max(home)) | (F.min(away) != F.max(away))).alias("conflict"))


def hour_join(left: DataFrame, hourly: DataFrame, keys: Sequence[str], left_ts: str, right_ts: str, order: Sequence[str]) -> DataFrame:
    """Left join on key and hour, keeping the last series row of an hour."""
    hour = hourly.withColumn("_hour", F.date_trunc("hour", right_ts)).drop(right_ts)
    last = O.latest_by(hour, [*keys, "_hour"], order)
    return left.withColumn("_hour", F.date_trunc("hour", left_ts)).join(last, [*keys, "_hour"], "left").drop("_hour")


def revised_games(history: DataFrame, game: str) -> DataFrame:
    """The games with more than one row."""
    return stored(history.groupBy(game).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(game), "revised")


def told_apart(history: DataFrame, targets: DataFrame, game: str, at: str, mature_at: str) -> DataFrame:
    """Hashes ``_h`` of the games with more than one row, or with a target that sees a row of its own game; a colliding game may be among them.
    Only hash and time of a row move."""
    here = F.xxhash64(game).alias("_h")
    rows = history.select(here, F.lit(1).alias("_n"), F.col(mature_at).alias("_m")).unionByName(
        targets.select(here, F.col(at).alias("_at")), allowMissingColumns=True)
    each = rows.groupBy("_h").agg(F.sum("_n").alias("_n"), F.min("_m").alias("_m"), F.max("_at").alias("_at"))
    return stored(each.filter("_n > 1 OR _m <= _at").select("_h"), "told")


def matured_steps(history: DataFrame, keys: Sequence[str], pred_time: str, mature_at: str, sums: Mapping[str, Column], game: str,
                  order: Sequence[str] = (), strata: str | None = None, revised: DataFrame | None = None) -> DataFrame:
    """(game, _t, _c, _p) for each matured revision that is later than all matured before it; ``_p`` is its predecessor. Games of one row
    are steps as they stand and need no shuffle. ``revised`` names at least the games of several rows, or their hashes ``_h``."""
    ok = F.when(F.col(mature_at) > F.col(pred_time), F.col(mature_at)).otherwise(
        F.raise_error(F.lit("outcome not after its prediction")).cast("timestamp"))
    rank = F.struct(F.col(pred_time).alias("r"), *[F.col(c).alias(f"r{i}") for i, c in enumerate(order)])
    under = F.transform(F.array_compact(strata), lambda x: F.struct(*[x[k].alias(k) for k in keys])) if strata else F.array(F.struct(*keys))
    cases = history.withColumns({"_t": ok, **{n: F.coalesce(e, F.lit(0)) for n, e in sums.items()}})
    cases = cases.select(game, "_t", F.struct(rank.alias("_rank"), under.alias("_under"), F.struct(*sums).alias("_sums")).alias("_c"))
    revised = revised_games(history, game) if revised is None else revised
    hashed = "_h" in revised.columns
    many = revised.select(F.col("_h" if hashed else game).alias("_many"))
    of_many = (F.xxhash64(game) if hashed else F.col(game)).eqNullSafe(F.col("_many"))
    # one row per game and maturity: the latest prediction among those that mature together
    again = cases.join(many, of_many, "left_semi").groupBy(game, "_t").agg(F.max("_c").alias("_c"))
    prior = F.max("_c").over(Window.partitionBy(game).orderBy("_t").rowsBetween(Window.unboundedPreceding, -1))
    again = again.withColumn("_p", prior).filter(F.col("_p").isNull() | (F.col("_c._rank") > F.col("_p._rank")))
    return cases.join(many, of_many, "left_anti").unionByName(again, allowMissingColumns=True)


def matured_sums(targets: DataFrame, history: DataFrame, keys: Sequence[str], at: str, pred_time: str, mature_at: str,
                 sums: Mapping[str, Column], game: str = "game_id", order: Sequence[str] = (), strata: str | None = None,
                 revised: DataFrame | None = None) -> DataFrame:
    """Per target: sums over prior cases already matured (``mature_at <= t``), the latest matured revision of each game, the target's
    own game excluded.

    On the maturity axis a revision that is later than all matured before it enters with its values and takes its predecessor's out, so
    nothing is paired and no target sees a revision from after its time; the two may lie under different keys. ``strata`` names an array
    of structs that hold the keys, for cases that count under several. A case must mature after it was predicted; otherwise the query
    fails. ``revised`` is :func:`revised_games`, where it is at hand. Targets of unknown key stay and see the history of that key.
    Sums are stored by instant, so targets stay where they are for few instants; only those of :func:`told_apart` look for their own game.
    """
    told = told_apart(history, targets, game, at, mature_at) if game in targets.columns else None
    steps = matured_steps(history, keys, pred_time, mature_at, sums, game, order, strata, told if revised is None else revised)
    moved = F.array_compact(F.array(F.struct(F.lit(1).alias("_sign"), F.col("_c").alias("_of")), F.when(F.col("_p").isNotNull(), F.struct(F.lit(-1).alias("_sign"), F.col("_p").alias("_of")))))
    facts = steps.select("_t", F.inline(moved)).select("_t", "_sign", "_of._sums", F.inline("_of._under"))
    facts = facts.select(*keys, "_t", F.lit(0).alias("_side"), *[(F.col("_sign") * F.col(f"_sums.{n}")).alias(n) for n in sums])
    rows = targets.select(*keys, F.col(at).alias("_t"), F.lit(1).alias("_side"), F.struct(*targets.columns).alias("_left"))
    both = rows.unionByName(facts, allowMissingColumns=True)
    # totals are pre-aggregated per instant, then scanned; targets read the inclusive total of their instant
    per_instant = both.groupBy(*keys, "_t").agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in sums])
    scanned = O.running_sums(per_instant, keys, ["_t"], {f"_s_{n}": F.col(n) for n in sums})
    found = O.attach(rows, stored(scanned.select(*keys, "_t", *[f"_s_{n}" for n in sums]), "matured"), [*keys, "_t"])
    out = found.select("_left.*", *[F.col(f"_s_{n}").alias(n) for n in sums])
    if told is None or told.isEmpty():
        return out
    of_told = F.xxhash64(game) == F.col("_h")
    mine = steps.join(told, of_told, "left_semi").select(game, "_t", F.col("_c._under").alias("_own_under"), F.col("_c._sums").alias("_own"))
    seen = O.as_of(out.join(told, of_told, "left_semi"), mine, [game], at, "_t", ["_t"], ["_own_under", "_own"])
    here = F.exists("_own_under", lambda x: x.eqNullSafe(F.struct(*keys)))
    less = seen.select(*targets.columns, *[(F.col(n) - F.when(here, F.col(f"_own.{n}")).otherwise(F.lit(0))).alias(n) for n in sums])
    return out.join(told, of_told, "left_anti").unionByName(less)


def model_panel(preds: DataFrame, models: Sequence[str], values: Sequence[str], key: str = "game_id") -> DataFrame:
    """Balanced game x model panel: every game has each model exactly once, or the query fails."""
    aggs = [F.max(F.when(F.col("model") == m, F.col(c))).alias(f"{m}_{c}") for m in models for c in values]
    counts = [F.sum((F.col("model") == m).cast("int")).alias(f"_n_{m}") for m in models]
    wide = preds.groupBy(key).agg(*aggs, *counts, F.count(F.lit(1)).alias("_n"))
    balanced = F.col("_n") == len(models)
    for m in models:
        balanced = balanced & (F.col(f"_n_{m}") == 1)
    checked = F.when(balanced, F.col(key)).otherwise(F.raise_error(F.lit("unbalanced model panel")).cast(preds.schema[key].dataType))
    return wide.withColumn(key, checked).drop("_n", *[f"_n_{m}" for m in models])


def lineup_means(lineup: DataFrame, history: DataFrame, key: str, ts: str, metrics: Mapping[str, tuple[Column, float]]) -> DataFrame:
    """Weighted means over a line-up of each player's totals strictly before the event.

    ``lineup(key, ts, lineup_json)``; ``history(player_id, ts, pa, ...)``; a metric is (numerator, value without history)
    over plate appearances, and players weigh ``max(1, pa)``.
    """
    players = lineup.select(key, ts, F.explode(F.from_json("lineup_json", "array<struct<player_id:string,batting_order:int>>")).alias("p"))
    players = players.select(key, ts, F.trim("p.player_id").alias("player_id")).filter("player_id <> ''")
    prior = history.groupBy("player_id", "ts").agg(
        F.sum("pa").alias("pa"), *[F.sum(n).alias(m) for m, (n, _) in metrics.items()])
    cumulative = O.running_sums(prior, ["player_id"], ["ts"], {"_pa": F.col("pa"), **{f"_{m}": F.col(m) for m in metrics}})
    profile = O.as_of(players.withColumnRenamed(ts, "_at"), cumulative.select("player_id", "ts", "_pa", *[f"_{m}" for m in metrics]),
                      ["player_id"], "_at", "ts", ["ts"], ["_pa", *[f"_{m}" for m in metrics]], inclusive=False)
    weight = F.greatest(F.lit(1.0), F.coalesce(F.col("_pa"), F.lit(0)).cast("double"))
    rate = lambda m, d: F.when(F.coalesce(F.col("_pa"), F.lit(0)) > 0, F.col(f"_{m}") / F.greatest(F.col("_pa"), F.lit(1))).otherwise(d)
    means = profile.groupBy(key).agg(*[
        (F.sum(weight * rate(m, d)) / F.sum(weight)).alias(f"lineup_{m}") for m, (_, d) in metrics.items()])
    out = lineup.select(key).join(means, key, "left")
    return out.select(key, *[F.coalesce(f"lineup_{m}", F.lit(d)).alias(f"lineup_{m}") for m, (_, d) in metrics.items()])


def target_rows(schedule: DataFrame, starters: DataFrame, keys: Sequence[str], now: Column, min_lead: float, max_lead: float,
                fallback_time: Column) -> DataFrame:
    """Upcoming events with their starters inside the lead window; conflicting start times fail the query."""
    one = unique_or_fail(starters, keys, "starter row").withColumnRenamed("start_at", "_starter_at")
    j = schedule.join(one, list(keys), "left")
    conflict = F.col("start_at").isNotNull() & F.col("_starter_at").isNotNull() & (F.col("start_at") != F.col("_starter_at"))
    at = F.coalesce("start_at", "_starter_at", fallback_time)
    checked = F.when(conflict, F.raise_error(F.lit("schedule and starter times disagree")).cast("timestamp")).otherwise(at)
    lead = (F.unix_micros("start_at") - F.unix_micros(now)) / 60e6
    return j.withColumn("start_at", checked).drop("_starter_at").withColumn("lead_minutes", lead).filter(
        F.col("lead_minutes").between(min_lead, max_lead))


def application_plan(scopes: DataFrame, sources: DataFrame) -> DataFrame:
    """Scope x applicable source with the features both sides know; empty intersections are left out."""
    s = scopes.select("scope_id", "canonical", F.explode("source_ids").alias("source_id"))
    both = s.join(sources, "source_id").withColumn("features", F.array_sort(F.array_intersect("features", "canonical")))
    return both.filter(F.size("features") > 0).select("scope_id", "source_id", "features")


def resolve_names(names: DataFrame, index: DataFrame) -> DataFrame:
    """Unique exact match, else unique substring match either way, else unresolved.

    ``names(name)``, ``index(candidate, id)``.  A contained text shares all its 3-grams with its container (its own length, if it is
    shorter), so the substring test is an equi join on grams followed by a check.  A contained text goes by the one of its grams that
    the fewest containers have, counted over all of them; a text with a gram that none has meets nothing.
    """
    n = names.select("name").distinct()
    exact = n.join(index, n["name"] == index["candidate"]).groupBy("name").agg(
        F.count(F.lit(1)).alias("n_exact"), F.min("id").alias("exact_id"))

    def runs(text: str, k: Column) -> Column:
        last = F.greatest(F.length(text) - k + 1, F.lit(1))
        return F.when(F.length(text) >= k, F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(text, i, k))).otherwise(F.array().cast("array<string>"))

    def grams(text: str, sizes: Sequence[Column]) -> Column:
        return F.array_distinct(F.concat(*[runs(text, k) for k in sizes]))

    def holding(outer: DataFrame, text: str) -> DataFrame:
        return outer.filter(F.col(text) != "").withColumn("_g", F.explode(grams(text, [F.lit(k) for k in (1, 2, 3)])))

    def by_rarest(inner: DataFrame, text: str, held: DataFrame) -> DataFrame:
        counts = held.groupBy("_g").agg(F.count(F.lit(1)).alias("_c"))
        each = inner.filter(F.col(text) != "").withColumn("_g", F.explode(grams(text, [F.least(F.length(text), F.lit(3))]))).join(counts, "_g", "left")
        rare = each.groupBy(*inner.columns).agg(F.min(F.struct(F.coalesce("_c", F.lit(0)).alias("c"), F.col("_g").alias("g"))).alias("_r"))
        return rare.filter("_r.c > 0").select(*inner.columns, F.col("_r.g").alias("_g"))

    of_names, of_index = holding(n, "name"), holding(index.select("candidate", "id"), "candidate")
    name_has = of_names.join(by_rarest(index.select("candidate", "id"), "candidate", of_names), "_g").filter(F.contains("name", "candidate")).select("name", "id")
    cand_has = of_index.join(by_rarest(n, "name", of_index), "_g").filter(F.contains("candidate", "name")).select("name", "id")
    partial = name_has.unionByName(cand_has).groupBy("name").agg(F.min("id").alias("_lo"), F.max("id").alias("_hi"))
    out = n.join(exact, "name", "left").join(partial, "name", "left")
    how = (F.when(F.col("n_exact") == 1, "exact").when(F.col("_lo") == F.col("_hi"), "substring").otherwise("unresolved"))
    ident = F.when(how == "exact", F.col("exact_id")).when(how == "substring", F.col("_lo"))
    return out.select("name", ident.alias("id"), how.alias("how"))


def starter_line(wanted: DataFrame, records: DataFrame, id_col: str) -> DataFrame:
    """Match ids as text, else as integers (leading zeros and decimals dropped)."""
    integer = lambda c: F.col(c).try_cast("double").cast("bigint").cast("string")
    by_text = unique_or_fail(records, [id_col], "record id")
    rest = [c for c in records.columns if c != id_col]
    by_int = O.latest_by(records.withColumn("_int", integer(id_col)).filter("_int IS NOT NULL"), ["_int"], [id_col], first=True)
    j = wanted.join(by_text.withColumnsRenamed({c: f"_t_{c}" for c in rest}).withColumn("_hit", F.lit(True)), id_col, "left")
    j = j.withColumn("_int", integer(id_col)).join(
        by_int.drop(id_col).withColumnsRenamed({c: f"_i_{c}" for c in rest}), "_int", "left")
    return j.select(*wanted.columns, *[
        F.when(F.col("_hit"), F.col(f"_t_{c}")).otherwise(F.col(f"_i_{c}")).alias(c) for c in rest])


def actual_starters(boxscores: DataFrame) -> DataFrame:
    """``boxscores(game_id, side, players map<id, struct<name, started, order>>)`` -> first started player per side."""
    p = boxscores.select("game_id", "side", F.explode("players").alias("player_id", "p")).filter("p.started")
    first = p.groupBy("game_id", "side").agg(F.min_by("p.name", F.struct("p.order", "player_id")).alias("starter"))
    return first.groupBy("game_id").agg(
        F.max(F.when(F.col("side") == "home", F.col("starter"))).alias("actual_home_starter"),
        F.max(F.when(F.col("side") == "away", F.col("starter"))).alias("actual_away_starter"))

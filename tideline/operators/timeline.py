"""Leak-free chronological features of entities and events."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tideline.functions import arrays as A
from tideline.functions.scalars import days_between, ratio
from tideline.operators import ordered as O
from tideline.session import stored

FORM_WINDOWS = (3, 5, 10, 20, 30, 45, 60)
KEYS = ("league", "entity")


def to_entity_rows(games: DataFrame) -> DataFrame:
    """Two rows per game, one for each side, from a single pass over the games."""
    views = F.array(
        F.struct(F.col("home").alias("entity"), F.col("away").alias("opponent"), F.lit("H").alias("side"),
                 F.col("home_score").alias("gf"), F.col("away_score").alias("ga")),
        F.struct(F.col("away").alias("entity"), F.col("home").alias("opponent"), F.lit("A").alias("side"),
                 F.col("away_score").alias("gf"), F.col("home_score").alias("ga")),
    )
    rest = [c for c in games.columns if c not in ("home", "away", "home_score", "away_score")]
    return games.select(*rest, F.inline(views))


def points(gf: Column, ga: Column) -> Column:
    return F.when(gf > ga, 3).when(gf == ga, 1).otherwise(0)


def _past(w: WindowSpec, n: int) -> WindowSpec:
    return w.rowsBetween(-n, -1)


def rolling_form(rows: DataFrame, windows: Sequence[int] = FORM_WINDOWS, keys: Sequence[str] = KEYS) -> DataFrame:
    """Means over the last ``w`` events before each instant; one row per entity and instant."""
    gf, ga = F.col("gf"), F.col("ga")
    facts = {"pts": (points(gf, ga), 1.0), "gf": (gf, 0.0), "ga": (ga, 0.0), "win": ((gf > ga).cast("int"), 0.33),
             "draw": ((gf == ga).cast("int"), 0.33)}

    def prepare(w: WindowSpec) -> dict[str, Column]:
        return {f"_{name}": O.running(w, value) for name, (value, _) in facts.items()}

    def build(w: WindowSpec) -> dict[str, Column]:
        seen = F.col("rn") - 1
        out = {"matches": seen}
        for n in windows:
            for name, (_, empty) in facts.items():
                mean = O.last_sum(w, f"_{name}", n) / F.least(seen, F.lit(n))
                out[f"{name}_{n}"] = F.when(seen > 0, mean).otherwise(F.lit(empty))
        return out

    state = O.frozen_state(rows, keys, "ts", ["game_id"], max(windows), build, prepare=prepare)
    return state.withColumns({f"gd_{n}": F.col(f"gf_{n}") - F.col(f"ga_{n}") for n in windows})


def shrunk_rate(x: Column, n: Column, prior: float, kappa: float = 20.0) -> Column:
    return (x * n + prior * kappa) / (n + kappa)


def shrunk_form(form: DataFrame, windows: Sequence[int] = (3, 5, 10, 20)) -> DataFrame:
    """Small-sample versions of the win, difference and draw rates of :func:`rolling_form`."""
    cols = {}
    for n in windows:
        eff = F.least(F.col("matches"), F.lit(n)).cast("double")
        cols[f"win_shrunk_{n}"] = shrunk_rate(F.col(f"win_{n}"), eff, 0.50)
        cols[f"gd_shrunk_{n}"] = shrunk_rate(F.col(f"gd_{n}"), eff, 0.0)
        cols[f"draw_shrunk_{n}"] = shrunk_rate(F.col(f"draw_{n}"), eff, 0.24)
    return form.withColumns(cols)


def venue_form(rows: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Games, points per game and last-10 means at the same side of the venue."""
    seen = F.col("rn") - 1
    return O.frozen_state(
        rows, [*keys, "side"], "ts", ["game_id"], 10,
        lambda w: {"venue_gf": F.coalesce(F.avg("gf").over(_past(w, 10)), F.lit(0.0)),
                   "venue_ga": F.coalesce(F.avg("ga").over(_past(w, 10)), F.lit(0.0)),
                   "venue_n": seen, "venue_pts": F.when(seen > 0, F.col("_points") / seen).otherwise(1.0)},
        totals={"_points": points(F.col("gf"), F.col("ga"))},
    )


def rest_days(rows: DataFrame, keys: Sequence[str] = KEYS, default: float | None = 30.0, whole: bool = False) -> DataFrame:
    """Days since the previous event of the entity, strictly before the instant."""
    gap = lambda w: days_between(F.col("ts"), F.max("ts").over(_past(w, 1)))

    def build(w: WindowSpec) -> dict[str, Column]:
        value = F.floor(gap(w)).cast("double") if whole else gap(w)
        return {"rest_days": value if default is None else F.coalesce(value, F.lit(default))}

    return O.frozen_state(rows, keys, "ts", ["game_id"], 1, build)


def row_features(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], back: int, build: Callable[[WindowSpec], Mapping[str, Column]],
    ahead: int = 0, size: int = O.BLOCK, seg: Column | None = None,
) -> DataFrame:
    """Every row with columns over its neighbours in a total order (no freezing at equal timestamps)."""
    spread, w = O.blocks(O.row_numbers(df, keys, order, seg), keys, back=back, ahead=ahead, size=size)
    return O.drop_halo(spread.withColumns(dict(build(w))))


def recent_form(rows: DataFrame, windows: Sequence[int] = (5, 10), keys: Sequence[str] = KEYS) -> DataFrame:
    """Points per game and difference over the previous ``w`` rows; NULL when there are none."""
    def build(w: WindowSpec) -> dict[str, Column]:
        out = {}
        for n in windows:
            out[f"ppg_{n}"] = F.avg(points(F.col("gf"), F.col("ga"))).over(_past(w, n))
            out[f"form_gd_{n}"] = F.avg(F.col("gf") - F.col("ga")).over(_past(w, n))
        return out

    return row_features(rows, keys, ["ts", "game_id"], max(windows), build).drop("rn")


def head_to_head(games: DataFrame, meetings: int = 8, keys: Sequence[str] = ("league",)) -> DataFrame:
    """Last meetings of the unordered pair: count, share won by today's home side, share drawn."""
    tagged = games.withColumns({"pair_lo": F.least("home", "away"), "pair_hi": F.greatest("home", "away")})
    h, a = F.col("home_score"), F.col("away_score")
    winner = F.when(h > a, F.col("home")).when(h < a, F.col("away"))

    def build(w: WindowSpec) -> dict[str, Column]:
        past = _past(w, meetings)
        n = F.count(F.lit(1)).over(past)
        lo = F.sum(F.coalesce((winner == F.col("pair_lo")).cast("int"), F.lit(0))).over(past)
        hi = F.sum(F.coalesce((winner == F.col("pair_hi")).cast("int"), F.lit(0))).over(past)
        mine = F.when(F.col("home") == F.col("pair_lo"), lo).otherwise(hi)
        return {"h2h_meetings": n, "h2h_home_win_rate": ratio(mine, n), "h2h_draw_rate": ratio(n - lo - hi, n)}

    out = row_features(tagged, [*keys, "pair_lo", "pair_hi"], ["ts", "game_id"], meetings, build)
    return out.drop("rn", "pair_lo", "pair_hi")


def shot_efficiency(games: DataFrame) -> DataFrame:
    """Conversion and accuracy ratios, added only for the columns that exist."""
    cols = {}
    for side in ("home", "away"):
        if f"shots_{side}" in games.columns:
            cols[f"{side}_shot_conversion"] = ratio(F.col(f"{side}_score"), F.col(f"shots_{side}"))
            if f"sot_{side}" in games.columns:
                cols[f"{side}_sot_accuracy"] = ratio(F.col(f"sot_{side}"), F.col(f"shots_{side}"))
    return games.withColumns(cols) if cols else games


def _home_away(games: DataFrame, state: DataFrame, cols: Mapping[str, str], keys: Sequence[str] = ("league",)) -> DataFrame:
    """Attach entity state to both sides of each game; ``cols`` maps state column to suffix. The state is stored first: where it turns
    out small, games need not move."""
    out, state = games, stored(state.select(*keys, "entity", "ts", *cols), "state")
    for side in ("home", "away"):
        right = state.select(*keys, F.col("entity").alias(side), "ts",
                             *[F.col(c).alias(f"{side}_{n}") for c, n in cols.items()])
        out = out.join(right, [*keys, side, "ts"], "left")
    return out


def stage_rest(games: DataFrame) -> DataFrame:
    state = rest_days(to_entity_rows(games), default=None, whole=True)
    out = _home_away(games, state, {"rest_days": "rest_days"})
    return out.withColumn("rest_days_diff", F.col("home_rest_days") - F.col("away_rest_days"))


STAGES: dict[str, Callable[[DataFrame], DataFrame]] = {
    "rest_days": stage_rest, "head_to_head": head_to_head, "shot_efficiency": shot_efficiency,
}


def apply_stages(games: DataFrame, names: Sequence[str], stages: Mapping[str, Callable] | None = None) -> DataFrame:
    """Run registered feature stages in order; an unknown name is an error."""
    known = stages or STAGES
    missing = [n for n in names if n not in known]
    if missing:
        raise KeyError(f"unknown feature stages: {missing}")
    out = games
    for n in names:
        out = out.transform(known[n])
    return out


BATTING = ("pa", "ab", "h", "hr", "bb", "so", "doubles", "triples")


def batting_windows(rows: DataFrame, windows: Sequence[int] = (3, 5, 10, 20, 30), keys: Sequence[str] = KEYS) -> DataFrame:
    """Rolling batting means turned into rates with denominators of at least one."""
    def prepare(w: WindowSpec) -> dict[str, Column]:
        return {f"_{c}": O.running(w, F.coalesce(F.col(c), F.lit(0)).cast("double")) for c in BATTING}

    def build(w: WindowSpec) -> dict[str, Column]:
        seen = F.col("rn") - 1
        return {
            f"_{c}_{n}": F.when(seen > 0, O.last_sum(w, f"_{c}", n) / F.least(seen, F.lit(n))).otherwise(0.0)
            for n in windows for c in BATTING
        }

    means = O.frozen_state(rows, keys, "ts", ["game_id"], max(windows), build, prepare=prepare)
    cols = {}
    for n in windows:
        c = lambda name: F.col(f"_{name}_{n}")  # noqa: E731,B023
        ab, pa = F.greatest(c("ab"), F.lit(1.0)), F.greatest(c("pa"), F.lit(1.0))
        power = (c("doubles") + 2 * c("triples") + 3 * c("hr")) / ab
        cols.update({
            f"bat_avg_{n}": c("h") / ab, f"bat_hr_{n}": c("hr"), f"bat_bb_{n}": c("bb"), f"bat_so_{n}": c("so"),
            f"bat_bb_rate_{n}": c("bb") / pa, f"bat_so_rate_{n}": c("so") / pa,
            f"bat_xbh_{n}": c("doubles") + c("triples") + c("hr"), f"bat_hr_rate_{n}": c("hr") / ab,
            f"bat_iso_proxy_{n}": F.greatest(F.lit(0.0), power - c("h") / ab),
            f"bat_extra_base_rate_{n}": F.greatest(F.lit(0.0), power),
        })
    return means.select(*keys, "ts", *[v.alias(k) for k, v in cols.items()])


RELIEF = ("er", "runs", "ip", "h", "bb", "so", "hr")


def event_team_records(rows: DataFrame) -> DataFrame:
    """Per-entity relief counters: the explicit total where given, else the conceded-runs proxy (never called ERA)."""
    explicit = {c: F.col(f"relief_{c}").cast("double") for c in RELIEF if f"relief_{c}" in rows.columns}
    get = lambda c: explicit.get(c, F.lit(None).cast("double"))
    proxy = F.greatest(F.lit(0.0), F.col("ga") - 3.0)
    er = F.coalesce(get("er"), proxy)
    cols = {"bp_er": er, "bp_runs": F.coalesce(get("runs"), er)}
    for c in ("ip", "h", "bb", "so", "hr"):
        cols[f"bp_{c}"] = F.coalesce(get(c), F.lit(0.0))
    cols["bp_actual_er"] = F.coalesce(get("er"), F.lit(0.0))
    cols["bp_actual"] = (get("ip").isNotNull() | get("er").isNotNull() | get("so").isNotNull()).cast("double")
    return rows.withColumns({"points": points(F.col("gf"), F.col("ga")), **cols})


def bullpen_window(records: DataFrame, n: int = 10, keys: Sequence[str] = KEYS) -> DataFrame:
    """Relief quality over the last ``n`` events, from explicit totals only."""
    def build(w: WindowSpec) -> dict[str, Column]:
        past = _past(w, n)
        total = lambda c: F.coalesce(F.sum(c).over(past), F.lit(0.0))
        ip = total("bp_ip")
        per9 = lambda c: F.when(ip > 0, 9.0 * total(c) / ip).otherwise(0.0)
        return {
            "bp_er_10": F.coalesce(F.avg("bp_er").over(past), F.lit(0.0)), "bp_ip_10": ip, "bp_era_10": per9("bp_actual_er"),
            "bp_whip_10": F.when(ip > 0, (total("bp_h") + total("bp_bb")) / ip).otherwise(0.0),
            "bp_k9_10": per9("bp_so"), "bp_bb9_10": per9("bp_bb"), "bp_hr9_10": per9("bp_hr"),
            "bp_coverage_10": total("bp_actual") / F.greatest(F.least(F.lit(float(n)), F.col("rn") - 1.0), F.lit(1.0)),
        }

    return O.frozen_state(records, keys, "ts", ["game_id"], n, build)


#: Powers stay within exp(+-RANGE) inside a block and its halo; what lies behind the halo weighs less than exp(-LOST) < 1e-18.
RANGE, LOST = 690.0, 41.5


def decayed_load(
    rows: DataFrame, value: Column, recurrences: Mapping[str, tuple[float, float]], keys: Sequence[str] = KEYS
) -> DataFrame:
    """``b <- keep*b + gain*x`` after every event, read frozen at each instant.

    A positional power sum inside blocks, so it stays a prefix sum. Halo and block follow from ``keep``: slow decays get long halos,
    fast ones short blocks, and recurrences whose halos and blocks do not go together are scanned apart. ``keep`` of 1 is a plain sum.
    """
    rates = {name: -math.log(keep) for name, (keep, _) in recurrences.items()}
    if any(r < 0 for r in rates.values()):
        raise ValueError("keep must lie in (0, 1]")
    groups: list[list[str]] = []
    for name in sorted((n for n in rates if rates[n]), key=rates.get):
        if groups and rates[name] / rates[groups[-1][0]] * LOST * 2 <= RANGE:
            groups[-1].append(name)
        else:
            groups.append([name])
    out = None
    for names in groups:
        back = math.ceil(LOST / rates[names[0]])
        size = max(back, int(RANGE / rates[names[-1]]) - back)

        def build(w: WindowSpec, names=names, back=back, size=size) -> dict[str, Column]:
            pos = (F.col("rn") - F.col(O.BLK) * size + back).cast("double")
            before = w.rowsBetween(Window.unboundedPreceding, -1)
            cols = {}
            for name in names:
                keep, gain = recurrences[name]
                scaled = F.sum(value * F.exp(pos * rates[name] - RANGE / 2)).over(before)
                cols[name] = F.coalesce(F.lit(gain) * scaled * F.exp(RANGE / 2 - (pos - 1) * rates[name]), F.lit(0.0))
            return cols

        found = O.frozen_state(rows, keys, "ts", ["game_id"], back, build, size=size)
        out = found if out is None else O.attach(out, found, [*keys, "ts"])
    plain = [n for n in rates if not rates[n]]
    if plain:
        sums = O.prior_sums(rows, keys, "ts", {n: F.lit(recurrences[n][1]) * value for n in plain})
        out = sums if out is None else O.attach(out, sums, [*keys, "ts"])
    return out


def volatility_trend(rows: DataFrame, metrics: Sequence[str], n: int = 20, keys: Sequence[str] = KEYS) -> DataFrame:
    """Population deviation (two rows or more) and least-squares slope over the index (four or more)."""
    def build(w: WindowSpec) -> dict[str, Column]:
        past = _past(w, n)
        count = F.count(F.lit(1)).over(past)
        out = {}
        for m in metrics:
            out[f"{m}_sd_{n}"] = F.when(count >= 2, F.stddev_pop(m).over(past)).otherwise(0.0)
            out[f"{m}_slope_{n}"] = F.when(
                count >= 4, F.regr_slope(F.col(m).cast("double"), F.col("rn").cast("double")).over(past)).otherwise(0.0)
        return out

    return O.frozen_state(rows, keys, "ts", ["game_id"], n, build)


def exp_weighted(
    rows: DataFrame, metrics: Mapping[str, float], tau: float, keys: Sequence[str] = KEYS, order: Sequence[str] = ("game_id",)
) -> DataFrame:
    """Positionally decayed means that skip missing values, with last-5 mean and deviation.

    ``metrics`` maps a column to its value when there is no history. The mean after each known value needs only known values within
    ``LOST * tau`` positions before it (older ones weigh less than 1e-18 of it); an instant then reads the mean at the last known value
    before it, however far back that lies. Rows move once; what goes from instant to instant is a row of sums for each.
    """
    def build(w: WindowSpec) -> dict[str, Column]:
        last5 = _past(w, 5)
        out = {"n_prior": F.col("rn") - 1}
        for m, empty in metrics.items():
            v = F.col(m).cast("double")
            out[f"{m}_recent"] = F.coalesce(F.avg(v).over(last5), F.lit(empty))
            out[f"{m}_recent_sd"] = F.coalesce(F.stddev_pop(v).over(last5), F.lit(0.0))
        return out

    out = O.frozen_state(rows, keys, "ts", order, 5, build)
    # what an instant adds is summed in it, weighted by the distance from its last known value, and only these sums are carried on
    back = math.ceil(LOST * tau)
    size = max(back, math.ceil(300 * tau))
    latest = Window.partitionBy(*keys, "ts").orderBy(*[F.col(c).desc() for c in order])
    behind = rows.withColumn("_behind", F.row_number().over(latest) - 1)
    near = {m: F.min(F.when(F.col(m).isNotNull(), F.col("_behind"))).over(latest.rowsBetween(Window.unboundedPreceding, 0)) for m in metrics}
    sums = {}
    for m in metrics:
        fade = F.when(F.col(m).isNotNull(), F.exp((F.col(f"_near_{m}") - F.col("_behind")).cast("double") / tau))
        sums |= {f"_near_{m}": F.min(f"_near_{m}"), f"_v_{m}": F.sum(F.col(m).cast("double") * fade), f"_w_{m}": F.sum(fade)}
    added = behind.withColumns({f"_near_{m}": c for m, c in near.items()}).groupBy(*keys, "ts").agg(F.count(F.lit(1)).alias("_own"), *[c.alias(n) for n, c in sums.items()])
    kept = out.columns
    added = stored(O.attach(out, added, [*keys, "ts"]), "instants")
    out = added.select(*kept)
    instants = added.select(*keys, F.col("ts").alias("at"))
    for m, empty in metrics.items():
        some = added.filter(F.col(f"_near_{m}").isNotNull()).withColumn("rn", F.col("n_prior") + F.col("_own") - F.col(f"_near_{m}"))
        spread, w = O.blocks(some, keys, back=back, size=size)
        weight = F.exp((F.col("rn") - F.col(O.BLK) * size).cast("double") / tau - 150.0)
        so_far = w.rowsBetween(Window.unboundedPreceding, 0)
        mean = ratio(F.sum(F.col(f"_v_{m}") * weight).over(so_far), F.sum(F.col(f"_w_{m}") * weight).over(so_far))
        after = O.drop_halo(spread.withColumn("_ew", mean)).select(*keys, "ts", "rn", "_ew")
        found = O.as_of(instants, after, keys, "at", "ts", ["ts", "rn"], ["_ew"], inclusive=False)
        out = O.attach(out, found.select(*keys, F.col("at").alias("ts"), F.coalesce("_ew", F.lit(empty)).alias(f"{m}_ew")), [*keys, "ts"])
    return out.select(*keys, "ts", "n_prior", *[f"{m}_{x}" for m in metrics for x in ("ew", "recent", "recent_sd")])


def tail_slope(
    rows: DataFrame, metric: str, n: int = 8, minimum: int = 3, keys: Sequence[str] = KEYS, order: Sequence[str] = ("game_id",)
) -> DataFrame:
    """Slope over the last ``n`` known values before each instant, however far back they lie; 0 below the minimum."""
    known = rows.filter(F.col(metric).isNotNull())
    numbered = O.row_numbers(known, keys, ["ts", *order])
    spread, w = O.blocks(numbered, keys, back=n)
    span = w.rowsBetween(-(n - 1), 0)
    slope = F.when(F.count(metric).over(span) >= minimum,
                   F.regr_slope(F.col(metric).cast("double"), F.col("rn").cast("double")).over(span)).otherwise(0.0)
    after = O.drop_halo(spread.withColumn("slope", slope)).select(*keys, "ts", "rn", "slope")
    instants = rows.select(*keys, F.col("ts").alias("at")).distinct()
    found = O.as_of(instants, after, keys, "at", "ts", ["ts", "rn"], ["slope"], inclusive=False)
    return found.select(*keys, F.col("at").alias("ts"), F.coalesce("slope", F.lit(0.0)).alias(f"{metric}_slope"))


def ew_team_runs(rows: DataFrame, n: int = 30, keys: Sequence[str] = KEYS) -> DataFrame:
    """Last-``n`` means with weights exp(linspace(-2.2, 0, count)); NULL without history."""
    def weighted(values: Column) -> Column:
        count = F.size(values)
        step = F.when(count > 1, 2.2 / (count - 1)).otherwise(0.0)
        weights = F.transform(values, lambda v, i: F.exp(-2.2 + step * i))
        return ratio(A.dot(values, weights), A.asum(weights))

    state = O.frozen_state(
        rows, keys, "ts", ["game_id"], n,
        lambda w: {"_gf": F.collect_list(F.col("gf").cast("double")).over(_past(w, n)),
                   "_ga": F.collect_list(F.col("ga").cast("double")).over(_past(w, n))},
    )
    return state.select(*keys, "ts", weighted(F.col("_gf")).alias("ew_for"), weighted(F.col("_ga")).alias("ew_against"))


def lagged_entity_features(rows: DataFrame, metrics: Sequence[str], n: int = 5, keys: Sequence[str] = KEYS) -> DataFrame:
    """Mean of the entity's previous ``n`` rows whichever side it played; 0 when none; marked unverified."""
    out = row_features(rows, keys, ["ts", "game_id"], n, lambda w: {
        f"lag_{m}": F.coalesce(F.avg(F.col(m).cast("double")).over(_past(w, n)), F.lit(0.0)) for m in metrics})
    lags = [f"lag_{m}" for m in metrics]
    wide = out.groupBy("game_id").agg(*[
        F.max(F.when(F.col("side") == s, F.col(c))).alias(f"{p}_{c}") for s, p in (("H", "home"), ("A", "away")) for c in lags])
    return wide.withColumns({"tracking_pit_status": F.lit("UNVERIFIED"), "historical_backtest_eligible": F.lit(False)})


def match_features(games: DataFrame, state: DataFrame, features: Sequence[str], keys: Sequence[str] = ("league",)) -> DataFrame:
    """Home, away and difference columns for every feature of the entity state, plus the scoring environment; games of unknown key stay.
    The state is stored first: where it turns out small, games need not move."""
    out, state = games, stored(state.select(*keys, "entity", "ts", *features), "state")
    for side, p in (("home", "h"), ("away", "a")):
        right = state.select(*keys, F.col("entity").alias(side), "ts", *[F.col(f).alias(f"{p}_{f}") for f in features])
        out = O.attach(out, right, [*keys, side, "ts"])
    cols = {"home_adv": F.lit(1.0)}
    cols.update({f"d_{f}": F.col(f"h_{f}") - F.col(f"a_{f}") for f in features})
    if {"gf_10", "ga_10"} <= set(features):
        env = 0.5 * (F.col("h_gf_10") + F.col("a_gf_10") + F.col("h_ga_10") + F.col("a_ga_10"))
        cols["expected_env"] = A.clip(env, 0.5, 12.0)
    return out.withColumns(cols)


def context_gate(df: DataFrame, cutoff: str, availability: Sequence[str], enabled: bool = True) -> DataFrame:
    """Context may be used only when every availability time is known and not after the cutoff."""
    ok = F.lit(enabled)
    for c in availability:
        ok = ok & F.coalesce(F.col(c) <= F.col(cutoff), F.lit(False))
    return df.withColumn("context_pit_safe", ok)


def prediction_dynamics(df: DataFrame, p: str, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Velocity, acceleration, flip, five-row persistence and reversal of probability vectors in order."""
    v = F.col(p)
    numbered = O.row_numbers(df, keys, order)
    spread, w = O.blocks(numbered, keys, back=8)
    one, two = F.lag(v, 1).over(w), F.lag(v, 2).over(w)
    step1 = spread.withColumns({"_p1": one, "_p2": two, "_top": A.arg_max(v), "_top1": A.arg_max(one)})
    velocity = F.when(F.col("_p1").isNull(), 0.0).otherwise(A.l1(v, F.col("_p1")))
    prior_velocity = F.when(F.col("_p2").isNull(), 0.0).otherwise(A.l1(F.col("_p1"), F.col("_p2")))
    flip = F.when(F.col("_p1").isNotNull() & (F.col("_top") != F.col("_top1")), 1.0).otherwise(0.0)
    turn = A.dot(F.zip_with(v, F.col("_p1"), lambda a, b: a - b), F.zip_with(F.col("_p1"), F.col("_p2"), lambda a, b: a - b))
    step2 = step1.withColumns({
        "velocity": velocity,
        "acceleration": F.when(F.col("_p2").isNull(), 0.0).otherwise(velocity - prior_velocity),
        "flip": flip,
        "reversal": F.when(F.col("_p2").isNotNull() & (turn < 0), 1.0).otherwise(0.0),
    })
    step3 = step2.withColumn("persistence", F.avg(1.0 - F.col("flip")).over(w.rowsBetween(-4, 0)))
    return O.drop_halo(step3).drop("rn", "_p1", "_p2", "_top", "_top1")


def information_shock(series: DataFrame, value: str, keys: Sequence[str], order: Sequence[str], window: int = 10) -> DataFrame:
    """Robust z score of each value against the median and deviation of its own recent past."""
    n = max(3, window)
    numbered = O.row_numbers(series, keys, order)
    first = O.latest_by(numbered.select(*keys, "rn", F.col(value).cast("double").alias("_x0")), keys, ["rn"], first=True).drop("rn")
    spread, w = O.blocks(O.attach(numbered, first, keys), keys, back=2 * n + 2)
    x = F.col(value).cast("double")
    past = _past(w, n)
    med = F.when(F.count(x).over(past) >= 2, F.percentile(x, F.lit(0.5)).over(past))
    one = spread.withColumns({"_med": med, "_dev": F.abs(F.lag(x).over(w) - med)})
    span = w.rowsBetween(-(n - 1), 0)
    mad = F.when(F.count("_dev").over(span) >= 2, F.percentile(F.col("_dev"), F.lit(0.5)).over(span))
    scale = F.greatest(F.coalesce(1.4826 * mad, F.lit(1.0)), F.lit(1e-6))
    two = one.withColumn("event_rate_z", F.abs((x - F.coalesce("_med", "_x0")) / scale))
    return O.drop_halo(two).withColumns({
        "shock_score": A.clip(F.col("event_rate_z") / 4.0, 0.0, 1.0),
        "information_shock": (F.col("event_rate_z") >= 4.0).cast("int"),
    }).drop("_med", "_dev", "_x0", "rn")


def regime_transitions(df: DataFrame, state: str, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Counts of state -> next state, plain and Laplace-smoothed probabilities over all observed states."""
    moves = row_features(df.select(*keys, *order, state), keys, order, 0, lambda w: {"_next": F.lead(state).over(w)}, ahead=1)
    counts = (moves.groupBy(F.col(state).alias("state"), F.col("_next").alias("next_state"))
              .agg(F.count(F.lit(1)).alias("n")))
    # every state occurs as a source row (the last one of a key has a NULL successor), so sources list all states
    all_states = F.collect_set("state").over(Window.partitionBy())
    grid = counts.withColumn("_all", all_states).groupBy("state").agg(
        F.first("_all").alias("_all"), F.map_from_entries(F.collect_list(
            F.when(F.col("next_state").isNotNull(), F.struct("next_state", "n")))).alias("_n"))
    wide = grid.select("state", F.explode("_all").alias("next_state"), F.size("_all").alias("_k"), "_n").select(
        "state", "next_state", F.coalesce(F.try_element_at("_n", "next_state"), F.lit(0)).cast("bigint").alias("n"), "_k")
    per_state = Window.partitionBy("state")
    total = F.sum("n").over(per_state)
    return wide.select("state", "next_state", "n", ratio(F.col("n"), total).alias("p"),
                       ((F.col("n") + 1.0) / (total + F.col("_k"))).alias("p_laplace"))


def regime_forecast(transitions: DataFrame, current: str, horizon: int) -> DataFrame:
    """Distribution ``horizon`` steps ahead of ``current`` by repeated joins with the transition table."""
    step = transitions.filter("n > 0").select(F.col("state").alias("_s"), F.col("next_state").alias("_t"), F.col("p").alias("_p"))
    dist = step.filter(F.col("_s") == current).select(F.col("_t").alias("state"), F.col("_p").alias("p"))
    for _ in range(max(0, horizon - 1)):
        dist = (dist.join(step, F.col("state") == F.col("_s")).groupBy(F.col("_t").alias("state"))
                .agg(F.sum(F.col("p") * F.col("_p")).alias("p")))
    return dist


def router_stability(df: DataFrame, weights: str, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Step sizes between consecutive normalised weight maps (a missing name weighs 0) and their concentration."""
    value = lambda m, k: F.greatest(F.coalesce(F.try_element_at(m, k), F.lit(0.0)), F.lit(0.0))

    def norm(m: Column) -> Column:
        total = F.greatest(A.asum(F.transform(F.map_values(m), lambda v: F.greatest(v, F.lit(0.0)))), F.lit(1e-12))
        return F.transform_values(m, lambda k, v: F.greatest(v, F.lit(0.0)) / total)

    unit = df.select(*keys, *order, norm(F.col(weights)).alias("_w"))
    rows = row_features(unit, keys, order, 1, lambda w: {"_prev": F.lag("_w").over(w)})
    names = F.array_union(F.map_keys("_w"), F.map_keys("_prev"))
    step = 0.5 * A.asum(F.transform(names, lambda k: F.abs(value(F.col("_w"), k) - value(F.col("_prev"), k))))
    moved = rows.select(*keys, F.when(F.col("_prev").isNotNull(), step).alias("_step"),
                        F.array_max(F.map_values("_w")).alias("_top"))
    out = moved.groupBy(*keys).agg(
        F.coalesce(F.avg("_step"), F.lit(0.0)).alias("mean_weight_velocity"),
        F.coalesce(F.max("_step"), F.lit(0.0)).alias("max_weight_velocity"), F.avg("_top").alias("concentration"))
    return out.withColumn("collapse", A.clip((F.col("concentration") - 0.85) / 0.15, 0.0, 1.0))


def top_per_day(df: DataFrame, p: str, day: Column, prefer_largest_id: bool = True, id_col: str = "game_id",
                keys: Sequence[str] = ()) -> DataFrame:
    """The row with the highest value of ``p`` per day; ties by id in the stated direction."""
    tagged = df.withColumn("day", day)
    if prefer_largest_id:
        return O.latest_by(tagged, [*keys, "day"], [p, id_col])
    return O.latest_by(tagged, [*keys, "day"], [-F.col(p), id_col], first=True)


def recency_weight(df: DataFrame, order: Sequence[str], half_life: float, keys: Sequence[str] = ()) -> DataFrame:
    """``clip(2**(-age/max(100, half_life)), 0.2, 1)`` with age in rows from the end."""
    backwards = [F.col(c).desc() for c in order]
    numbered = O.row_numbers(df, keys, backwards, seg=-F.unix_date(F.to_date(order[0])))
    age = F.col("rn") - 1
    return numbered.withColumn("weight", A.clip(F.exp(-math.log(2) * age / max(100.0, half_life)), 0.2, 1.0)).drop("rn")


def team_strength(
    rows: DataFrame, half_life_days: float | None = 90.0, shrink: float = 24.0, bounds: tuple[float, float] = (0.60, 1.55),
    base_run: float = 4.0, keys: Sequence[str] = ("league",), entity: str = "entity",
) -> DataFrame:
    """Offence and defence factors of each entity against its league, time-decayed, strictly before each instant.

    Decay is a ratio of prefix sums of values scaled by ``2**(days/half_life)`` since the start of a block of 400 half-lives, and the last
    60 half-lives of a block count in the next one too; older values weigh less than 1e-18.
    """
    if half_life_days:
        days = F.unix_micros("ts") / 86400e6
        span = 400.0 * half_life_days
        home = F.floor(days / span)
        late = days - home * span > span - 60.0 * half_life_days
        placed = rows.withColumn("_span", F.explode(F.when(late, F.array(home, home + 1)).otherwise(F.array(home))))
        placed = placed.withColumn("_scale", F.pow(F.lit(2.0), (days - F.col("_span") * span) / half_life_days))
        scale = F.pow(F.lit(2.0), (days - F.col("_span") * span) / half_life_days)
        own_rows = lambda df: df.filter(F.col("_span") == home)
    else:
        placed, scale = rows.withColumns({"_span": F.lit(0), "_scale": F.lit(1.0)}), F.lit(1.0)
        own_rows = lambda df: df
    w = F.col("_scale")
    own = own_rows(O.prior_sums(placed, [*keys, entity, "_span"], "ts", {"_gf": F.col("gf") * w, "_ga": F.col("ga") * w, "_n": w}))
    league = own_rows(O.prior_sums(placed, [*keys, "_span"], "ts", {"_runs": F.col("gf") * w, "_weight": w}))
    both = O.attach(own, league.drop("_span"), [*keys, "ts"])
    decay = F.lit(1.0) / scale
    mean = F.when(F.col("_weight") > 0, F.greatest(F.lit(0.1), F.col("_runs") / F.col("_weight"))).otherwise(base_run)
    n = F.col("_n") * decay
    lo, hi = bounds
    factor = lambda c: A.clip((F.col(c) * decay + shrink * mean) / (n + shrink) / mean, lo, hi)
    return both.select(*keys, entity, "ts", factor("_gf").alias("offense"), factor("_ga").alias("defense"))

"""Projections, filters and contracts that turn raw rows into the fixed shapes the other operators expect."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions import arrays as A
from tideline.functions.scalars import clean_text, first_nonblank, ratio, safe_double
from tideline.operators import ordered as O

# Ordered keyword rules (first match wins) and code rules of the competition taxonomy:
# (words or code) -> competition, stage, season type, game class.
KEYWORD_RULES = (
    (("日本シリーズ",), "npb_japan_series", "japan_series", "postseason", "championship"),
    (("クライマックスシリーズ", "クライマックス", "ＣＳ", "CS"), "npb_climax_series", "climax_series", "postseason", "playoff"),
    (("フレッシュオールスター",), "npb_fresh_all_star", "all_star", "all_star", "exhibition"),
    (("オールスター",), "npb_all_star", "all_star", "all_star", "exhibition"),
    (("ファーム日本選手権",), "npb_farm_championship", "championship", "farm_postseason", "championship"),
    (("ファーム公式戦", "ファーム", "二軍"), "npb_farm", "regular_season", "farm", "official"),
    (("春季教育リーグ", "秋季教育リーグ", "教育リーグ", "教育"), "npb_education_league", "regular_season", "education", "development"),
    (("オープン戦", "オープン"), "npb_open", "spring_training", "spring", "exhibition"),
    (("特別試合",), "npb_special", "special", "special", "special"),
    (("交流戦",), "npb_interleague", "interleague", "regular_season", "official"),
    (("公式戦",), "npb_regular", "regular_season", "regular_season", "official"),
)
CODE_RULES = {
    "R": ("mlb_regular", "regular_season", "regular_season", "official"), "S": ("mlb_spring", "spring_training", "spring", "exhibition"),
    "E": ("mlb_exhibition", "exhibition", "exhibition", "exhibition"), "A": ("mlb_all_star", "all_star", "all_star", "exhibition"),
    "F": ("mlb_postseason", "wild_card", "postseason", "playoff"), "D": ("mlb_postseason", "division_series", "postseason", "playoff"),
    "L": ("mlb_postseason", "league_championship_series", "postseason", "playoff"), "W": ("mlb_postseason", "world_series", "postseason", "championship"),
    "P": ("mlb_postseason", "postseason_unknown", "postseason", "playoff"), "C": ("mlb_championship", "championship", "postseason", "championship"),
    "I": ("mlb_intrasquad", "intrasquad", "special", "exhibition"), "B": ("mlb_preseason", "preseason", "preseason", "exhibition"),
}
OFFICIAL_WORDS, EXCLUDED_WORDS = ("公式戦", "交流戦"), ("オープン戦", "オールスター", "ファーム", "二軍", "教育")
LABELS = ("competition", "stage", "season_type", "game_class")


def canonical_entity(df: DataFrame, name: str, aliases: DataFrame, alias: str, canonical: str) -> DataFrame:
    """Alias to canonical label, unchanged when unknown."""
    lookup = aliases.select(F.col(alias).alias("_alias"), F.col(canonical).alias("_canonical"))
    out = df.withColumn("_key", F.trim(name)).join(lookup, F.col("_key") == F.col("_alias"), "left")
    return out.withColumn(name, F.coalesce("_canonical", "_key")).drop("_key", "_alias", "_canonical")


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def attach_event_ids(df: DataFrame, candidates: Sequence[str], out: str = "event_id") -> DataFrame:
    """Copy the id from the first candidate column that exists; an id is never made up."""
    for c in candidates:
        if c in df.columns:
            return df.withColumn(out, F.col(c).cast("string"))
    raise ValueError(f"no identity column among {list(candidates)}")


def classify_competition(df: DataFrame, league: Column, game_type: Column, keyword_league: str = "NPB", code_league: str = "MLB") -> DataFrame:
    """Competition labels, key and status; in a league with rules, what none covers is ``<league>_unknown``, elsewhere ``unknown``.

    The rule is found once, as a key into one literal map of labels.
    """
    tagged = df.withColumns({"_text": F.regexp_replace(clean_text(game_type), r"\s+", " "), "_lg": F.upper(clean_text(league))})
    text, lg = F.col("_text"), F.col("_lg")
    words = None
    for needles, competition, *_ in KEYWORD_RULES:
        hit = text.rlike("|".join(needles))
        words = F.when(hit, competition) if words is None else words.when(hit, competition)
    rule = F.when(lg == keyword_league, words).when((lg == code_league) & F.upper(text).isin(*CODE_RULES), F.upper(text))
    table = {**{r[1]: r[1:] for r in KEYWORD_RULES}, **CODE_RULES}
    labels = F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.array(*[F.lit(y) for y in v]))])
    found = tagged.withColumn("_rule", rule).withColumn("_labels", F.element_at(labels, F.col("_rule")))
    none = F.when(lg.isin(keyword_league, code_league), F.concat(F.lower(lg), F.lit("_unknown"))).otherwise("unknown")
    cols = {n: F.coalesce(F.col("_labels")[i], none if i == 0 else F.lit("unknown")) for i, n in enumerate(LABELS)}
    known = F.col("_rule").isNotNull()
    cols["competition_key"] = F.when(known, F.concat_ws(":", lg, F.col("_labels")[0], F.col("_labels")[1])).otherwise(F.when(none == "unknown", F.concat(lg, F.lit(":unknown"))).otherwise(F.concat(lg, F.lit(":"), none, F.lit(":unknown"))))
    cols["classification_status"] = F.when(known, "classified").otherwise("unknown")
    return found.withColumns(cols).drop("_text", "_lg", "_rule", "_labels")


def competition_dimensions(df: DataFrame, league: str, key: str, stage: str) -> DataFrame:
    """Explicit labels win; missing ones come from ``league:competition:stage`` keys."""
    parts = F.split(F.coalesce(F.col(key), F.lit("")), ":")
    part = lambda i: F.nullif(F.get(parts, F.lit(i)), F.lit(""))
    return df.withColumns({
        "dim_league": F.coalesce(first_nonblank(F.col(league)), part(0), F.lit("UNKNOWN")), "dim_competition": F.coalesce(part(1), F.lit("unknown")),
        "dim_stage": F.coalesce(first_nonblank(F.col(stage)), part(2), F.lit("unknown"))})


def official_filter(df: DataFrame, text: str) -> DataFrame:
    """Drop exhibition kinds; keep rows whose kind is blank or names an official one."""
    any_of = lambda words: F.coalesce(F.col(text), F.lit("")).rlike("|".join(words))
    return df.filter(~any_of(EXCLUDED_WORDS) & (any_of(OFFICIAL_WORDS) | (clean_text(F.col(text)) == "")))


def confirmed_coverage(df: DataFrame, home: Column, away: Column, keys: Sequence[str] = ()) -> DataFrame:
    both = home & away
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.sum(both.cast("int")).alias("confirmed_rows"), F.avg(both.cast("int")).alias("coverage"))


def starter_pit_mask(df: DataFrame, sides: Sequence[str] = ("home", "away"), cutoff: str = "prediction_cutoff") -> DataFrame:
    """Keep a starter name only when it was announced by the cutoff; pit_safe / partial / unknown."""
    ok = {s: (clean_text(F.col(f"{s}_starter")) != "") & F.coalesce(F.col(f"{s}_starter_announced_at") <= F.col(cutoff), F.lit(False)) for s in sides}
    h, a = (ok[s] for s in sides)
    names = {f"{s}_starter": F.when(ok[s], clean_text(F.col(f"{s}_starter"))).otherwise("") for s in sides}
    return df.withColumns({"starter_evidence_status": F.when(h & a, "pit_safe").when(h | a, "partial").otherwise("unknown"), "confirmed_starters": h & a, **names})


def normalize_tracking(df: DataFrame, metrics: Mapping[str, Sequence[str]], available: str | None = None, prediction: str | None = None) -> DataFrame:
    """Alias-resolved numeric metrics; with both time columns named, a late or missing availability fails the query."""
    cols = {}
    for name, names in metrics.items():
        present = [safe_double(F.col(n)) for n in names if n in df.columns]
        cols[name] = F.coalesce(*present) if present else F.lit(None).cast("double")
    out = df.withColumns(cols)
    if available and prediction:
        late = F.coalesce(F.col(available) > F.col(prediction), F.lit(True))
        out = out.withColumn(available, F.when(late, F.raise_error(F.lit("tracking row not available before prediction")).cast("timestamp")).otherwise(F.col(available)))
    return out


def normalize_research_frame(df: DataFrame, scopes: DataFrame, available: str, prediction: str, event: str = "event_id") -> DataFrame:
    """Rows with an identity and ``available <= prediction`` joined to their scope."""
    ok = F.col(event).isNotNull() & (F.col(available) <= F.col(prediction))
    return df.filter(ok).join(scopes, "scope_id")


def dataset_manifest(df: DataFrame, event: str, groups: Mapping[str, Sequence[str]], keys: Sequence[str] = ()) -> DataFrame:
    """Rows, distinct events and which feature groups carry any value."""
    present = [F.coalesce(F.max(F.greatest(*[F.col(c).isNotNull().cast("int") for c in cols], F.lit(0))), F.lit(0)).alias(f"has_{g}") for g, cols in groups.items()]
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(event).alias("distinct_events"), *present)


# Column-name pattern of each feature family (first match wins, otherwise core).
FAMILIES = (
    ("lineup", r"(?:^|_)lineup_"), ("weather", r"(?:^|_)weather_"), ("context", r"(?:^|_)context(?:_|$)"),
    ("interaction", r"^(?:matchup_)|_x_|(?:^|_)(?:gap|diff)(?:_|$)"), ("starter", r"^(?:hs_|as_|starter_)"),
    ("bullpen", r"^(?:h_|a_|d_)?(?:bp(?:_|[0-9])|bullpen_)"), ("offense", r"^(?:h_|a_|d_)?(?:bat_|offense_)"),
    ("volatility", r"(?:sd_20|slope_20)$|^run_(?:volatility|trend)_"),
)
# The families of every feature-set variant.
VARIANTS = {
    "BASELINE_TEAM_STATE": ("core", "volatility"),
    "TEAM_CORE_SHORT_HORIZON": ("core",),
    "TEAM_CORE_MEDIUM_HORIZON": ("core",),
    "TEAM_CORE_LONG_HORIZON": ("core",),
    "TEAM_CORE_NO_SHRINK": ("core",),
    "TEAM_CORE_SHRINK_ONLY": ("core",),
    "TEAM_CORE_NO_VOLATILITY": ("core",),
    "TEAM_PLUS_STARTER": ("core", "volatility", "starter"),
    "TEAM_PLUS_STARTER_RECENT": ("core", "volatility", "starter"),
    "TEAM_PLUS_BULLPEN": ("core", "volatility", "bullpen"),
    "TEAM_PLUS_BULLPEN_WORKLOAD": ("core", "volatility", "bullpen"),
    "TEAM_PLUS_BULLPEN_QUALITY": ("core", "volatility", "bullpen"),
    "TEAM_PLUS_OFFENSE": ("core", "volatility", "offense"),
    "TEAM_PLUS_OFFENSE_RATE": ("core", "volatility", "offense"),
    "TEAM_PLUS_OFFENSE_POWER": ("core", "volatility", "offense"),
    "TEAM_PLUS_STARTER_BULLPEN": ("core", "volatility", "starter", "bullpen"),
    "TEAM_PLUS_STARTER_OFFENSE": ("core", "volatility", "starter", "offense"),
    "TEAM_PLUS_STARTER_INTERACTIONS": ("core", "volatility", "starter", "interaction"),
    "TEAM_PLUS_STARTER_OFFENSE_INTERACTIONS": ("core", "volatility", "starter", "offense", "interaction"),
    "TEAM_PLUS_STARTER_BULLPEN_OFFENSE_NO_INTERACTIONS": ("core", "volatility", "starter", "bullpen", "offense"),
    "TEAM_PLUS_STARTER_BULLPEN_OFFENSE_INTERACTIONS": ("core", "volatility", "starter", "bullpen", "offense", "interaction"),
    "TEAM_PLUS_LINEUP_PIT_SAFE": ("core", "volatility", "lineup"),
    "TEAM_PLUS_STARTER_LINEUP_PIT_SAFE": ("core", "volatility", "starter", "lineup"),
    "TEAM_PLUS_STARTER_BULLPEN_LINEUP_PIT_SAFE": ("core", "volatility", "starter", "bullpen", "lineup"),
    "TEAM_PLUS_WEATHER_PIT_SAFE": ("core", "volatility", "weather"),
    "FULL_NO_STARTER": ("core", "volatility", "bullpen", "offense", "interaction"),
    "FULL_NO_BULLPEN": ("core", "volatility", "starter", "offense", "interaction"),
    "FULL_NO_OFFENSE": ("core", "volatility", "starter", "bullpen", "interaction"),
    "FULL_NO_INTERACTIONS": ("core", "volatility", "starter", "bullpen", "offense"),
    "FULL_NO_PIT_CONTEXT": ("core", "volatility", "starter", "bullpen", "offense", "interaction"),
    "FULL_PIT_LINEUP_ONLY": ("core", "volatility", "starter", "bullpen", "offense", "interaction", "lineup"),
    "FULL_PIT_WEATHER_ONLY": ("core", "volatility", "starter", "bullpen", "offense", "interaction", "weather"),
    "FULL_VALIDATED_ENSEMBLE": ("core", "volatility", "starter", "bullpen", "offense", "interaction", "lineup", "weather", "context"),
}
# The columns that a variant keeps within one family; horizon and shrink-only variants keep no venue columns.
KEEP = {
    "TEAM_CORE_SHORT_HORIZON": ("core", r"^(?:home_adv|expected_env|[had]_(?:elo|rest_days|matches|bp3|bp7))$|_(?:3|5|10)$"),
    "TEAM_CORE_MEDIUM_HORIZON": ("core", r"^(?:home_adv|expected_env|[had]_(?:elo|rest_days|matches|bp3|bp7))$|_(?:5|10|20)$"),
    "TEAM_CORE_LONG_HORIZON": ("core", r"^(?:home_adv|expected_env|[had]_(?:elo|rest_days|matches|bp3|bp7))$|_(?:10|20|30|45|60)$"),
    "TEAM_CORE_NO_SHRINK": ("core", r"^(?!.*_shrunk_)"),
    "TEAM_CORE_SHRINK_ONLY": ("core", r"^(?:home_adv|expected_env|[had]_(?:elo|rest_days|matches|bp3|bp7))$|_shrunk_"),
    "TEAM_PLUS_STARTER_RECENT": ("starter", r"^(?:hs_|as_)(?:recent_|starts$)"),
    "TEAM_PLUS_BULLPEN_WORKLOAD": ("bullpen", r"^(?:h_|a_|d_)?(?:bp3|bp7|bp_app_10|bp_runs_10|bp_er_10)$"),
    "TEAM_PLUS_BULLPEN_QUALITY": ("bullpen", r"^(?:h_|a_|d_)?bp_(?:ip|era|whip|k9|bb9|hr9|actual_coverage)_10$"),
    "TEAM_PLUS_OFFENSE_RATE": ("offense", r"^(?:h_|a_|d_)?bat_(?:avg|bb_rate|so_rate|hr_rate|iso_proxy|extra_base_rate)_"),
    "TEAM_PLUS_OFFENSE_POWER": ("offense", r"^(?:h_|a_|d_)?(?:bat_(?:hr|xbh|hr_rate|iso_proxy|extra_base_rate)_|offense_power_gap_10)"),
}


def feature_family(column: str) -> str:
    if column in ("home_adv", "expected_env"):
        return "core"
    return next((f for f, pattern in FAMILIES if re.search(pattern, column)), "core")


def schema_hash(columns: Sequence[str]) -> str:
    return hashlib.sha256("\n".join(columns).encode()).hexdigest()


def variant_columns(columns: Sequence[str], variant: str, families: Mapping[str, Sequence[str]] = VARIANTS,
                    rules: Mapping[str, tuple[str, str]] = KEEP) -> list[str]:
    """Columns of a variant, chosen from the schema and the two tables alone (plan time, no data read)."""
    if variant not in families:
        raise ValueError(f"unknown feature-set variant: {variant}")
    present = {feature_family(c) for c in columns}
    for needed in ("lineup", "weather"):
        if needed in families[variant] and needed not in present and variant != "FULL_VALIDATED_ENSEMBLE":
            raise ValueError(f"variant {variant} needs {needed} columns")
    family, rule = rules.get(variant, (None, ""))
    keep = [c for c in columns if feature_family(c) in families[variant] and (feature_family(c) != family or re.search(rule, c))]
    if not keep:
        raise ValueError(f"variant {variant} selects no column")
    return keep


def select_feature_set(df: DataFrame, variant: str, carry: Sequence[str] = (), minimum: int = 1) -> tuple[DataFrame, dict]:
    """Projection of a variant plus its description (id, count, schema hash, excluded columns)."""
    columns = [c for c in df.columns if c not in carry]
    if len(set(columns)) != len(columns):
        raise ValueError("feature columns are not unique")
    keep = variant_columns(columns, variant)
    if len(keep) < minimum:
        raise ValueError(f"variant {variant} is narrower than {minimum} columns")
    digest = schema_hash(keep)
    return df.select(*carry, *keep), {"variant": variant, "feature_set_id": f"{variant}:{digest[:16]}", "feature_count": len(keep), "schema_hash": digest,
                                      "excluded": [c for c in columns if c not in keep]}


def select_pattern(df: DataFrame, families: Sequence[str], horizon: str = "ALL", carry: Sequence[str] = ()) -> DataFrame:
    """Core plus any subset of optional families; the horizon limits the core windows."""
    ends = {"ALL": None, "SHORT": r"_(?:3|5|10)$", "LONG": r"_(?:10|20|30|45|60)$"}[horizon]
    columns = [c for c in df.columns if c not in carry]
    missing = set(families) - {feature_family(c) for c in columns} - {"core"}
    if missing:
        raise ValueError(f"pattern needs unavailable families: {sorted(missing)}")
    core = lambda c: ends is None or c in ("home_adv", "expected_env") or bool(re.search(ends, c))
    keep = [c for c in columns if (core(c) if feature_family(c) == "core" else feature_family(c) in families)]
    return df.select(*carry, *keep)


def transform_representation(df: DataFrame, mode: str, carry: Sequence[str] = ()) -> DataFrame:
    """Level, gap and derived representations of home / away / difference columns."""
    cols = [c for c in df.columns if c not in carry]
    side = {p: [c for c in cols if c.startswith(f"{p}_")] for p in "had"}
    paired = {c for group in side.values() for c in group}
    steady = [c for c in cols if c in ("home_adv", "expected_env", "context_pit_safe")]
    other = [c for c in cols if c not in paired and c not in steady]
    base = {"LEVEL": cols, "HOME_AWAY_ONLY": steady + side["h"] + side["a"] + other, "LEVEL_GAP_ABS_LOG": cols, "PAIR_LOG_RATIO": cols}.get(mode, steady + side["d"] + other)
    extra: dict[str, Column] = {}
    for c in side["d"]:
        x = F.col(c)
        if mode in ("GAP_ABS", "LEVEL_GAP_ABS_LOG"):
            extra[f"abs_{c}"] = F.abs(x)
        if mode == "GAP_POLY2":
            extra[f"sq_{c}"] = x * x
        if mode in ("GAP_SIGNED_LOG", "LEVEL_GAP_ABS_LOG"):
            extra[f"slog_{c}"] = F.signum(x) * F.log1p(F.abs(x))
    if mode == "PAIR_LOG_RATIO":
        for c in side["h"]:
            if f"a_{c[2:]}" in cols:
                up = lambda n: F.log1p(F.greatest(F.col(n), F.lit(0.0)))
                extra[f"logratio_{c[2:]}"] = up(c) - up(f"a_{c[2:]}")
    return df.select(*carry, *base, *[e.alias(n) for n, e in extra.items()])


def validate_feature_matrix(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Violation counts of the matrix contract in one aggregate row."""
    if len(set(features)) != len(features):
        raise ValueError("duplicate feature columns")
    bad = lambda c: F.col(c).isNull() | F.isnan(c) | (F.abs(F.col(c)) == float("inf"))
    count = lambda cond: F.sum(cond.cast("int"))
    undefined = A.add([bad(c).cast("int") for c in features])
    gaps = [c for c in features if c.startswith("d_") and f"h_{c[2:]}" in features and f"a_{c[2:]}" in features]
    broken = A.add([F.coalesce((F.abs(F.col(c) - (F.col(f"h_{c[2:]}") - F.col(f"a_{c[2:]}"))) > 1e-10).cast("int"), F.lit(0)) for c in gaps]) if gaps else F.lit(0)
    adv = count(F.col("home_adv") != 1.0) if "home_adv" in features else F.lit(0)
    return df.agg(F.count(F.lit(1)).alias("rows"), F.sum(undefined).alias("undefined_values"), F.sum(broken).alias("broken_differences"), adv.alias("home_adv_violations"),
                  F.lit(len(gaps)).alias("differences_checked"))


def expand_weights(df: DataFrame, json: str, models: Sequence[str]) -> DataFrame:
    """JSON map of weights to one column per model plus the dominant model (ties by name)."""
    m = F.from_json(json, "map<string,double>")
    entries = F.transform(F.map_entries(m), lambda e: F.struct((-e["value"]).alias("v"), e["key"].alias("k")))
    return df.withColumns({**{f"weight_{x}": F.try_element_at(m, F.lit(x)) for x in models}, "dominant_model": F.array_min(entries)["k"]})


def situation_tags(df: DataFrame, regime: Column, signals: Mapping[str, tuple[Column, float]], environment: Column) -> Column:
    """Compact tags: regime, which side each signal favours beyond its margin, scoring environment."""
    side = lambda v, m: F.when(v > m, "home").when(v < -m, "away").otherwise("balanced")
    tags = [F.concat(F.lit("regime:"), regime), *[F.concat(F.lit(f"{n}:"), side(v, m)) for n, (v, m) in signals.items()]]
    tags.append(F.concat(F.lit("environment:"), F.when(environment >= 4.8, "high").when(environment <= 3.2, "low").otherwise("neutral")))
    return F.array(*tags)


def normalize_probability_rows(df: DataFrame, cols: Sequence[str], tolerance: float = 3e-6, allow_percent: bool = True) -> DataFrame:
    """Percent or unit rows to unit rows; a row that sums to neither fails the query."""
    raw = [F.col(c).cast("double") for c in cols]
    total = A.add(raw)
    ok = F.abs(total - 1.0) <= tolerance
    if allow_percent:
        ok = ok | (F.abs(total - 100.0) <= tolerance * 100)
    positive = F.least(*raw) >= 0
    fail = F.raise_error(F.lit("probability row is not normalised")).cast("double")
    return df.withColumns({c: F.when(ok & positive, r / total).otherwise(fail) for c, r in zip(cols, raw, strict=True)})


def roster_status(players: DataFrame, transactions: DataFrame, key: str = "player_id") -> DataFrame:
    """REGISTERED / REMOVED / REGISTERED_AND_REMOVED / NO_TRANSACTION per player."""
    t = transactions.groupBy(key).agg(F.max((F.col("kind") == "REGISTERED").cast("int")).alias("_in"), F.max((F.col("kind") == "REMOVED").cast("int")).alias("_out"))
    status = (F.when((F.col("_in") == 1) & (F.col("_out") == 1), "REGISTERED_AND_REMOVED").when(F.col("_in") == 1, "REGISTERED").when(F.col("_out") == 1, "REMOVED")
              .otherwise("NO_TRANSACTION"))
    return players.join(t, key, "left").withColumn("roster_status", status).drop("_in", "_out")


def merge_player_kinds(batting: DataFrame, pitching: DataFrame, fielding: DataFrame, roster: DataFrame) -> DataFrame:
    """One row per identity over three stat tables keyed by name; ids only through names unique in the roster."""
    unique = roster.groupBy("name").agg(F.count_distinct("player_id").alias("_n"), F.min("player_id").alias("player_id")).filter("_n = 1").drop("_n")
    merged = batting.join(pitching, "name", "full_outer").join(fielding, "name", "full_outer")
    out = merged.join(unique, "name", "left")
    return out.withColumn("identity_status", F.when(F.col("player_id").isNotNull(), "VERIFIED_STABLE_ID").otherwise("NAME_ONLY"))


# The strategy table (stages, kinds, strategy id, calibration id, minimum rows), first match from the top.
STRATEGIES = (
    (("regular_season", "interleague"), (), "league_adaptive_ensemble", "competition_temperature", 40),
    (("climax_series", "division_series", "league_championship_series", "wild_card", "japan_series", "postseason"), (),
     "postseason_shrunk_ensemble", "competition_temperature", 50),
    (("tournament", "qualifier", "championship"), ("tournament", "qualifier", "international", "international_club"),
     "tournament_shrunk_ensemble", "competition_temperature", 60),
    (("all_star", "spring"), ("exhibition", "friendly"), "exhibition_fallback", "league_temperature_only", 999999),
)
UNKNOWN_STRATEGY = ("unknown_fail_closed", "league_temperature_only", 999999)
OTHER_STRATEGY = ("competition_shrunk_ensemble", "competition_temperature", 60)


def strategy_labels(key: Column, stage: Column, kind: Column, rules: Sequence[tuple] = STRATEGIES, unknown: tuple = UNKNOWN_STRATEGY,
                    other: tuple = OTHER_STRATEGY) -> dict[str, Column]:
    """Strategy, calibration and minimum sample per competition, from a small table of rules; unknown scopes fail closed."""
    part = F.nullif(F.get(F.split(key, ":"), F.lit(2)), F.lit(""))
    stg = F.when(F.coalesce(stage, F.lit("unknown")) == "unknown", F.coalesce(part, F.lit("unknown"))).otherwise(stage)
    names = ("strategy_id", "calibration_id", "minimum_rows")
    pack = lambda values: F.struct(*[F.lit(v).alias(n) for n, v in zip(names, values, strict=True)])
    row = F.when(key.endswith(":unknown") | (stg == "unknown"), pack(unknown)).otherwise(pack(other))
    for stages, kinds, *values in reversed(rules):
        row = F.when(stg.isin(*stages) | (kind.isin(*kinds) if kinds else F.lit(False)), pack(values)).otherwise(row)
    return {n: row[n] for n in names}


def epoch_quarantine(df: DataFrame, generated: str, cutoff: str, start: str, epoch: Column) -> tuple[DataFrame, DataFrame]:
    """(kept, quarantined): rows before the epoch, or whose cutoff was a planned deadline after generation, are not scored."""
    legacy = F.coalesce(F.col(generated) < epoch, F.lit(True)) | F.coalesce(F.col(cutoff) > F.col(generated), F.lit(True)) | F.coalesce(F.col(cutoff) > F.col(start), F.lit(False))
    return df.filter(~legacy), df.filter(legacy)


def outcome_columns(df: DataFrame, p: Sequence[str], names: Sequence[str] = ("home_win_probability", "draw_probability", "away_win_probability")) -> DataFrame:
    """Explicit, validated three-way probability columns."""
    checked = normalize_probability_rows(df, p, 1e-6, allow_percent=False)
    return checked.withColumns({n: F.col(c) for n, c in zip(names, p, strict=True)}).withColumn("outcome_labels", F.array(*[F.lit(x) for x in ("HOME_WIN", "DRAW", "AWAY_WIN")]))


def readiness_state(sources: DataFrame, key: str = "scope_id") -> DataFrame:
    """Best status reached by any source of a scope."""
    order = ("PRODUCTION", "OOS", "PIT", "ADAPTER", "REGISTERED", "HOLD")
    rank = F.lit(len(order))
    for i, s in reversed(list(enumerate(order))):
        rank = F.when(F.col("status") == s, i).otherwise(rank)
    best = sources.groupBy(key).agg(F.min(rank).alias("_r"), F.count(F.lit(1)).alias("sources"))
    return best.select(key, "sources", F.coalesce(F.get(F.array(*[F.lit(s) for s in order]), F.col("_r")), F.lit("HOLD")).alias("readiness"))


# -- rates of counters --------------------------------------------------------------------------------------------


def batting_rates(c: Mapping[str, Column]) -> dict[str, Column]:
    """Rates of batting counters; NULL where a denominator or a counter is missing."""
    z = lambda n: F.coalesce(c[n], F.lit(0.0))
    bases = c["h"] - z("doubles") - z("triples") - z("hr") + 2.0 * z("doubles") + 3.0 * z("triples") + 4.0 * z("hr")
    pos = lambda x: F.when(x > 0, x)
    avg, slg = ratio(c["h"], pos(c["ab"])), ratio(bases, pos(c["ab"]))
    reach = c["ab"] + z("bb") + z("hbp") + z("sf")
    obp = F.when(c["ab"] > 0, ratio(c["h"] + z("bb") + z("hbp"), pos(reach)))
    return {
        "bb_pct": ratio(c["bb"], pos(c["pa"])), "k_pct": ratio(c["so"], pos(c["pa"])), "hr_per_pa": ratio(c["hr"], pos(c["pa"])), "avg": avg, "slg": slg,
        "iso": F.when(avg.isNotNull(), F.greatest(F.lit(0.0), slg - avg)), "obp": obp, "ops": obp + slg, "hr_per_ab": ratio(c["hr"], pos(c["ab"])),
        "sb_success_rate": ratio(z("sb"), pos(z("sb") + z("cs"))), "bb_k_ratio": ratio(c["bb"], pos(c["so"])), "xbh_rate": ratio(z("doubles") + z("triples") + z("hr"), pos(c["h"]))}


def pitching_rates(c: Mapping[str, Column]) -> dict[str, Column]:
    pos = lambda x: F.when(x > 0, x)
    ip, tbf = pos(c["ip"]), pos(c["tbf"])
    return {
        "k9": ratio(9.0 * c["so"], ip), "bb9": ratio(9.0 * c["bb"], ip), "hr9": ratio(9.0 * c["hr"], ip), "whip": ratio(c["h"] + c["bb"], ip), "era": ratio(9.0 * c["er"], ip),
        "fip": ratio(13.0 * c["hr"] + 3.0 * c["bb"] - 2.0 * c["so"], ip) + 3.20, "k_pct": ratio(c["so"], tbf), "bb_pct": ratio(c["bb"], tbf), "k_minus_bb_pct": ratio(c["so"] - c["bb"], tbf),
        "start_share": ratio(c["starts"], pos(c["games"])), "win_rate": ratio(c["wins"], pos(c["wins"] + c["losses"]))}


def fielding_rates(c: Mapping[str, Column]) -> dict[str, Column]:
    pos = lambda x: F.when(x > 0, x)
    chances = c["putouts"] + c["assists"] + c["errors"]
    return {"error_rate": ratio(c["errors"], pos(chances)), "chances_per_game": ratio(pos(chances), pos(c["games"])), "double_plays_per_game": ratio(c["double_plays"], pos(c["games"]))}


def player_role(position: Column, pa: Column, ip: Column, starts: Column, games: Column) -> tuple[Column, Column]:
    """Role and the evidence it rests on; usage on both sides outranks a position label."""
    pos = clean_text(position)
    has = lambda w: F.contains(pos, F.lit(w))
    two_way = F.coalesce((pa >= 20) & (ip >= 10), F.lit(False))
    starter = F.coalesce(starts >= 3, F.lit(False)) | F.coalesce(ratio(starts, F.when(games > 0, games)) >= 0.25, F.lit(False))
    utility = has("内外野") | (has("内野") & has("外野"))
    role = (F.when(two_way, "TWO_WAY_CANDIDATE").when(has("投手") & starter, "STARTING_PITCHER").when(has("投手") & F.coalesce(ip > 0, F.lit(False)), "RELIEF_PITCHER")
            .when(has("投手"), "PITCHER").when(utility, "UTILITY_POSITION_PLAYER").when(has("捕手"), "CATCHER").when(has("内野"), "INFIELDER").when(has("外野"), "OUTFIELDER")
            .when(pa.isNotNull(), "POSITION_PLAYER_UNVERIFIED").when(ip.isNotNull(), "PITCHER_UNVERIFIED").otherwise("UNKNOWN"))
    source = (F.when(two_way & (pos != ""), "OFFICIAL_POSITION_PLUS_PITCHING_USAGE").when(two_way, "BATTING_PLUS_PITCHING_USAGE").when(has("投手"), "OFFICIAL_POSITION_PLUS_PITCHING_USAGE")
              .when(has("捕手") | has("内野") | has("外野"), "OFFICIAL_POSITION").when(pa.isNotNull(), "BATTING_DATA_WITHOUT_CONFIRMED_POSITION")
              .when(ip.isNotNull(), "PITCHING_DATA_WITHOUT_CONFIRMED_POSITION").otherwise("INSUFFICIENT_EVIDENCE"))
    return role, source


def player_coverage(players: DataFrame, flags: Mapping[str, Column], pa: Column, ip: Column, role: str, keys: Sequence[str] = ()) -> DataFrame:
    """Counts and rates of each kind of evidence, usage sums, role histogram as text."""
    base = players.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("player_count"), *[x for n, c in flags.items() for x in (F.sum(c.cast("int")).alias(f"{n}_count"), F.avg(c.cast("int")).alias(f"{n}_rate"))],
        F.sum(pa).alias("observed_pa"), F.sum(ip).alias("observed_ip"))
    roles = players.groupBy(*keys, role).agg(F.count(F.lit(1)).alias("_n")).groupBy(*keys).agg(
        F.concat_ws(",", F.sort_array(F.collect_list(F.concat_ws("=", role, "_n")))).alias("role_counts"))
    return O.attach(base, roles, keys)


def tracking_summary(df: DataFrame, player: str, ts: str, metrics: Sequence[str], minimum: int = 10, tie: str = "event_id") -> DataFrame:
    """Mean, sample deviation (0 for one value) and last value per player; players below the minimum are left out."""
    usable = F.coalesce(*[F.col(m).isNotNull().cast("int") * F.lit(1) for m in metrics]) if len(metrics) == 1 else F.greatest(*[F.col(m).isNotNull().cast("int") for m in metrics])
    rows = df.filter(F.col(player).isNotNull() & F.col(ts).isNotNull() & (usable == 1))
    aggs = []
    for m in metrics:
        at = F.when(F.col(m).isNotNull(), F.struct(ts, tie))
        aggs += [F.avg(m).alias(f"{m}_mean"), F.when(F.count(m) > 1, F.stddev_samp(m)).when(F.count(m) == 1, 0.0).alias(f"{m}_std"), F.max_by(m, at).alias(f"{m}_last")]
    return rows.groupBy(player).agg(F.count(F.lit(1)).alias("observations"), *aggs).filter(F.col("observations") >= minimum)


def game_batting(records: DataFrame, keys: Sequence[str], player: str, counters: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One record per player (the first in ``order``), then sums per key."""
    one = O.latest_by(records, [*keys, player], order, first=True)
    return one.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in counters], F.count(F.lit(1)).alias("players"))


# Event words in order of precedence and the counters each kind adds to.
EVENT_KINDS = (
    ("hr", ("本塁打", "ホームラン"), ("hr", "h", "ab", "pa", "power_events", "contact_events")),
    ("double", ("二塁打",), ("doubles", "h", "ab", "pa", "power_events", "contact_events")),
    ("triple", ("三塁打",), ("triples", "h", "ab", "pa", "power_events", "contact_events")),
    ("walk", ("四球", "死球"), ("pa",)), ("strikeout", ("三振",), ("so", "ab", "pa")), ("bunt", ("犠打", "バント"), ("sh", "bunt", "pa")), ("sac_fly", ("犠飛",), ("sf", "pa")),
    ("gidp", ("併殺",), ("gidp", "ab", "pa")), ("error", ("失策",), ("errors", "ab", "pa")), ("single", ("安打", "単打"), ("h", "ab", "pa", "contact_events")), ("groundout", ("ゴロ",), ("groundout", "ab", "pa")),
    ("flyout", ("フライ",), ("flyout", "ab", "pa")), ("lineout", ("ライナー",), ("lineout", "ab", "pa")),
)
COUNTERS = ("pa", "ab", "h", "hr", "doubles", "triples", "bb", "hbp", "so", "sh", "sf", "gidp", "errors", "groundout", "flyout", "lineout", "sb", "cs", "rbi", "bunt", "power_events", "contact_events")


def event_kind(text: Column) -> Column:
    out = None
    for kind, words, _ in EVENT_KINDS:
        hit = text.rlike("|".join(words))
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out


def player_game_counters(events: DataFrame, text: str, keys: Sequence[str]) -> DataFrame:
    """Counters per key from event texts; a text without a known kind adds nothing, and plate appearances are never fewer than their parts."""
    t, k = F.col(text), F.col("_k")
    adds = {c: [kind for kind, _, cs in EVENT_KINDS if c in cs] for c in COUNTERS}
    cond = {c: k.isin(*kinds) for c, kinds in adds.items() if kinds}
    cond["bb"], cond["hbp"] = (k == "walk") & F.contains(t, F.lit("四球")), (k == "walk") & F.contains(t, F.lit("死球"))
    cond["rbi"] = t.rlike("打点|(?i)rbi")
    cond["cs"] = F.contains(t, F.lit("盗塁死"))
    cond["sb"] = F.contains(t, F.lit("盗塁")) & ~cond["cs"]
    known = events.withColumn("_k", event_kind(t)).filter(k.isNotNull())
    out = known.groupBy(*keys).agg(F.count(F.lit(1)).alias("event_count"), *[F.sum(cond[c].cast("int")).alias(c) for c in COUNTERS])
    return out.withColumn("pa", F.greatest("pa", "ab", "bb", "hbp", "sf", "sh"))

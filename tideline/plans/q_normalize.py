"""Queries over normalisation, contracts, counters and rates."""

from pyspark.sql import functions as F

from tideline.functions.scalars import clean_text, first_nonblank, safe_double
from tideline.operators import evaluate as E
from tideline.operators import normalize as N
from tideline.operators import playlog as L
from tideline.plans.catalog import register
from tideline.plans.q_timeline import us
from tideline.plans.views import Views


@register("p1_first_existing", "SELECT event_id, user_id AS entity, value, -1 AS missing FROM events")
def _(v: Views):
    e = v.table("events")
    return e.select("event_id", L.first_existing(e, ["player", "user_id", "event_type"]).alias("entity"), L.first_existing(e, ["amount", "value"]).alias("value"), L.first_existing(e, ["x", "y"], -1).alias("missing"))


RAW = "CASE event_id % 6 WHEN 0 THEN ' nan ' WHEN 1 THEN '' WHEN 2 THEN 'None' WHEN 3 THEN CAST(value AS VARCHAR) WHEN 4 THEN '-' ELSE '1,234.5' END"
RAWS = RAW.replace("CAST(value AS VARCHAR)", "string(value)")


@register("p2_first_nonnull", f"WITH r AS (SELECT event_id, event_type, {RAW} AS raw FROM events) SELECT event_id, CASE WHEN trim(raw) IN ('', 'nan', 'None') THEN event_type ELSE raw END AS v FROM r")
def _(v: Views):
    return v.table("events").select("event_id", first_nonblank(F.expr(RAWS), F.col("event_type")).alias("v"))


@register("p4_safe_double", f"WITH r AS (SELECT event_id, value, {RAW} AS raw FROM events) SELECT event_id, CASE event_id % 6 WHEN 3 THEN value WHEN 5 THEN 1234.5 END AS v FROM r")
def _(v: Views):
    return v.table("events").select("event_id", safe_double(F.expr(RAWS), strip_commas=True).alias("v"))


@register("p5_clean_text", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN '' WHEN 1 THEN event_type ELSE event_type || ' x' END AS v FROM events")
def _(v: Views):
    return v.table("events").select("event_id", clean_text(F.expr("CASE event_id % 3 WHEN 0 THEN ' NaN ' WHEN 1 THEN concat('　', event_type, '　') ELSE concat(event_type, '　x') END")).alias("v"))


@register("p3_canonical_entity", "SELECT event_id, CASE event_type WHEN 'click' THEN 'tap' WHEN 'view' THEN 'look' ELSE event_type END AS event_type FROM events")
def _(v: Views):
    types = v.table("events").select(F.col("event_type").alias("alias")).distinct()
    aliases = types.select("alias", F.expr("CASE alias WHEN 'click' THEN 'tap' WHEN 'view' THEN 'look' END").alias("canonical")).filter("canonical IS NOT NULL")
    return N.canonical_entity(v.table("events").select("event_id", "event_type"), "event_type", aliases, "alias", "canonical")


@register("p6_attach_event_ids", "SELECT game_id AS event_id, league FROM games")
def _(v: Views):
    return N.attach_event_ids(N.require_columns(v.games, ["game_id", "ts", "home", "away"]), ["event_id", "game_id"]).select("event_id", "league")


KIND = "CASE event_id % 9 WHEN 0 THEN '公式戦' WHEN 1 THEN 'セ・パ交流戦' WHEN 2 THEN '日本シリーズ　第1戦' WHEN 3 THEN 'フレッシュオールスター' WHEN 4 THEN 'オープン戦' WHEN 5 THEN 'w' WHEN 6 THEN 'R' WHEN 7 THEN 'ファーム公式戦' ELSE '' END"
LG = "CASE WHEN event_id % 9 IN (5, 6) THEN 'MLB' WHEN event_id % 27 = 8 THEN 'other' ELSE 'NPB' END"
NAMES = {0: ("npb_regular", "regular_season", "regular_season", "official"), 1: ("npb_interleague", "interleague", "regular_season", "official"), 2: ("npb_japan_series", "japan_series", "postseason", "championship"),
         3: ("npb_fresh_all_star", "all_star", "all_star", "exhibition"), 4: ("npb_open", "spring_training", "spring", "exhibition"), 5: ("mlb_postseason", "world_series", "postseason", "championship"),
         6: ("mlb_regular", "regular_season", "regular_season", "official"), 7: ("npb_farm", "regular_season", "farm", "official")}


NONE, QUOTED = "CASE WHEN event_id % 27 = 8 THEN 'unknown' ELSE 'npb_unknown' END", "'unknown'"


@register("p7_classify_competition", "SELECT event_id, " + ", ".join(
    "CASE event_id % 9 " + " ".join(f"WHEN {k} THEN '{x[i]}'" for k, x in NAMES.items()) + f" ELSE {NONE if i == 0 else QUOTED} END AS {n}" for i, n in enumerate(N.LABELS)) +
    ", CASE event_id % 9 " + " ".join(f"WHEN {k} THEN '{'MLB' if k in (5, 6) else 'NPB'}:{x[0]}:{x[1]}'" for k, x in NAMES.items()) +
    " ELSE CASE WHEN event_id % 27 = 8 THEN 'OTHER:unknown' ELSE 'NPB:npb_unknown:unknown' END END AS competition_key, CASE WHEN event_id % 9 = 8 THEN 'unknown' ELSE 'classified' END AS classification_status FROM events")
def _(v: Views):
    out = N.classify_competition(v.table("events").select("event_id"), F.expr(LG), F.expr(KIND))
    return out.select("event_id", *N.LABELS, "competition_key", "classification_status")


@register("p8_competition_dimensions", "SELECT game_id, CASE WHEN k1 % 3 = 0 THEN 'X' ELSE league END AS dim_league, CASE WHEN k1 % 5 = 0 THEN 'unknown' ELSE 'cup' END AS dim_competition, CASE WHEN k2 % 2 = 0 THEN stage WHEN k1 % 5 = 0 THEN 'unknown' ELSE 'final' END AS dim_stage FROM games")
def _(v: Views):
    g = v.games.select("game_id", F.expr("CASE WHEN k1 % 3 = 0 THEN ' ' ELSE league END").alias("lg"), F.expr("CASE WHEN k1 % 5 = 0 THEN 'X' ELSE 'X:cup:final' END").alias("key"), F.expr("CASE WHEN k2 % 2 = 0 THEN stage END").alias("st"))
    return N.competition_dimensions(g, "lg", "key", "st").select("game_id", "dim_league", "dim_competition", "dim_stage")


@register("p9_official_filter", "SELECT event_id FROM events WHERE event_id % 9 IN (0, 1, 8)")
def _(v: Views):
    return N.official_filter(v.table("events").withColumn("kind", F.expr(KIND)), "kind").select("event_id")


@register("p10_filter_confirmed", "SELECT league, count(*) AS rows, CAST(SUM(CASE WHEN k1 % 3 > 0 AND k2 % 4 > 0 THEN 1 ELSE 0 END) AS BIGINT) AS confirmed_rows, ROUND(avg(CASE WHEN k1 % 3 > 0 AND k2 % 4 > 0 THEN 1 ELSE 0 END), 9) AS coverage FROM games GROUP BY 1")
def _(v: Views):
    return us(N.confirmed_coverage(v.games, F.expr("k1 % 3 > 0"), F.expr("k2 % 4 > 0"), ["league"]))


@register("p11_starter_pit_mask", """WITH s AS (SELECT event_id, event_id % 7 > 0 AND available_at <= prediction_cutoff - INTERVAL 4 HOUR AS h0, event_id % 5 > 0 AND retrieved_at <= prediction_cutoff - INTERVAL 4 HOUR AS a0, entity_id FROM ledger), m AS (SELECT *, COALESCE(h0, FALSE) AS h, COALESCE(a0, FALSE) AS a FROM s)
SELECT event_id, CASE WHEN h AND a THEN 'pit_safe' WHEN h OR a THEN 'partial' ELSE 'unknown' END AS starter_evidence_status, h AND a AS confirmed_starters, CASE WHEN h THEN 'H' || entity_id ELSE '' END AS home_starter FROM m""")
def _(v: Views):
    s = v.ledger.select("event_id", F.expr("prediction_cutoff - INTERVAL 4 HOURS").alias("prediction_cutoff"), F.expr("CASE WHEN event_id % 7 > 0 THEN concat('H', entity_id) ELSE 'nan' END").alias("home_starter"),
                        F.expr("CASE WHEN event_id % 5 > 0 THEN concat('A', entity_id) END").alias("away_starter"), F.col("available_at").alias("home_starter_announced_at"), F.col("retrieved_at").alias("away_starter_announced_at"))
    return N.starter_pit_mask(s).select("event_id", "starter_evidence_status", "confirmed_starters", "home_starter")


@register("p12_normalize_tracking", "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN NULL WHEN event_id % 4 = 1 THEN value + 1 ELSE value END AS speed, CAST(NULL AS DOUBLE) AS spin FROM ledger WHERE available_at IS NOT NULL")
def _(v: Views):
    t = v.ledger.filter("available_at IS NOT NULL").select("event_id", "available_at", "prediction_cutoff", F.expr("CASE WHEN event_id % 4 IN (0, 1) THEN 'nan' ELSE string(value) END").alias("pitch_speed_kmh"),
                                                           F.expr("CASE WHEN event_id % 4 = 1 THEN value + 1 END").alias("release_speed"))
    out = N.normalize_tracking(t, {"speed": ["pitch_speed_kmh", "release_speed"], "spin": ["spin_rate_rpm"]}, "available_at", "prediction_cutoff")
    return out.select("event_id", "speed", "spin")


@register("p13_normalize_research_frame", "SELECT event_id, 'region ' || r_name AS scope FROM ledger JOIN region ON r_regionkey = entity_id % 5 WHERE available_at <= prediction_cutoff - INTERVAL 8 HOUR")
def _(v: Views):
    scopes = v.table("region").select(F.col("r_regionkey").alias("scope_id"), F.concat(F.lit("region "), "r_name").alias("scope"))
    f = v.ledger.select("event_id", F.expr("int(entity_id % 5)").alias("scope_id"), "available_at", F.expr("prediction_cutoff - INTERVAL 8 HOURS").alias("prediction_time"))
    return N.normalize_research_frame(f, scopes, "available_at", "prediction_time").select("event_id", "scope")


@register("p14_dataset_manifest", "SELECT source, count(*) AS rows, count(DISTINCT entity_id) AS distinct_events, MAX(CASE WHEN payload_hash IS NOT NULL OR value IS NOT NULL THEN 1 ELSE 0 END) AS has_payload, MAX(CASE WHEN available_at IS NOT NULL THEN 1 ELSE 0 END) AS has_time FROM ledger GROUP BY 1")
def _(v: Views):
    return N.dataset_manifest(v.ledger, "entity_id", {"payload": ["payload_hash", "value"], "time": ["available_at"]}, ["source"])


FEAT = {"home_adv": "1.0", "h_elo": "1500 + k1 % 50", "a_elo": "1500 + k2 % 50", "d_elo": "k1 % 50 - k2 % 50", "h_gf_3": "home_score", "h_gf_10": "home_score + k1 % 3", "a_gf_10": "away_score", "d_gf_10": "home_score + k1 % 3 - away_score",
        "h_win_shrunk_5": "k1 % 7 / 7.0", "hs_era": "k2 % 9", "hs_recent_era": "k2 % 4", "h_bp3": "k1 % 4", "bp_era_10": "k3 % 8", "h_bat_hr_10": "k1 % 6", "h_bat_avg_10": "k1 % 10 / 30.0", "h_gf_sd_20": "k2 % 3", "matchup_x": "k3 % 5", "expected_env": "3 + k3 % 4"}


def _matrix(v: Views):
    fix = lambda e: e.replace("7.0", "7D").replace("30.0", "30D").replace("1.0", "1D")
    return v.games.select("game_id", *[F.expr(f"double({fix(e)})").alias(c) for c, e in FEAT.items()])


MX = "mx AS (SELECT game_id, " + ", ".join(f"CAST({e} AS DOUBLE) AS {c}" for c, e in FEAT.items()) + " FROM games)"
RD = lambda cols: ", ".join(f"ROUND({c}, 9) AS {c}" for c in cols)


@register("p15_select_feature_set", f"WITH {MX} SELECT game_id, {RD(['home_adv', 'h_elo', 'a_elo', 'd_elo', 'h_gf_3', 'h_gf_10', 'a_gf_10', 'd_gf_10', 'h_win_shrunk_5', 'hs_recent_era', 'h_gf_sd_20', 'expected_env'])} FROM mx")
def _(v: Views):
    return us(N.select_feature_set(_matrix(v), "TEAM_PLUS_STARTER_RECENT", ["game_id"])[0])


@register("p16_select_features", f"WITH {MX} SELECT game_id, {RD(['home_adv', 'h_elo', 'a_elo', 'd_elo', 'h_gf_3', 'h_gf_10', 'a_gf_10', 'd_gf_10', 'h_win_shrunk_5', 'expected_env'])} FROM mx")
def _(v: Views):
    return us(N.select_feature_set(_matrix(v), "TEAM_CORE_SHORT_HORIZON", ["game_id"], minimum=5)[0])


@register("p17_select_pattern", f"WITH {MX} SELECT game_id, {RD(['home_adv', 'h_gf_3', 'h_gf_10', 'a_gf_10', 'd_gf_10', 'h_win_shrunk_5', 'hs_era', 'hs_recent_era', 'matchup_x', 'expected_env'])} FROM mx")
def _(v: Views):
    return us(N.select_pattern(_matrix(v), ["starter", "interaction"], "SHORT", ["game_id"]))


@register("p18_transform_representation", f"""WITH {MX} SELECT game_id, {RD([c for c in FEAT])}, {', '.join(f'ROUND(abs({c}), 9) AS abs_{c}, ROUND(sign({c}) * ln(1 + abs({c})), 9) + 0.0 AS slog_{c}' for c in ('d_elo', 'd_gf_10'))} FROM mx""")
def _(v: Views):
    return us(N.transform_representation(_matrix(v), "LEVEL_GAP_ABS_LOG", ["game_id"]))


@register("p18_pair_log_ratio", f"WITH {MX} SELECT game_id, {', '.join(f'ROUND(ln(1 + h_{c}) - ln(1 + a_{c}), 9) + 0.0 AS logratio_{c}' for c in ('elo', 'gf_10'))} FROM mx")
def _(v: Views):
    out = N.transform_representation(_matrix(v), "PAIR_LOG_RATIO", ["game_id"])
    return us(out.select("game_id", "logratio_elo", "logratio_gf_10"))


@register("p19_validate_feature_matrix", f"WITH {MX} SELECT count(*) AS rows, CAST(SUM(CASE WHEN h_gf_3 > 8 THEN 1 ELSE 0 END) AS BIGINT) AS undefined_values, CAST(0 AS BIGINT) AS broken_differences, CAST(0 AS BIGINT) AS home_adv_violations, 2 AS differences_checked FROM mx")
def _(v: Views):
    m = _matrix(v).withColumn("h_gf_3", F.when(F.col("h_gf_3") > 8, F.lit(None)).otherwise(F.col("h_gf_3")))
    return N.validate_feature_matrix(m, list(FEAT))


@register("p20_expand_weights", """WITH w AS (SELECT game_id, ROUND((k1 % 5) / 10.0, 1) AS a, ROUND((k2 % 4) / 10.0, 1) AS b, CASE WHEN k3 % 2 = 0 THEN ROUND((k3 % 3) / 10.0, 1) END AS c FROM games)
SELECT game_id, CAST(a AS DOUBLE) AS weight_a, CAST(b AS DOUBLE) AS weight_b, CAST(c AS DOUBLE) AS weight_c, CASE WHEN a >= b AND a >= COALESCE(c, -1) THEN 'a' WHEN b >= COALESCE(c, -1) THEN 'b' ELSE 'c' END AS dominant_model FROM w""")
def _(v: Views):
    js = F.expr("to_json(map_filter(map('a', k1 % 5 / 10D, 'b', k2 % 4 / 10D, 'c', CASE WHEN k3 % 2 = 0 THEN k3 % 3 / 10D END), (k, x) -> x IS NOT NULL))")
    return N.expand_weights(v.games.select("game_id", js.alias("w")), "w", ["a", "b", "c"]).drop("w")


@register("p21_situation_tags", """SELECT game_id, concat_ws(',', 'regime:' || league, 'starter:' || CASE WHEN home_score - away_score > 2 THEN 'home' WHEN home_score - away_score < -2 THEN 'away' ELSE 'balanced' END,
 'rest:' || CASE WHEN k1 % 5 - 2 > 1 THEN 'home' WHEN k1 % 5 - 2 < -1 THEN 'away' ELSE 'balanced' END, 'environment:' || CASE WHEN k3 % 7 >= 4.8 THEN 'high' WHEN k3 % 7 <= 3.2 THEN 'low' ELSE 'neutral' END) AS tags FROM games""")
def _(v: Views):
    tags = N.situation_tags(v.games, F.col("league"), {"starter": (F.col("home_score") - F.col("away_score"), 2), "rest": (F.expr("k1 % 5 - 2"), 1)}, F.expr("k3 % 7"))
    return v.games.select("game_id", F.concat_ws(",", tags).alias("tags"))


@register("p22_horizon_bucket", "WITH m AS (SELECT event_id, CASE WHEN event_id % 50 = 0 THEN NULL ELSE event_id % 500 - 20 END AS m FROM events) SELECT event_id, CASE WHEN m IS NULL OR m < 0 THEN 'UNKNOWN' WHEN m < 30 THEN 'LT_30M' WHEN m < 60 THEN '30_TO_60M' WHEN m < 180 THEN '1_TO_3H' WHEN m < 360 THEN '3_TO_6H' ELSE 'GE_6H' END AS horizon FROM m")
def _(v: Views):
    return v.table("events").select("event_id", E.horizon_bucket(F.expr("CASE WHEN event_id % 50 = 0 THEN NULL ELSE double(event_id % 500 - 20) END")).alias("horizon"))


@register("p23_normalize_probability_rows", "SELECT game_id, ROUND(p_home, 8) AS a, ROUND(p_draw, 8) AS b, ROUND(p_away, 8) AS c FROM probs")
def _(v: Views):
    scale = F.expr("CASE WHEN k1 % 2 = 0 THEN 100D ELSE 1D END")
    p = v.probs.select("game_id", *[(F.col(f"p_{c}") * scale).alias(n) for c, n in (("home", "a"), ("draw", "b"), ("away", "c"))])
    return us(N.normalize_probability_rows(p, ["a", "b", "c"]), digits=8)


@register("p24_roster_status", """WITH t AS (SELECT user_id, MAX(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) AS i, MAX(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS o FROM events WHERE user_id % 3 > 0 AND event_id % 9 = 0 AND event_type IN ('signup', 'error') GROUP BY 1)
SELECT c_custkey AS player_id, CASE WHEN i = 1 AND o = 1 THEN 'REGISTERED_AND_REMOVED' WHEN i = 1 THEN 'REGISTERED' WHEN o = 1 THEN 'REMOVED' ELSE 'NO_TRANSACTION' END AS roster_status FROM customer LEFT JOIN t ON user_id = c_custkey""")
def _(v: Views):
    tx = v.table("events").filter("user_id % 3 > 0 AND event_id % 9 = 0 AND event_type IN ('signup', 'error')").select(F.col("user_id").alias("player_id"), F.expr("CASE event_type WHEN 'signup' THEN 'REGISTERED' ELSE 'REMOVED' END").alias("kind"))
    return N.roster_status(v.table("customer").select(F.col("c_custkey").alias("player_id")), tx)


@register("p25_merge_player_kinds", """WITH b AS (SELECT c_name AS name, c_acctbal AS bat FROM customer WHERE c_custkey % 2 = 0), p AS (SELECT c_name AS name, c_acctbal + 1 AS pit FROM customer WHERE c_custkey % 3 = 0), f AS (SELECT c_name AS name, c_acctbal + 2 AS fld FROM customer WHERE c_custkey % 5 = 0),
r AS (SELECT name, MIN(id) AS id FROM (SELECT c_name AS name, c_custkey AS id FROM customer UNION ALL SELECT c_name, c_custkey + 1000000 FROM customer WHERE c_custkey % 7 = 0) GROUP BY 1 HAVING count(DISTINCT id) = 1)
SELECT COALESCE(b.name, p.name, f.name) AS name, bat, pit, fld, CAST(COALESCE(r.id, -1) AS BIGINT) AS player_id, CASE WHEN r.id IS NULL THEN 'NAME_ONLY' ELSE 'VERIFIED_STABLE_ID' END AS identity_status
FROM b FULL JOIN p ON p.name = b.name FULL JOIN f ON f.name = COALESCE(b.name, p.name) LEFT JOIN r ON r.name = COALESCE(b.name, p.name, f.name)""")
def _(v: Views):
    c = v.table("customer").select(F.col("c_name").alias("name"), "c_custkey", "c_acctbal")
    part = lambda n, col, add: c.filter(f"c_custkey % {n} = 0").select("name", (F.col("c_acctbal") + add).alias(col))
    roster = c.select("name", F.col("c_custkey").alias("player_id")).unionByName(c.filter("c_custkey % 7 = 0").select("name", (F.col("c_custkey") + 1000000).alias("player_id")))
    return N.merge_player_kinds(part(2, "bat", 0), part(3, "pit", 1), part(5, "fld", 2), roster).withColumn("player_id", F.coalesce("player_id", F.lit(-1)))


STG = "CASE k1 % 6 WHEN 0 THEN 'regular_season' WHEN 1 THEN 'wild_card' WHEN 2 THEN 'tournament' WHEN 3 THEN 'all_star' WHEN 4 THEN 'unknown' ELSE 'other' END"


@register("p27_strategy_labels", f"""WITH s AS (SELECT game_id, k2, {STG} AS raw, CASE WHEN {STG} = 'unknown' THEN CASE WHEN k2 % 2 = 0 THEN 'interleague' ELSE 'unknown' END ELSE {STG} END AS s FROM games)
SELECT game_id, CASE WHEN s IN ('regular_season', 'interleague') THEN 'league_adaptive_ensemble' WHEN s = 'wild_card' THEN 'postseason_shrunk_ensemble' WHEN s = 'tournament' THEN 'tournament_shrunk_ensemble' WHEN s = 'all_star' THEN 'exhibition_fallback' WHEN s = 'unknown' THEN 'unknown_fail_closed' ELSE 'competition_shrunk_ensemble' END AS strategy_id,
 CASE WHEN s IN ('all_star', 'unknown') THEN 'league_temperature_only' ELSE 'competition_temperature' END AS calibration_id, CASE WHEN s IN ('regular_season', 'interleague') THEN 40 WHEN s = 'wild_card' THEN 50 WHEN s = 'tournament' THEN 60 WHEN s IN ('all_star', 'unknown') THEN 999999 ELSE 60 END AS minimum_rows FROM s""")
def _(v: Views):
    key = F.expr("CASE WHEN k2 % 2 = 0 THEN 'A:b:interleague' WHEN k1 % 6 = 4 THEN 'A:unknown' ELSE 'A:b:c' END")
    return v.games.select("game_id", *[c.alias(n) for n, c in N.strategy_labels(key, F.expr(STG), F.lit("league")).items()])


@register("p28_epoch_quarantine", """SELECT event_id, CASE WHEN retrieved_at < TIMESTAMP '2024-01-05' OR source_timestamp > retrieved_at OR source_timestamp > prediction_cutoff THEN 'QUARANTINED' ELSE 'KEPT' END AS fate FROM ledger""")
def _(v: Views):
    kept, out = N.epoch_quarantine(v.ledger, "retrieved_at", "source_timestamp", "prediction_cutoff", F.expr("TIMESTAMP '2024-01-05 00:00:00 UTC'"))
    return kept.select("event_id", F.lit("KEPT").alias("fate")).unionByName(out.select("event_id", F.lit("QUARANTINED").alias("fate")))


@register("p30_outcome_columns", "SELECT game_id, ROUND(p_home, 8) AS home_win_probability, ROUND(p_draw, 8) AS draw_probability, ROUND(p_away, 8) AS away_win_probability, 'HOME_WIN,DRAW,AWAY_WIN' AS labels FROM probs")
def _(v: Views):
    out = N.outcome_columns(v.probs, ["p_home", "p_draw", "p_away"])
    return us(out.select("game_id", "home_win_probability", "draw_probability", "away_win_probability", F.array_join("outcome_labels", ",").alias("labels")), digits=8)


@register("p31_readiness_state", """WITH s AS (SELECT c_nationkey AS scope_id, CASE WHEN c_custkey % 97 = 0 THEN 'PRODUCTION' WHEN c_custkey % 31 = 0 THEN 'OOS' WHEN c_custkey % 5 = 0 THEN 'REGISTERED' ELSE 'HOLD' END AS status FROM customer)
SELECT scope_id, count(*) AS sources, arg_min(status, CASE status WHEN 'PRODUCTION' THEN 0 WHEN 'OOS' THEN 1 WHEN 'REGISTERED' THEN 4 ELSE 5 END) AS readiness FROM s GROUP BY 1""")
def _(v: Views):
    s = v.table("customer").select(F.col("c_nationkey").alias("scope_id"), F.expr("CASE WHEN c_custkey % 97 = 0 THEN 'PRODUCTION' WHEN c_custkey % 31 = 0 THEN 'OOS' WHEN c_custkey % 5 = 0 THEN 'REGISTERED' ELSE 'HOLD' END").alias("status"))
    return N.readiness_state(s)


CNT = {"pa": "SUM(4 + k1 % 3)", "ab": "SUM(3 + k1 % 2)", "h": "SUM(home_score % 3)", "doubles": "SUM(k1 % 2)", "triples": "SUM(k2 % 2)", "hr": "SUM(k3 % 2)", "bb": "SUM(k2 % 3)", "hbp": "SUM(k3 % 5 // 4)", "sf": "SUM(k1 % 7 // 6)", "so": "SUM(away_score % 4)", "sb": "SUM(k1 % 4 // 3)", "cs": "SUM(k2 % 4 // 3)"}


def _counters(v: Views, spec, key):
    return v.games.groupBy(F.expr(key).alias("player_id")).agg(*[F.expr(e.replace("//", "div")).cast("double").alias(c) for c, e in spec.items()])


@register("a7_batting_rates", f"""WITH c AS (SELECT k1 % 300 AS player_id, {', '.join(f'CAST({e} AS DOUBLE) AS {c}' for c, e in CNT.items())} FROM games GROUP BY 1),
r AS (SELECT *, h / NULLIF(ab, 0) AS avg, (h + doubles + 2 * triples + 3 * hr) / NULLIF(ab, 0) AS slg, (h + bb + hbp) / NULLIF(ab + bb + hbp + sf, 0) AS obp FROM c)
SELECT player_id, ROUND(bb / NULLIF(pa, 0), 8) AS bb_pct, ROUND(so / NULLIF(pa, 0), 8) AS k_pct, ROUND(hr / NULLIF(pa, 0), 8) AS hr_per_pa, ROUND(avg, 8) AS avg, ROUND(slg, 8) AS slg, ROUND(GREATEST(0, slg - avg), 8) AS iso, ROUND(obp, 8) AS obp, ROUND(obp + slg, 8) AS ops,
 ROUND(hr / NULLIF(ab, 0), 8) AS hr_per_ab, ROUND(sb / NULLIF(sb + cs, 0), 8) AS sb_success_rate, ROUND(bb / NULLIF(so, 0), 8) AS bb_k_ratio, ROUND((doubles + triples + hr) / NULLIF(h, 0), 8) AS xbh_rate FROM r""")
def _(v: Views):
    c = _counters(v, CNT, "k1 % 300")
    return us(c.select("player_id", *[e.alias(n) for n, e in N.batting_rates({x: F.col(x) for x in CNT}).items()]), digits=8)


PIT = {"ip": "SUM(k2 % 4)", "so": "SUM(home_score % 3)", "bb": "SUM(k2 % 3)", "hr": "SUM(k3 % 2)", "h": "SUM(away_score % 3)", "er": "SUM(k1 % 4)", "tbf": "SUM(4 + k1 % 3)", "starts": "SUM(k3 % 3 // 2)", "games": "COUNT(*)", "wins": "SUM(k1 % 2)", "losses": "SUM(k2 % 2)"}


@register("a8_pitching_rates", f"""WITH c AS (SELECT k2 % 300 AS player_id, {', '.join(f'CAST({e} AS DOUBLE) AS {c}' for c, e in PIT.items())} FROM games GROUP BY 1)
SELECT player_id, {', '.join(f'ROUND({e}, 8) AS {n}' for n, e in (('k9', '9 * so / NULLIF(ip, 0)'), ('bb9', '9 * bb / NULLIF(ip, 0)'), ('hr9', '9 * hr / NULLIF(ip, 0)'), ('whip', '(h + bb) / NULLIF(ip, 0)'), ('era', '9 * er / NULLIF(ip, 0)'), ('fip', '(13 * hr + 3 * bb - 2 * so) / NULLIF(ip, 0) + 3.20::DOUBLE'), ('k_pct', 'so / NULLIF(tbf, 0)'), ('bb_pct', 'bb / NULLIF(tbf, 0)'), ('k_minus_bb_pct', '(so - bb) / NULLIF(tbf, 0)'), ('start_share', 'starts / NULLIF(games, 0)'), ('win_rate', 'wins / NULLIF(wins + losses, 0)')))} FROM c""")
def _(v: Views):
    c = _counters(v, PIT, "k2 % 300")
    return us(c.select("player_id", *[e.alias(n) for n, e in N.pitching_rates({x: F.col(x) for x in PIT}).items()]), digits=8)


FLD = {"putouts": "SUM(k1 % 5)", "assists": "SUM(k2 % 3)", "errors": "SUM(k3 % 9 // 8)", "double_plays": "SUM(k1 % 6 // 5)", "games": "COUNT(*)"}


@register("a9_fielding_rates", f"WITH c AS (SELECT k3 % 400 AS player_id, {', '.join(f'CAST({e} AS DOUBLE) AS {c}' for c, e in FLD.items())} FROM games GROUP BY 1) SELECT player_id, ROUND(errors / NULLIF(putouts + assists + errors, 0), 8) AS error_rate, ROUND(NULLIF(putouts + assists + errors, 0) / games, 8) AS chances_per_game, ROUND(double_plays / games, 8) AS double_plays_per_game FROM c")
def _(v: Views):
    c = _counters(v, FLD, "k3 % 400")
    return us(c.select("player_id", *[e.alias(n) for n, e in N.fielding_rates({x: F.col(x) for x in FLD}).items()]), digits=8)


ROLE = "r AS (SELECT c_custkey AS id, c_nationkey AS team, CASE c_custkey % 6 WHEN 0 THEN '投手' WHEN 1 THEN '捕手' WHEN 2 THEN '内野手' WHEN 3 THEN '外野手' WHEN 4 THEN '内外野手' END AS pos, CASE WHEN c_custkey % 4 > 0 THEN c_custkey % 40 END AS pa, CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 20 END AS ip, c_custkey % 5 AS starts, c_custkey % 11 AS games FROM customer)"
ROLED = ROLE + """, q AS (SELECT *, CASE WHEN COALESCE(pa >= 20 AND ip >= 10, FALSE) THEN 'TWO_WAY_CANDIDATE' WHEN pos = '投手' AND (starts >= 3 OR COALESCE(starts / NULLIF(games, 0) >= 0.25, FALSE)) THEN 'STARTING_PITCHER' WHEN pos = '投手' AND COALESCE(ip > 0, FALSE) THEN 'RELIEF_PITCHER' WHEN pos = '投手' THEN 'PITCHER'
 WHEN pos = '内外野手' THEN 'UTILITY_POSITION_PLAYER' WHEN pos = '捕手' THEN 'CATCHER' WHEN pos = '内野手' THEN 'INFIELDER' WHEN pos = '外野手' THEN 'OUTFIELDER' WHEN pa IS NOT NULL THEN 'POSITION_PLAYER_UNVERIFIED' WHEN ip IS NOT NULL THEN 'PITCHER_UNVERIFIED' ELSE 'UNKNOWN' END AS role FROM r)"""


def _roles(v: Views):
    r = v.table("customer").select(
        F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("team"), F.expr("CASE c_custkey % 6 WHEN 0 THEN '投手' WHEN 1 THEN '捕手' WHEN 2 THEN '内野手' WHEN 3 THEN '外野手' WHEN 4 THEN '内外野手' END").alias("pos"),
        F.expr("CASE WHEN c_custkey % 4 > 0 THEN c_custkey % 40 END").alias("pa"), F.expr("CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 20 END").alias("ip"), F.expr("c_custkey % 5").alias("starts"), F.expr("c_custkey % 11").alias("games"))
    role, source = N.player_role(F.col("pos"), F.col("pa"), F.col("ip"), F.col("starts"), F.col("games"))
    return r.withColumns({"role": role, "role_source": source})


@register("a11_player_role", f"""WITH {ROLED} SELECT id, role, CASE WHEN role = 'TWO_WAY_CANDIDATE' THEN CASE WHEN pos IS NOT NULL THEN 'OFFICIAL_POSITION_PLUS_PITCHING_USAGE' ELSE 'BATTING_PLUS_PITCHING_USAGE' END WHEN pos = '投手' THEN 'OFFICIAL_POSITION_PLUS_PITCHING_USAGE' WHEN pos IS NOT NULL THEN 'OFFICIAL_POSITION'
 WHEN pa IS NOT NULL THEN 'BATTING_DATA_WITHOUT_CONFIRMED_POSITION' WHEN ip IS NOT NULL THEN 'PITCHING_DATA_WITHOUT_CONFIRMED_POSITION' ELSE 'INSUFFICIENT_EVIDENCE' END AS role_source FROM q""")
def _(v: Views):
    return _roles(v).select("id", "role", "role_source")


@register("a10_player_coverage", f"""WITH {ROLED}, h AS (SELECT team, string_agg(role || '=' || n, ',' ORDER BY role || '=' || n) AS role_counts FROM (SELECT team, role, count(*) AS n FROM q GROUP BY ALL) GROUP BY 1)
SELECT q.team, count(*) AS player_count, CAST(SUM(CASE WHEN pa IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS batting_count, ROUND(avg(CASE WHEN pa IS NOT NULL THEN 1 ELSE 0 END), 8) AS batting_rate, CAST(SUM(CASE WHEN ip IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS pitching_count, ROUND(avg(CASE WHEN ip IS NOT NULL THEN 1 ELSE 0 END), 8) AS pitching_rate,
 CAST(SUM(pa) AS BIGINT) AS observed_pa, CAST(SUM(ip) AS BIGINT) AS observed_ip, any_value(role_counts) AS role_counts FROM q JOIN h USING (team) GROUP BY 1""")
def _(v: Views):
    return us(N.player_coverage(_roles(v), {"batting": F.col("pa").isNotNull(), "pitching": F.col("ip").isNotNull()}, F.col("pa"), F.col("ip"), "role", ["team"]), digits=8)


@register("a12_tracking_summary", """WITH t AS (SELECT user_id AS player_id, ts, event_id, CASE WHEN event_id % 4 > 0 THEN value END AS speed, CASE WHEN event_id % 6 > 0 THEN value * 2 END AS spin FROM events)
SELECT player_id, count(*) AS observations, ROUND(avg(speed), 6) AS speed_mean, ROUND(COALESCE(stddev_samp(speed), CASE WHEN count(speed) = 1 THEN 0 END), 6) AS speed_std, arg_max(speed, (ts, event_id)) FILTER (speed IS NOT NULL) AS speed_last, ROUND(avg(spin), 6) AS spin_mean, ROUND(COALESCE(stddev_samp(spin), CASE WHEN count(spin) = 1 THEN 0 END), 6) AS spin_std,
 arg_max(spin, (ts, event_id)) FILTER (spin IS NOT NULL) AS spin_last FROM t WHERE speed IS NOT NULL OR spin IS NOT NULL GROUP BY 1 HAVING count(*) >= 10""")
def _(v: Views):
    t = v.table("events").select(F.col("user_id").alias("player_id"), "ts", "event_id", F.expr("CASE WHEN event_id % 4 > 0 THEN value END").alias("speed"), F.expr("CASE WHEN event_id % 6 > 0 THEN value * 2 END").alias("spin"))
    return us(N.tracking_summary(t, "player_id", "ts", ["speed", "spin"]), digits=6)


@register("a5_game_batting", """WITH d AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linestatus, l_suppkey ORDER BY l_linenumber, l_partkey, l_extendedprice) AS rk FROM lineitem)
SELECT l_orderkey, l_linestatus, CAST(SUM(CAST(l_quantity AS BIGINT)) AS BIGINT) AS pa, CAST(SUM(CAST(l_quantity AS BIGINT) % 5) AS BIGINT) AS hits, count(*) AS players FROM d WHERE rk = 1 GROUP BY ALL""")
def _(v: Views):
    rec = v.table("lineitem").select("l_orderkey", "l_linestatus", "l_suppkey", "l_linenumber", "l_partkey", "l_extendedprice", F.col("l_quantity").cast("bigint").alias("pa"), (F.col("l_quantity").cast("bigint") % 5).alias("hits"))
    return N.game_batting(rec, ["l_orderkey", "l_linestatus"], "l_suppkey", ["pa", "hits"], ["l_linenumber", "l_partkey", "l_extendedprice"])


TXT = ("本塁打 打点2", "右中間二塁打", "三塁打", "四球", "死球", "空振り三振", "犠打", "犠飛 RBI", "併殺打", "失策", "中前安打", "ゴロ", "フライ", "ライナー", "盗塁", "安打 盗塁", "安打 盗塁死")
GOT = {
    0: ("hr", "h", "ab", "pa", "rbi", "power_events", "contact_events"),
    1: ("doubles", "h", "ab", "pa", "power_events", "contact_events"),
    2: ("triples", "h", "ab", "pa", "power_events", "contact_events"),
    3: ("pa", "bb"),
    4: ("pa", "hbp"),
    5: ("so", "ab", "pa"),
    6: ("sh", "bunt", "pa"),
    7: ("sf", "pa", "rbi"),
    8: ("gidp", "ab", "pa"),
    9: ("errors", "ab", "pa"),
    10: ("h", "ab", "pa", "contact_events"),
    11: ("groundout", "ab", "pa"),
    12: ("flyout", "ab", "pa"),
    13: ("lineout", "ab", "pa"),
    15: ("h", "ab", "pa", "sb", "contact_events"),
    16: ("h", "ab", "pa", "cs", "contact_events"),
}


@register("a6_player_game_counters", "SELECT user_id, CASE WHEN event_id % 2 = 0 THEN 'H' ELSE 'A' END AS side, count(*) AS event_count, " + ", ".join(
    f"CAST(SUM(CASE WHEN event_id % 17 IN ({', '.join(str(k) for k, s in GOT.items() if c in s)}) THEN 1 ELSE 0 END) AS BIGINT) AS {c}" for c in N.COUNTERS) + " FROM events WHERE event_id % 17 <> 14 GROUP BY ALL")
def _(v: Views):
    text = F.element_at(F.array(*[F.lit(t) for t in TXT]), (F.col("event_id") % 17 + 1).cast("int"))
    e = v.table("events").select("user_id", F.expr("CASE WHEN event_id % 2 = 0 THEN 'H' ELSE 'A' END").alias("side"), text.alias("text"))
    return N.player_game_counters(e, "text", ["user_id", "side"])

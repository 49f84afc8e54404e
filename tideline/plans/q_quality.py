"""Queries over quality, drift and audits."""

from pyspark.sql import functions as F

from tideline.operators import quality as Q
from tideline.plans.catalog import register
from tideline.plans.q_timeline import us
from tideline.plans.views import Views


@register("q1_data_quality", """WITH s AS (SELECT count(*) AS n, SUM((payload_hash IS NULL)::INT + (available_at IS NULL)::INT) AS m, count(DISTINCT (entity_id, source)) AS d FROM ledger),
r AS (SELECT n AS rows, 5 AS columns, m / (n * 5) AS missing_rate, 1 - d / n AS duplicate_rate, 0.0::DOUBLE AS nonfinite_rate FROM s), z AS (SELECT *, GREATEST(0, LEAST(1, 1 - 0.45 * missing_rate - 0.30 * duplicate_rate)) AS score FROM r)
SELECT rows, columns, ROUND(missing_rate, 9) AS missing_rate, ROUND(duplicate_rate, 9) AS duplicate_rate, nonfinite_rate, ROUND(score, 9) AS score, CASE WHEN score >= 0.8 THEN 'PASS' ELSE 'WARN' END AS status FROM z""")
def _(v: Views):
    return us(Q.data_quality(v.ledger.select("entity_id", "source", "payload_hash", "available_at", "value"), ["entity_id", "source"]))


@register("q2_table_quality", """WITH l AS (SELECT 'l_extendedprice' AS col, CASE WHEN l_linenumber % 4 = 0 THEN NULL ELSE l_extendedprice END AS v FROM lineitem UNION ALL SELECT 'skewed', CASE WHEN l_suppkey % 9 = 0 THEN 1e6 ELSE l_discount END FROM lineitem),
o AS (SELECT col, v, row_number() OVER (PARTITION BY col ORDER BY v) - 1 AS r, count(*) OVER (PARTITION BY col) AS k FROM l WHERE v IS NOT NULL), q AS (SELECT col, MAX(k) AS k, MAX(CASE WHEN r = k // 4 THEN v END) AS q1, MAX(CASE WHEN r = (3 * k) // 4 THEN v END) AS q3 FROM o GROUP BY 1),
f AS (SELECT l.col, count(*) AS rows, count(*) - count(v) AS missing, SUM(CASE WHEN q3 > q1 AND (v < q1 - 5 * (q3 - q1) OR v > q3 + 5 * (q3 - q1)) THEN 1 ELSE 0 END) AS far, MAX(k) AS k FROM l JOIN q USING (col) GROUP BY 1)
SELECT col AS "column", rows, missing, missing / rows > 0.2 AS missing_over_20pct, CAST(far AS BIGINT) AS outliers, k >= 20 AND far / k > 0.10 AS outliers_over_10pct FROM f""")
def _(v: Views):
    t = v.table("lineitem").select(F.expr("CASE WHEN l_linenumber % 4 = 0 THEN NULL ELSE l_extendedprice END").alias("l_extendedprice"), F.expr("CASE WHEN l_suppkey % 9 = 0 THEN 1e6D ELSE l_discount END").alias("skewed"))
    return Q.table_quality(t, ["l_extendedprice", "skewed"])


@register("q2_duplicate_rows", "SELECT l_orderkey, l_linenumber, l_returnflag, count(*) AS copies FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def _(v: Views):
    return Q.duplicate_rows(v.table("lineitem").select("l_orderkey", "l_linenumber", "l_returnflag"))


FEATS = ("home_score", "lam_h", "p_home")


def _rel(c):
    known = f"count({c}) FILTER (NOT isnan({c}))"
    unstable = f"CASE WHEN count(*) FILTER (isinf({c})) > 0 THEN 1 ELSE LEAST(1, stddev_pop(CASE WHEN isfinite({c}) THEN {c} END) / GREATEST(abs(avg(CASE WHEN isfinite({c}) THEN {c} END)), 1)) END"
    return (f"SELECT '{c}' AS feature, ROUND(GREATEST(0, LEAST(1, 0.45 * {known} / count(*) + 0.35 * count(*) FILTER (isfinite({c})) / {known} + 0.20 * (1 - 0.35 * {unstable}))), 8) AS reliability FROM qf")


@register("q3_feature_reliability", "WITH qf AS (SELECT CASE WHEN k1 % 5 > 0 THEN CAST(home_score AS DOUBLE) END AS home_score, CASE WHEN k1 % 7 = 0 THEN CAST('nan' AS DOUBLE) ELSE lam_h END AS lam_h, CASE WHEN k2 % 9 = 0 THEN CAST('inf' AS DOUBLE) ELSE p_home END AS p_home FROM probs) " + " UNION ALL ".join(map(_rel, FEATS)))
def _(v: Views):
    t = v.probs.select(F.expr("CASE WHEN k1 % 5 > 0 THEN double(home_score) END").alias("home_score"), F.expr("CASE WHEN k1 % 7 = 0 THEN double('NaN') ELSE lam_h END").alias("lam_h"), F.expr("CASE WHEN k2 % 9 = 0 THEN double('Infinity') ELSE p_home END").alias("p_home"))
    return us(Q.feature_reliability(t, FEATS), digits=8)


@register("q3_source_reliability", """WITH s AS (SELECT source, avg(CASE WHEN status = 'KNOWN' THEN 1 ELSE 0 END) AS a, avg(CASE WHEN available_at IS NOT NULL THEN 1 ELSE 0 END) AS b, avg(CASE WHEN payload_hash IS NOT NULL THEN 1 ELSE 0 END) AS c, avg(event_id % 7) / 7 AS l FROM ledger GROUP BY 1)
SELECT source, ROUND(0.35 * a + 0.25 * b + 0.25 * c + 0.15 * (1 - l), 8) AS source_reliability, ROUND(0.30 * a + 0.15 * b + 0.20 * c + 0.20 * a + 0.15 * (1 - l), 8) AS combined FROM s""")
def _(v: Views):
    share = lambda e: F.avg(F.expr(e).cast("int"))
    s = v.ledger.groupBy("source").agg(share("status = 'KNOWN'").alias("a"), share("available_at IS NOT NULL").alias("b"), share("payload_hash IS NOT NULL").alias("c"), (F.avg(F.expr("event_id % 7")) / 7).alias("l"))
    a, b, c, lat = (F.col(x) for x in "abcl")
    return us(s.select("source", Q.source_reliability(a, b, c, lat).alias("source_reliability"), Q.combined_reliability({"reliability": a, "freshness": b, "completeness": c, "consistency": a, "drift": lat}).alias("combined")), digits=8)


DRIFT = "r AS (SELECT * FROM probs WHERE ts < TIMESTAMP '1998-01-01'), c AS (SELECT lam_h + CASE WHEN k1 % 3 = 0 THEN 2 ELSE 0 END AS lam_h, p_home, lam_a FROM probs WHERE ts >= TIMESTAMP '1998-01-01')"


@register("q4_drift", f"WITH {DRIFT}, d AS (" + " UNION ALL ".join(f"SELECT '{x}' AS feature, GREATEST(0, LEAST(1, abs((SELECT avg({x}) FROM c) - avg({x})) / (stddev_pop({x}) + 1e-12) / 3)) AS drift FROM r" for x in ("lam_h", "p_home", "lam_a")) + """)
SELECT feature, ROUND(drift, 7) AS drift, ROUND(avg(drift) OVER (), 7) AS score, CASE WHEN avg(drift) OVER () >= 0.33 THEN 'WARN' ELSE 'PASS' END AS status FROM d""")
def _(v: Views):
    cut = F.expr("TIMESTAMP '1998-01-01 00:00:00 UTC'")
    cur = v.probs.filter(F.col("ts") >= cut).withColumn("lam_h", F.expr("lam_h + CASE WHEN k1 % 3 = 0 THEN 2D ELSE 0D END"))
    return us(Q.drift(v.probs.filter(F.col("ts") < cut), cur, ["lam_h", "p_home", "lam_a"]), digits=7)


@register("q5_ood", "WITH s AS (SELECT avg(lam_h) AS m1, stddev_pop(lam_h) AS s1, avg(lam_a) AS m2, stddev_pop(lam_a) AS s2 FROM probs) SELECT game_id, ROUND(LEAST(1.0, (abs(lam_h - m1) / (s1 + 1e-12) + abs(lam_a - m2) / (s2 + 1e-12)) / 2 / 5), 7) AS ood FROM probs CROSS JOIN s")
def _(v: Views):
    return us(Q.ood(v.probs.select("game_id", "lam_h", "lam_a"), v.probs, ["lam_h", "lam_a"]).select("game_id", "ood"), digits=7)


@register("q6_regime_state", "WITH s AS (SELECT game_id, k1 % 11 / 10.0 AS v, (k2 % 9 - 4) / 10.0 AS t, k3 % 6 / 5.0 AS s FROM games) SELECT game_id, CASE WHEN s >= 0.75 THEN 'information_shock' WHEN v >= 0.75 AND abs(t) >= 0.2 THEN 'high_vol_trend' WHEN v >= 0.75 THEN 'high_volatility' WHEN abs(t) >= 0.2 THEN 'trend' WHEN v <= 0.2 THEN 'low_volatility' ELSE 'range' END AS state FROM s")
def _(v: Views):
    return v.games.select("game_id", Q.regime_state(F.expr("k1 % 11 / 10D"), F.expr("(k2 % 9 - 4) / 10D"), F.expr("k3 % 6 / 5D")).alias("state"))


@register("q7_pit_audit", """WITH r AS (SELECT event_id, CASE WHEN event_id % 29 = 0 THEN NULL ELSE prediction_cutoff - INTERVAL 5 HOUR END AS p, available_at AS a, retrieved_at + INTERVAL 2 HOUR AS l FROM ledger)
SELECT event_id, 'invalid_prediction_time' AS violation FROM r WHERE p IS NULL UNION ALL SELECT event_id, 'available_at_missing' FROM r WHERE p IS NOT NULL AND a IS NULL UNION ALL SELECT event_id, 'available_at_after_prediction' FROM r WHERE a > p UNION ALL SELECT event_id, 'label_available_before_or_at_prediction' FROM r WHERE l <= p""")
def _(v: Views):
    r = v.ledger.select("event_id", F.expr("CASE WHEN event_id % 29 = 0 THEN NULL ELSE prediction_cutoff - INTERVAL 5 HOURS END").alias("prediction_time"), "available_at", F.expr("retrieved_at + INTERVAL 2 HOURS").alias("label_at"))
    return Q.pit_audit(r, ["event_id"], label="label_at")


@register("q8_assert_no_future", "SELECT event_id, CAST(COALESCE(epoch_us(available_at), 0) AS BIGINT) AS available_us FROM ledger")
def _(v: Views):
    out = Q.assert_no_future(v.ledger, F.expr("TIMESTAMP '2024-02-01 00:00:00 UTC'"))
    return out.select("event_id", F.coalesce(F.unix_micros("available_at"), F.lit(0)).alias("available_us"))


AV = """a AS (SELECT event_id, CASE WHEN event_id % 3 > 0 THEN 'H' END AS hs, CASE WHEN event_id % 4 > 0 THEN available_at END AS ha, CASE WHEN event_id % 5 = 0 THEN source_timestamp END AS hp, CASE WHEN event_id % 8 = 0 THEN retrieved_at + INTERVAL 1 MINUTE END AS hv,
 'A' AS as_, source_timestamp AS aa, retrieved_at AS r, prediction_cutoff - INTERVAL 2 HOUR AS c, CASE WHEN event_id % 6 = 0 THEN retrieved_at + INTERVAL 3 MINUTE END AS la, CASE WHEN event_id % 7 = 0 THEN 'confirmed' WHEN event_id % 7 = 1 THEN 'PROJECTED' WHEN event_id % 7 > 2 THEN 'unconfirmed' END AS ls,
 CASE WHEN event_id % 11 > 0 THEN 'T' END AS ht, CASE WHEN event_id % 13 = 0 THEN '' ELSE 'U' END AS at_, CASE WHEN event_id % 10 = 0 THEN retrieved_at + INTERVAL 5 MINUTE WHEN event_id % 10 = 1 THEN retrieved_at - INTERVAL 5 MINUTE END AS rv FROM ledger)"""
AVR = [("retrieved_after_cutoff", "r > c"), ("home_announcement_unknown", "ha IS NULL AND (hs IS NOT NULL OR hp IS NOT NULL OR hv IS NOT NULL)"), ("home_announced_after_cutoff", "ha > c"), ("home_announced_after_retrieval", "ha > r"),
       ("home_available_after_cutoff", "CASE WHEN ha IS NOT NULL THEN COALESCE(hv, ha) END > c"), ("home_available_after_retrieval", "CASE WHEN ha IS NOT NULL THEN COALESCE(hv, ha) END > r"), ("home_published_after_retrieval", "hp > r"),
       ("home_published_after_announcement", "hp > ha"), ("home_published_after_cutoff", "hp > c"), ("team_missing", "COALESCE(ht, '') = '' OR COALESCE(at_, '') = ''"),
       ("lineup_status_invalid", "NOT COALESCE(upper(ls) IN ('CONFIRMED', 'UNCONFIRMED', 'UNAVAILABLE', 'UNVERIFIABLE'), FALSE)"), ("revision_after_cutoff", "rv > c"), ("revision_after_retrieval", "rv > r"), ("away_announced_after_cutoff", "aa > c"), ("away_announced_after_retrieval", "aa > r"), ("away_available_after_cutoff", "aa > c"), ("away_available_after_retrieval", "aa > r"),
       ("lineup_not_pit_safe", "(la > c OR la > r)"), ("confirmed_without_time", "upper(ls) = 'CONFIRMED' AND la IS NULL")]


def _availability(v: Views):
    none = F.lit(None).cast("timestamp")
    return v.ledger.select(
        "event_id", F.expr("CASE WHEN event_id % 3 > 0 THEN 'H' END").alias("home_starter"), F.expr("CASE WHEN event_id % 4 > 0 THEN available_at END").alias("home_starter_announced_at"), F.expr("CASE WHEN event_id % 5 = 0 THEN source_timestamp END").alias("home_starter_published_at"),
        F.expr("CASE WHEN event_id % 8 = 0 THEN retrieved_at + INTERVAL 1 MINUTE END").alias("home_starter_available_at"), F.lit("A").alias("away_starter"), F.col("source_timestamp").alias("away_starter_announced_at"), none.alias("away_starter_published_at"),
        none.alias("away_starter_available_at"), "retrieved_at", F.expr("prediction_cutoff - INTERVAL 2 HOURS").alias("prediction_cutoff"), F.expr("CASE WHEN event_id % 6 = 0 THEN retrieved_at + INTERVAL 3 MINUTES END").alias("lineup_announced_at"),
        F.expr("CASE WHEN event_id % 7 = 0 THEN 'confirmed' WHEN event_id % 7 = 1 THEN 'PROJECTED' WHEN event_id % 7 > 2 THEN 'unconfirmed' END").alias("lineup_status"), "source",
        F.expr("CASE WHEN event_id % 11 > 0 THEN 'T' END").alias("home_team"), F.expr("CASE WHEN event_id % 13 = 0 THEN '' ELSE 'U' END").alias("away_team"),
        F.expr("CASE WHEN event_id % 10 = 0 THEN retrieved_at + INTERVAL 5 MINUTES WHEN event_id % 10 = 1 THEN retrieved_at - INTERVAL 5 MINUTES END").alias("revision_time"))


@register("q9_validate_availability", f"WITH {AV} " + " UNION ALL ".join(f"SELECT event_id, '{n}' AS violation FROM a WHERE {c}" for n, c in AVR))
def _(v: Views):
    return Q.validate_availability(_availability(v), ["event_id"])


@register("q10_eligibility", """WITH a AS (SELECT event_id, event_id % 3 > 0 AS named, event_id % 4 > 0 AND available_at IS NOT NULL AS timed, source, CASE WHEN event_id % 9 > 0 THEN retrieved_at + INTERVAL 6 HOUR END AS st, prediction_cutoff - INTERVAL 2 HOUR AS c FROM ledger),
r AS (SELECT event_id, concat_ws(',', CASE WHEN NOT named THEN 'home_starter_not_confirmed' END, CASE WHEN named AND NOT timed THEN 'home_starter_announcement_time_unverified' END, CASE WHEN st IS NULL THEN 'event_start_time_missing' END, CASE WHEN st <= c THEN 'event_already_started_or_not_future' END,
 CASE WHEN source NOT IN ('click', 'view') THEN 'starter_source_not_official' END, CASE WHEN event_id % 10 = 0 THEN 'competition_not_production_eligible' END) AS reasons FROM a) SELECT event_id, reasons, reasons = '' AS eligible FROM r""")
def _(v: Views):
    a = _availability(v).withColumn("event_start_at", F.expr("CASE WHEN event_id % 9 > 0 THEN retrieved_at + INTERVAL 6 HOURS END"))
    return Q.eligibility(a, F.col("source").isin("click", "view"), F.expr("event_id % 10 > 0")).select("event_id", "reasons", "eligible")


@register("q12_validate_ledger", """WITH t AS (SELECT event_id, event_id % 4 = 1 AS naive, event_id % 9 = 2 AS late, event_id % 7 = 3 AS official FROM ledger)
SELECT event_id, 'retrieved_at_not_iso_with_offset' AS violation FROM t WHERE naive UNION ALL SELECT event_id, 'available_after_retrieval' FROM t WHERE late AND NOT naive UNION ALL SELECT event_id, 'announcement_without_timestamp' FROM t WHERE official""")
def _(v: Views):
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    t = v.ledger.select("event_id", F.when(F.expr("event_id % 4 = 1"), iso("retrieved_at")).otherwise(F.concat(iso("retrieved_at"), F.lit("Z"))).alias("retrieved_at"),
                        F.concat(iso(F.expr("CASE WHEN event_id % 9 = 2 THEN retrieved_at + INTERVAL 1 MINUTE ELSE retrieved_at - INTERVAL 1 MINUTE END")), F.lit("+00:00")).alias("available_at"),
                        F.expr("CASE WHEN event_id % 7 = 3 THEN 'official_announcement' ELSE 'NONE' END").alias("level"), F.lit(None).cast("string").alias("announced_at"))
    return Q.validate_ledger(t, ["event_id"], ["retrieved_at", "available_at"], "level", "announced_at")


@register("q13_validate_snapshots", """SELECT event_id, 'status_invalid' AS violation FROM ledger WHERE status = 'UNVERIFIABLE' UNION ALL SELECT event_id, 'league_unknown' FROM ledger WHERE league = 'L2' UNION ALL SELECT event_id, 'available_after_retrieval' FROM ledger WHERE available_at > retrieved_at - INTERVAL 1 MINUTE
UNION ALL SELECT event_id, 'source_after_retrieval' FROM ledger WHERE source_timestamp > retrieved_at - INTERVAL 1 MINUTE""")
def _(v: Views):
    led = v.ledger.withColumn("retrieved_at", F.expr("retrieved_at - INTERVAL 1 MINUTE"))
    return Q.validate_snapshots(led, ["L0", "L1"], ["KNOWN", "MISSING", "UNAVAILABLE"])


@register("q14_validate_predictions", """WITH p AS (SELECT game_id, k1, k2, k3, p_home + CASE WHEN k1 % 17 = 0 THEN 0.01 ELSE 0 END AS ph, p_draw, p_away FROM probs)
SELECT game_id, 'probabilities_do_not_sum_to_one' AS violation FROM p WHERE k1 % 17 = 0 UNION ALL SELECT game_id, 'candidate_order' FROM p WHERE k2 % 13 = 0 UNION ALL SELECT game_id, 'candidate_count' FROM p WHERE k3 % 19 = 0 UNION ALL SELECT game_id, 'created_before_cutoff' FROM p WHERE k3 % 23 = 0 UNION ALL SELECT game_id, 'low_high_sum' FROM p WHERE k2 % 29 = 0""")
def _(v: Views):
    cand = F.expr("""transform(CASE WHEN k3 % 19 = 0 THEN CASE WHEN k2 % 13 = 0 THEN array(0.1D, 0.3D, 0.2D) ELSE array(0.4D, 0.3D, 0.2D) END WHEN k2 % 13 = 0 THEN array(0.4D, 0.1D, 0.2D, 0.05D) ELSE array(0.4D, 0.3D, 0.2D, 0.1D) END, x -> named_struct('score', '1-0', 'probability', x))""")
    p = v.probs.select("game_id", F.expr("p_home + CASE WHEN k1 % 17 = 0 THEN 0.01D ELSE 0D END").alias("ph"), "p_draw", "p_away", cand.alias("candidates"), F.expr("CASE WHEN k3 % 23 = 0 THEN ts - INTERVAL 1 MINUTE ELSE ts END").alias("created_at"), F.col("ts").alias("cutoff"),
                       F.lit(0.4).alias("low"), F.expr("CASE WHEN k2 % 29 = 0 THEN 0.5D ELSE 0.6D END").alias("high"))
    return Q.validate_predictions(p, ["game_id"], ["ph", "p_draw", "p_away"])


@register("q15_audit_prediction_store", """SELECT count(*) AS rows, CAST(SUM(CASE WHEN payload_hash IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS missing_payload_hash, CAST(0 AS BIGINT) AS missing_source, CAST(SUM(CASE WHEN source_timestamp > retrieved_at THEN 1 ELSE 0 END) AS BIGINT) AS source_timestamp_after_retrieved_at, CAST(count(*) - count(DISTINCT entity_id) AS BIGINT) AS duplicate_ids FROM ledger""")
def _(v: Views):
    return Q.audit_prediction_store(v.ledger, "entity_id", ["payload_hash", "source"], [("source_timestamp", "retrieved_at")])


@register("q17_validate_targets", "SELECT league, count(*) AS rows, CAST(SUM(CASE WHEN home_score = 9 THEN 1 ELSE 0 END) AS BIGINT) AS bad_scores, CAST(count(*) - count(DISTINCT k3) AS BIGINT) AS duplicate_ids, CAST(SUM(CASE WHEN home_score > away_score AND home_score < 9 THEN 1 ELSE 0 END) AS BIGINT) AS home_wins, CAST(SUM(CASE WHEN home_score = away_score AND home_score < 9 THEN 1 ELSE 0 END) AS BIGINT) AS draws, CAST(SUM(CASE WHEN home_score < away_score AND home_score < 9 THEN 1 ELSE 0 END) AS BIGINT) AS away_wins FROM games GROUP BY 1")
def _(v: Views):
    g = v.games.withColumn("home_score", F.expr("CASE WHEN home_score = 9 THEN NULL ELSE home_score END"))
    return Q.validate_targets(g, "k3", "home_score", "away_score", ["league"])


@register("q18_policies", """WITH s AS (SELECT game_id, k1 % 11 / 10.0 AS p, k2 % 11 / 10.0 AS u, k3 % 11 / 10.0 AS o, k1 % 7 / 7.0 AS f, k2 % 5 AS used, k3 % 20 / 100.0 AS shift FROM games), d AS (SELECT *, 0.35 * (1 - p) + 0.25 * u + 0.25 * f + 0.15 * o AS diff FROM s)
SELECT game_id, ROUND(diff, 8)::DOUBLE AS difficulty, CASE WHEN o >= 0.9 OR u >= 0.92 THEN 'ABSTAIN' WHEN ROUND(diff, 10) >= 0.70 THEN 'DEEP_COMPUTE' WHEN ROUND(diff, 10) >= 0.45 THEN 'ENSEMBLE_RETRIEVAL' ELSE 'STANDARD' END AS compute_level,
 CASE WHEN o >= 0.85 THEN 'ABSTAIN' WHEN p <= 0.20 THEN 'SCENARIO' WHEN f >= 0.75 THEN 'DEEP_COMPUTE' WHEN u >= 0.95 THEN 'ADD_INFORMATION' WHEN p <= 0.42 THEN 'RETRIEVAL' ELSE 'RECOMPUTE' END AS policy, CASE WHEN (used >= 3 AND shift < 0.15) OR shift < 0.03 THEN 'MAINTAIN' WHEN shift < 0.12 THEN 'MINOR_REVISION' ELSE 'MAJOR_REVISION' END AS revision FROM d""")
def _(v: Views):
    e = lambda x: F.expr(x)
    p, u, o, f = e("k1 % 11 / 10D"), e("k2 % 11 / 10D"), e("k3 % 11 / 10D"), e("k1 % 7 / 7D")
    diff, level = Q.adaptive_compute(p, u, f, o)
    info = F.when(u >= 0.95, 0.05).otherwise(0.0)
    return us(v.games.select("game_id", diff.alias("difficulty"), level.alias("compute_level"), Q.prediction_policy(p, o, f, info, F.lit(0.0)).alias("policy"), Q.revision_policy(e("k3 % 20 / 100D"), e("k2 % 5"), 3).alias("revision")), digits=8)


@register("q19_probability_safety", """WITH l AS (SELECT *, GREATEST(abs(p_home - lag(p_home) OVER w), abs(p_draw - lag(p_draw) OVER w), abs(p_away - lag(p_away) OVER w)) AS jump FROM probs WINDOW w AS (PARTITION BY league ORDER BY ts, game_id)) SELECT game_id, ROUND(jump, 8) AS jump, ROUND(COALESCE(jump, 0), 10) <= 0.4 AS safe FROM l""")
def _(v: Views):
    out = Q.probability_safety(v.probs.select("league", "ts", "game_id", "p_home", "p_draw", "p_away"), ["p_home", "p_draw", "p_away"], ["league"], ["ts", "game_id"], 0.4 + 1e-11)
    return us(out.select("game_id", "jump", "safe"), digits=8)


@register("q20_maturity_contract", """WITH l AS (SELECT league, retrieved_at, source_timestamp, lag(retrieved_at) OVER (PARTITION BY league ORDER BY event_id) AS prev FROM ledger)
SELECT league, count(*) AS rows, CAST(SUM(CASE WHEN prev > retrieved_at THEN 1 ELSE 0 END) AS BIGINT) AS out_of_order, CAST(SUM(CASE WHEN source_timestamp + INTERVAL 10 MINUTE < retrieved_at THEN 1 ELSE 0 END) AS BIGINT) AS outcome_before_prediction FROM l GROUP BY 1""")
def _(v: Views):
    led = v.ledger.withColumn("outcome_at", F.expr("source_timestamp + INTERVAL 10 MINUTES"))
    return Q.maturity_contract(led, ["league"], ["event_id"], "retrieved_at", "outcome_at", seg=F.floor(F.col("event_id") / 1000))


@register("q21_prediction_set_valid", "SELECT game_id, k1 % 4 IN (1, 2) AS valid FROM games")
def _(v: Views):
    s = F.expr("CASE k1 % 4 WHEN 0 THEN cast(array() AS array<string>) WHEN 1 THEN array('home') WHEN 2 THEN array('home', 'draw') ELSE array('home', CASE WHEN k2 % 2 = 0 THEN 'home' ELSE 'other' END) END")
    return v.games.select("game_id", Q.prediction_set_valid(s, ["home", "draw", "away"]).alias("valid"))



"""Queries over the point-in-time operators."""

from pyspark.sql import functions as F

from tideline.operators import pit as P
from tideline.plans.catalog import register
from tideline.plans.q_timeline import us
from tideline.plans.views import Views

CUT = "TIMESTAMP '2024-01-16 12:00:00'"
OFFICIAL = ("click", "purchase", "view")


def cutoff():
    return F.expr("TIMESTAMP '2024-01-16 12:00:00 UTC'")


def micros(df, *cols):
    return df.withColumns({f"{c}_us": F.unix_micros(c) for c in cols}).drop(*cols)


REPLAY = f"""(SELECT * FROM ledger WHERE status NOT IN ('UNAVAILABLE', 'MISSING') AND available_at <= {CUT}
  AND (retrieved_at IS NULL OR retrieved_at <= {CUT}))"""
EUS = "CAST(epoch_us({0}) AS BIGINT) AS {0}_us"


@register("j6_as_of_filter", f"""SELECT event_id, status FROM ledger WHERE available_at <= {CUT}
  OR (available_at IS NULL AND source_timestamp < {CUT})""")
def _(v: Views):
    return P.as_of_filter(v.ledger, cutoff(), "available_at", "source_timestamp", strict_event_time=True).select("event_id", "status")


@register("j7_pit_replay", f"""SELECT event_id, league, entity_id, source, {EUS.format('available_at')}, {EUS.format('retrieved_at')},
  status FROM {REPLAY}""")
def _(v: Views):
    out = P.pit_replay(v.ledger, cutoff())
    return micros(out.select("event_id", "league", "entity_id", "source", "available_at", "retrieved_at", "status"), "available_at", "retrieved_at")


@register("j7_replay_positions", f"""SELECT event_id, row_number() OVER (ORDER BY available_at, retrieved_at, CAST(entity_id AS VARCHAR), source, event_id) AS position
FROM {REPLAY}""")
def _(v: Views):
    from tideline.operators.ordered import row_numbers

    rows = P.pit_replay(v.ledger, cutoff()).withColumn("_e", F.col("entity_id").cast("string"))
    return row_numbers(rows, [], ["available_at", "retrieved_at", "_e", "source", "event_id"], out="position").select("event_id", "position")


@register("j8_latest_known", f"""SELECT league, entity_type, entity_id, source, event_id, {EUS.format('available_at')}, payload_hash
FROM (SELECT *, row_number() OVER (PARTITION BY league, entity_type, entity_id, source ORDER BY available_at DESC, retrieved_at DESC, event_id DESC) rk
FROM {REPLAY}) WHERE rk = 1""")
def _(v: Views):
    out = P.latest_known(v.ledger, cutoff())
    return micros(out.select("league", "entity_type", "entity_id", "source", "event_id", "available_at", "payload_hash"), "available_at")


@register("j8_latest_known_many", """WITH t AS (SELECT DISTINCT league, entity_type, entity_id, source, prediction_cutoff - INTERVAL 7 HOUR AS cutoff FROM ledger),
u AS (SELECT *, GREATEST(available_at, retrieved_at) AS eligible FROM ledger WHERE status NOT IN ('UNAVAILABLE', 'MISSING') AND available_at IS NOT NULL),
j AS (SELECT t.*, u.event_id, u.available_at, u.value, row_number() OVER (PARTITION BY t.league, t.entity_type, t.entity_id, t.source, t.cutoff
   ORDER BY u.available_at DESC NULLS LAST, u.retrieved_at DESC, u.event_id DESC) AS rk
  FROM t LEFT JOIN u ON u.league = t.league AND u.entity_type = t.entity_type AND u.entity_id = t.entity_id AND u.source = t.source AND u.eligible <= t.cutoff)
SELECT league, entity_id, source, CAST(epoch_us(cutoff) AS BIGINT) AS cutoff_us, CAST(COALESCE(event_id, -1) AS BIGINT) AS event_id, value FROM j WHERE rk = 1""")
def _(v: Views):
    t = v.ledger.select("league", "entity_type", "entity_id", "source", F.expr("prediction_cutoff - INTERVAL 7 HOURS").alias("cutoff")).distinct()
    out = P.latest_known_many(t, v.ledger, "cutoff", ["event_id", "value"])
    return micros(out.select("league", "entity_id", "source", "cutoff", F.coalesce("event_id", F.lit(-1)).alias("event_id"), "value"), "cutoff")


@register("j9_attach_pit_evidence", """WITH o AS (SELECT event_id AS oos_id, CAST(entity_id AS VARCHAR) AS game_id, prediction_cutoff + INTERVAL 12 HOUR AS event_time,
  CASE WHEN event_id % 17 = 0 THEN NULL WHEN event_id % 23 = 0 THEN prediction_cutoff + INTERVAL 24 HOUR ELSE prediction_cutoff END AS prediction_time FROM ledger),
av AS (SELECT CAST(entity_id AS VARCHAR) AS game_id, CAST(event_id AS VARCHAR) AS sid, prediction_cutoff, retrieved_at AS observed_at FROM ledger
  WHERE status = 'KNOWN' AND event_id % 5 > 0),
obs AS (SELECT game_id, prediction_cutoff, sid FROM (SELECT *, row_number() OVER (PARTITION BY game_id, prediction_cutoff ORDER BY observed_at DESC, sid DESC) AS rk FROM av) WHERE rk = 1),
sn AS (SELECT CASE WHEN event_id % 2 = 0 THEN CAST(event_id AS VARCHAR) ELSE CAST(entity_id AS VARCHAR) END AS k, available_at + CAST(event_id % 3 AS INT) * INTERVAL 9 HOUR AS snap_at
  FROM ledger WHERE status = 'KNOWN' AND available_at IS NOT NULL),
l AS (SELECT o.*, obs.sid, CASE WHEN obs.sid IN (SELECT k FROM sn) THEN obs.sid ELSE o.game_id END AS k FROM o LEFT JOIN obs ON obs.game_id = o.game_id AND obs.prediction_cutoff = o.prediction_time),
f AS (SELECT l.oos_id, l.prediction_time, l.event_time, l.sid, MAX(sn.snap_at) AS snap_at FROM l LEFT JOIN sn ON l.sid IS NOT NULL AND sn.k = l.k AND sn.snap_at <= l.prediction_time GROUP BY ALL),
r AS (SELECT *, CASE WHEN prediction_time IS NULL THEN 'prediction_time_missing_or_invalid' WHEN prediction_time > event_time THEN 'prediction_time_after_event_time'
  WHEN sid IS NULL THEN 'no_exact_pit_record_at_prediction_time' WHEN snap_at IS NULL THEN 'matching_snapshot_missing_or_after_prediction_time'
  ELSE 'exact_game_and_prediction_cutoff' END AS pit_join_reason FROM f)
SELECT oos_id, pit_join_reason, CASE WHEN pit_join_reason = 'exact_game_and_prediction_cutoff' THEN 'PIT_VERIFIED' ELSE 'UNRESOLVED' END AS pit_join_status,
  CAST(CASE WHEN pit_join_reason = 'exact_game_and_prediction_cutoff' THEN epoch_us(snap_at) ELSE 0 END AS BIGINT) AS available_us FROM r""")
def _(v: Views):
    led = v.ledger
    gid = F.col("entity_id").cast("string").alias("game_id")
    oos = led.select(F.col("event_id").alias("oos_id"), gid, F.expr("prediction_cutoff + INTERVAL 12 HOURS").alias("event_time"), F.expr(
        "CASE WHEN event_id % 17 = 0 THEN NULL WHEN event_id % 23 = 0 THEN prediction_cutoff + INTERVAL 24 HOURS ELSE prediction_cutoff END").alias("prediction_time"))
    av = led.filter("event_id % 5 > 0").select(gid, F.col("event_id").cast("string").alias("event_id"), "prediction_cutoff",
                                               F.col("retrieved_at").alias("observed_at"), "status")
    sn = led.select(F.expr("CASE WHEN event_id % 2 = 0 THEN string(event_id) ELSE string(entity_id) END").alias("entity_id"),
                    F.expr("available_at + make_dt_interval(0, int((event_id % 3) * 9))").alias("available_at"), "status")
    out = P.attach_pit_evidence(oos, av, sn, ("KNOWN", "OBSERVED", "OBSERVED_UNVERIFIABLE_ANNOUNCEMENT_TIME", "ANNOUNCED"))
    return out.select("oos_id", "pit_join_reason", "pit_join_status", F.coalesce(F.unix_micros("available_at"), F.lit(0)).alias("available_us"))


LEVEL = "CASE event_id % 5 WHEN 0 THEN 'NONE' WHEN 1 THEN 'RETRIEVAL_ONLY' WHEN 2 THEN 'THIRD_PARTY_FIRST_SEEN' WHEN 3 THEN 'OFFICIAL_PUBLICATION' ELSE 'OFFICIAL_ANNOUNCEMENT' END"


@register("j10_best_evidence", f"""SELECT entity_id, level, evidence_id FROM (SELECT entity_id, {LEVEL} AS level, event_id AS evidence_id,
 row_number() OVER (PARTITION BY entity_id ORDER BY event_id % 5 DESC, available_at DESC, event_id DESC) AS rk FROM ledger WHERE available_at <= {CUT}) WHERE rk = 1""")
def _(v: Views):
    c = v.ledger.select("entity_id", F.expr(LEVEL).alias("level"), F.col("available_at").alias("ts"), F.col("event_id").alias("evidence_id"))
    return P.best_evidence(c, ["entity_id"], cutoff()).select("entity_id", "level", "evidence_id")


@register("q11_evidence_reason", f"""SELECT event_id, CASE WHEN {LEVEL} = 'OFFICIAL_ANNOUNCEMENT' AND available_at <= prediction_cutoff - INTERVAL 6 HOUR AND source IN {OFFICIAL} THEN 'eligible_official_announcement'
 WHEN {LEVEL} = 'OFFICIAL_PUBLICATION' THEN 'official_publication_not_announcement_proof' WHEN {LEVEL} = 'THIRD_PARTY_FIRST_SEEN' THEN 'third_party_first_seen_not_official'
 WHEN {LEVEL} = 'RETRIEVAL_ONLY' THEN 'retrieval_time_not_announcement_proof' ELSE 'starter_announcement_evidence_unverifiable' END AS reason FROM ledger""")
def _(v: Views):
    reason = P.evidence_reason(F.expr(LEVEL), F.col("available_at"), F.expr("prediction_cutoff - INTERVAL 6 HOURS"), F.col("source").isin(*OFFICIAL))
    return v.ledger.select("event_id", reason.alias("reason"))


OBS = """CASE WHEN available_at IS NOT NULL AND available_at <= retrieved_at THEN available_at WHEN observed_at IS NOT NULL AND observed_at <= retrieved_at THEN observed_at
 WHEN available_at IS NULL AND observed_at IS NULL THEN retrieved_at END"""
OBSERVED = "CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 3 = 1 THEN retrieved_at + INTERVAL 5 MINUTE ELSE retrieved_at - INTERVAL 5 MINUTE END"


@register("p29_observation_time", f"SELECT event_id, CAST(COALESCE(epoch_us({OBS}), -1) AS BIGINT) AS observed_us FROM (SELECT *, {OBSERVED} AS observed_at FROM ledger)")
def _(v: Views):
    o = P.observation_time(F.col("available_at"), F.expr(OBSERVED), F.col("retrieved_at"))
    return v.ledger.select("event_id", F.coalesce(F.unix_micros(o), F.lit(-1)).alias("observed_us"))


@register("j11_first_observed", f"""SELECT entity_id, source, event_id, {EUS.format('retrieved_at')} FROM (SELECT *, row_number() OVER (PARTITION BY entity_id, source
 ORDER BY retrieved_at, COALESCE(payload_hash, ''), event_id) AS rk FROM ledger WHERE source IN {OFFICIAL} AND status NOT IN ('UNAVAILABLE', 'MISSING')) WHERE rk = 1""")
def _(v: Views):
    led = v.ledger.withColumn("_tie", F.struct(F.coalesce("payload_hash", F.lit("")), "event_id"))
    out = P.first_observed(led, ["entity_id", "source"], "retrieved_at", "_tie", F.col("source").isin(*OFFICIAL))
    return micros(out.select("entity_id", "source", "event_id", "retrieved_at"), "retrieved_at")


@register("j12_pit_safe_rows", "SELECT event_id, value FROM ledger WHERE available_at <= prediction_cutoff - INTERVAL 3 HOUR AND status = 'KNOWN'")
def _(v: Views):
    led = v.ledger.withColumn("prediction_time", F.expr("prediction_cutoff - INTERVAL 3 HOURS"))
    return P.pit_safe_rows(led).select("event_id", "value")


@register("w31_detect_revisions", """WITH o AS (SELECT *, lag(payload_hash) OVER w AS ph, lag(available_at) OVER w AS pa, lag(source_timestamp) OVER w AS ps, row_number() OVER w AS rn FROM ledger
  WINDOW w AS (PARTITION BY league, entity_type, entity_id, source ORDER BY retrieved_at, COALESCE(payload_hash, ''), event_id)),
f AS (SELECT event_id, 'REVISION' AS kind, ph, payload_hash FROM o WHERE rn > 1 AND payload_hash <> ph
 UNION ALL SELECT event_id, 'BACKFILL', ph, payload_hash FROM o WHERE rn > 1 AND COALESCE(available_at < pa, FALSE) OR COALESCE(source_timestamp < ps, FALSE))
SELECT event_id, kind, ph AS previous_hash, payload_hash AS current_hash FROM f""")
def _(v: Views):
    return P.detect_revisions(v.ledger).select("event_id", "kind", "previous_hash", "current_hash")


@register("a26_count_probe_latest", """SELECT entity_type, entity_id, CAST(epoch_us(MAX(CASE WHEN status = 'KNOWN' THEN retrieved_at END)) AS BIGINT) AS last_seen_us,
 COALESCE(epoch_us(TIMESTAMP '2024-01-31') - epoch_us(MAX(CASE WHEN status = 'KNOWN' THEN retrieved_at END)) >= 30 * 3600 * 1e6, TRUE) AS due FROM ledger GROUP BY ALL""")
def _(v: Views):
    return micros(P.probe_due(v.ledger, F.expr("TIMESTAMP '2024-01-31 00:00:00 UTC'"), 1800), "last_seen")


@register("a24_status_counts", "SELECT status, count(*) AS n FROM ledger GROUP BY status")
def _(v: Views):
    return P.status_counts(v.ledger)


A23 = """SELECT {0}, count(*) AS rows, count(available_at) AS available_at_present, count(retrieved_at) AS retrieved_at_present,
 count(available_at) AS both_timestamps_present, CAST(SUM(CASE WHEN available_at <= retrieved_at THEN 1 ELSE 0 END) AS BIGINT) AS ordering_valid,
 CAST(SUM(CASE WHEN available_at > retrieved_at THEN 1 ELSE 0 END) AS BIGINT) AS ordering_violations, count(*) - count(available_at) AS availability_unverifiable,
 {1}, ROUND(count(available_at) / count(*), 9) AS available_at_coverage, ROUND(count(available_at) / count(*), 9) AS both_timestamps_coverage,
 ROUND(SUM(CASE WHEN available_at <= retrieved_at THEN 1 ELSE 0 END) / count(available_at), 9) AS ordering_valid_coverage,
 ROUND(SUM(CASE WHEN available_at > retrieved_at THEN 1 ELSE 0 END) / count(available_at), 9) AS ordering_violation_rate FROM ledger GROUP BY {0}"""
STAT = ", ".join(f"CAST(SUM(CASE WHEN status = '{s}' THEN 1 ELSE 0 END) AS BIGINT) AS status_{s.lower()}" for s in P.STATUSES)


@register("a23_provenance_coverage", A23.format("league, source", STAT))
def _(v: Views):
    return us(P.provenance_coverage(v.ledger, ["league", "source"]))


@register("q16_pit_readiness", A23.format("league, source, entity_type", STAT))
def _(v: Views):
    return us(P.provenance_coverage(v.ledger, ["league", "source", "entity_type"]))


@register("j27_earliest_availability", """WITH p AS (SELECT entity_id, MIN(available_at) AS prior FROM ledger WHERE event_id % 2 = 0 GROUP BY 1),
f AS (SELECT event_id, entity_id, available_at FROM ledger WHERE event_id % 2 = 1)
SELECT event_id, CAST(COALESCE(epoch_us(LEAST(available_at, prior)), 0) AS BIGINT) AS available_us FROM f LEFT JOIN p USING (entity_id)""")
def _(v: Views):
    led = v.ledger.select("event_id", "entity_id", "available_at")
    out = P.earliest_availability(led.filter("event_id % 2 = 1"), led.filter("event_id % 2 = 0"), "entity_id", "available_at")
    return out.select("event_id", F.coalesce(F.unix_micros("available_at"), F.lit(0)).alias("available_us"))

"""Streaming queries: each runs a stream over the whole table to completion and returns the resulting table."""

from pyspark.sql import functions as F

from tideline.operators import pit as P
from tideline.plans.catalog import ORACLES, register
from tideline.plans.views import Views
from tideline.session import scratch_path
from tideline.sources import layers as S
from tideline.streaming import feeds as T

LDDL = "event_id bigint, league string, entity_type string, entity_id bigint, source string, retrieved_at timestamp, available_at timestamp, payload_hash string, status string, value double"


def _us(df, *cols):
    return df.withColumns({f"{c}_us": F.unix_micros(c) for c in cols}).drop(*cols)


@register("t1_observation_feed", "SELECT event_id, source, CAST(epoch_us(retrieved_at) AS BIGINT) AS retrieved_at_us, status, value FROM ledger")
def _(v: Views):
    path = scratch_path(v.spark, "feed")
    S.append_ledger(v.ledger.select("event_id", "league", "entity_type", "entity_id", "source", "retrieved_at", "available_at", "payload_hash", "status", "value"), path)
    out = T.materialized(v.spark, S.stream_ledger(v.spark, path, LDDL))
    return _us(out.select("event_id", "source", "retrieved_at", "status", "value"), "retrieved_at")


@register("t2_deduplicated_feed", "SELECT event_id, value FROM events")
def _(v: Views):
    feed = v.stream("events").select("event_id", "ts", "value", F.explode(F.array(F.lit(1), F.lit(2))).alias("copy"))
    return T.materialized(v.spark, T.deduplicated(feed, "ts", ["event_id"])).select("event_id", "value")


@register("t3_revision_stream")
def _(v: Views):
    out = T.materialized(v.spark, T.revision_stream(v.ledger_of(v.stream("events"))))
    return out.select("event_id", "kind", "previous_hash", "current_hash")


@register("t4_late_data_replay", """SELECT event_id, value, COALESCE(retrieved_at <= TIMESTAMP '2024-01-16 12:00:00', TRUE) AS known_at_cutoff FROM ledger
WHERE COALESCE(status, 'KNOWN') NOT IN ('UNAVAILABLE', 'MISSING') AND available_at <= TIMESTAMP '2024-01-16 12:00:00'""")
def _(v: Views):
    # late rows stay in the table; the replay, retrieval rule included, decides which were known at the cutoff and which came later
    late = T.materialized(v.spark, v.ledger_of(v.stream("events")))
    cut = F.expr("TIMESTAMP '2024-01-16 12:00:00 UTC'")
    known = P.pit_replay(late, cut).select("event_id", "value", F.lit(True).alias("known_at_cutoff"))
    ever = P.pit_replay(late, F.greatest(cut, F.col("retrieved_at"))).filter(F.col("available_at") <= cut)
    return known.unionByName(ever.join(known, "event_id", "left_anti").select("event_id", "value", F.lit(False).alias("known_at_cutoff")))


@register("t5_maturity_gate", "SELECT event_id, user_id, value FROM events WHERE event_id % 5 > 0 AND (event_id % 9) BETWEEN 1 AND 7")
def _(v: Views):
    p = v.stream("events").select("event_id", "user_id", F.col("ts").alias("prediction_time"))
    o = v.stream("events").filter("event_id % 5 > 0").select("event_id", F.expr("ts + make_dt_interval(int(event_id % 9))").alias("matured_at"), "value")
    return T.materialized(v.spark, T.matured_join(p, o, "event_id")).select("event_id", "user_id", "value")


@register("t6_probe_cadence", """SELECT entity_id, CAST(epoch_us(date_trunc('day', retrieved_at)) AS BIGINT) AS window_start_us, count(*) AS n, CAST(epoch_us(MAX(retrieved_at)) AS BIGINT) AS last_seen_us FROM ledger GROUP BY ALL""")
def _(v: Views):
    led = v.ledger_of(v.stream("events"))
    out = T.windowed_counts(led, "retrieved_at", ["entity_id"], F.window("retrieved_at", "1 day"), last_seen=F.max("retrieved_at"))
    done = T.materialized(v.spark, out, "update", ["window_start", "window_end", "entity_id"])
    return _us(done.select("entity_id", "window_start", "n", "last_seen"), "window_start", "last_seen")


@register("t7_tumbling_window", "SELECT event_type, CAST(epoch_us(date_trunc('hour', ts)) AS BIGINT) AS window_start_us, count(*) AS n FROM events GROUP BY ALL")
def _(v: Views):
    out = T.windowed_counts(v.stream("events"), "ts", ["event_type"], F.window("ts", "1 hour"))
    return _us(T.materialized(v.spark, out, "update", ["window_start", "window_end", "event_type"]).select("event_type", "window_start", "n"), "window_start")


@register("t7_sliding_window", """SELECT event_type, CAST(epoch_us(date_trunc('hour', ts)) - k * 3600000000 AS BIGINT) AS window_start_us, count(*) AS n FROM events CROSS JOIN (SELECT unnest([0, 1, 2]) AS k) GROUP BY ALL""")
def _(v: Views):
    out = T.windowed_counts(v.stream("events"), "ts", ["event_type"], F.window("ts", "3 hours", "1 hour"))
    return _us(T.materialized(v.spark, out, "update", ["window_start", "window_end", "event_type"]).select("event_type", "window_start", "n"), "window_start")


@register("t7_session_window", """WITH g AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) < 21600000000 THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, SUM(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS sid FROM g)
SELECT user_id, CAST(epoch_us(MIN(ts)) AS BIGINT) AS window_start_us, CAST(epoch_us(MAX(ts)) + 21600000000 AS BIGINT) AS window_end_us, count(*) AS n FROM s GROUP BY user_id, sid""")
def _(v: Views):
    out = T.windowed_counts(v.stream("events"), "ts", ["user_id"], F.session_window("ts", "6 hours"))
    return _us(T.materialized(v.spark, out, "complete"), "window_start", "window_end")


@register("t8_exactly_once", "SELECT event_id, user_id, event_type, value FROM events")
def _(v: Views):
    path, checkpoint = scratch_path(v.spark, "once"), scratch_path(v.spark, "once-checkpoint")
    feed = v.stream("events").select("event_id", "user_id", "event_type", "value")
    for _ in range(2):  # the second run finds nothing new
        T.run_available(feed, path, checkpoint)
    return v.spark.read.parquet(path)


def _share_revision_oracle() -> None:
    """The stream must find what the batch operator finds."""
    if "w31_detect_revisions" in ORACLES:
        ORACLES["t3_revision_stream"] = ORACLES["w31_detect_revisions"]


from tideline.plans import q_pit  # noqa: E402,F401

_share_revision_oracle()

"""Point-in-time operators: replay, latest known state, evidence, revisions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions.scalars import host_allowed, reasons
from tideline.operators import ordered as O

# Statuses and evidence levels of the ledger contract.
STATUSES = ("KNOWN", "MISSING", "UNAVAILABLE", "UNVERIFIABLE")
EVIDENCE_LEVELS = {
    "NONE": 0, "RETRIEVAL_ONLY": 1, "THIRD_PARTY_FIRST_SEEN": 2, "OFFICIAL_PUBLICATION": 3, "OFFICIAL_ANNOUNCEMENT": 4,
}
ENTITY = ("league", "entity_type", "entity_id", "source")


def as_of_filter(df: DataFrame, cutoff: Column, available: str = "available_ts", event: str = "event_time",
                 strict_event_time: bool = False) -> DataFrame:
    """Rows available by the cutoff; optionally rows without availability whose event lies strictly before it."""
    known = F.col(available) <= cutoff
    if strict_event_time:
        known = known | (F.col(available).isNull() & (F.col(event) < cutoff))
    return df.filter(F.coalesce(known, F.lit(False)))


def pit_replay(ledger: DataFrame, cutoff: Column, event_id: str | None = None, league: str | None = None,
               include_unverifiable: bool = False) -> DataFrame:
    """What the ledger said at the cutoff: usable status, available and (when recorded) retrieved by then."""
    out = ledger
    if event_id is not None:
        out = out.filter(F.col("event_id").cast("string") == event_id)
    if league is not None:
        out = out.filter(F.col("league") == league)
    available = F.col("available_at") <= cutoff
    if include_unverifiable:
        available = available | F.col("available_at").isNull()
    usable = ~F.coalesce(F.col("status"), F.lit("KNOWN")).isin("UNAVAILABLE", "MISSING")
    retrieved = F.col("retrieved_at").isNull() | (F.col("retrieved_at") <= cutoff)
    return out.filter(usable & available & retrieved)


def replay_order() -> list[Column]:
    """Deterministic replay order: available, retrieved, entity, source (each time standing in for the other)."""
    return [F.coalesce("available_at", "retrieved_at"), F.coalesce("retrieved_at", "available_at"),
            F.col("entity_id").cast("string"), F.col("source")]


def latest_known(ledger: DataFrame, cutoff: Column, league: str | None = None, tie: str = "event_id") -> DataFrame:
    """Last replayed row per (league, entity type, entity, source)."""
    return O.latest_by(pit_replay(ledger, cutoff, league=league), list(ENTITY), [*replay_order()[:2], tie])


def latest_known_many(targets: DataFrame, ledger: DataFrame, cutoff: str, payload: Sequence[str],
                      keys: Sequence[str] = ENTITY, tie: str = "event_id") -> DataFrame:
    """:func:`latest_known` for many (entity, cutoff) rows at once.

    A row becomes eligible when both its availability and its retrieval have passed, but the winner is chosen in replay
    order, so a late-retrieved row with an earlier availability never displaces a newer fact.
    """
    usable = ledger.filter(
        ~F.coalesce(F.col("status"), F.lit("KNOWN")).isin("UNAVAILABLE", "MISSING") & F.col("available_at").isNotNull()
    ).withColumns({
        "_eligible": F.greatest("available_at", "retrieved_at"),
        "_second": F.coalesce("retrieved_at", "available_at"),
    })
    return O.as_of(targets, usable, keys, cutoff, "_eligible", ["available_at", "_second", tie], payload)


def attach_pit_evidence(oos: DataFrame, availability: DataFrame, snapshots: DataFrame, allowed: Sequence[str]) -> DataFrame:
    """Tie predictions to ledger evidence by exact (game, cutoff), then by the latest snapshot available by then.

    ``oos(game_id, event_time, prediction_time)``, ``availability(game_id, event_id, prediction_cutoff, observed_at,
    status)``, ``snapshots(entity_id, available_at, status)``; adds available_at, pit_join_status, pit_join_reason.
    """
    observed = O.latest_by(
        availability.filter(F.col("status").isin(*allowed) & F.col("prediction_cutoff").isNotNull())
        .select("game_id", F.col("prediction_cutoff").alias("prediction_time"), "observed_at", F.col("event_id").alias("_sid")),
        ["game_id", "prediction_time"], ["observed_at", "_sid"],
    ).drop("observed_at")
    facts = snapshots.filter((F.col("status") == "KNOWN") & F.col("available_at").isNotNull() & (F.col("entity_id") != ""))
    by_snapshot = facts.select(F.col("entity_id").alias("_key"), F.col("available_at").alias("_snap_at"))
    known_ids = by_snapshot.select(F.col("_key").alias("_sid")).distinct().withColumn("_has", F.lit(True))
    linked = (oos.join(observed, ["game_id", "prediction_time"], "left").join(known_ids, "_sid", "left")
              .withColumn("_key", F.when(F.col("_has"), F.col("_sid")).when(F.col("_sid").isNotNull(), F.col("game_id"))))
    found = O.as_of(linked, by_snapshot, ["_key"], "prediction_time", "_snap_at", ["_snap_at"], ["_snap_at"])
    reason = (
        F.when(F.col("prediction_time").isNull(), "prediction_time_missing_or_invalid")
        .when(F.col("prediction_time") > F.col("event_time"), "prediction_time_after_event_time")
        .when(F.col("_sid").isNull(), "no_exact_pit_record_at_prediction_time")
        .when(F.col("_snap_at").isNull(), "matching_snapshot_missing_or_after_prediction_time")
        .otherwise("exact_game_and_prediction_cutoff")
    )
    verified = reason == "exact_game_and_prediction_cutoff"
    return found.withColumns({
        "pit_join_reason": reason,
        "pit_join_status": F.when(verified, "PIT_VERIFIED").otherwise("UNRESOLVED"),
        "available_at": F.when(verified, F.col("_snap_at")),
    }).drop("_key", "_sid", "_has", "_snap_at")


def level_rank(level: Column) -> Column:
    out = F.lit(None).cast("int")
    for name, rank in EVIDENCE_LEVELS.items():
        out = F.when(F.upper(level) == name, F.lit(rank)).otherwise(out)
    return out


def best_evidence(candidates: DataFrame, keys: Sequence[str], cutoff: Column, level: str = "level", ts: str = "ts",
                  tie: str = "evidence_id") -> DataFrame:
    """Strongest evidence that existed by the cutoff; the later one among equals."""
    return O.latest_by(candidates.filter(F.col(ts) <= cutoff).withColumn("_rank", level_rank(F.col(level))),
                       keys, ["_rank", ts, tie]).drop("_rank")


def evidence_reason(level: Column, ts: Column, cutoff: Column, official: Column) -> Column:
    """Why a piece of starter evidence does or does not make an event eligible."""
    strict = (F.upper(level) == "OFFICIAL_ANNOUNCEMENT") & (ts <= cutoff) & official
    return (
        F.when(level.isNull(), "starter_announcement_evidence_missing")
        .when(F.coalesce(strict, F.lit(False)), "eligible_official_announcement")
        .when(F.upper(level) == "OFFICIAL_PUBLICATION", "official_publication_not_announcement_proof")
        .when(F.upper(level) == "THIRD_PARTY_FIRST_SEEN", "third_party_first_seen_not_official")
        .when(F.upper(level) == "RETRIEVAL_ONLY", "retrieval_time_not_announcement_proof")
        .otherwise("starter_announcement_evidence_unverifiable")
    )


def observation_time(available: Column, observed: Column, retrieved: Column) -> Column:
    """Explicit boundary not later than retrieval; retrieval itself only when no boundary was recorded at all."""
    fits = lambda c: F.when(c.isNotNull() & (retrieved.isNull() | (c <= retrieved)), c)
    explicit = available.isNotNull() | observed.isNotNull()
    return F.coalesce(fits(available), fits(observed), F.when(~explicit, retrieved))


def first_observed(observations: DataFrame, keys: Sequence[str], ts: str, tie: str, official: Column) -> DataFrame:
    """Earliest official observation of each key: "available by", never "announced at"."""
    usable = observations.filter(
        official & ~F.upper(F.coalesce(F.col("status"), F.lit("KNOWN"))).isin("UNAVAILABLE", "MISSING", "SOURCE_FAILED")
        & F.col(ts).isNotNull())
    return O.latest_by(usable, keys, [ts, tie], first=True)


def pit_safe_rows(df: DataFrame, available: str = "available_at", prediction: str = "prediction_time",
                  status: str | None = "status") -> DataFrame:
    """Fail-closed filter: both times known, available first, status KNOWN when a status column is named."""
    ok = F.col(available) <= F.col(prediction)
    if status:
        ok = ok & (F.upper(F.col(status)) == "KNOWN")
    return df.filter(ok)


def detect_revisions(ledger: DataFrame, keys: Sequence[str] = ENTITY, tie: str = "event_id") -> DataFrame:
    """REVISION when the hash differs from the previous row's, BACKFILL when an availability or source time moves back.

    Only the immediately previous row counts: a missing hash breaks the chain instead of being skipped.
    """
    cols = ["payload_hash", "available_at", "source_timestamp", "retrieved_at"]
    ordered = ledger.select(*keys, tie, *cols, F.coalesce("payload_hash", F.lit("")).alias("_h"))
    spread, w = O.blocks(O.row_numbers(ordered, keys, ["retrieved_at", "_h", tie]), keys)
    prev = spread.withColumn("_p", F.lag(F.struct(*cols)).over(w))
    changed = F.col("payload_hash") != F.col("_p.payload_hash")
    back = (F.col("available_at") < F.col("_p.available_at")) | (F.col("source_timestamp") < F.col("_p.source_timestamp"))
    found = reasons(("REVISION", changed), ("BACKFILL", back))
    return O.drop_halo(prev).filter(F.col("_p").isNotNull()).select(
        *keys, tie, F.explode(found).alias("kind"), F.col("_p.payload_hash").alias("previous_hash"),
        F.col("payload_hash").alias("current_hash"), F.col("_p.available_at").alias("previous_available_at"),
        F.col("available_at").alias("current_available_at"), F.col("retrieved_at").alias("current_retrieved_at"))


def probe_due(ledger: DataFrame, now: Column, every_minutes: float, keys: Sequence[str] = ("entity_type", "entity_id")) -> DataFrame:
    """Latest KNOWN retrieval per entity and whether the next probe is due."""
    latest = ledger.groupBy(*keys).agg(F.max(F.when(F.col("status") == "KNOWN", F.col("retrieved_at"))).alias("last_seen"))
    age = (F.unix_micros(now) - F.unix_micros("last_seen")) / 60e6
    return latest.withColumn("due", F.col("last_seen").isNull() | (age >= every_minutes))


def status_counts(ledger: DataFrame, status: str = "status", allowed: Sequence[str] = STATUSES) -> DataFrame:
    """Histogram of statuses; a status outside the contract fails the query."""
    checked = F.when(F.col(status).isin(*allowed), F.col(status)).otherwise(
        F.raise_error(F.concat(F.lit("unknown status: "), F.coalesce(F.col(status), F.lit("NULL")))))
    return ledger.select(checked.cast("string").alias("status")).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def provenance_coverage(ledger: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Presence and ordering of availability and retrieval times per group, with the status histogram."""
    one = lambda cond: F.sum(F.when(cond, 1).otherwise(0))
    a, r = F.col("available_at"), F.col("retrieved_at")
    both = a.isNotNull() & r.isNotNull()
    agg = ledger.groupBy(*fields).agg(
        F.count(F.lit(1)).alias("rows"), one(a.isNotNull()).alias("available_at_present"),
        one(r.isNotNull()).alias("retrieved_at_present"), one(both).alias("both_timestamps_present"),
        one(both & (a <= r)).alias("ordering_valid"), one(both & (a > r)).alias("ordering_violations"),
        one(~both).alias("availability_unverifiable"),
        *[one(F.upper(F.coalesce("status", F.lit("KNOWN"))) == s).alias(f"status_{s.lower()}") for s in STATUSES])
    part = lambda n, d: F.try_divide(F.col(n).cast("double"), F.col(d))
    return agg.withColumns({
        "available_at_coverage": part("available_at_present", "rows"),
        "both_timestamps_coverage": part("both_timestamps_present", "rows"),
        "ordering_valid_coverage": part("ordering_valid", "both_timestamps_present"),
        "ordering_violation_rate": part("ordering_violations", "both_timestamps_present"),
    })


def source_is_official(source: Column, hosts: Sequence[str], suffixes: Sequence[str] = ()) -> Column:
    return host_allowed(source, hosts, suffixes)


def earliest_availability(fresh: DataFrame, prior: DataFrame, key: str, at: str) -> DataFrame:
    """Keep the first verified availability of each key across refreshes."""
    first = prior.filter(F.col(at).isNotNull()).groupBy(key).agg(F.min(at).alias("_prior"))
    return fresh.join(first, key, "left").withColumn(at, F.least(F.col(at), F.col("_prior"))).drop("_prior")

"""Structured Streaming twins of the ledger operators."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tideline.session import scratch_path

cloudpickle.register_pickle_by_value(sys.modules[__name__])

CORRECTION_HORIZON = "7 days"


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process everything that is there, exactly once per checkpoint, into Parquet.

    Append goes to the transactional file sink.  Other modes write each batch to its own directory, replaced as a whole,
    so a replayed batch leaves the same files.
    """
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").start(path)
    else:
        def save(batch: DataFrame, batch_id: int) -> None:
            batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

        query = writer.foreachBatch(save).start()
    query.awaitTermination()


def materialized(spark: SparkSession, stream: DataFrame, mode: str = "append", keys: Sequence[str] = ()) -> DataFrame:
    """Run a stream to completion and return its table; for update and complete output, the newest batch per key."""
    path, checkpoint = scratch_path(spark, "stream"), scratch_path(spark, "stream-checkpoint")
    run_available(stream, path, checkpoint, mode)
    table = spark.read.schema(stream.schema if mode == "append" else StructType([*stream.schema.fields, StructField("batch", LongType())])).parquet(path)
    if mode == "append":
        return table
    if mode == "complete":
        last = table.agg(F.max("batch").alias("batch"))
        return table.join(last, "batch", "left_semi").drop("batch")
    rest = [c for c in table.columns if c not in keys and c != "batch"]
    return table.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_r")).select(*keys, "_r.*")


def deduplicated(stream: DataFrame, ts: str, keys: Sequence[str], delay: str = CORRECTION_HORIZON) -> DataFrame:
    """Drop repeated records; the delay is the correction horizon, so a late correction is still seen."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(keys))


FINDINGS = "league string, entity_type string, entity_id bigint, source string, event_id bigint, kind string, previous_hash string, current_hash string"
LAST = "payload_hash string, available_at double, source_timestamp double"


def _findings(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Compare each observation with the previous one of its key, in (retrieval, hash, id) order."""
    rows = pd.concat(list(batches), ignore_index=True)
    rows["_h"] = rows["payload_hash"].fillna("")
    rows = rows.sort_values(["retrieved_at", "_h", "event_id"], kind="stable")
    last = state.get if state.exists else None
    out = []
    for r in rows.itertuples():
        now = (r.payload_hash if isinstance(r.payload_hash, str) else None, None if pd.isna(r.available_at) else r.available_at.timestamp(),
               None if pd.isna(r.source_timestamp) else r.source_timestamp.timestamp())
        if last is not None:
            if now[0] is not None and last[0] is not None and now[0] != last[0]:
                out.append((*key, r.event_id, "REVISION", last[0], now[0]))
            if any(a is not None and b is not None and a < b for a, b in zip(now[1:], last[1:], strict=True)):
                out.append((*key, r.event_id, "BACKFILL", last[0], now[0]))
        last = now
    state.update(last)
    yield pd.DataFrame(out, columns=["league", "entity_type", "entity_id", "source", "event_id", "kind", "previous_hash", "current_hash"])


def revision_stream(ledger: DataFrame) -> DataFrame:
    """Revisions and backfills with one small state row per (league, entity type, entity, source).

    Late observations are data, not noise: nothing is dropped, an earlier availability is reported as BACKFILL.  A batch
    holds what one trigger admits; a source of many files should set ``maxFilesPerTrigger``, or the first trigger is its whole backlog.
    """
    cols = ["league", "entity_type", "entity_id", "source", "event_id", "payload_hash", "available_at", "source_timestamp", "retrieved_at"]
    return ledger.select(*cols).groupBy("league", "entity_type", "entity_id", "source").applyInPandasWithState(
        _findings, FINDINGS, LAST, "append", GroupStateTimeout.NoTimeout)


def matured_join(predictions: DataFrame, outcomes: DataFrame, key: str, horizon: str = CORRECTION_HORIZON) -> DataFrame:
    """Stream-stream join of predictions with the outcomes that matured after them, within the horizon."""
    p = predictions.withWatermark("prediction_time", horizon)
    o = outcomes.withColumnRenamed(key, "_key").withWatermark("matured_at", horizon)
    on = (F.col(key) == F.col("_key")) & (F.col("matured_at") > F.col("prediction_time")) & (
        F.col("matured_at") <= F.col("prediction_time") + F.expr(f"INTERVAL {horizon}"))
    return p.join(o, on).drop("_key")


def windowed_counts(stream: DataFrame, ts: str, keys: Sequence[str], window: Column, delay: str = CORRECTION_HORIZON, **aggs: Column) -> DataFrame:
    """Counts (and further aggregates) per key over tumbling, sliding or session windows."""
    g = stream.withWatermark(ts, delay).groupBy(window.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), *[a.alias(n) for n, a in aggs.items()])
    return g.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "n", *aggs)


def foreach_batch(stream: DataFrame, checkpoint: str, save: Callable[[DataFrame, int], None]) -> None:
    """One idempotent write per batch id."""
    stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

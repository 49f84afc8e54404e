"""Helpers shared by the operators: staged tables, byte-level text rules, counted runs and connected components."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tideline.session import scratch_path

#: A-Z to a-z, every other byte as it is.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def stage(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage is cut and a lost executor costs nothing that was done."""
    path = scratch_path(df.sparkSession, label)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: What worker processes keep between tasks, by owner: functions that let go of it.
STORES: dict[str, Callable[[], None]] = {}


def only(owner: str = "") -> None:
    """Lets go of what other operators have kept in this worker process, and gives freed memory back to the system."""
    for name, forget in STORES.items():
        if name != owner:
            forget()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc keeps freed pages otherwise
    if trim:
        trim(0)


def slices(batches, rows: int = 500):
    """Arrow batches in slices of few rows, whatever the session's batch size: a row may be a very long text."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def width(spark: SparkSession) -> int:
    """Partitions that a shuffle of this session makes."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_of(column: str = "text") -> Column:
    """A document's text; null counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def texts(batch, column: str = "text") -> list[str]:
    return ["" if t is None else t for t in batch.column(column).to_pylist()]


def blob(column: np.ndarray | list) -> bytes:
    return np.ascontiguousarray(column).tobytes()


def by_ranges(docs: DataFrame, ranges: int) -> DataFrame:
    """(range, doc_id, text_hash, text): documents in some `ranges` ranges of rising doc_id, cut at sampled quantiles; null comes last."""
    at = F.col("doc_id").cast("double")
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), text_of().alias("text"), at.alias("_at"))
    cuts = sorted(set(rows.approxQuantile("_at", [i / ranges for i in range(1, ranges)], 0.25 / ranges))) or [0.0]
    bucket = Bucketizer(splits=[float("-inf"), *cuts, float("inf")], inputCol="_at", outputCol="_bucket", handleInvalid="keep")
    number = F.when(F.col("_at").isNull(), len(cuts) + 1).otherwise(F.col("_bucket")).cast("int")
    return bucket.transform(rows).select(number.alias("range"), "doc_id", "text_hash", "text")


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node that an edge (a, b) of two longs reaches; equal labels mean the same component.

    Contraction: in each round a node steps to the neighbour of least hashed rank, or stays if it is least itself; edges are
    renamed by that step and loops fall away. Ranks are drawn anew each round, so a constant share of the nodes goes whatever
    the shape. Only aggregates and equi-joins; nothing reaches the driver but whether edges are left.
    """
    spark = edges.sparkSession
    left = stage(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels, turn = spark.createDataFrame([], "node long, label long"), 0
    while not left.isEmpty():
        rank = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(turn)).alias("h"), F.col(c).alias("n"))  # noqa: B023, E731
        both = left.select("a", "b").unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = stage(both.groupBy("a").agg(F.min(rank("b")).alias("m")).select(
            F.col("a").alias("was"), F.when(F.col("m") < rank("a"), F.col("m.n")).otherwise(F.col("a")).alias("now")), "steps")
        if turn == 0:
            labels = step.select(F.col("was").alias("node"), F.col("now").alias("label"))
        else:
            moved = labels.join(step, labels["label"] == step["was"], "left")
            labels = stage(moved.select("node", F.coalesce("now", "label").alias("label")), "labels")
        to_a, to_b = (step.select(F.col("was").alias(c), F.col("now").alias(f"to_{c}")) for c in "ab")
        renamed = left.join(to_a, "a").join(to_b, "b").where("to_a <> to_b")
        left = stage(renamed.select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct(), "edges")
        turn += 1
    return labels


def forest(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs out of (a, b) that span the same components over nodes 0 to n-1: n-1 at most, however many pairs there are."""
    label, kept = np.arange(n), []
    while True:
        differ = label[a] != label[b]
        if not differ.any():
            break
        a, b = a[differ], b[differ]
        high, low = np.maximum(label[a], label[b]), np.minimum(label[a], label[b])
        order = np.lexsort((low, high))
        first = order[np.unique(high[order], return_index=True)[1]]  # each root hooks to its least partner, so no cycle
        kept.append((a[first], b[first]))
        label[high[first]] = low[first]
        while (label[label] != label).any():
            label = label[label]
    if not kept:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*kept, strict=True))


def numbered(rows: DataFrame, keys: list[str], order: list[Column], runs: int = 16, name: str = "_n") -> DataFrame:
    """Rows with their number from 0 within `keys`, in no order that matters between runs; `order` makes it repeatable.

    A key's rows are dealt into `runs` by a hash of `order`, each run is numbered alone, and a small table of counts (one row
    for a key and run) shifts the runs. So the largest unit of work is a key's rows divided by `runs`.
    """
    run = rows.withColumn("_run", F.pmod(F.xxhash64(*order), F.lit(runs)))
    counts = run.groupBy(*keys, "_run").agg(F.count(F.lit(1)).alias("_c"))
    ahead = W.partitionBy(*keys).orderBy("_run").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select(*keys, "_run", F.coalesce(F.sum("_c").over(ahead), F.lit(0)).alias("_start"))
    within = F.row_number().over(W.partitionBy(*keys, "_run").orderBy(*order))
    n = run.withColumn("_i", within)
    right = starts.select(*[F.col(k).alias(f"_r_{k}") for k in [*keys, "_run"]], "_start")
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in [*keys, "_run"]])
    return n.join(right, same).withColumn(name, F.col("_start") + F.col("_i") - 1).drop("_run", "_i", "_start", *[f"_r_{k}" for k in [*keys, "_run"]])

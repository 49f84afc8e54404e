"""Session helpers: settings the operators rely on and where durable scratch data goes."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


# Spark 4.1 leaves out the shuffle after a union whose inputs are dealt alike. Adaptive execution may deal the inputs anew
# afterwards, and a window over the union then sees parts of its key.
UNION_PARTITIONING = "spark.sql.unionOutputPartitioning"


def build_session(app: str = "tideline", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators expect (UTC, AQE with skew handling)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        UNION_PARTITIONING: "false",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def configure(spark: SparkSession) -> SparkSession:
    """Apply the run-time settings to a session somebody else built. On a local master the Python workers import the package from
    where the driver did; a cluster ships it (``--py-files``)."""
    if spark.sparkContext.master.startswith("local["):
        spark.sparkContext.environment.setdefault("PYTHONPATH", os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    # set whatever was there: get() with a default answers that default, not Spark's own, where nobody set the key
    spark.conf.set(UNION_PARTITIONING, "false")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for checkpoints: the cluster's setting, or one of our own where it is unset."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    own = spark.conf.get("tideline.checkpoint.dir", None)
    if not own:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        own = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("tideline.checkpoint.dir", own)
    return own


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path under the shared folder."""
    return os.path.join(checkpoint_root(spark), f"{label}-{uuid.uuid4().hex}")


def materialize(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder (survives executor loss)."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(checkpoint_root(spark))
    return df.checkpoint(eager)


def stored(df: DataFrame, label: str) -> DataFrame:
    """df written to the shared folder and read back, so that its size is known when a join is planned."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)

"""File layers, seasons, ledgers and nested documents, through the DataFrame readers and writers."""

from __future__ import annotations

import sys
from collections.abc import Mapping, Sequence

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.functions.scalars import short_hash
from tideline.operators import ordered as O

cloudpickle.register_pickle_by_value(sys.modules[__name__])


# -- layers -------------------------------------------------------------------------------------------------------


def layer_path(root: str, layer: str, dataset: str) -> str:
    return f"{root}/{layer}/{dataset}"


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def write_layer(df: DataFrame, root: str, layer: str, dataset: str, mode: str = "overwrite", partition: Sequence[str] = ()) -> str:
    """Overwrite or append; with partitions, only the partitions present in ``df`` are replaced."""
    path = layer_path(root, layer, dataset)
    writer = df.write.mode(mode)
    if partition:
        writer = writer.partitionBy(*partition).option("partitionOverwriteMode", "dynamic")
    writer.parquet(path)
    return path


def read_layer(spark: SparkSession, root: str, layer: str, dataset: str, schema: T.StructType | str | None = None) -> DataFrame:
    """All partitions of a dataset, schemas merged, corrupt files skipped; an empty frame when nothing is there."""
    path = layer_path(root, layer, dataset)
    if not exists(spark, path):
        return spark.createDataFrame([], schema or T.StructType())
    reader = spark.read.option("mergeSchema", True).option("ignoreCorruptFiles", True)
    return (reader.schema(schema) if schema else reader).parquet(path)


def inventory(df: DataFrame, dataset: str) -> DataFrame:
    """Rows, files and bytes of a file-backed frame, from file metadata columns."""
    files = df.select("_metadata.file_path", "_metadata.file_size").groupBy("file_path").agg(F.first("file_size").alias("size"), F.count(F.lit(1)).alias("n"))
    return files.agg(F.lit(dataset).alias("dataset"), F.sum("n").alias("row_count"), F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes_on_disk"))


# -- CSV families -------------------------------------------------------------------------------------------------


def read_seasons(spark: SparkSession, families: Sequence[str], key: str, schema: str) -> DataFrame:
    """The first existing source family wins; rows without the key are dropped."""
    for path in families:
        if exists(spark, path):
            return spark.read.schema(schema).option("header", True).csv(path).filter(F.col(key).isNotNull())
    return spark.createDataFrame([], schema)


def read_player_games(spark: SparkSession, path: str, schema: str, keys: Sequence[str] = ("game_id", "player_id"), side: str = "unknown") -> DataFrame:
    df = spark.read.schema(schema).option("header", True).csv(path)
    out = df.filter(" AND ".join(f"{k} IS NOT NULL" for k in keys)).withColumns({k: F.trim(F.col(k).cast("string")) for k in keys})
    return out.withColumn("side", F.coalesce("side", F.lit(side)))


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """Union by name with schema drift."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def normalize_schedule(df: DataFrame, aliases: Mapping[str, Sequence[str]], state: str, final: object, required: Sequence[str]) -> DataFrame:
    """Lower-case headers, resolve aliases, keep finished rows that carry every required value."""
    low = df.toDF(*[c.strip().lower() for c in df.columns])
    cols = {n: F.coalesce(*[F.col(a) for a in names if a in low.columns]) for n, names in aliases.items() if any(a in low.columns for a in names)}
    return low.filter(F.col(state) == final).select(*[c.alias(n) for n, c in cols.items()]).dropna(subset=list(required))


# -- ledgers ------------------------------------------------------------------------------------------------------


INSTANT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"  # the default format would drop microseconds


def read_ledger(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with a fixed schema; a line that is not an object fails the query."""
    return spark.read.schema(schema).option("mode", "FAILFAST").option("timestampFormat", INSTANT).json(path)


def stream_ledger(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).option("timestampFormat", INSTANT).json(path)


def append_ledger(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("timestampFormat", INSTANT).json(path)


def new_records(incoming: DataFrame, existing: DataFrame, key: str, content: str) -> DataFrame:
    """Rows to append: unseen keys only; a known key with the same content is a no-op, with different content an error."""
    once = incoming.groupBy(key).agg(F.min(content).alias("_lo"), F.max(content).alias("_hi"), F.min_by(F.struct(*incoming.columns), content).alias("_row"))
    known = existing.select(key, F.col(content).alias("_old")).groupBy(key).agg(F.max("_old").alias("_old"))
    j = once.join(known, key, "left")
    clash = (F.col("_lo") != F.col("_hi")) | F.coalesce(F.col("_old") != F.col("_lo"), F.lit(False))
    checked = F.when(clash, F.raise_error(F.concat(F.lit("conflicting content for "), F.col(key).cast("string"))).cast("boolean")).otherwise(F.col("_old").isNull())
    return j.filter(checked).select("_row.*")


def append_once(df: DataFrame, path: str, key: str, content: str) -> None:
    """Exactly-once append by key."""
    spark = df.sparkSession
    old = spark.read.schema(df.schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], df.schema)
    new_records(df, old, key, content).write.mode("append").parquet(path)


def incremental_upsert(existing: DataFrame, fresh: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Fresh rows replace existing ones by key; the last of several fresh rows wins through the given load order."""
    both = existing.withColumn("_load", F.lit(0)).unionByName(fresh.withColumn("_load", F.lit(1)), allowMissingColumns=True)
    rest = [c for c in both.columns if c not in keys and c != "_load"]
    return O.latest_by(both, keys, ["_load", *rest]).drop("_load")


def replace_by_key(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Drop every old row whose key occurs in the new rows, then add the new rows."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def keep_latest(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    return O.latest_by(df, keys, order)


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    return O.latest_by(df, keys, order, first=True)


def set_report(expected: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Missing, unexpected and duplicated ids between an expected and a completed set."""
    e, d = expected.select(key), done.select(key)
    missing = e.distinct().join(d, key, "left_anti").withColumn("issue", F.lit("missing"))
    extra = d.distinct().join(e, key, "left_anti").withColumn("issue", F.lit("unexpected"))
    dup = d.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(key, F.lit("duplicate").alias("issue"))
    return missing.unionByName(extra).unionByName(dup)


def equality_gate(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row of differences between two tables as bags of rows: both counts are 0 when they are equal."""
    if [f.name for f in left.schema] != [f.name for f in right.schema]:
        raise ValueError("schemas differ")
    cols = left.columns
    a = left.groupBy(*cols).agg(F.count(F.lit(1)).alias("_n")).withColumn("_m", F.lit(0))
    b = right.groupBy(*cols).agg(F.count(F.lit(1)).alias("_m")).withColumn("_n", F.lit(0))
    both = a.unionByName(b).groupBy(*cols).agg((F.sum("_n") - F.sum("_m")).alias("_d"))
    return both.agg(F.coalesce(F.sum(F.greatest("_d", F.lit(0))), F.lit(0)).alias("only_left"), F.coalesce(F.sum(F.greatest(-F.col("_d"), F.lit(0))), F.lit(0)).alias("only_right"))


# -- nested documents ---------------------------------------------------------------------------------------------

SCHEDULE = ("dates array<struct<date:string,games:array<struct<gamePk:string,status:string,gameDate:string,"
            "teams:struct<home:struct<name:string,score:int,starter:string>,away:struct<name:string,score:int,starter:string>>>>>>")


def games_from_schedule_json(docs: DataFrame, final: str = "Final") -> DataFrame:
    """Explode dates and games of nested schedule documents, finished games only."""
    g = docs.select(F.explode("dates").alias("d")).select(F.explode("d.games").alias("g")).filter(F.col("g.status") == final)
    return g.select(F.col("g.gamePk").alias("game_id"), F.try_to_timestamp("g.gameDate").alias("ts"), F.col("g.teams.home.name").alias("home"), F.col("g.teams.away.name").alias("away"),
                    F.col("g.teams.home.score").alias("home_score"), F.col("g.teams.away.score").alias("away_score"), F.col("g.teams.home.starter").alias("home_starter"))


def observation_records(starters: DataFrame, schedule: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Starters with the schedule's event id, or a hashed id of the pair and time when the schedule has none."""
    j = starters.join(schedule.select(*keys, "event_id"), list(keys), "left")
    fallback = short_hash(*[F.col(k).cast("string") for k in keys])
    return j.withColumn("event_id", F.coalesce("event_id", fallback)).withColumn("id_source", F.when(F.col("event_id") == fallback, "HASH").otherwise("SCHEDULE"))


def stage_artifact(raw: DataFrame, game: DataFrame, lagged: DataFrame, root: str) -> DataFrame:
    """Write the three stages and return one manifest row read back from them."""
    spark = raw.sparkSession
    one = None
    for name, df in (("pitch", raw), ("games", game), ("lagged", lagged)):
        path = write_layer(df, root, "research", name)
        count = spark.read.parquet(path).agg(F.count(F.lit(1)).alias(f"rows_{name}")).withColumn("_one", F.lit(1))
        one = count if one is None else one.join(count, "_one")
    return one.drop("_one").withColumns({"tracking_pit_status": F.lit("UNVERIFIED"), "historical_backtest_eligible": F.lit(False), "production_eligible": F.lit(False)})


def find_values(json_text: Column, names: Sequence[str]) -> Column:
    """Values found at any depth under one of the names, as text, in document order."""
    keys = "|".join(names)
    return F.regexp_extract_all(json_text, F.lit(rf'"(?:{keys})"\s*:\s*"?([^",}}\]]*)'), F.lit(1))



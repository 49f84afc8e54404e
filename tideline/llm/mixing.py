"""Mixing sources to target weights by systematic sampling.

A source's target is its share of the weights, but never over `most` times its own size; the excess is shared again by weight
until no source is above. Every document of a source then expects target / size copies. Documents are laid out by size class (the
leading five bits of the size) and a hash, expected copies are summed along that line from one random offset a source, and a
document is taken once for each whole number its stretch crosses. Sizes lie evenly along the line, so words taken come near the
target, and no document is taken more than `most` times.

The line is never sorted as a whole: documents are counted by (source, size class, hash digit), those counts give each stretch
its start, and rows are numbered only within a stretch. A source with a third of all rows is hundreds of stretches.

Defined results: null source is a source of its own, last in order; a null or empty text has size 0 and is taken 0 words
(its copies follow the same rule, so an empty document may be repeated or left out); rows with equal or null doc_id each count;
a source whose size is 0 has target 0; an empty table gives an empty result. Columns named `_mix_*` are the operator's own, and given
columns named source_size, target or copies are replaced by its own (the size may not have such a name). Documents of one class, doc_id
and size are laid out by the hash of their text, if they have one, so a rerun repeats the same ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

WEIGHTS = (5, 2, 1)
MOST = 3
SEED = "mix-1"
#: Words: runs without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def words(column: str = "text"):
    return F.coalesce(F.regexp_count(F.col(column), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, _mix_key, source_size, target) from one row a source: source, _mix_key, source_size."""
    turn = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (turn % len(weights) + 1).cast("int")).cast("long")
    rows = sizes.withColumn("w", weight).withColumn("reach", F.col("source_size") * most / F.col("w"))
    line = W.orderBy("reach", F.col("source").asc_nulls_last())
    before = line.rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy()
    rest = F.sum("source_size").over(whole) - F.coalesce(F.sum(F.col("source_size") * most).over(before), F.lit(0))
    level = rest / (F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0)))
    rows = rows.withColumn("level", level).withColumn("at", F.row_number().over(line))
    # the first source in that order that its share does not fill sets the level for itself and all after it
    rows = rows.withColumn("level", F.min(F.when(F.col("level") <= F.col("reach"), F.struct("at", "level"))).over(whole)["level"])
    cap = (F.col("source_size") * most).cast("double")
    return rows.select("source", "_mix_key", "source_size", F.least(cap, F.coalesce(F.col("level") * F.col("w"), cap)).alias("target"))


def size_class(size):
    """Leading five bits and their place."""
    bits = F.length(F.bin(size))
    return bits * 32 + F.call_function("shiftright", size, F.greatest(bits - 5, F.lit(0)).cast("int")).cast("int")


def mix(docs: DataFrame, size: str, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = SEED) -> DataFrame:
    """docs with source_size, target and copies; `size` names a column of sizes (long, not null) in docs, which has doc_id and source."""
    docs = docs.drop("source_size", "target", "copies")
    key = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))
    mark = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    rows = docs.withColumns({"_mix_key": key, "_mix_class": size_class(F.col(size)), "_mix_mark": mark, "_mix_run": F.substring(mark, 1, 1)})
    stretch = rows.groupBy("_mix_key", "_mix_class", "_mix_run").agg(
        F.count(F.lit(1)).alias("_mix_n"), F.sum(size).alias("_mix_size"), F.first("source").alias("source"))
    by_source = stretch.groupBy("_mix_key").agg(F.first("source").alias("source"), F.sum("_mix_size").alias("source_size"))
    drawn = targets(by_source, weights, most).select("_mix_key", F.col("source_size").alias("_mix_source_size"), F.col("target").alias("_mix_target"))
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), "_mix_key")), 1, 8), 16, 10).cast("double") / 4294967296.0
    ahead = W.partitionBy("_mix_key").orderBy("_mix_class", "_mix_run").rowsBetween(W.unboundedPreceding, -1)
    start = F.coalesce(F.sum("_mix_n").over(ahead), F.lit(0))
    plan = stretch.select("_mix_key", "_mix_class", "_mix_run", start.alias("_mix_start")).join(drawn, "_mix_key").withColumn("_mix_offset", offset)
    within = F.row_number().over(W.partitionBy("_mix_key", "_mix_class", "_mix_run").orderBy("_mix_mark", size, *([F.xxhash64("text")] if "text" in docs.columns else [])))
    rate = F.when(F.col("_mix_source_size") > 0, F.col("_mix_target") / F.col("_mix_source_size")).otherwise(F.lit(0.0))
    place = F.col("_mix_start") + F.col("_mix_i")
    copies = F.floor(rate * place + F.col("_mix_offset")) - F.floor(rate * (place - 1) + F.col("_mix_offset"))
    out = rows.withColumn("_mix_i", within).join(plan, ["_mix_key", "_mix_class", "_mix_run"]).withColumn("copies", copies.cast("long"))
    out = out.withColumns({"source_size": F.col("_mix_source_size"), "target": F.col("_mix_target")})
    return out.drop(*[c for c in out.columns if c.startswith("_mix_")])


ORACLE = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT coalesce('s' || source, 'n') AS k, source, sum(size)::BIGINT AS source_size FROM d GROUP BY ALL),
w AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::BIGINT AS w FROM s),
r AS (SELECT *, source_size * 3 / w AS reach FROM w),
l AS (SELECT *, row_number() OVER o AS seq,
  (sum(source_size) OVER () - coalesce(sum(source_size * 3) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
  / (sum(w) OVER () - coalesce(sum(w) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM r WINDOW o AS (ORDER BY reach, source NULLS LAST)),
t AS (SELECT k, source_size, least(source_size * 3.0::DOUBLE, coalesce((SELECT arg_min(level, seq) FROM l WHERE level <= reach) * w, source_size * 3.0::DOUBLE)) AS target,
  ('0x' || substr(md5('mix-1:' || k), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM l),
n AS (SELECT doc_id, size, coalesce('s' || source, 'n') AS k,
  row_number() OVER (PARTITION BY source ORDER BY length(bin(size)) * 32 + (size >> greatest(length(bin(size)) - 5, 0)), md5(coalesce(doc_id::VARCHAR, '')), size) AS i FROM d)
SELECT doc_id, size, source_size, target,
  (floor(CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END * i + u) - floor(CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END * (i - 1) + u))::BIGINT * size AS taken
FROM n JOIN t USING (k)
"""

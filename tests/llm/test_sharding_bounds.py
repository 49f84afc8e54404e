"""What the driver holds while shards are cut, with groups of copies below an even share."""

import random
from itertools import accumulate

from pyspark.sql import functions as F

from tideline.llm import sharding


def test_large_groups_do_not_bring_all_groups_to_the_driver(spark, monkeypatch):
    n, shards, rng = 60_000, 40, random.Random(2)
    large = set(rng.sample(range(n), 10))
    share = 100 * n / (shards - 10 * 0.76)
    groups = spark.range(n).select(F.xxhash64("id").alias("_hash"), F.when(F.col("id").isin(large), int(0.76 * share)).otherwise(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(200))).cast("long").alias("size")).localCheckpoint()
    got, real = [], sharding._sums
    monkeypatch.setattr(sharding, "_sums", lambda *a: got.append(real(*a)) or got[-1])
    rows = sorted((r["_hash"], r["size"]) for r in groups.collect())
    largest = max(size for _, size in rows)
    cuts = sharding.cut_points(groups, shards, largest)
    starts = [0, *accumulate(size for _, size in rows)]
    place = {h: i for i, (h, _) in enumerate(rows)}
    edges = [0, *(starts[place[c]] for c in cuts), starts[-1]]
    assert len(cuts) < shards and max(b - a for a, b in zip(edges[:-1], edges[1:], strict=True)) == sharding.least_capacity(starts, shards, largest)
    assert len(got[0]) <= 4096 and max(map(len, got[1:]), default=0) <= shards * 64

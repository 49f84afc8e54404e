"""Rated games move once; seasons of any kind and ids that games share are as in the plain fold and the SQL."""

import random
from datetime import datetime, timedelta

import __spark_entry__ as entry
import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_ratings_tree import fold

from tideline.operators import ratings as R

NAMES = "league string, game_id string, ts timestamp, home string, away string, home_score int, away_score int, s string"


def league(name, n, seed):
    rng, out = random.Random(seed), []
    for i in range(n):
        h, a = rng.sample(range(5), 2)
        out.append((name, f"{name}{i:03d}", datetime(2020 + i // 70, 1, 1) + timedelta(days=i // 4), f"e{h}", f"e{a}", rng.randrange(5), rng.randrange(5), rng.choice(["x", "y", None]) if i % 9 == 0 else "x"))
    return out


def ran(df):
    found = df.collect()
    return found, df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


@pytest.mark.parametrize("size", [3, 25, 4000])
def test_rows_meet_their_ratings_without_a_shuffle(spark, size):
    rows = league("A", 150, 1) + league("B", 40, 2)
    games = spark.createDataFrame(rows, NAMES).repartition(3)
    found, plan = ran(R.elo(games, rows_per_segment=size, carry=("league", "home_score")))
    assert "Exchange hashpartitioning" not in plan and len(found) == len(rows)
    want = fold([r[:7] for r in rows if r[0] == "A"]) | fold([r[:7] for r in rows if r[0] == "B"])
    kept = {r[1]: (r[0], r[5]) for r in rows}
    for r in found:
        assert np.allclose((r.elo_home, r.elo_away, r.expected_home), want[r.game_id], atol=1e-6)
        assert (r["league"], r["home_score"]) == kept[r["game_id"]]


def test_a_season_is_any_column_and_unknown_ones_change_nothing(spark):
    rows, x, last, want = league("A", 120, 3), {}, None, {}
    for r in sorted(rows, key=lambda r: (r[2], r[1])):
        if last is not None and r[7] is not None and r[7] != last:
            x = {e: 1500 + 0.2 * (v - 1500) for e, v in x.items()}
        last = r[7]
        h, a = x.get(r[3], 1500.0), x.get(r[4], 1500.0)
        want[r[1]] = (h, a)
        p = 1 / (1 + 10 ** (-(h + 25 - a) / 400))
        d = 24 * ((r[5] > r[6]) + 0.5 * (r[5] == r[6]) - p)
        x[r[3]], x[r[4]] = h + d, a - d
    for r in R.elo(spark.createDataFrame(rows, NAMES).repartition(3), k=24.0, margin=0.0, season=F.col("s"), rows_per_segment=7).collect():
        assert np.allclose((r.elo_home, r.elo_away), want[r.game_id], atol=1e-6)


def test_the_baseline_counts_shared_ids_like_its_sql(spark, tmp_path):
    con = duckdb.connect()
    source = "SELECT * FROM '/root/testdata/sf0.001/lineitem.parquet' WHERE l_orderkey < 200"
    con.execute(f"COPY ({source} UNION ALL {source} AND l_orderkey % 7 = 0) TO '{tmp_path}/lineitem.parquet'")
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet'")
    df = entry.queries()["e11_elo_baseline"](spark, str(tmp_path))
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({entry.oracle_sql()['e11_elo_baseline']})").fetchall()
    assert want and sorted(map(tuple, df.collect())) == sorted(want)

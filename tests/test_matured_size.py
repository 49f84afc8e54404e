"""What the join of targets with their matured history moves."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tideline.operators import joins as J

T0 = datetime(2024, 1, 1)
D = timedelta(days=1)
NAMES = "league string, game_id string, pt timestamp, mt timestamp, ok int"


def matured(spark, rows, targets=None):
    cases = spark.createDataFrame(rows, NAMES).repartition(3)
    asked = cases.select("league", "game_id", "pt") if targets is None else spark.createDataFrame(targets, "league string, game_id string, pt timestamp")
    return J.matured_sums(asked, cases, ["league"], "pt", "pt", "mt", {"n": F.lit(1), "hits": F.col("ok")})


def moved(df):
    """Shuffles of the plan as it ran."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count("Exchange hashpartitioning")


def test_targets_that_never_see_their_own_game_stay_where_they_are(spark):
    rows = [("AB"[i % 2], f"g{i}", T0 + (i // 9) * D, T0 + (i // 9 + 3) * D, i % 2) for i in range(200)]
    out = matured(spark, rows)
    for r in out.collect():
        seen = [q[4] for q in rows if q[0] == r["league"] and q[3] <= r["pt"]]
        assert (r["n"], r["hits"]) == (len(seen), sum(seen))
    assert moved(out) == 0


def test_a_late_target_of_a_game_of_one_row_does_not_see_it(spark):
    rows = [("A", "g1", T0, T0 + D, 1), ("A", "g2", T0, T0 + D, 0), ("A", None, T0, T0 + 2 * D, 1)]
    targets = [("A", "g1", T0 + D), ("A", "g1", T0), ("A", "g2", T0 + 5 * D), ("A", "g9", T0 + 5 * D), ("A", None, T0 + 5 * D), ("B", "g1", T0 + 5 * D)]
    got = sorted(map(tuple, matured(spark, rows, targets).select("league", "game_id", "n", "hits").collect()), key=str)
    assert got == sorted([("A", "g1", 1, 0), ("A", "g1", 0, 0), ("A", "g2", 2, 2), ("A", "g9", 3, 2), ("A", None, 2, 1), ("B", "g1", 0, 0)], key=str)

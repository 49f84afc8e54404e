"""Blockers of an out-of-sample table, one group for each kind."""

from datetime import datetime, timedelta

from tideline.operators import experience as X

START = datetime(2024, 5, 1)


def rows(group, n=120, **change):
    out = []
    for i in range(n):
        r = {"league": group, "seq": START + timedelta(minutes=i), "prediction_time": START + timedelta(hours=i), "available_at": START + timedelta(hours=i - 1), "pit_matched": True, "y": i % 3, "p0": 0.2, "p1": 0.3, "p2": 0.5}
        if i == n // 2:
            r.update(change)
        out.append(tuple(r.values()))
    return out


def test_each_blocker_alone_and_a_clean_table(spark):
    late = START + timedelta(days=400)
    groups = {
        "clean": ({}, ""), "join": ({"pit_matched": False}, "pit_join_incomplete"), "order": ({"prediction_time": late, "available_at": START}, "oos_not_chronological"),
        "time": ({"prediction_time": None}, "invalid_prediction_time,pit_not_verified"), "late": ({"available_at": late}, "pit_not_verified"), "none": ({"available_at": None}, "pit_not_verified"),
        "nan": ({"p1": float("nan")}, "invalid_probabilities"), "neg": ({"p0": -0.1}, "invalid_probabilities"), "null": ({"p2": None}, "invalid_probabilities"), "y": ({"y": 3}, "target_contract"), "yn": ({"y": None}, "target_contract"),
    }
    data = [r for g, (change, _) in groups.items() for r in rows(g, **change)] + rows("short", 99)
    df = spark.createDataFrame(data, "league string, seq timestamp, prediction_time timestamp, available_at timestamp, pit_matched boolean, y int, p0 double, p1 double, p2 double").repartition(3)
    got = {r["league"]: (r["rows"], r["blockers"]) for r in X.oos_blockers(df, ["p0", "p1", "p2"], "y", ["seq"]).collect()}
    assert got == {g: (120, want) for g, (_, want) in groups.items()} | {"short": (99, "insufficient_oos_rows")}
    assert X.oos_blockers(df.where("false"), ["p0", "p1", "p2"], "y", ["seq"]).count() == 0

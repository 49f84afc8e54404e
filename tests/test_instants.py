"""Instants are cut to the rows that later ones can see; changes under noise come from one row; quantiles by bracket."""

import math
import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tideline.operators import learners as L
from tideline.operators import ordered as O
from tideline.operators import timeline as T

START = datetime(2026, 1, 1, tzinfo=timezone.utc)


def _rows(n, seed):
    rng = random.Random(seed)
    return [(rng.choice("ab") if rng.random() > 0.1 else None, START + timedelta(hours=rng.choice([0, 1, 5, 9, 30, 31])), i, rng.randrange(9)) for i in range(n)]


@pytest.mark.parametrize("size", [7, O.BLOCK])
def test_instants_of_many_rows_see_the_same_past(spark, size):
    rows, back = _rows(300, 4), 3
    df = spark.createDataFrame(rows, "k string, ts timestamp, id long, v long").repartition(5)
    out = O.frozen_state(
        df, ["k"], "ts", ["id"], back, lambda w: {"seen": F.col("rn") - 1, "last": F.sum("v").over(w.rowsBetween(-back, -1)), "slope": F.max("rn").over(w.rowsBetween(-back, -1))},
        size=size, totals={"total": F.col("v")} if size == 7 else None)
    got = {(r["k"], r["ts"]): (r["seen"], r["last"], r["slope"]) for r in out.collect()}
    want = {}
    for k in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == k), key=lambda r: (r[1], r[2]))
        for t in {r[1] for r in mine}:
            past = [r for r in mine if r[1] < t]
            want[k, t.replace(tzinfo=None)] = (len(past), sum(r[3] for r in past[-back:]) if past else None, len(past) or None)
    assert got == want


def test_rows_of_an_instant_that_nobody_can_see_do_not_move(spark):
    df = spark.range(20_000).select(F.lit("a").alias("k"), F.timestamp_seconds(F.col("id") % 4).alias("ts"), "id")
    tails = O._instant_tails(df, ["k"], "ts", ["id"], 5, None, {})
    assert tails.count() == 4 * 6
    assert sorted(r["rn"] for r in tails.collect() if r[O.LEAD]) == [1, 5001, 10001, 15001]
    assert "WindowGroupLimit" in tails._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("q", [0.0, 0.5, 0.95, 1.0])
def test_a_quantile_by_bracket_is_exact(spark, monkeypatch, q):
    rng = random.Random(3)
    for values in ([rng.gauss(0, 1) for _ in range(5000)], [1.0] * 50 + [2.0], [4.0], [None], [-1.0, None, 3.0]):
        df = spark.createDataFrame([(v,) for v in values], "v double")
        known = sorted(v for v in values if v is not None)
        want = None
        if known:
            at = q * (len(known) - 1)
            low, high = known[int(at)], known[min(int(at) + 1, len(known) - 1)]
            want = low + (high - low) * (at - int(at))
        got = O.exact_quantile(df, "v", q, "x").first()["x"]
        assert got == (pytest.approx(want, abs=1e-9) if known else None)


def test_changes_under_noise_come_from_one_row(spark):
    """Rows of one key are compared with themselves only, and no row is joined with another."""
    rng = random.Random(1)
    rows = [(f"g{i // 2}", rng.gauss(0, 1), rng.gauss(0, 3), float(rng.randrange(3))) for i in range(400)]
    df = spark.createDataFrame(rows, "key string, a double, b double, y double")
    model = L.fit_classifier(df, ["a", "b"], "y")
    one, twin = (L.counterfactual_stability(model, d, ["a", "b"], "key", draws=2).first() for d in (df, df.union(df)))
    assert one["mean_change"] == pytest.approx(twin["mean_change"]) and one["max_change"] < 0.1


def test_decayed_means_carry_sums_of_instants_not_rows(spark, monkeypatch):
    """Many rows an instant and a gap of unknown values by which any power of the decay vanishes; rows are never numbered whole."""
    rng, tau, rows = random.Random(6), 2.0, []
    for hour in (0, 3, 4, 30, 31, 90):
        rows += [("L", 1, START + timedelta(hours=hour), i, rng.random() if hour < 4 or (hour == 90 and i < 5) else None) for i in range(900 if hour == 30 else 40)]
    df = spark.createDataFrame(rows, "league string, entity int, ts timestamp, game_id long, x double").repartition(4)

    def numbered(*args, **kwargs):
        raise AssertionError("rows are numbered whole")

    monkeypatch.setattr(T.O, "row_numbers", numbered)
    got = {r["ts"]: (r["n_prior"], r["x_ew"]) for r in T.exp_weighted(df, {"x": 7.0}, tau).collect()}
    ordered = sorted(rows, key=lambda r: (r[2], r[3]))
    for at in {r[2] for r in rows}:
        past = [(i, r[4]) for i, r in enumerate(ordered) if r[2] < at]
        known = [(i, v) for i, v in past if v is not None]
        weights = [math.exp((i - known[-1][0]) / tau) for i, _ in known]
        want = sum(w * v for w, (_, v) in zip(weights, known, strict=True)) / sum(weights) if known else 7.0
        assert got[at.replace(tzinfo=None)] == (len(past), pytest.approx(want, rel=1e-9))


@pytest.mark.parametrize("kind", ["logistic", "boosted"])
def test_equal_rows_are_fitted_once(spark, monkeypatch, kind):
    rng = random.Random(2)
    rows = [(float(rng.randrange(4)), float(rng.randrange(3)), float(rng.randrange(3))) for _ in range(600)]
    df, seen, kept = spark.createDataFrame(rows, "a double, b double, y double"), [], L.stored
    monkeypatch.setattr(L, "stored", lambda d, label: seen.append(kept(d, label)) or seen[-1])
    plain, once = (L.predict(L.fit_classifier(df, ["a", "b"], "y", kind, equal=e), df.distinct(), 3).orderBy("a", "b", "y").collect() for e in (False, True))
    assert len(seen) == 1 and seen[0].count() <= 36 and seen[0].agg(F.sum("_n")).first()[0] == 600
    assert len(plain) == len(once) and all(p[i] == pytest.approx(o[i], abs=1e-4) for p, o in zip(plain, once, strict=True) for i in range(3, 6))


def test_games_stay_where_they_are_for_a_small_state(spark):
    games = spark.createDataFrame([("L", f"g{i}", START + timedelta(days=i // 5), i % 4, (i + 1) % 4, i % 3, i % 2) for i in range(60)],
                                  "league string, game_id string, ts timestamp, home int, away int, home_score int, away_score int")
    plan = T.stage_rest(games)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") == 2 and "SortMergeJoin" not in plan

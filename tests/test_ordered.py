"""Ordered primitives against obvious versions, with one key holding most rows and tiny blocks."""

import random
from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import functions as F

from tideline.operators import evaluate as E
from tideline.operators import ordered as O
from tideline.operators import timeline as T

T0 = datetime(2024, 1, 1)


def facts(spark, n=300, seed=7):
    rng = random.Random(seed)
    rows = [("hot" if rng.random() < 0.6 else rng.choice("ab"), T0 + timedelta(hours=6 * rng.randrange(60)), i, float(rng.randrange(20))) for i in range(n)]
    rows += [(None, T0 + timedelta(days=k), 1000 + k, 1.0) for k in range(3)]
    return rows, spark.createDataFrame(rows, "k string, ts timestamp, id int, x double")


def test_row_numbers_match_plain_order_with_null_keys(spark):
    rows, df = facts(spark)
    got = {r.id: r.rn for r in O.row_numbers(df, ["k"], ["ts", "id"]).collect()}
    for key in {r[0] for r in rows}:
        for i, r in enumerate(sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2])), 1):
            assert got[r[2]] == i


def test_global_numbers_need_no_key(spark):
    rows, df = facts(spark)
    got = {r.id: r.rn for r in O.row_numbers(df, [], ["ts", "id"]).collect()}
    assert [got[r[2]] for r in sorted(rows, key=lambda r: (r[1], r[2]))] == list(range(1, len(rows) + 1))


def test_blocks_keep_bounded_frames_exact(spark):
    rows, df = facts(spark)
    spread, w = O.blocks(O.row_numbers(df, ["k"], ["ts", "id"]), ["k"], back=4, size=8)
    got = {r.id: r.s for r in O.drop_halo(spread.withColumn("s", F.sum("x").over(w.rowsBetween(-4, -1)))).collect()}
    assert len(got) == len(rows)
    for key in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2]))
        for i, r in enumerate(own):
            past = [q[3] for q in own[max(0, i - 4):i]]
            assert got[r[2]] == (sum(past) if past else None)


def test_prior_and_running_sums(spark):
    rows, df = facts(spark)
    prior = {(r.k, r.ts): r.s for r in O.prior_sums(df, ["k"], "ts", {"s": F.col("x")}).collect()}
    run = {r.id: r.s for r in O.running_sums(df, ["k"], ["ts", "id"], {"s": F.col("x")}).collect()}
    for k, ts, i, _ in rows:
        assert prior[(k, ts)] == sum(r[3] for r in rows if r[0] == k and r[1] < ts)
        assert run[i] == sum(r[3] for r in rows if r[0] == k and (r[1], r[2]) <= (ts, i))


def test_as_of_picks_best_eligible_not_latest_eligible(spark):
    rng = random.Random(3)
    right = [(rng.choice("hhhab"), T0 + timedelta(hours=rng.randrange(400)), rng.randrange(1000), i) for i in range(200)]
    left = [(rng.choice("hab"), T0 + timedelta(hours=rng.randrange(400)), i) for i in range(100)]
    r = spark.createDataFrame(right, "k string, e timestamp, rank int, rid int")
    q = spark.createDataFrame(left, "k string, t timestamp, lid int")
    for inclusive in (True, False):
        got = {x.lid: x.rid for x in O.as_of(q, r, ["k"], "t", "e", ["rank", "rid"], ["rid"], inclusive).collect()}
        for k, t, lid in left:
            ok = [x for x in right if x[0] == k and (x[1] <= t if inclusive else x[1] < t)]
            assert got[lid] == (max(ok, key=lambda x: (x[2], x[3]))[3] if ok else None)


def test_prior_range_counts(spark):
    rng = random.Random(5)
    fs = [("h" if rng.random() < 0.7 else "a", T0 + timedelta(hours=rng.randrange(200)), rng.randrange(50) / 10, i % 2) for i in range(400)]
    qs = [("h" if rng.random() < 0.7 else "a", T0 + timedelta(hours=rng.randrange(200)), rng.randrange(50) / 10, f"q{i}") for i in range(120)]
    f = spark.createDataFrame(fs, "k string, ts timestamp, v double, hit int")
    q = spark.createDataFrame(qs, "k string, ts timestamp, v double, qid string").withColumns({"lo": F.col("v") - 0.5, "hi": F.col("v") + 0.5})
    for inclusive in (True, False):
        got = {r.qid: (r.n, r.h) for r in O.prior_range_counts(f, q, ["k"], "ts", "v", "lo", "hi", "qid", {"n": F.lit(1), "h": F.col("hit")}, inclusive).collect()}
        for k, ts, v, qid in qs:
            m = [x for x in fs if x[0] == k and (x[1] <= ts if inclusive else x[1] < ts) and v - 0.5 <= x[2] <= v + 0.5]
            assert got[qid] == (len(m), sum(x[3] for x in m))


def test_exact_quantiles(spark):
    rng = np.random.default_rng(1)
    values = np.concatenate([np.full(500, 3.25), rng.normal(0, 100, 301)])
    df = spark.createDataFrame([(float(x),) for x in values], "x double")
    r = O.exact_quantiles(df, [], "x", {"a": 0.33, "b": 0.5, "c": 0.95}).first()
    assert np.allclose([r.a, r.b, r.c], np.quantile(values, [0.33, 0.5, 0.95]))


def test_nearest_prefers_earlier_row_on_equal_gap(spark):
    r = spark.createDataFrame([("v", T0, 1, "early"), ("v", T0 + timedelta(hours=2), 2, "late")], "k string, rt timestamp, rid int, label string")
    q = spark.createDataFrame([("v", T0 + timedelta(hours=1), 1), ("v", T0 + timedelta(hours=9), 2)], "k string, t timestamp, lid int")
    got = {x.lid: x.label for x in O.nearest(q, r, ["k"], "t", "rt", "rid", ["label"], 3600).collect()}
    assert got == {1: "early", 2: None}


def games(spark, n=200, seed=11):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        h, a = rng.sample(range(5), 2)
        rows.append((f"g{i:04d}", T0 + timedelta(days=rng.randrange(40)), "L", h, a, rng.randrange(6), rng.randrange(6), i, i, i))
    return rows, spark.createDataFrame(rows, "game_id string, ts timestamp, league string, home int, away int, home_score int, away_score int, k1 int, k2 int, k3 int")


def test_form_is_frozen_at_equal_timestamps_and_ignores_the_future(spark):
    rows, g = games(spark)
    cut = T0 + timedelta(days=25)
    key = lambda r: (r.entity, r.ts)
    full = {key(r): r for r in T.rolling_form(T.to_entity_rows(g), (3, 10)).collect()}
    part = {key(r): r for r in T.rolling_form(T.to_entity_rows(g.filter(F.col("ts") <= cut).repartition(7)), (3, 10)).collect()}
    assert all(full[k] == v for k, v in part.items())
    for (entity, ts), r in full.items():
        past = sorted((x for x in rows if entity in (x[3], x[4]) and x[1] < ts), key=lambda x: (x[1], x[0]))[-3:]
        gf = [x[5] if x[3] == entity else x[6] for x in past]
        assert abs(r.gf_3 - (sum(gf) / len(gf) if gf else 0.0)) < 1e-12


def test_unknown_stage_is_an_error(spark):
    import pytest

    with pytest.raises(KeyError):
        T.apply_stages(games(spark, 3)[1], ["nope"])


def test_repeated_rows_move_once_in_range_counts(spark, monkeypatch):
    """Equal facts and equal asks are one row before the time axis is numbered."""
    rng = random.Random(5)
    kinds = [("k", T0 + timedelta(days=rng.randrange(5)), rng.randrange(4) / 4, rng.randrange(3)) for _ in range(2000)]
    probs = {0: (0.5, 0.25, 0.25), 1: (0.25, 0.5, 0.25), 2: (0.25, 0.25, 0.5), 3: (0.5, 0.5, 0.0)}
    rows = [(k, t, str(i), *probs[int(v * 4)], y) for i, (k, t, v, y) in enumerate(kinds)]
    df = spark.createDataFrame(rows, "league string, ts timestamp, game_id string, a double, b double, c double, y int")
    moved, plain = [], O.row_numbers
    monkeypatch.setattr(O, "row_numbers", lambda d, *a, **k: (moved.append(d.count()), plain(d, *a, **k))[1])
    out = E.walk_forward_conformal(df.withColumn("m", F.expr("ts + INTERVAL 2 DAYS")), ["a", "b", "c"], "y", "game_id", ["league"], "ts", "m")
    got = {r.game_id: r for r in out.collect()}
    series = {r.game_id: r for r in E.predictability_series(df, ["a", "b", "c"], "y", "game_id", ["league"], "ts").collect()}
    assert len(got) == len(series) == len(rows) and len(moved) == 2 and max(moved) < 100
    for _, t, i, *p, _y in rows[:200]:
        past = [1.0 - r[3:6][r[6]] for r in rows if r[1] + timedelta(days=2) <= t]
        assert got[i].calibration_count == len(past)
        for c in range(3):
            want = (1 + sum(s >= 1.0 - p[c] for s in past)) / (len(past) + 1) if len(past) >= 30 else None
            assert got[i][f"pv{c}"] == want
        assert series[i].history_count == sum(r[1] < t and abs(max(r[3:6]) - max(p)) <= 0.1 for r in rows)

"""Histories with revisions, unknown keys, and decays of any speed, against plain loops."""

import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tideline.operators import evaluate as E
from tideline.operators import experience as X
from tideline.operators import joins as J
from tideline.operators import normalize as N
from tideline.operators import quality as Q
from tideline.operators import timeline as T

T0 = datetime(2024, 1, 1)
H = timedelta(hours=1)


def test_history_is_the_latest_matured_revision_of_other_games(spark):
    rng = random.Random(3)
    cases = [(rng.choice(["A", "B", None]), f"g{i % 25}", T0 + rng.randrange(400) * H, rng.randrange(1, 60), rng.randrange(2)) for i in range(100)]
    cases = list({(g, t): (k, g, t, t + d * H, ok) for k, g, t, d, ok in cases}.values())
    history = spark.createDataFrame(cases, "league string, game_id string, pt timestamp, mt timestamp, ok int")
    targets = [(rng.choice(["A", "B", None]), f"g{rng.randrange(30)}", T0 + rng.randrange(500) * H) for _ in range(60)]
    out = J.matured_sums(spark.createDataFrame(targets, "league string, game_id string, at timestamp"), history, ["league"], "at", "pt", "mt", {"n": F.lit(1), "hits": F.col("ok")})
    want = []
    for league, game, at in targets:
        latest = {}
        for k, g, p, m, ok in sorted(cases, key=lambda c: c[2]):
            if m <= at and g != game:
                latest[g] = (k, ok)
        mine = [ok for k, ok in latest.values() if k == league]
        want.append((league, game, at, len(mine), sum(mine)))
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, out.collect()), key=key) == sorted(want, key=key)


def entity_rows(spark, values, column="ga", league="L"):
    rows = [(league, "e", T0 + i * H, f"{i:06d}", None if v is None else float(v), 0.0) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, f"league string, entity string, ts timestamp, game_id string, {column} double, gf double")


@pytest.mark.parametrize("keeps", [(0.99,), (0.4,), (0.99, 0.4, 1.0), (0.0001,)])
def test_decayed_load_at_any_speed(spark, keeps):
    rng = random.Random(1)
    values = [rng.random() for _ in range(2500)]
    out = T.decayed_load(entity_rows(spark, values), F.col("ga"), {f"k{i}": (k, 1.0) for i, k in enumerate(keeps)}).orderBy("ts").collect()
    state = [0.0] * len(keeps)
    for row, x in zip(out, values, strict=True):
        for i, k in enumerate(keeps):
            assert row[f"k{i}"] == pytest.approx(state[i], rel=1e-9, abs=1e-12)
            state[i] = k * state[i] + x


@pytest.mark.parametrize("tau", [3.0, 18.0, 200.0])
def test_decayed_mean_keeps_a_value_behind_many_unknown_ones(spark, tau):
    rng = random.Random(2)
    values = [9.0, *[None] * 5000, *[rng.choice([None, rng.random()]) for _ in range(400)]]
    out = T.exp_weighted(entity_rows(spark, values, "era"), {"era": 4.0}, tau).orderBy("ts").collect()
    num = den = 0.0
    for i, (row, v) in enumerate(zip(out, values, strict=True)):
        if i % 7 == 0 or i > 4990:
            assert row["era_ew"] == pytest.approx(num / den if den else 4.0, rel=1e-9)
        if v is not None:  # renormalised at each known value, so nothing underflows
            gap = math.exp(-(i - last) / tau) if den else 0.0
            num, den, last = num * gap + v, den * gap + 1.0, i
        assert row["n_prior"] == i


@pytest.mark.parametrize("half_life", [5.0, 90.0])
def test_team_strength_of_short_half_lives(spark, half_life):
    rng = random.Random(4)
    rows = [("L", rng.choice("ab"), T0 + timedelta(days=9 * i), f"{i}", float(rng.randrange(8)), float(rng.randrange(8))) for i in range(500)]
    out = T.team_strength(spark.createDataFrame(rows, "league string, entity string, ts timestamp, game_id string, gf double, ga double"), half_life)
    for row in out.collect():
        w = [(r, 0.5 ** ((row["ts"] - r[2]).total_seconds() / 86400 / half_life)) for r in rows if r[2] < row["ts"]]
        mean = max(0.1, sum(r[4] * x for r, x in w) / sum(x for _, x in w)) if w else 4.0
        mine = [(r, x) for r, x in w if r[1] == row["entity"]]
        n = sum(x for _, x in mine)
        assert row["offense"] == pytest.approx(min(1.55, max(0.6, (sum(r[4] * x for r, x in mine) + 24 * mean) / (n + 24) / mean)), rel=1e-9)


def test_unknown_keys_stay(spark):
    rows = entity_rows(spark, [1, 2, 3], league=None).withColumn("side", F.lit("H"))
    assert T.venue_form(rows).count() == 3
    state = T.rolling_form(rows, (10,))
    games = rows.select("league", F.col("entity").alias("home"), F.lit("z").alias("away"), "ts")
    assert T.match_features(games, state, ["gf_10"]).filter("h_gf_10 is not null").count() == 3


def test_no_case_calibrates_on_its_own_outcome(spark):
    rows = [("A", str(i), T0, T0, 0.5, 0.3, 0.2, 0) for i in range(40)]
    df = spark.createDataFrame(rows, "league string, q string, p timestamp, m timestamp, a double, b double, c double, y int")
    out = E.walk_forward_conformal(df, ["a", "b", "c"], "y", "q", ["league"], "p", "m", minimum=1)
    assert out.filter("calibration_count > 0").count() == 0


def test_rules_of_the_small_tables(spark):
    df = spark.createDataFrame([(1.0, 5.0), (float("inf"), 5.0), (2.0, float("nan")), (3.0, None)], "a double, b double")
    got = {r["feature"]: r["reliability"] for r in Q.feature_reliability(df, ["a", "b"]).collect()}
    assert got["a"] == pytest.approx(0.45 + 0.35 * 0.75 + 0.20 * 0.65) and got["b"] == pytest.approx(0.45 * 0.5 + 0.35 + 0.20 * 0.65)
    one = spark.range(1).select(*[c.alias(n) for n, c in N.strategy_labels(F.lit("A:b:c"), F.lit("final"), F.lit("league")).items()]).first()
    assert tuple(one) == ("competition_shrunk_ensemble", "competition_temperature", 60)
    found = N.classify_competition(spark.createDataFrame([("NPB", "?"), ("MLB", "?"), ("X", "?")], "lg string, kind string"), F.col("lg"), F.col("kind"))
    assert [(r["competition"], r["competition_key"]) for r in found.collect()] == [("npb_unknown", "NPB:npb_unknown:unknown"), ("mlb_unknown", "MLB:mlb_unknown:unknown"), ("unknown", "X:unknown")]
    assert "h_venue_pts" not in N.variant_columns(["home_adv", "h_venue_pts", "h_gf_3"], "TEAM_CORE_SHORT_HORIZON")


def test_policy_replay_asks_once_for_cases_of_the_same_time_and_strata(spark, monkeypatch):
    """Revised games count by their latest matured revision and never for themselves; equal questions are put once."""
    rng = random.Random(8)
    shown = [(0.5, 0.3, 0.2), (0.2, 0.3, 0.5)]
    cases = [(f"{i}", f"g{i if i % 3 else i // 9}", T0 + timedelta(days=rng.randrange(6)), *shown[i % 2], rng.randrange(3), "AB"[rng.randrange(2)]) for i in range(400)]
    cases = list({(c[1], c[2]): c for c in cases}.values())
    df = spark.createDataFrame(cases, "q string, game_id string, prediction_time timestamp, a double, b double, c double, y int, k string").withColumns({
        "available_at": F.expr("prediction_time + INTERVAL 2 DAYS"),
        "strata": F.expr("array(named_struct('scope', 'global', 'key', 'GLOBAL', 'spec', 1), named_struct('scope', 'target', 'key', k, 'spec', 2), null)")})
    asked, plain = [], J.matured_sums
    monkeypatch.setattr(J, "matured_sums", lambda t, *a, **kw: (asked.append(t.count()), plain(t, *a, **kw))[1])
    got = {r["q"]: r for r in X.policy_replay(df, "q", ["a", "b", "c"], "y").collect()}
    assert len(got) == len(cases) and asked == [24]
    sources = set()
    for q, g, t, *p, y, k in cases:
        latest = {}
        for c in sorted(cases, key=lambda c: c[2]):
            if c[2] + timedelta(days=2) <= t and c[1] != g:
                latest[c[1]] = c
        rows = {"target:" + k: [c for c in latest.values() if c[7] == k], "global:GLOBAL": list(latest.values())}
        best = next((s for s in rows if len(rows[s]) >= 30), None)
        assert got[q]["policy_source"] == best
        sources.add(best)
        raw = p
        if best:
            share = [sum(c[6] == i for c in latest.values()) / len(latest) for i in range(3)]
            n, raw = len(rows[best]), []
            for i in range(3):
                d = (sum(c[6] == i for c in rows[best]) + 50 * share[i]) / (n + 50) - sum(c[3 + i] for c in rows[best]) / n
                ratio = min(2.0, max(0.5, min(1.0, max(1e-6, p[i] + d)) / p[i]))
                raw.append(p[i] * math.exp(0.5 * min(0.35, max(-0.35, math.log(ratio)))))
        assert [got[q][f"learned_{n}"] for n in "abc"] == pytest.approx([x / sum(raw) for x in raw], rel=1e-9)
    assert None in sources and len(sources) > 1


def test_policy_strata_tell_apart_only_games_of_several_rows(spark, monkeypatch):
    named = lambda *ks: "array(" + ", ".join(f"named_struct('scope', 's', 'key', {k}, 'spec', 1)" if k else "null" for k in ks) + ")"
    rows = [(g, i % 3, "ab"[i % 2]) for i, g in enumerate(["g1", "g2", "g2", "g3", "g3", "g3", None, None, "g4", "g5"])]
    df = spark.createDataFrame(rows, "game_id string, y int, k string").withColumns({"a": F.lit(0.5), "b": F.lit(0.25), "c": F.lit(0.25), "strata": F.expr(named("'all'", "k", "k", None))})
    told, plain = [], X.by_stratum
    monkeypatch.setattr(X, "by_stratum", lambda d, *c: (told.append(d.count()), plain(d, *c))[1])
    got = {r["key"]: (r["rows"], r["games"], r["pred0"], r["actual1"]) for r in X.policy_strata(df, ["a", "b", "c"], "y").collect()}
    want = {}
    for key in ("all", "a", "b"):
        mine = [r for r in rows for _ in range(1 if key == "all" else 2) if key in ("all", r[2])]
        want[key] = (len(mine), len({r[0] for r in mine if r[0]}), 0.5 * len(mine), float(sum(r[1] == 1 for r in mine)))
    assert got == want and told == [7]

"""Single operators on inline fixtures: results, fail-closed rules, brute-force comparisons."""

import math
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.functions import poisson as S
from tideline.operators import evaluate as E
from tideline.operators import experience as X
from tideline.operators import joins as J
from tideline.operators import learners as L
from tideline.operators import neighbours as N
from tideline.operators import normalize as Z
from tideline.operators import pit as P
from tideline.operators import playlog as B
from tideline.operators import prob as D
from tideline.operators import ratings as R
from tideline.session import scratch_path
from tideline.sources import layers as Y
from tideline.streaming import feeds as W

T0 = datetime(2024, 3, 1)
H = timedelta(hours=1)
LEDGER = "event_id long, league string, entity_type string, entity_id long, source string, source_timestamp timestamp, retrieved_at timestamp, available_at timestamp, payload_hash string, status string"


def ledger(spark, rows):
    return spark.createDataFrame([(i, "L", "t", 1, "s", None, T0 + r * H, None if a is None else T0 + a * H, h, st) for i, (r, a, h, st) in enumerate(rows)], LEDGER)


def test_replay_excludes_late_unknown_and_unavailable(spark):
    led = ledger(spark, [(1, 0, "a", "KNOWN"), (5, 2, "b", "KNOWN"), (1, None, "c", "UNVERIFIABLE"), (1, 1, "d", "UNAVAILABLE"), (2, 9, "e", "KNOWN")])
    at = F.lit(T0 + 4 * H)
    assert [r.event_id for r in P.pit_replay(led, at).collect()] == [0]
    assert {r.event_id for r in P.pit_replay(led, at, include_unverifiable=True).collect()} == {0, 2}
    assert P.latest_known(led, F.lit(T0 + 6 * H)).first().event_id == 1


def test_missing_hash_breaks_the_revision_chain(spark):
    led = ledger(spark, [(1, 1, "a", "KNOWN"), (2, 2, None, "KNOWN"), (3, 3, "b", "KNOWN"), (4, 2, "c", "KNOWN")])
    assert sorted((r.event_id, r.kind) for r in P.detect_revisions(led).collect()) == [(3, "BACKFILL"), (3, "REVISION")]


def test_revision_stream_over_batches_equals_batch(spark):
    rng = random.Random(2)
    rows = [(i, "L", "t", rng.randrange(3), "s", None, T0 + i * H, T0 + (i - rng.randrange(4)) * H, rng.choice("abc"), "KNOWN") for i in range(60)]
    src, out, cp = (scratch_path(spark, n) for n in ("src", "out", "cp"))
    for part in (rows[:25], rows[25:40], rows[40:]):
        spark.createDataFrame(part, LEDGER).coalesce(1).write.mode("append").parquet(src)
        W.run_available(W.revision_stream(spark.readStream.schema(LEDGER).parquet(src)), out, cp)
    got = sorted((r.event_id, r.kind) for r in spark.read.parquet(out).collect())
    assert got == sorted((r.event_id, r.kind) for r in P.detect_revisions(spark.createDataFrame(rows, LEDGER)).collect())


def test_unknown_status_fails(spark):
    with pytest.raises(Exception, match="unknown status"):
        P.status_counts(ledger(spark, [(1, 1, "a", "WEIRD")])).collect()


def test_duplicate_key_fails_the_join(spark):
    left, right = spark.createDataFrame([(1,)], "k int"), spark.createDataFrame([(1, 2), (1, 3)], "k int, v int")
    with pytest.raises(Exception, match="duplicate"):
        J.equi_left(left, right, ["k"]).collect()


def test_append_once(spark):
    path = scratch_path(spark, "once")
    a = spark.createDataFrame([(1, "x"), (2, "y")], "id int, content string")
    Y.append_once(a, path, "id", "content")
    Y.append_once(a.unionByName(spark.createDataFrame([(3, "z")], a.schema)), path, "id", "content")
    assert spark.read.parquet(path).count() == 3
    with pytest.raises(Exception, match="conflicting"):
        Y.append_once(spark.createDataFrame([(1, "other")], a.schema), path, "id", "content")


def test_unreadable_probabilities_fail(spark):
    bad = spark.createDataFrame([(0.5, 0.2, 0.2)], "a double, b double, c double")
    with pytest.raises(Exception, match="not normalised"):
        Z.normalize_probability_rows(bad, ["a", "b", "c"]).collect()


def test_elo_equals_the_fold_for_any_segment_size(spark):
    rng = random.Random(4)
    rows = []
    for i in range(240):
        h, a = rng.sample(range(6), 2)
        rows.append(("L", f"g{i:03d}", datetime(2020 + i // 80, 1, 1) + timedelta(days=rng.randrange(90)), h, a, rng.randrange(8), rng.randrange(8)))
    g = spark.createDataFrame(rows, "league string, game_id string, ts timestamp, home int, away int, home_score int, away_score int")
    want, x, year = {}, {}, None
    for _, gid, ts, h, a, hs, as_ in sorted(rows, key=lambda r: (r[2], r[1])):
        if year is not None and ts.year != year:
            x = {k: 1500 + 0.2 * (v - 1500) for k, v in x.items()}
        year = ts.year
        eh, ea = x.get(h, 1500.0), x.get(a, 1500.0)
        want[gid] = (eh, ea)
        p = 1 / (1 + 10 ** (-(eh + 25 - ea) / 400))
        d = 20 * (1 + 0.35 * math.log1p(abs(hs - as_))) * ((hs > as_) + 0.5 * (hs == as_) - p)
        x[h], x[a] = eh + d, ea - d
    for size in (17, 1000):
        for r in R.elo(g, rows_per_segment=size).collect():
            assert np.allclose((r.elo_home, r.elo_away), want[r.game_id], atol=1e-6)


def plays(spark, rows):
    return spark.createDataFrame(rows, "game_id long, play_order long, inning int, half string, state_home long, state_away long")


def test_half_innings_are_islands_and_scores_never_fall(spark):
    ok = plays(spark, [(1, 1, 1, "T", 0, 0), (1, 2, 1, "T", 0, 2), (1, 3, 1, "B", 1, 2), (1, 4, 2, "T", 1, 2)])
    got = [(r.inning, r.half, r.runs, r.score_diff_for) for r in B.half_innings(ok, ["play_order"], F.col("inning")).orderBy("island").collect()]
    assert got == [(1, "T", 2, 0), (1, "B", 1, -2), (2, "T", 0, 1)]
    with pytest.raises(Exception, match="score fell"):
        B.half_innings(plays(spark, [(1, 1, 1, "T", 0, 2), (1, 2, 1, "B", 0, 1)]), ["play_order"], F.col("inning")).collect()


def test_base_mask_reads_blank_and_zero_as_empty(spark):
    df = spark.createDataFrame([("12", "0.0", "nan"), ("false", "x", None)], "a string, b string, c string")
    assert [r[0] for r in df.select(B.base_mask(F.col("a"), F.col("b"), F.col("c"))).collect()] == [1, 2]


def test_score_grid(spark):
    df = spark.createDataFrame([(1.4, 2.2, 0.0), (3.0, 3.0, 0.4)], "h double, a double, c double")
    for r in df.select(S.grid_summary(F.col("h"), F.col("a"), F.col("c")).alias("s")).collect():
        assert abs(r.s.home + r.s.draw + r.s.away - 1) < 1e-12 and abs(r.s.final_home + r.s.final_draw + r.s.final_away - 1) < 1e-12
        assert r.s.final_draw < r.s.draw and list(r.s.probabilities) == sorted(r.s.probabilities, reverse=True)
    h, a = 1.4, 2.2
    pois = lambda m: np.array([math.exp(-m) * m**k / math.factorial(k) for k in range(15)])
    grid = np.outer(pois(h), pois(a))
    got = df.select(S.grid_summary(F.col("h"), F.col("a"), F.col("c")).alias("s")).first().s
    assert abs(got.home - np.tril(grid, -1).sum() / grid.sum()) < 1e-12


def probs(spark, n=240, seed=9):
    rng = np.random.default_rng(seed)
    p = rng.dirichlet([2, 1, 2], n)
    y = [int(rng.choice(3, p=row)) for row in p]
    rows = [(f"g{i:03d}", T0 + timedelta(hours=i // 3), "A" if i % 3 else "B", *map(float, p[i]), y[i]) for i in range(n)]
    return p, np.array(y), rows, spark.createDataFrame(rows, "game_id string, ts timestamp, grp string, p0 double, p1 double, p2 double, y int")


def test_metrics_match_numpy(spark):
    p, y, _, df = probs(spark)
    r = E.classification_metrics(df, ["p0", "p1", "p2"], "y").first()
    conf, hit = p.max(1), p.argmax(1) == y
    ece = sum(abs(conf[b].sum() - hit[b].sum()) for b in [np.minimum((conf * 10).astype(int), 9) == i for i in range(10)]) / len(y)
    assert np.allclose([r.accuracy, r.log_loss, r.brier, r.ece], [hit.mean(), -np.log(p[np.arange(len(y)), y]).mean(), ((p - np.eye(3)[y]) ** 2).sum(1).mean(), ece])


def test_conformal_pvalues_and_small_group_fallback(spark):
    p, y, rows, df = probs(spark)
    cal, test = df.filter("game_id < 'g150'"), df.filter("game_id >= 'g150'")
    got = {r.game_id: r for r in E.conformal_pvalues(cal, test, ["p0", "p1", "p2"], "y", "game_id", "grp", 60).collect()}
    s = 1 - p[np.arange(len(y)), y]
    for i in range(150, len(rows)):
        own = [j for j in range(150) if rows[j][2] == rows[i][2]]
        use = own if len(own) >= 60 else list(range(150))
        r = got[rows[i][0]]
        assert r.fallback == (len(own) < 60)
        assert np.allclose([r.pv0, r.pv1, r.pv2], [(1 + sum(s[j] >= 1 - q for j in use)) / (len(use) + 1) for q in p[i]])


def test_walk_forward_conformal_uses_matured_cases_only(spark):
    p, y, rows, df = probs(spark)
    df = df.withColumn("m", F.expr("ts + INTERVAL 5 HOURS"))
    got = {r.game_id: r for r in E.walk_forward_conformal(df, ["p0", "p1", "p2"], "y", "game_id", [], "ts", "m").collect()}
    s = 1 - p[np.arange(len(y)), y]
    for i in range(0, len(rows), 7):
        use = [j for j in range(len(rows)) if rows[j][1] + 5 * H <= rows[i][1]]
        r = got[rows[i][0]]
        assert r.calibration_count == len(use)
        if len(use) >= 30:
            assert abs(r.pv1 - (1 + sum(s[j] >= 1 - p[i, 1] for j in use)) / (len(use) + 1)) < 1e-12
        else:
            assert r.action == "ABSTAIN"


def test_bootstrap_interval_brackets_the_difference(spark):
    p, y, _, df = probs(spark, 600)
    good, flat = D.nll_cols([F.col(c) for c in ("p0", "p1", "p2")], F.col("y")), D.nll_cols([F.lit(1 / 3)] * 3, F.col("y"))
    r = E.paired_block_bootstrap(df, {"LogLoss": flat}, {"LogLoss": good}, ["ts", "game_id"], replications=200).first()
    mean = df.agg(F.avg(flat - good)).first()[0]
    assert r.ci_low < mean < r.ci_high and r.p_improvement_positive > 0.9
    assert r == E.paired_block_bootstrap(df.repartition(5), {"LogLoss": flat}, {"LogLoss": good}, ["ts", "game_id"], replications=200).first()


def test_blend_weights_and_mixes():
    assert len(D.weight_grid(3, 0.25)) == 15 and all(abs(sum(w) - 1) < 1e-12 for w in D.weight_grid(3, 0.25))
    assert D.mix_weights([2.0, 1.0, 4.0], "TOP1") == [0.0, 1.0, 0.0]
    assert np.allclose(D.mix_weights([2.0, 1.0, 4.0], "TOP2_INVLOSS"), [1 / 3, 2 / 3, 0])
    assert len(Z.VARIANTS) == 33


def test_policy_replay_never_sees_its_own_or_later_outcomes(spark):
    _, _, _, df = probs(spark, 300)
    s = X.strata(F.col("grp"), F.lit("r"), F.lit(None).cast("string"), F.lit("m"), F.array(F.lit("t")))
    cases = df.withColumns({"prediction_time": F.col("ts"), "available_at": F.expr("ts + INTERVAL 6 HOURS"), "strata": s})
    cut = T0 + 60 * H
    flip = cases.withColumn("y", F.when(F.col("ts") >= F.lit(cut), (F.col("y") + 1) % 3).otherwise(F.col("y")))
    a, b = ({r.game_id: r.learned_p0 for r in X.policy_replay(c, "game_id", ["p0", "p1", "p2"], "y").filter(F.col("ts") < F.lit(cut + 6 * H)).collect()} for c in (cases, flip))
    assert a == b and any(r.policy_source for r in X.policy_replay(cases, "game_id", ["p0", "p1", "p2"], "y").collect())


def test_nearest_neighbours_match_brute_force_with_small_chunks(spark):
    rng = np.random.default_rng(6)
    v = np.concatenate([rng.normal(0, 0.05, (120, 3)), rng.normal(3, 1, (60, 3))])
    rows = [(i, list(map(float, x))) for i, x in enumerate(v)]
    h, q = spark.createDataFrame(rows, "hid long, hv array<double>"), spark.createDataFrame(rows, "qid long, qv array<double>")
    old, N.CHUNK = N.CHUNK, 25
    try:
        got = {}
        for r in N.nearest(h, q, 4, pivots=6).collect():
            got.setdefault(r.qid, {})[r["rank"]] = r.hid
    finally:
        N.CHUNK = old
    for i, x in enumerate(v):
        d = np.sqrt(((v - x) ** 2).sum(1))
        d[i] = np.inf
        assert [got[i][k] for k in range(1, 5)] == list(np.argsort(d, kind="stable")[:4])


def test_walk_forward_beats_guessing_and_permuted_targets_do_not(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(800, 2))
    y = (x[:, 0] + 0.5 * rng.normal(size=800) > 0).astype(float)
    rows = [(i, T0 + timedelta(hours=i), float(a), float(b), float(c)) for i, ((a, b), c) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "id int, ts timestamp, a double, b double, y double")
    out = L.walk_forward(df, ["a", "b"], "y", ["ts", "id"], 3, k=2)
    m = E.classification_metrics(out, ["p0", "p1"], "y").first()
    assert m.rows == df.count() - 267 and m.log_loss < 0.6
    audit = {r.run: r.log_loss for r in L.target_permutation_audit(df.filter("id < 500"), df.filter("id >= 500"), ["a", "b"], "y", 2, 1).collect()}
    assert audit["real"] < audit["permuted_0"]


def test_shuffled_is_a_permutation(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(100)], "id int, x double")
    out = L.shuffled(df, "x", 1).collect()
    assert sorted(r.x for r in out) == [float(i) for i in range(100)] and any(r.x != r.id for r in out)


def test_timed_neighbours_leave_out_what_no_query_sees(spark, monkeypatch):
    """Retrieval under RMS with small chunks and parts against all pairs; rows later than every query reach no task."""
    rng = random.Random(3)
    value = lambda: None if rng.random() < 0.2 else float(rng.randrange(6))
    hs = [(1000 + i, [value(), value(), float(i % 5)], i % 60, i % 60 + rng.randrange(4)) for i in range(300)] + [(5000 + i, [0.0, 0.0, 0.0], 900, 900) for i in range(200)]
    qs = [(i, [value(), value(), float(i % 4)], i % 70 if i else None) for i in range(120)]
    h = spark.createDataFrame(hs, "hid long, hv array<double>, ht int, ha int")
    q = spark.createDataFrame(qs, "qid long, qv array<double>, qt int")
    seen, plain = [], N._round
    monkeypatch.setattr(N, "CHUNK", 40)
    monkeypatch.setattr(N, "PART", 50)
    monkeypatch.setattr(N, "_round", lambda asks, rows, *a: (seen.append((asks.count(), rows.count())), plain(asks, rows, *a))[1])
    got = {}
    for r in N.nearest(h, q, 4, metric="rms").collect():
        got.setdefault(r["qid"], {})[r["rank"]] = (round(r["distance"], 9), r["hid"])
    for qid, v, t in qs:
        want = []
        for hid, u, ht, ha in hs:
            both = [(a - b) ** 2 for a, b in zip(v, u, strict=True) if a is not None and b is not None]
            if t is not None and ht < t and ha <= t and both:
                want.append((round((sum(both) / len(both)) ** 0.5, 9), hid))
        assert got.get(qid, {}) == dict(enumerate(sorted(want)[:4], 1))
    asks, rows = seen[0]
    assert rows == 300 and asks < 8 * len(qs)


def test_closest_by_products_equals_all_distances_also_far_from_zero_and_among_ties():
    rng = np.random.default_rng(4)
    for shift, k in ((0.0, 1), (1e3, 7), (1e7, 7)):
        h, q = (np.round(rng.normal(size=(n, 6)), 1) + shift for n in (900, 70))
        h[10:30], own = h[5], rng.random((70, 900)) < 0.02
        d = np.where(own, np.inf, N._distances(q, h, "euclid"))
        order = np.argsort(d, axis=1, kind="stable")[:, :k]
        row, col, exact = N._closest(q, h, k, own)
        assert (col.reshape(70, k) == order).all() and (exact.reshape(70, k) == np.take_along_axis(d, order, 1)).all()
    row, col, exact = N._closest(q, h, 3, np.ones_like(own))
    assert len(row) == 0
    h[3] = np.nan
    row, col, _ = N._closest(q, h, 3, own)
    assert len(row) == 210 and 3 not in col

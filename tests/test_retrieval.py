"""Retrieval-local conformal sets against a plain scan over all earlier cases, and prefixes by the tree of merges."""

import math
import pickle
import random
from datetime import datetime, timedelta, timezone

import numpy as np
import pandas as pd
import pytest
from pyspark.errors import PySparkException

from tideline.operators import retrieval
from tideline.operators.retrieval import retrieval_conformal
from tideline.operators.scan import tree_prefix

START = datetime(2026, 1, 1, tzinfo=timezone.utc)
SCHEMA = "league string, id long, game string, ts timestamp, done timestamp, y int, p0 double, p1 double, p2 double, a double, b double"


def cases(n, seed=1, **change):
    rng, out = random.Random(seed), []
    for i in range(n):
        p = [rng.random() + 0.1 for _ in range(3)]
        p = [x / sum(p) for x in p]
        at = START + timedelta(hours=i // 2 if "ties" in change else i)
        out.append(["L", i, f"g{i // change.get('revisions', 1)}", at, at + timedelta(hours=change.get("lag", 1) * rng.randint(0, 5)), rng.randrange(3), *p, *([0.0, 0.0] if "flat" in change else [float(rng.randrange(5)), rng.gauss(0, 1)])])
    return out


def frame(spark, rows):
    return spark.createDataFrame([tuple(r) for r in rows], SCHEMA).repartition(3)


def got(spark, rows, minimum=10, pool=25, k=12, **kw):
    out = retrieval_conformal(frame(spark, rows), ["p0", "p1", "p2"], "y", ["a", "b"], "game", "id", "ts", "done", ["league"], minimum=minimum, pool=pool, k=k, **kw)
    return {r["case"]: r for r in out.collect()}


def plain(rows, minimum=10, pool=25, k=12):
    out = {}
    for i, r in enumerate(rows):
        latest = {}
        for j, q in enumerate(rows):
            if q[0] == r[0] and q[3] < r[3] and q[4] <= r[3] and q[2] != r[2] and (q[2] not in latest or (q[3], j) > latest[q[2]]):
                latest[q[2]] = (q[3], j)
        held = [rows[j] for _, j in sorted(latest.values())][-pool:]
        if len(held) < minimum:
            out[r[1]] = (len(held), 0, None, None)
            continue
        sd = []
        for c in (9, 10):
            mean = sum(h[c] for h in held) / len(held)
            s = math.sqrt(sum((h[c] - mean) ** 2 for h in held) / len(held))
            sd.append(s if s > 1e-9 else 1.0)
        d = [round(((h[9] - r[9]) / sd[0]) ** 2 + ((h[10] - r[10]) / sd[1]) ** 2, 9) for h in held]
        near = sorted(range(len(held)), key=lambda x: (d[x], x))[:k]
        scores = [1 - held[x][6 + held[x][5]] for x in near]
        pv = [(1 + sum(s >= 1 - r[6 + c] - 1e-12 for s in scores)) / (len(near) + 1) for c in range(3)]
        out[r[1]] = (len(held), len(near), math.sqrt(d[near[0]]), pv)
    return out


@pytest.mark.parametrize("change", [{}, {"ties": 1}, {"revisions": 3}, {"flat": 1}, {"lag": 9, "revisions": 2}])
def test_sets_are_those_of_a_plain_scan(spark, change):
    rows = cases(110, **change)
    other = [["M", 1000 + r[1], *r[2:]] for r in cases(30, 5)]  # another league shares games and times
    found, want = got(spark, rows + other, chunk=17, fan=2), plain(rows + other)
    assert found.keys() == want.keys()
    for case, (held, n, near, pv) in want.items():
        r = found[case]
        assert (r["pool_count"], r["calibration_count"]) == (held, n)
        assert (r["nearest_distance"] is None) == (near is None)
        if pv:
            assert r["nearest_distance"] == pytest.approx(near, abs=1e-4) and [r[f"pv{c}"] for c in range(3)] == pytest.approx(pv)
            assert r["set"] == ",".join(str(c) for c in range(3) if pv[c] > 0.1)
        else:
            assert r["action"] == "ABSTAIN" and r["set"] == ""


def test_short_history_abstains_and_chunks_do_not_matter(spark):
    rows = cases(60)
    a, b = got(spark, rows, chunk=7, fan=2), got(spark, rows, chunk=10_000)
    assert a == b and a[0]["action"] == "ABSTAIN" and max(r["pool_count"] for r in a.values()) == 25


def test_what_fails_closed(spark):
    for column, value in ((4, START - timedelta(days=9)), (9, float("nan")), (10, None), (2, " "), (2, None)):
        rows = cases(12)
        rows[5][column] = value
        with pytest.raises(PySparkException):
            got(spark, rows)
    for wrong in ({"minimum": 1}, {"pool": 5}, {"k": 30}, {"alpha": 1.0}):
        with pytest.raises(ValueError):
            got(spark, cases(5), **wrong)
    assert got(spark, []) == {}


def test_prefixes_of_a_tree_keep_order_and_stay_small(spark):
    rows = [(k, s, pickle.dumps([f"{k}{s};"])) for k, n in (("a", 100), ("b", 1), ("c", 7)) for s in range(n) if s % 5 != 3]
    states = spark.createDataFrame(rows, "k string, seg bigint, state binary").repartition(4)

    def merge(a, b):
        return pickle.dumps(pickle.loads(a) + pickle.loads(b))

    for fan in (2, 3, 16):
        out = tree_prefix(states, ["k"], merge, fan=fan).collect()
        assert len(out) == len(rows)
        for r in out:
            before = [f"{k}{s};" for k, s, _ in rows if k == r["k"] and s < r["seg"]]
            assert (pickle.loads(r["before"]) if r["before"] is not None else []) == before


@pytest.mark.parametrize("seed", [1, 2])
def test_many_cases_of_a_pool_are_measured_like_one(spark, seed, monkeypatch):
    """Cases that share a pool are measured together, with ties at the k-th distance, and no pool is scaled once a case."""
    rng = random.Random(seed)
    pool = [(i, i, f"g{i}", rng.random(), (float(rng.randrange(3)), rng.choice([1.0, rng.gauss(0, 1)]))) for i in range(60)]
    p, x = np.array([[rng.random() for _ in range(3)] for _ in range(700)]), np.array([[float(rng.randrange(3)), rng.gauss(0, 1)] for _ in range(700)])
    n, near, pv = retrieval.conformal_of_many(pool, p, x, 25)
    for i in range(700):
        assert (n, near[i], pv[i].tolist()) == retrieval.conformal_of(pool, p[i], x[i], 25)
    calls, inner = [], retrieval.conformal_of_many
    monkeypatch.setattr(retrieval, "conformal_of_many", lambda *a: calls.append(1) or inner(*a))
    day = [["L", i, f"g{i}", START + timedelta(days=i // 50), START + timedelta(days=i // 50 + 1), i % 3, 0.3, 0.3, 0.4, float(i % 7), 0.5] for i in range(200)]
    frame = [pd.DataFrame({"pt": [(r[3] - START).days], "case": r[1], "game": r[2], "score": 0.5, "is_fact": f, "p": [r[6:9]], "features": [r[9:11]], "t": (r[4] if f else r[3]), "s": not f}) for r in day for f in (True, False)]
    rows = pd.concat(frame).sort_values(["t", "s", "case"]).assign(rn=lambda d: range(len(d)))
    out = retrieval._walk(["league"], 25, 12, 10, 3)(rows, pd.DataFrame({"before": []}))
    assert len(out) == 200 and len(calls) == 3 and out["pool_count"].tolist() == [0] * 50 + [25] * 150

"""Ratings by a tree of affine maps against the plain fold, for many entities and deep trees."""

import math
import random
from datetime import datetime, timedelta

import numpy as np

from tideline.operators import ratings as R


def fold(rows, k=20, adv=25, margin=0.35, keep=0.2):
    x, year, out = {}, None, {}
    for _, gid, ts, h, a, hs, as_ in sorted(rows, key=lambda r: (r[2], r[1])):
        if year is not None and ts.year != year:
            x = {n: 1500 + keep * (v - 1500) for n, v in x.items()}
        year = ts.year
        eh, ea = x.get(h, 1500.0), x.get(a, 1500.0)
        p = 1 / (1 + 10 ** (-(eh + adv - ea) / 400))
        out[gid] = (eh, ea, p)
        d = k * (1 + margin * math.log1p(abs(hs - as_))) * ((hs > as_) + 0.5 * (hs == as_) - p)
        x[h], x[a] = eh + d, ea - d
    return out


def test_a_thousand_entities_and_a_deep_tree(spark):
    rng, rows = random.Random(11), []
    for i in range(2400):
        h, a = rng.sample(range(1000), 2)
        rows.append(("L", f"g{i:05d}", datetime(2020 + i // 900, 1, 1) + timedelta(days=rng.randrange(200)), f"e{h}", f"e{a}", rng.randrange(8), rng.randrange(8)))
    rows += [("M", f"h{i:05d}", datetime(2021, 1, 1) + timedelta(hours=i), f"e{i % 3}", f"e{(i + 1) % 3}", rng.randrange(4), rng.randrange(4)) for i in range(5)]
    games = spark.createDataFrame(rows, "league string, game_id string, ts timestamp, home string, away string, home_score int, away_score int").repartition(3)
    want = fold([r for r in rows if r[0] == "L"]) | fold([r for r in rows if r[0] == "M"])
    found = R.elo(games, rows_per_segment=200, fan=2).collect()
    assert len(found) == len(rows)
    for r in found:
        assert np.allclose((r.elo_home, r.elo_away, r.expected_home), want[r.game_id], atol=1e-6)
    assert R.elo(games.where("false")).count() == 0


def test_maps_compose_like_folds():
    rng = np.random.default_rng(2)
    draw = lambda names: R._affine(names, 1500 + rng.normal(0, 9, len(names)), 1500 + rng.normal(0, 9, len(names)), np.eye(len(names)) + rng.normal(0, 0.1, (len(names),) * 2), rng.uniform(0.5, 1))
    a, b, c = draw(["x", "y"]), draw(["y", "z"]), draw(["w"])
    step = lambda carry, *states: step(R._advance(carry, states[0]), *states[1:]) if states else R.pickle.loads(carry)
    one = step(None, a, b, c)
    for whole in (R._compose(R._compose(a, b), c), R._compose(a, R._compose(b, c))):
        two = step(None, whole)
        assert one.keys() == two.keys() and all(abs(one[n] - two[n]) < 1e-9 for n in one)

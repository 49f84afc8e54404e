"""Facts that no pool can hold stay where they are, cases move once."""

import random
from datetime import timedelta

import pytest
from test_retrieval import START, got, plain

from tideline.operators import retrieval


def days(seed, revisions):
    """Sixty cases a day that mature together, of games that may come again on the day and later."""
    rng, out = random.Random(seed), []
    for i in range(240):
        p = [rng.random() + 0.1 for _ in range(3)]
        game = f"g{rng.randrange(240 // revisions)}" if revisions > 1 else f"g{i}"
        at = START + timedelta(days=i // 60)
        out.append(["L", i, game, at, at + timedelta(days=rng.choice([1, 1, 1, 2])), rng.randrange(3), *[x / sum(p) for x in p], float(rng.randrange(5)), rng.gauss(0, 1)])
    return out


@pytest.mark.parametrize("revisions", [1, 4, 24])
def test_crowded_instants_are_cut_to_what_pools_can_hold(spark, monkeypatch, revisions):
    rows, sizes, plainly = days(revisions, revisions), {}, retrieval.stored
    rows += [["M", 1000 + r[1], *r[2:]] for r in days(7, revisions)[:70]]

    def counted(df, label):
        out = plainly(df, label)
        sizes[label] = out.count()
        return out

    monkeypatch.setattr(retrieval, "stored", counted)
    found, want = got(spark, rows, minimum=5, pool=9, k=6, chunk=17, fan=2), plain(rows, minimum=5, pool=9, k=6)
    assert found.keys() == want.keys()
    for case, (held, n, near, pv) in want.items():
        r = found[case]
        assert (r["pool_count"], r["calibration_count"]) == (held, n)
        if pv:
            assert r["nearest_distance"] == pytest.approx(near, abs=1e-4) and [r[f"pv{c}"] for c in range(3)] == pytest.approx(pv)
    instants = len({(r[0], r[4]) for r in rows})
    assert sum(sizes.values()) - sizes["pools"] - sizes["axis"] - sizes["instants"] <= 2 * 10 * instants + 240 // revisions * (revisions > 1) + instants


def test_an_outcome_of_unknown_time_never_matures(spark):
    rows = days(3, 1)[:120]
    for r in rows[:60:2]:
        r[4] = None
    known = [r for r in rows if r[4] is not None]
    found = got(spark, rows, minimum=5, pool=9, k=6)
    want = plain([r if r[4] is not None else [*r[:4], START + timedelta(days=99), *r[5:]] for r in rows], minimum=5, pool=9, k=6)
    assert len(known) < len(rows) == len(found) and all(found[c]["pool_count"] == w[0] for c, w in want.items())

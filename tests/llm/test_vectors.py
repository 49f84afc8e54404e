"""Cap filters against all pairs."""

import numpy as np
import pytest

from tideline.llm import embedding_caps

SCHEMA = "vec_id long, embedding array<float>, label int, node string, n long"


def rows():
    rng = np.random.default_rng(2)
    out = []
    for label in (1, 2):
        centres = rng.standard_normal((40, 64))
        x = np.concatenate([centres, centres[:20] + 0.2 * rng.standard_normal((20, 64)), centres[0] + 0.15 * rng.standard_normal((60, 64)), np.repeat(centres[5:6], 9, axis=0)])
        out += [(len(out) + i, v.astype(np.float32).tolist(), label, "x", 1) for i, v in enumerate(x)]
    some = out[0][1]
    odd = [None, [], [0.0] * 64, [float("nan")] * 64, [float("inf")] + some[1:], [None, *some[1:]], some[:8], [1e30 * v for v in some]]
    out += [(1000 + i, v, 1, None, None) for i, v in enumerate(odd)]
    return [*out, (2000, some, None, None, None), (None, some, 1, None, None), out[3], out[3], (None, None, None, None, None)]


@pytest.mark.parametrize("cell", [embedding_caps.CELL, 16])
def test_links_and_components_match_all_pairs(spark, monkeypatch, cell):
    monkeypatch.setattr(embedding_caps, "CELL", cell)
    given = rows()
    got = embedding_caps.near_vectors(spark.createDataFrame(given, SCHEMA).repartition(3)).collect()
    fit = lambda r: r[1] and r[2] is not None and None not in r[1] and np.isfinite(r[1]).all() and np.any(r[1])
    unit = [np.array(r[1], np.float64) / np.abs(r[1]).max() if fit(r) else None for r in given]
    unit = [None if u is None else u / np.linalg.norm(u) for u in unit]
    near = np.zeros((len(given), len(given)), bool)
    for i, a in enumerate(unit):
        for j, b in enumerate(unit):
            near[i, j] = i != j and a is not None and b is not None and len(a) == len(b) and given[i][2] == given[j][2] and a @ b >= embedding_caps.COSINE
    reach = near | np.eye(len(given), dtype=bool)
    for _ in range(8):
        reach = reach @ reach
    want = []
    for i, r in enumerate(given):
        ids = [given[j][0] for j in np.nonzero(reach[i])[0] if given[j][0] is not None]
        smallest = min(ids, default=None)
        want.append((r[0], int(near[i].sum()), smallest, r[0] == smallest))
    order = lambda x: sorted(x, key=lambda r: tuple((v is None, v or 0) for v in r))
    assert order([tuple(r) for r in got]) == order(want)


def test_filters_are_those_that_exceed():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((50, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    codes = embedding_caps.codes_for(16)
    row, number = embedding_caps.exceeded(x, codes, 1.5)
    want = set()
    for c, blocks in enumerate(codes):
        for k in np.ndindex(*[len(w) for _, w in blocks]):
            direction, name = np.zeros(16), c
            for (part, words), i in zip(blocks, k, strict=True):
                direction[part] = words[i]
                name = name * embedding_caps.WORDS + i
            want |= {(int(r), name) for r in np.nonzero(x @ direction >= 1.5 / 4)[0]}
    assert set(zip(row.tolist(), number.tolist(), strict=True)) == want


def test_empty_table(spark):
    assert embedding_caps.near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0

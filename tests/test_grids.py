"""Expected games of each score: equal intensities are one grid."""

import types

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tideline.functions import poisson as S
from tideline.plans import q_prob


@pytest.mark.parametrize("shared", [0.0, 0.3])
def test_equal_intensities_are_one_grid(spark, monkeypatch, shared):
    rows = [("A", 0.5 + i % 3, 1.1) for i in range(300)] + [("B", 0.5, 1.1)] * 50 + [("B", 0.2, 7.0)]
    computed = spark.sparkContext.accumulator(0)

    def kernel(lam_h: pd.Series, lam_a: pd.Series, c: pd.Series) -> pd.Series:
        computed.add(len(lam_h))
        return S._cells_kernel(lam_h, lam_a, c)

    monkeypatch.setattr(S, "grid_cells", lambda h, a, c: F.pandas_udf(kernel, "array<double>")(h, a, c))
    frame = spark.createDataFrame(rows, "league string, lam_h double, lam_a double")
    got = {(r["league"], r["home_runs"], r["away_runs"]): r["expected_games"] for r in q_prob._expected_cells(types.SimpleNamespace(probs=frame), shared).collect()}
    assert computed.value == 5 and len(got) == 2 * 15 * 15
    for league in "AB":
        some = [r for r in rows if r[0] == league]
        h, a = (np.array([r[k] for r in some]) for k in (1, 2))
        want = S._joint(h, a, np.full(len(h), shared)).sum(axis=0)
        assert all(got[league, i, j] == pytest.approx(want[i, j], abs=1e-6) for i in range(15) for j in range(15))

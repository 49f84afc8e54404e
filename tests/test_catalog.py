"""The driver contract on the smallest tables."""

import os

import pytest

import __spark_entry__ as contract

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="driver tables not present")


def test_entry_has_rows_and_a_stable_schema(spark):
    a, b = contract.entry(spark), contract.entry(spark)
    assert a.schema == b.schema and a.limit(1).count() == 1


def test_every_oracle_belongs_to_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", ["j8_latest_known", "w4_venue_form", "a13_transition_counts", "e1_classification_metrics", "q1_data_quality"])
def test_query_agrees_with_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    from tideline.plans.views import TABLES

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    cur = con.execute(contract.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    df = contract.queries()[name](spark, DIR).select(*cols)
    order = lambda rows: sorted([tuple(r) for r in rows], key=lambda r: tuple((x is None, str(x)) for x in r))
    assert order(df.collect()) == order(cur.fetchall())

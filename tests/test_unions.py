"""Windows over unions whose inputs are dealt alike, in a session somebody else built."""

import __spark_entry__ as entry
import duckdb
import pytest

from tideline.session import UNION_PARTITIONING

SF = "/root/testdata/sf0.01"
CONF = {UNION_PARTITIONING: "true", "spark.sql.shuffle.partitions": "48", "spark.sql.autoBroadcastJoinThreshold": "-1"}


@pytest.mark.parametrize("name", ["a14_kernel_probability", "a15_shrunk_run_rates", "a29_half_rate"])
def test_keys_stay_whole_behind_a_union(spark, name):
    before = {k: spark.conf.get(k) for k in CONF}
    for k, v in CONF.items():
        spark.conf.set(k, v)
    try:
        df = entry.queries()[name](spark, SF)
        got = sorted(map(str, (tuple(r) for r in df.collect())))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{SF}/lineitem.parquet'")
    columns = ", ".join(f'"{c}"' for c in df.columns)
    assert got == sorted(map(str, con.execute(f"SELECT {columns} FROM ({entry.oracle_sql()[name]})").fetchall()))

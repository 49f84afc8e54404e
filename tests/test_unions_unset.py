"""Windows over unions in a session whose builder never named the setting that keeps their shuffles."""

import __spark_entry__ as entry
import duckdb
import pytest

from tideline.session import UNION_PARTITIONING, configure

SF = "/root/testdata/sf0.01"


@pytest.fixture
def plain(spark):
    own = spark.newSession()
    for k, v in {"spark.sql.shuffle.partitions": "48", "spark.sql.autoBroadcastJoinThreshold": "-1"}.items():
        own.conf.set(k, v)
    own.conf.unset(UNION_PARTITIONING)
    assert own.conf.get(UNION_PARTITIONING) == "true"
    return own


def test_an_unset_key_is_set(plain):
    assert configure(plain).conf.get(UNION_PARTITIONING) == "false"


@pytest.mark.parametrize("name", ["a14_kernel_probability", "a15_shrunk_run_rates", "a29_half_rate"])
def test_keys_stay_whole_where_nobody_set_the_key(plain, name):
    df = entry.queries()[name](plain, SF)
    got = sorted(map(str, (tuple(r) for r in df.collect())))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{SF}/lineitem.parquet'")
    columns = ", ".join(f'"{c}"' for c in df.columns)
    assert got == sorted(map(str, con.execute(f"SELECT {columns} FROM ({entry.oracle_sql()[name]})").fetchall()))

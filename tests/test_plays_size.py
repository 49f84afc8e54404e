"""What the view of plays and the aggregates over it move."""

import datetime

from tideline.operators import playlog
from tideline.plans import views

NAMES = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_tax double, l_discount double, l_returnflag string, l_linestatus string, l_shipdate timestamp"


def plays(spark, monkeypatch, orders):
    day = datetime.datetime(2020, 1, 1)
    rows = [(o, n, n % 11, n % 13, float(n % 7), 100.0 + n, 0.0, 0.0, "A", "F", day) for o, lines in orders for n in range(lines, 0, -1)]
    v = views.Views(spark, "")
    monkeypatch.setattr(v, "table", lambda name: spark.createDataFrame(rows, NAMES).repartition(4), raising=False)
    return v._derive_plays()


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_short_orders_move_once_and_totals_hold_for_long_ones(spark, monkeypatch):
    short = [(o, o % 8) for o in range(1, 40)]
    assert physical(plays(spark, monkeypatch, short)).count("Exchange hashpartitioning") == 1
    for p in (plays(spark, monkeypatch, short), plays(spark, monkeypatch, [*short, (50, 9001), (60, 4097)])):
        got = {}
        for r in p.collect():
            got.setdefault(r["game_id"], []).append(r)
        for game, rows in got.items():
            assert sorted(r["play_order"] for r in rows) == list(range(1, len(rows) + 1))
            for half, column, extra in (("B", "home_total", int(game % 10 == 0)), ("T", "away_total", 0)):
                assert {r[column] for r in rows} == {sum(r["added_runs"] for r in rows if r["half"] == half) + extra}
    assert sum(len(rows) for rows in got.values()) == sum(n for _, n in short) + 9001 + 4097


def test_plain_aggregates_of_games_are_not_sorted(spark, monkeypatch):
    p = plays(spark, monkeypatch, [(1, 5), (2, 3)])
    assert "SortAggregate" not in physical(playlog.aggregate_games(p, ["play_order"]))
    assert "SortAggregate" not in physical(playlog.state_scores(p, ["play_order"], p["inning"]))

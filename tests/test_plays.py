"""Lines of one order are numbered by stretches of line numbers."""

import datetime

from tideline.operators import ordered
from tideline.plans import views


def test_play_order_of_short_and_very_long_orders_and_few_offsets(spark, monkeypatch):
    day, rows = datetime.datetime(2020, 1, 1), []
    for order, lines in ((1, 5), (2, 9001), (3, 1)):
        rows += [(order, n, n % 11, n % 13, float(n % 7), 100.0 + n, 0.0, 0.0, "A", "F", day) for n in range(lines, 0, -1)]
    names = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_tax double, l_discount double, l_returnflag string, l_linestatus string, l_shipdate timestamp"
    frame, segments = spark.createDataFrame(rows, names).repartition(4), []

    def numbered(df, keys, order, seg, out):
        segments.append(df.select(*keys, seg.alias("s")).distinct().count())
        return ordered.row_numbers(df, keys, order, seg=seg, out=out)

    monkeypatch.setattr(views, "row_numbers", numbered)
    v = views.Views(spark, "")
    monkeypatch.setattr(v, "table", lambda name: frame, raising=False)
    got = {(r["game_id"], r["value"]): r["play_order"] for r in v._derive_plays().select("game_id", "value", "play_order").collect()}
    assert got == {(r[0], r[5]): r[1] for r in rows} and segments == [5]  # one segment an order, three for the long one

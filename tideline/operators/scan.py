"""Exclusive prefixes of mergeable states along segments, by a tree.

A state stands for what a segment adds (a bounded pool, an affine map). Neighbouring states are merged level by level, ``fan`` of
them in a task, until one task holds what is left of a key; on the way down each group of ``fan`` receives what lies before it
and passes it along its members.  A task never sees more than ``fan`` states and one carry, however many segments a key has.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

Merge = Callable[[bytes, bytes], bytes]
Advance = Callable[["bytes | None", bytes], bytes]


def _up(keys: Sequence[str], merge: Merge) -> Callable:
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("seg")
        total = None
        for state in group["state"]:
            total = state if total is None else merge(total, state)
        first = group.iloc[:1]
        return first.assign(seg=first["_parent"], state=[total])[[*keys, "seg", "state"]]
    return run


def _down(keys: Sequence[str], advance: Advance) -> Callable:
    def run(group: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("seg")
        carry, out = (above["before"].iloc[0] if len(above) else None), []
        for state in group["state"]:
            out.append(carry)
            carry = advance(carry, state)
        return group.assign(before=out)[[*keys, "seg", "before"]]
    return run


def tree_prefix(states: DataFrame, keys: Sequence[str], merge: Merge, advance: Advance | None = None, fan: int = 16) -> DataFrame:
    """``(keys, seg, before)`` from ``states(keys, seg, state)``: all states of smaller ``seg``, NULL for the first.

    ``seg`` counts from 0 (gaps are allowed).  ``merge`` joins two neighbouring states; ``advance`` takes a carry (NULL at the
    start) past a state and may keep less than a state does.  ``states`` should be cheap to read again."""
    kinds = dict(states.dtypes)
    head = "".join(f"{k} {kinds[k]}, " for k in keys) + "seg bigint, "
    last = states.agg(F.max("seg")).first()[0]
    levels = [states.select(*keys, F.col("seg").cast("bigint").alias("seg"), "state")]
    while last is not None and last >= fan:
        parent = levels[-1].withColumn("_parent", F.floor(F.col("seg") / fan))
        levels.append(parent.groupBy(*keys, "_parent").applyInPandas(_up(keys, merge), f"{head}state binary"))
        last //= fan
    before = states.sparkSession.createDataFrame([], f"{head}before binary")
    for level in reversed(levels):
        grouped = level.withColumn("_parent", F.floor(F.col("seg") / fan)).groupBy(*keys, "_parent")
        above = before.withColumnRenamed("seg", "_parent").groupBy(*keys, "_parent")
        before = grouped.cogroup(above).applyInPandas(_down(keys, advance or _first_or(merge)), f"{head}before binary")
    return before


def _first_or(merge: Merge) -> Advance:
    return lambda carry, state: state if carry is None else merge(carry, state)

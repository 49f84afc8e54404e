"""Ordered computations that never put a whole key into one task.

A plain ``Window.partitionBy(entity)`` sends every row of an entity to a single task, so an entity that holds a third
of the table decides the run time.  Everything here splits a key along its own order instead:

* *segments*: a coarse, order-preserving expression (by default the day of the ordering timestamp).  Per-segment
  totals are aggregated with map-side combine and only those totals are scanned per key.  What a segment inherits is
  then added to it as one *head* row in front of its own rows, so a single shuffle by ``(key, segment)`` and one running
  aggregate finish the job: no join, and NULL keys need no special care.
* *blocks*: runs of ``size`` consecutive row numbers.  The last ``back`` rows of a block are also sent to the next
  block (and the first ``ahead`` rows to the previous one), so bounded ``ROWS`` frames stay exact.

History is *frozen at equal timestamps*: rows that share a timestamp see the same past, strictly before it.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

BLOCK = 1 << 16
FLAG = "_halo"
BLK = "_blk"
SEG = "_seg"
HEAD = "_head"
STEP = "_step"
LEAD = "_lead"
#: Longest frame for which instants are first cut to the rows that later ones can see.
TAIL = 32


def day_segment(ts: str) -> Column:
    return F.date_trunc("day", F.col(ts))


def attach(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Null-safe equi join that keeps the left key columns only."""
    if not keys:
        return left.join(right, how=how) if how == "cross" else left.join(right, F.lit(True), how)
    renamed = right.select(
        *[F.col(k).alias(f"_r_{k}") for k in keys], *[F.col(c) for c in right.columns if c not in keys]
    )
    condition = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    return left.join(renamed, condition, how).drop(*[f"_r_{k}" for k in keys])


def _segment_window(keys: Sequence[str]) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(SEG)


def _before(spec: WindowSpec) -> WindowSpec:
    return spec.rowsBetween(Window.unboundedPreceding, -1)


def row_numbers(
    df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], seg: Column | None = None, out: str = "rn",
    sums: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Exact ``row_number`` per key in ``order``; ``seg`` must be non-decreasing along that order.

    With ``keys=[]`` this numbers the whole table without a single-partition sort.  ``sums`` adds, by the same pass, each sum over
    all rows before the row (0 when there are none).
    """
    sums = dict(sums or {})
    part = {n: f"_v_{n}" for n in sums}
    tagged = df.withColumns({SEG: day_segment(order[0]) if seg is None else seg, STEP: F.lit(1).cast("bigint"), HEAD: F.lit(1),
                             **{part[n]: c for n, c in sums.items()}})
    totals = tagged.groupBy(*keys, SEG).agg(F.count(F.lit(1)).alias("_n"), *[F.sum(v).alias(v) for v in part.values()])
    ahead = _before(_segment_window(keys))
    offsets = totals.select(*keys, SEG, F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias(STEP), F.lit(0).alias(HEAD),
                            *[F.sum(v).over(ahead).alias(v) for v in part.values()])
    spec = Window.partitionBy(*keys, SEG).orderBy(HEAD, *order)
    numbered = tagged.unionByName(offsets, allowMissingColumns=True).withColumns(
        {out: F.sum(STEP).over(spec.rowsBetween(Window.unboundedPreceding, 0)),
         **{n: F.coalesce(F.sum(v).over(_before(spec)), F.lit(0)) for n, v in part.items()}})
    return numbered.filter(F.col(HEAD) == 1).drop(SEG, STEP, HEAD, *part.values())


def blocks(
    df: DataFrame, keys: Sequence[str], rn: str = "rn", back: int = 1, ahead: int = 0, size: int = BLOCK
) -> tuple[DataFrame, WindowSpec]:
    """Replicate block edges and return the frame with the window to use on it.

    Rows with ``_halo`` set are copies for context only; drop them with :func:`drop_halo`.
    """
    if size < back + ahead:
        raise ValueError("a block must be at least as long as its halo")
    home = F.floor((F.col(rn) - 1) / size)
    pos = (F.col(rn) - 1) % size
    targets = [home]
    if back:
        targets.append(F.when(pos >= size - back, home + 1))
    if ahead:
        targets.append(F.when(pos < ahead, home - 1))
    spread = df.withColumn(BLK, F.explode(F.array_compact(F.array(*targets)))).withColumn(FLAG, F.col(BLK) != home)
    return spread, Window.partitionBy(*keys, BLK).orderBy(rn)


def drop_halo(df: DataFrame) -> DataFrame:
    return df.filter(~F.col(FLAG)).drop(FLAG, BLK)


def frozen_state(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    order: Sequence[str],
    back: int,
    build: Callable[[WindowSpec], Mapping[str, Column]],
    seg: Column | None = None,
    size: int = BLOCK,
    prepare: Callable[[WindowSpec], Mapping[str, Column]] | None = None,
    totals: Mapping[str, Column] | None = None,
) -> DataFrame:
    """One row per ``(keys, ts)``: columns built on the rows strictly before ``ts``.

    ``build`` receives the block window (ordered by row number) and must use frames ending at ``-1`` and starting no
    earlier than ``-back``.  ``prepare`` adds columns it may refer to (for instance running sums); ``totals`` names sums over all
    earlier rows of the key, however far back, that it may refer to.
    """
    if back <= TAIL:
        numbered = _instant_tails(df, keys, ts, order, max(back, 1), seg, totals or {})
    else:
        numbered = row_numbers(df, keys, [ts, *order], seg, sums=totals)
    spread, window = blocks(numbered, keys, back=max(back, 1), size=size)
    if prepare:
        spread = spread.withColumns(dict(prepare(window)))
    before = F.lag(ts).over(window)
    columns = dict(build(window))
    first = F.col(LEAD) if back <= TAIL else before.isNull() | (before < F.col(ts))
    out = spread.withColumns({"_first": first, **columns})
    return out.filter(F.col("_first") & ~F.col(FLAG)).select(*keys, ts, *columns)


def _instant_tails(
    df: DataFrame, keys: Sequence[str], ts: str, order: Sequence[str], back: int, seg: Column | None, totals: Mapping[str, Column],
) -> DataFrame:
    """The last ``back`` rows of each ``(keys, ts)`` with their ``rn``, all that later instants can see of it, and one row more that stands for
    the first (``LEAD``, with its ``rn``). Rows are cut before they move, so what moves is bounded by the instants of each input partition."""
    instants = prior_sums(df, keys, ts, {"_before": F.lit(1).cast("bigint"), **totals}, seg, own=["_before"])
    latest = Window.partitionBy(*keys, ts).orderBy(*[F.col(c).desc() for c in order])
    tails = df.withColumn("_back", F.row_number().over(latest)).filter(F.col("_back") <= back + 1)
    exact = F.col("_before") + F.col("_before_own") - F.col("_back") + 1
    rn = F.when(F.col("_back") > back, F.col("_before") + 1).otherwise(exact)
    return attach(tails, instants, [*keys, ts]).withColumn("rn", rn).withColumn(LEAD, F.col("rn") == F.col("_before") + 1).drop("_before", "_before_own", "_back")


def running(window: WindowSpec, value: Column) -> Column:
    """Running sum inside a block, halo included."""
    return F.sum(value).over(window.rowsBetween(Window.unboundedPreceding, 0))


def last_sum(window: WindowSpec, prefix: str, n: int) -> Column:
    """Sum over the previous ``n`` rows as a difference of two running sums: constant work per row for any ``n``."""
    zero = F.lit(0)
    return F.coalesce(F.lag(prefix, 1).over(window), zero) - F.coalesce(F.lag(prefix, n + 1).over(window), zero)


def prior_sums(
    df: DataFrame, keys: Sequence[str], ts: str, sums: Mapping[str, Column], seg: Column | None = None, own: Sequence[str] = (),
) -> DataFrame:
    """One row per ``(keys, ts)`` with each sum over all rows strictly before ``ts`` (0 when there are none); those named in ``own``
    also over the rows at ``ts``, as ``<name>_own``."""
    totals = df.groupBy(*keys, ts).agg(*[F.sum(c).alias(name) for name, c in sums.items()])
    totals = totals.withColumns({SEG: day_segment(ts) if seg is None else seg, HEAD: F.lit(1)})
    carried = totals.groupBy(*keys, SEG).agg(*[F.sum(n).alias(n) for n in sums])
    spec = _before(_segment_window(keys))
    heads = carried.select(*keys, SEG, F.lit(0).alias(HEAD), *[F.sum(n).over(spec).alias(n) for n in sums])
    inside = _before(Window.partitionBy(*keys, SEG).orderBy(HEAD, ts))
    scanned = totals.unionByName(heads, allowMissingColumns=True).withColumns(
        {f"_s_{n}": F.coalesce(F.sum(n).over(inside), F.lit(0)) for n in sums})
    return scanned.filter(F.col(HEAD) == 1).select(*keys, ts, *[F.col(f"_s_{n}").alias(n) for n in sums], *[F.col(n).alias(f"{n}_own") for n in own])


def running_sums(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], sums: Mapping[str, Column], seg: Column | None = None
) -> DataFrame:
    """Every row with inclusive running sums in ``order`` (which must be total within a key)."""
    tagged = df.withColumns({SEG: day_segment(order[0]) if seg is None else seg, HEAD: F.lit(1), **{f"_t{i}": c for i, c in enumerate(sums.values())}})
    carried = tagged.groupBy(*keys, SEG).agg(*[F.sum(f"_t{i}").alias(f"_t{i}") for i in range(len(sums))])
    spec = _before(_segment_window(keys))
    heads = carried.select(*keys, SEG, F.lit(0).alias(HEAD), *[F.sum(f"_t{i}").over(spec).alias(f"_t{i}") for i in range(len(sums))])
    inside = Window.partitionBy(*keys, SEG).orderBy(HEAD, *order).rowsBetween(Window.unboundedPreceding, 0)
    scanned = tagged.unionByName(heads, allowMissingColumns=True).withColumns(
        {name: F.coalesce(F.sum(f"_t{i}").over(inside), F.lit(0)) for i, name in enumerate(sums)})
    return scanned.filter(F.col(HEAD) == 1).drop(SEG, HEAD, *[f"_t{i}" for i in range(len(sums))])


def latest_by(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], first: bool = False) -> DataFrame:
    """The last (or first) row of each key in ``order``; an aggregate, so it combines before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    rank = F.struct(*[F.col(o) if isinstance(o, str) else o for o in order])
    pick = F.min_by if first else F.max_by
    return df.groupBy(*keys).agg(pick(F.struct(*rest), rank).alias("_row")).select(*keys, "_row.*")


def as_of(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_ts: str,
    eligible_at: str,
    choose: Sequence[str],
    payload: Sequence[str],
    inclusive: bool = True,
    seg: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Left rows with the best right row eligible by ``left_ts``.

    *Eligible* means ``eligible_at <= left_ts`` (``<`` unless ``inclusive``); *best* is the greatest ``choose`` tuple
    among all eligible rows.  Works by union and running maximum, so no pair of rows is ever formed.
    """
    to_seg = seg or (lambda c: F.date_trunc("day", c))
    best = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(choose)], F.struct(*payload).alias("v"))
    rows = left.select(*keys, F.col(left_ts).alias("_t"), F.lit(1 if inclusive else 0).alias("_side"),
                       F.struct(*left.columns).alias("_left"))
    facts = right.filter(F.col(eligible_at).isNotNull()).select(
        *keys, F.col(eligible_at).alias("_t"), F.lit(0 if inclusive else 1).alias("_side"), best.alias("_best"))
    both = rows.unionByName(facts, allowMissingColumns=True).withColumns({SEG: to_seg(F.col("_t")), HEAD: F.lit(1)})
    heads = both.groupBy(*keys, SEG).agg(F.max("_best").alias("_m")).select(
        *keys, SEG, F.lit(0).alias(HEAD), F.max("_m").over(_before(_segment_window(keys))).alias("_best"))
    inside = Window.partitionBy(*keys, SEG).orderBy(HEAD, "_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    scanned = both.unionByName(heads, allowMissingColumns=True).withColumn("_hit", F.max("_best").over(inside))
    return scanned.filter(F.col("_left").isNotNull()).select(
        "_left.*", *[F.col("_hit.v")[c].alias(c) for c in payload])


def nearest(
    left: DataFrame, right: DataFrame, keys: Sequence[str], left_ts: str, right_ts: str, tie: str, payload: Sequence[str],
    tolerance_seconds: float,
) -> DataFrame:
    """Left rows with the right row closest in time within the tolerance.

    Equal gaps go to the earlier row, equal times to the smallest numeric ``tie``."""
    fields = [right_ts, *[p for p in payload if p != right_ts]]
    facts = right.select(*keys, *fields, (-F.col(tie)).alias("_tie"))
    back = as_of(left, facts, keys, left_ts, right_ts, [right_ts, "_tie"], fields)
    back = back.withColumnsRenamed({f: f"_b_{f}" for f in fields})
    # mirrored time turns "first at or after" into an as-of lookup
    mirrored = facts.withColumn("_mt", F.timestamp_micros(-F.unix_micros(right_ts)))
    flipped = back.withColumn("_ml", F.timestamp_micros(-F.unix_micros(left_ts)))
    ahead = as_of(flipped, mirrored, keys, "_ml", "_mt", ["_mt", "_tie"], fields).withColumnsRenamed(
        {f: f"_a_{f}" for f in fields})
    at = F.unix_micros(left_ts)
    before_gap = at - F.unix_micros(f"_b_{right_ts}")
    after_gap = F.unix_micros(f"_a_{right_ts}") - at
    limit = int(tolerance_seconds * 1_000_000)
    use_before = before_gap.isNotNull() & (after_gap.isNull() | (before_gap <= after_gap))
    gap = F.when(use_before, before_gap).otherwise(after_gap)
    return ahead.select(
        *left.columns,
        *[
            F.when(gap <= limit, F.when(use_before, F.col(f"_b_{f}")).otherwise(F.col(f"_a_{f}"))).alias(f)
            for f in payload
        ],
        F.when(gap <= limit, gap / 1e6).alias("gap_seconds"),
    )


def value_segment(value: str) -> Column:
    """Order-preserving coarse bucket of a number (about two percent wide at any magnitude)."""
    return F.floor(F.asinh(F.col(value) * 1000) * 50)


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float], higher: bool = False) -> DataFrame:
    """Exact linear-interpolation quantiles per key (the upper neighbour with ``higher``).

    Values are counted before anything is ordered, so one frequent value is one row; the running count is segmented.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    scanned = running_sums(counts, keys, [value], {"_cum": F.col("_n")}, seg=value_segment(value))
    totals = counts.groupBy(*keys).agg(F.sum("_n").alias("_total"))
    both = attach(scanned, totals, keys) if keys else scanned.withColumn("_one", F.lit(1)).join(totals.withColumn("_one", F.lit(1)), "_one")
    aggs = []
    for name, q in probs.items():
        pos = F.round(F.lit(q) * (F.col("_total") - 1), 9)
        lo, hi = F.floor(pos), F.ceil(pos)
        at = lambda r: F.min(F.when(F.col("_cum") > r, F.col(value)))
        low, high = at(lo), at(hi)
        frac = F.max(pos - lo)
        aggs.append((high if higher else low + (high - low) * frac).alias(name))
    return both.groupBy(*keys).agg(*aggs)


#: Half the width, in ranks, of the bracket around an approximate quantile, and the accuracy of that.
NEAR, ACCURACY = 5e-4, 10_000


def exact_quantile(df: DataFrame, value: str, q: float, name: str) -> DataFrame:
    """One row: the exact linear-interpolation quantile of a whole column, of which only the values around it are ordered.

    A sketch gives a bracket, values below it are counted, values inside it ordered. ``df`` is read three times."""
    v = F.col(value)
    lo, hi, n = df.filter(v.isNotNull()).agg(
        F.percentile_approx(v, max(q - NEAR, 0.0), ACCURACY), F.percentile_approx(v, min(q + NEAR, 1.0), ACCURACY), F.count(F.lit(1))).first()
    if not n:
        return df.sparkSession.createDataFrame([(None,)], f"{name} {df.schema[value].dataType.simpleString()}")
    below = df.filter(v < lo).count()
    pos = round(q * (n - 1), 9)
    first = math.floor(pos)
    ordered = df.filter(v.between(lo, hi)).groupBy(v.alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    scanned = running_sums(ordered, [], ["_v"], {"_cum": F.col("_n")}, seg=value_segment("_v"))
    at = lambda rank: F.min(F.when(F.col("_cum") + below > rank, F.col("_v")))
    low, high, seen = scanned.agg(at(first), at(math.ceil(pos)), F.sum("_n")).first()
    if below > first or below + seen <= math.ceil(pos):  # the sketch missed its accuracy
        return exact_quantiles(df, [], value, {name: q})
    return df.sparkSession.createDataFrame([(low + (high - low) * (pos - first),)], f"{name} double")


FAN = 16


def range_counts(
    facts: DataFrame, asks: DataFrame, keys: Sequence[str], ts: str, value: str, lo: str, hi: str, sums: Mapping[str, Column], inclusive: bool = True,
) -> DataFrame:
    """One row per distinct ``(keys, ts, lo, hi)`` of ``asks``: sums over facts placed earlier on the time axis whose value lies in ``[lo, hi]``.

    Facts of the same key, time and value are summed, and equal asks are one, before anything moves.  The rest is numbered on one axis; a
    prefix of that axis is split into blocks of 16**level rows, and per level a running sum in value order answers both ends of the range.
    Work is distinct rows x log16(distinct rows); no fact is ever paired with an ask.
    """
    side_f, side_q = (0, 1) if inclusive else (1, 0)
    own = [ts, lo, hi]
    f = facts.select(*keys, F.col(ts).alias("_t"), F.col(value).cast("double").alias("_value"), *[F.coalesce(c, F.lit(0)).alias(n) for n, c in sums.items()])
    f = f.groupBy(*keys, "_t", "_value").agg(*[F.sum(n).alias(n) for n in sums]).withColumn("_side", F.lit(side_f))
    q = asks.select(*keys, F.col(ts).alias("_t"), F.col(lo).cast("double").alias("_lo"), F.col(hi).cast("double").alias("_hi")).distinct()
    q = q.withColumns({"_side": F.lit(side_q), **{n: F.lit(0) for n in sums}})
    both = f.unionByName(q, allowMissingColumns=True)
    numbered = row_numbers(both, keys, ["_t", "_side", "_lo", "_hi", "_value"], seg=day_segment("_t"), out="_pos")
    size = both.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size"))
    numbered = attach(numbered, size, keys) if keys else numbered.withColumn("_one", F.lit(1)).join(size.withColumn("_one", F.lit(1)), "_one").drop("_one")
    levels = F.sequence(F.lit(0), F.ceil(F.log(F.col("_size") + 1.0) / F.log(F.lit(float(FAN)))).cast("int"))
    at = numbered.select("*", F.explode(levels).alias("_lv"))
    unit = F.pow(F.lit(float(FAN)), F.col("_lv")).cast("bigint")
    at = at.withColumns({"_par": F.floor(F.col("_pos") / (unit * FAN)), "_child": F.floor(F.col("_pos") / unit) % FAN})
    is_fact = F.col("_side") == side_f
    ends = F.when(is_fact, F.array(F.struct(F.col("_value").alias("_v"), F.lit(1).alias("_kind")))).otherwise(
        F.array(F.struct(F.col("_lo").alias("_v"), F.lit(0).alias("_kind")), F.struct(F.col("_hi").alias("_v"), F.lit(2).alias("_kind"))))
    rows = at.filter(is_fact | (F.col("_child") > 0)).select(*keys, "_lv", "_par", "_child", "_t", "_lo", "_hi", *sums, F.inline(ends))
    parts = {f"_s{c}_{n}": F.when((F.col("_kind") == 1) & (F.col("_child") == c), F.col(n)).otherwise(0) for c in range(FAN - 1) for n in sums}
    scanned = running_sums(rows, [*keys, "_lv", "_par"], ["_v", "_kind"], parts, seg=value_segment("_v"))
    asked = scanned.filter(F.col("_kind") != 1)
    sign = F.when(F.col("_kind") == 2, 1).otherwise(-1)
    below = {n: reduce(lambda a, b: a + b, [F.when(F.col("_child") > c, F.col(f"_s{c}_{n}")).otherwise(0) for c in range(FAN - 1)]) for n in sums}
    found = asked.groupBy(*keys, "_t", "_lo", "_hi").agg(*[F.sum(sign * below[n]).alias(n) for n in sums])
    # asks without a block before them are not in found
    every = attach(q.select(*keys, "_t", "_lo", "_hi"), found, [*keys, "_t", "_lo", "_hi"])
    return every.select(*keys, *[F.col(c).alias(n) for c, n in zip(("_t", "_lo", "_hi"), own, strict=True)], *[F.coalesce(n, F.lit(0)).alias(n) for n in sums])


def prior_range_counts(
    facts: DataFrame, queries: DataFrame, keys: Sequence[str], ts: str, value: str, lo: str, hi: str, qid: str,
    sums: Mapping[str, Column], inclusive: bool = True,
) -> DataFrame:
    """For each query: sums over facts placed earlier on the time axis whose value lies in ``[lo, hi]``.

    ``facts(keys, ts, value, ...)``, ``queries(keys, ts, lo, hi, qid)``; see :func:`range_counts`.
    """
    wanted = queries.select(*keys, ts, F.col(lo).cast("double").alias(lo), F.col(hi).cast("double").alias(hi), qid)
    found = range_counts(facts, wanted, keys, ts, value, lo, hi, sums, inclusive)
    return attach(wanted, found, [*keys, ts, lo, hi]).select(*keys, qid, *sums)

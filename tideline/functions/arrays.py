"""Column helpers over probability vectors (array<double>) and short numeric arrays."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-12


def vec(*cols: str | Column) -> Column:
    return F.array(*[F.col(c) if isinstance(c, str) else c for c in cols])


def asum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)


def normalize(a: Column) -> Column:
    total = asum(a)
    return F.transform(a, lambda x: x / total)


def clip(c: Column, lo: float | None, hi: float | None) -> Column:
    """Bounds that keep NULL as NULL (``greatest``/``least`` would skip it)."""
    out = c
    if hi is not None:
        out = F.least(out, F.lit(float(hi)))
    if lo is not None:
        out = F.greatest(out, F.lit(float(lo)))
    return F.when(c.isNotNull(), out)


def arg_max(a: Column) -> Column:
    """Zero-based index of the first maximum."""
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def arg_max_cols(cols: list[Column]) -> Column:
    """First maximum over separate columns, without building an array."""
    top = F.greatest(*cols)
    out = F.lit(len(cols) - 1)
    for i in range(len(cols) - 2, -1, -1):
        out = F.when(cols[i] == top, F.lit(i)).otherwise(out)
    return out


def entropy(a: Column) -> Column:
    return -asum(F.transform(a, lambda x: x * F.log(F.greatest(x, F.lit(EPS)))))


def l1(a: Column, b: Column) -> Column:
    return asum(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(asum(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def total_variation(a: Column, b: Column) -> Column:
    return l1(a, b) / 2


def kl(a: Column, b: Column) -> Column:
    lo = F.lit(EPS)
    return asum(F.zip_with(a, b, lambda x, y: F.greatest(x, lo) * F.log(F.greatest(x, lo) / F.greatest(y, lo))))


def js(a: Column, b: Column) -> Column:
    mid = F.zip_with(a, b, lambda x, y: (x + y) / 2)
    return (kl(a, mid) + kl(b, mid)) / 2


def dot(a: Column, b: Column) -> Column:
    return asum(F.zip_with(a, b, lambda x, y: x * y))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.greatest(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(EPS))


def tail(a: Column, n: int) -> Column:
    """Last ``n`` elements, all of them when there are fewer."""
    return F.slice(a, F.greatest(F.size(a) - n, F.lit(0)) + 1, n)


def temper(a: Column, t: Column | float) -> Column:
    """softmax(log p / t)."""
    inv = 1.0 / (F.lit(t) if isinstance(t, (int, float)) else t)
    return normalize(F.transform(a, lambda x: F.pow(F.greatest(x, F.lit(EPS)), inv)))


def pick(a: Column, zero_based: Column) -> Column:
    return F.element_at(a, zero_based.cast("int") + 1)


def log_loss(a: Column, y: Column) -> Column:
    return -F.log(F.greatest(F.least(pick(a, y), F.lit(1.0)), F.lit(EPS)))


def brier(a: Column, y: Column) -> Column:
    squares = F.transform(a, lambda x, i: F.pow(x - F.when(i == y, 1.0).otherwise(0.0), 2.0))
    return asum(squares)


def add(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, cols)

"""Scalar column helpers: parsing, cleaning, dates, hashes, hosts."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANK_WORDS = ("", "nan", "none", "nat")
ISO_WITH_OFFSET = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})$"


def safe_double(c: Column, strip_commas: bool = False) -> Column:
    """Numeric parse, NULL on failure, never NaN or infinity; the comma variant also reads ``-`` as missing."""
    text = F.trim(c.cast("string"))
    if strip_commas:
        text = F.regexp_replace(text, ",", "")
    value = text.try_cast("double")
    return F.when(F.isnan(value) | (F.abs(value) == float("inf")), F.lit(None)).otherwise(value)


def clean_text(c: Column) -> Column:
    """Trim, fold the ideographic space, and blank out the words that stand for missing."""
    text = F.trim(F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), "　", " "))
    return F.when(F.lower(text).isin(*BLANK_WORDS), F.lit("")).otherwise(text)


def first_nonblank(*cols: Column) -> Column:
    return F.coalesce(*[F.nullif(clean_text(c), F.lit("")) for c in cols])


def strict_timestamp(c: Column) -> Column:
    """ISO-8601 with an explicit offset, else NULL: zone-less text is not an instant."""
    return F.when(c.rlike(ISO_WITH_OFFSET), F.try_to_timestamp(c))


def local_date(ts: Column, zone: str) -> Column:
    return F.to_date(F.from_utc_timestamp(ts, zone))


def minutes_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / 60e6


def days_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / 86400e6


def short_hash(*cols: Column, length: int = 24) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *cols), 256), 1, length)


def host_allowed(url: Column, hosts: Iterable[str], suffixes: Iterable[str] = ()) -> Column:
    """URL host (or a bare host name) on the allow-list, exactly or by suffix."""
    value = F.lower(F.trim(url))
    bare = F.substring_index(F.substring_index(value, "/", 1), ":", 1)
    host = F.coalesce(F.parse_url(value, F.lit("HOST")), bare)
    ok = host.isin(*hosts)
    for s in suffixes:
        ok = ok | host.endswith(s)
    return F.coalesce(ok, F.lit(False))


def reasons(*rules: tuple[str, Column]) -> Column:
    """Codes of the rules whose condition holds (NULL counts as not held)."""
    return F.array_compact(F.array(*[F.when(cond, F.lit(code)) for code, cond in rules]))


def ratio(num: Column, den: Column) -> Column:
    """NULL instead of a division by zero."""
    return F.try_divide(num.cast("double"), den.cast("double"))

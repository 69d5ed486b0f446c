"""Scalar column helpers (all JVM-side built-ins, no Python UDFs)."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def timestamp_of(date_col, time_col) -> Column:
    """date + 'HH:mm:ss' text → TIMESTAMP_NTZ (wall clock, no zone)."""
    return F.to_timestamp_ntz(F.concat_ws(" ", _c(date_col).cast("string"), _c(time_col)),
                              F.lit("yyyy-MM-dd HH:mm:ss"))


def duration_minutes(start, end) -> Column:
    return (F.timestamp_diff("SECOND", _c(start), _c(end)) / 60.0).cast("double")


def day_name(date_col) -> Column:
    return F.date_format(_c(date_col), "EEEE")


def r_week_of_year(date_col) -> Column:
    """lubridate ``week()``: completed 7-day blocks since 1 Jan, plus one (not ISO)."""
    return (F.floor((F.dayofyear(_c(date_col)) - 1) / 7) + 1).cast("int")


def weekday0_monday(date_col) -> Column:
    """0 = Monday … 6 = Sunday."""
    return (F.dayofweek(_c(date_col)) + 5) % 7


def time_bucket(hour) -> Column:
    h = _c(hour)
    return (F.when((h >= 0) & (h < 6), "Night").when((h >= 6) & (h < 12), "Morning")
            .when((h >= 12) & (h < 18), "Afternoon").when((h >= 18) & (h <= 23), "Evening")
            .otherwise("Unknown"))


def label_lookup(col, mapping: dict) -> Column:
    """Named-vector lookup: unknown → NULL."""
    m = F.create_map(*[F.lit(x) for x in chain.from_iterable(mapping.items())])
    return m[_c(col)]


def clip(col, lo, hi) -> Column:
    """pmax(pmin(x, hi), lo) with NULL kept NULL (Spark's least/greatest skip NULL)."""
    x = _c(col)
    return F.when(x.isNull(), None).otherwise(F.greatest(F.least(x, F.lit(hi)), F.lit(lo)))


def regex_category(col, rules: list[tuple[str, str]], default: str = "other") -> Column:
    """First matching regex wins (path → category)."""
    x = _c(col)
    out = None
    for pattern, label in rules:
        out = F.when(x.rlike(pattern), label) if out is None else out.when(x.rlike(pattern), label)
    return out.otherwise(default) if out is not None else F.lit(default)


def split_last_underscore(col) -> tuple[Column, Column]:
    """'a_b_c' → ('a_b', 'c'): split at the last underscore."""
    x = _c(col)
    return F.regexp_extract(x, r"^(.*)_([^_]+)$", 1), F.regexp_extract(x, r"^(.*)_([^_]+)$", 2)

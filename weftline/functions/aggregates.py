"""Named group statistics, over all rows of a group or those that a condition marks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(x: Column, rows: Column) -> Column:
    return F.coalesce(F.sum(x), F.lit(0.0))


def _complete(x: Column, rows: Column, value: Column) -> Column:
    """value, unless one of the rows misses x."""
    return F.when(F.count(x) < F.sum(rows), None).otherwise(value)


#: A skew below this is the rounding error of a symmetric group.
NO_SKEW = 1e-8


def _skew(x: Column, rows: Column) -> Column:
    flat = (F.stddev_pop(x) == 0) | (F.abs(F.skewness(x)) < NO_SKEW)
    return _complete(x, rows, F.when(flat, F.lit(0.0)).otherwise(F.skewness(x)))


def _kurt(x: Column, rows: Column) -> Column:
    return _complete(x, rows, F.when(F.stddev_pop(x) == 0, F.lit(-3.0)).otherwise(F.kurtosis(x)))


def _iqr(x: Column, rows: Column) -> Column:
    return _complete(x, rows, F.percentile(x, F.lit(0.75)) - F.percentile(x, F.lit(0.25)))


#: name -> builder of (value, 1 for each row that counts and 0 else). Sums of nothing are 0, as are counts; sample
#: statistics of one row are NULL; skew, kurt (population, excess) and iqr are NULL if a value is missing.
AGGREGATES: dict[str, Callable[[Column, Column], Column]] = {
    "min": lambda x, rows: F.min(x),
    "max": lambda x, rows: F.max(x),
    "mean": lambda x, rows: F.avg(x),
    "sum": _sum,
    "var": lambda x, rows: F.var_samp(x),
    "std": lambda x, rows: F.stddev_samp(x),
    "count": lambda x, rows: F.count(x),
    "size": lambda x, rows: F.sum(rows).cast("bigint"),
    "nunique": lambda x, rows: F.countDistinct(x),
    "approx_nunique": lambda x, rows: F.approx_count_distinct(x),
    "median": lambda x, rows: F.median(x),
    "skew": _skew,
    "kurt": _kurt,
    "iqr": _iqr,
}


def trend(y: Column, rn: Column, rows: Column) -> Column:
    """Least-squares slope of y over 0, 1, 2, ... for the newest, next, ... row. NULL if a y is missing, 0 for one row."""
    x = F.when(rows == 1, rn - 1)
    return F.when(F.count(y) < F.sum(rows), None).when(F.sum(rows) == 1, F.lit(0.0)).otherwise(F.regr_slope(y.cast("double"), x.cast("double")))


def first_known(value: Column, order: Column) -> Column:
    """The value of least order among rows that have one."""
    return F.min_by(value, F.when(value.isNotNull(), order))


def last_known(value: Column, order: Column) -> Column:
    return F.max_by(value, F.when(value.isNotNull(), order))

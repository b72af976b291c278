"""The one place that says what nulls, zero divisors and single rows mean.

Missing values are NULL; NaN is turned into NULL where data is read. Comparisons with a missing value are false in
flags, sums of nothing are 0, and a group statistic that needs every value is NULL if one is missing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def col(name: str) -> Column:
    """A column by its exact name: blanks, dots and operators in it are part of the name."""
    return F.col("`" + name.replace("`", "``") + "`")


def without_nan(df: DataFrame) -> DataFrame:
    """Every NaN of a float column as NULL."""
    floats = {f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.select(*[F.nanvl(col(c), F.lit(None)).alias(c) if c in floats else col(c) for c in df.columns])


def null_if(c: Column, value) -> Column:
    """Sentinel to NULL."""
    return F.when(c != F.lit(value), c)


def null_where(c: Column, bad: Column) -> Column:
    """Outlier to NULL; an undecided test leaves the value, which is NULL itself."""
    return F.when(~F.coalesce(bad, F.lit(False)), c)


def ratio(a: Column, b: Column, zero: str = "null") -> Column:
    """a / b; a zero divisor gives NULL, or with zero="inf" the signed infinity (0 / 0 gives NULL)."""
    a, b = a.cast("double"), b.cast("double")
    if zero == "null":
        return F.when(b != 0, a / b)
    return F.when(b != 0, a / b).when(a > 0, F.lit(float("inf"))).when(a < 0, F.lit(float("-inf")))


def ratio_or_zero(a: Column, b: Column) -> Column:
    """a / b, 0 for a zero divisor; NULL stays NULL."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / F.when(b != 0, b.cast("double")))


def flag(test: Column) -> Column:
    """1 where test holds; 0 where it doesn't or can't be decided."""
    return F.coalesce(test, F.lit(False)).cast("int")


def differs(c: Column, value) -> Column:
    """1 where c isn't value; a missing c differs."""
    return (~c.eqNullSafe(F.lit(value))).cast("int")


def at_least_zero(c: Column) -> Column:
    """c, but 0 where it is negative or missing."""
    return F.greatest(c, F.lit(0))


def finite_or_zero(c: Column) -> Column:
    """0 for NULL, NaN and infinities."""
    c = c.cast("double")
    return F.when(c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), F.lit(0.0)).otherwise(c)


def keep_unless(test: Column) -> Column:
    """Row filter that drops what test marks and keeps what it can't decide."""
    return ~F.coalesce(test, F.lit(False))

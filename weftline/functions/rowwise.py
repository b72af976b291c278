"""Statistics over columns of one row. Missing values are left out; all stay inside generated code."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F


def _known(cols: list[Column]) -> Column:
    return reduce(add, [c.isNotNull().cast("int") for c in cols])


def _present(cols: list[Column]) -> Column:
    return F.array_compact(F.array(*[c.cast("double") for c in cols]))


def row_sum(cols: list[Column]) -> Column:
    """0 if all are missing."""
    return reduce(add, [F.coalesce(c, F.lit(0)) for c in cols])


def row_mean(cols: list[Column]) -> Column:
    n = _known(cols)
    return F.when(n > 0, row_sum(cols).cast("double") / n)


def row_min(cols: list[Column]) -> Column:
    return F.least(*cols)


def row_max(cols: list[Column]) -> Column:
    return F.greatest(*cols)


def _moment(cols: list[Column], mean: Column, power: int) -> Column:
    def term(c: Column) -> Column:
        d = c.cast("double") - mean
        return F.coalesce(reduce(lambda x, _: x * d, range(power - 1), d), F.lit(0.0))

    return reduce(add, [term(c) for c in cols])


def row_std(cols: list[Column]) -> Column:
    """Sample deviation; NULL for fewer than two values."""
    n = _known(cols)
    return F.when(n > 1, F.sqrt(_moment(cols, row_mean(cols), 2) / F.when(n > 1, n - 1)))


def row_median(cols: list[Column]) -> Column:
    s, n = F.array_sort(_present(cols)), _known(cols)
    low, high = F.floor((n + 1) / 2).cast("int"), F.floor((n + 2) / 2).cast("int")
    return F.when(n > 0, (F.try_element_at(s, low) + F.try_element_at(s, high)) / 2)


def row_kurtosis(cols: list[Column]) -> Column:
    """Bias-corrected excess kurtosis; 0 without variance, NULL for fewer than four values.

    Through one array of the values, so that the expression doesn't grow with the number of columns."""
    v, n = _present(cols), _known(cols).cast("double")
    total = F.aggregate(v, F.lit(0.0), lambda a, x: a + x)
    mean = total / F.when(n > 0, n)
    power = lambda k: F.aggregate(F.transform(v, lambda x: F.pow(x - mean, F.lit(float(k)))), F.lit(0.0), lambda a, x: a + x)
    m2, m4 = power(2), power(4)
    enough = F.when(n > 3, n)
    corrected = enough * (enough + 1) * (enough - 1) * m4 / ((enough - 2) * (enough - 3) * F.when(m2 != 0, m2 * m2)) - 3 * (enough - 1) * (enough - 1) / ((enough - 2) * (enough - 3))
    return F.when(n > 3, F.when(m2 == 0, F.lit(0.0)).otherwise(corrected))


def row_nulls(cols: list[Column]) -> Column:
    return reduce(add, [c.isNull().cast("int") for c in cols])

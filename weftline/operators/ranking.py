"""Ranks over whole columns, and what follows from them: exact AUC and the rank-sum test.

Ranks come from counts of distinct values: the values are aggregated first, then their counts are summed up in
order within ranges of values, so rows are never sorted in one task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..nulls import col
from ..settle import settle
from .cells import range_bounds, range_ranks, range_sizes, sorted_cells

RANGES = 64
IN_RANGE = 1_000_000


def ranges_for(distinct: int, ranges: int = RANGES) -> int:
    """Ranges of about IN_RANGE distinct values, `ranges` at least."""
    return max(ranges, -(-distinct // IN_RANGE))


def value_ranks(df: DataFrame, value: Column, extra: dict[str, Column] | None = None, ranges: int = RANGES) -> DataFrame:
    """(v, n, below, extra sums): each distinct value with its rows and the rows of smaller values.

    Distinct values are written once and dealt to ranges by approximate quantiles; a running sum within each range
    starts from the sum of the ranges below it, which are few."""
    values = df.filter(value.isNotNull()).groupBy(value.alias("v")).agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(k) for k, c in (extra or {}).items()])
    values = settle(values, "values")
    ranges = ranges_for(values.count(), ranges)
    shares = [i / ranges for i in range(1, ranges)]
    bounds = sorted(set(values.agg(F.percentile_approx("v", shares, 10 * ranges)).first()[0] or []))
    sorted_ = values.withColumn("r", F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= F.col("v"))) if bounds else F.lit(0))
    sizes = sorted_.groupBy("r").agg(F.sum("n").alias("size"))
    starts = sizes.select("r", (F.sum("size").over(Window.orderBy("r")) - F.col("size")).alias("start"))
    inside = F.sum("n").over(Window.partitionBy("r").orderBy("v").rowsBetween(Window.unboundedPreceding, -1))
    placed = sorted_.select("*", F.coalesce(inside, F.lit(0)).alias("inside")).join(F.broadcast(starts), "r")
    return placed.select("v", "n", (F.col("start") + F.col("inside")).alias("below"), *(extra or {}))


def group_medians(df: DataFrame, group: str, value: str, ranges: int = RANGES) -> DataFrame:
    """(g, median): the exact median of value, the mean of the middle two of an even number, in each group that has one.

    As in :func:`value_ranks`, values become counts and counts are summed up within ranges of values, so a group of all rows
    is dealt to as many tasks as there are ranges; only groups times ranges sums meet in one place."""
    known = df.filter(col(group).isNotNull() & col(value).isNotNull())
    values = settle(known.groupBy(col(group).alias("g"), col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n")), "group-values")
    ranges = ranges_for(values.count(), ranges)
    bounds = sorted(set(values.agg(F.percentile_approx("v", [i / ranges for i in range(1, ranges)], 10 * ranges)).first()[0] or []))
    ranged = values.withColumn("r", F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= F.col("v"))) if bounds else F.lit(0))
    sizes = ranged.groupBy("g", "r").agg(F.sum("n").alias("size"))
    lower = Window.partitionBy("g").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(F.col("g").alias("of"), F.col("r").alias("at"), F.coalesce(F.sum("size").over(lower), F.lit(0)).alias("start"), F.sum("size").over(Window.partitionBy("g")).alias("all"))
    before = Window.partitionBy("g", "r").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    inside = ranged.withColumn("inside", F.coalesce(F.sum("n").over(before), F.lit(0)))
    placed = inside.join(starts, (inside.g == starts.of) & (inside.r == starts.at)).withColumn("below", F.col("start") + F.col("inside"))
    at = lambda place: F.max(F.when((F.col("below") <= place) & (place < F.col("below") + F.col("n")), F.col("v")))
    return placed.groupBy("g").agg(((at(F.floor((F.col("all") - 1) / 2)) + at(F.floor(F.col("all") / 2))) / 2).alias("median"))


def min_rank(ranks: DataFrame) -> DataFrame:
    """(v, rank): 1 plus the number of smaller rows."""
    return ranks.select("v", (F.col("below") + 1).alias("rank"))


def with_rank(df: DataFrame, column: str, name: str, average: bool = False) -> DataFrame:
    """df with the rank of each row's value: that of its first tie, or the average of all of them."""
    ranks = value_ranks(df, col(column))
    rank = F.col("below") + (F.lit(1) + F.col("n")) / 2 if average else F.col("below") + 1
    table = ranks.select(F.col("v").alias("__v"), rank.alias("__rank"))
    return df.join(table, col(column) == F.col("__v"), "left").select(*[df["`" + c + "`"] for c in df.columns], F.col("__rank").alias(name))


def auc(df: DataFrame, target: str, score: str) -> DataFrame:
    """One row: `auc`, exact, ties counting half; NULL unless both classes occur."""
    known = df.filter(col(target).isNotNull() & col(score).isNotNull())
    ranks = value_ranks(known, col(score), {"pos": col(target).cast("double")})
    rank_sum = F.sum(F.col("pos") * (F.col("below") + (F.col("n") + 1) / 2))
    n1, n = F.sum("pos"), F.sum("n")
    return ranks.agg(F.try_divide(rank_sum - n1 * (n1 + 1) / 2, n1 * (n - n1)).alias("auc"))


def rank_sum_test(df: DataFrame, target: str, value: str, least: int = 20) -> tuple[float | None, float]:
    """(z, two-sided p) of the rank-sum test of value between targets 0 and 1 by the normal approximation with
    average ranks; (None, 2.0) unless both have `least` values."""
    known = df.filter(col(target).isNotNull() & col(value).isNotNull())
    ranks = value_ranks(known, col(value), {"pos": col(target).cast("double")})
    row = ranks.agg(F.sum(F.col("pos") * (F.col("below") + (F.col("n") + 1) / 2)), F.sum("pos"), F.sum("n")).first()
    return rank_sum(*row, least)


NO_TEST = 2.0


def rank_sum(s: float | None, n1: float | None, n: float | None, least: int = 20) -> tuple[float | None, float]:
    """(z, two-sided p) from the rank sum of n1 of n values; (None, NO_TEST) for fewer than `least` of either kind."""
    s, n1, n = (float(x or 0) for x in (s, n1, n))
    n0 = n - n1
    if n1 < least or n0 < least:
        return None, NO_TEST
    z = (s - n1 * (n + 1) / 2) / math.sqrt(n1 * n0 * (n + 1) / 12)
    return z, math.erfc(abs(z) / math.sqrt(2))


def class_comparison(df: DataFrame, flag: str, columns: list[str], ranges: int = RANGES, written: bool = False) -> DataFrame:
    """A row for each column that has a value: c (its place in `columns`), n, n1, rank_sum of flag 1, mean0, mean1,
    exact median0 and median1, least, most, and others (values that are neither 0 nor 1).

    Three passes over df, which is written first unless it is `written`: bounds that cut each column into ranges, sizes of the
    ranges, and the columns' sorted values by range. Only these are shuffled, as arrays: a row for each cell would be several
    times as large, and what sums it up spills. Neither a column nor a class is ever held in one task."""
    df = df.filter(col(flag).isNotNull()).select(col(flag).cast("int").alias("__flag"), *[col(c) for c in dict.fromkeys(columns)])
    df = df if written else settle(df, "compared")
    ranges = ranges_for(df.count(), ranges)
    bounds = range_bounds(df, columns, "__flag", ranges)
    sizes = settle(range_sizes(df, columns, "__flag", bounds), "range-sizes")
    lower = Window.partitionBy("c").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("c")
    starts = sizes.select("*", *[F.coalesce(F.sum(k).over(lower), F.lit(0)).alias("start" + k) for k in ("n0", "n1")], *[F.sum(k).over(whole).alias("all" + k) for k in ("n0", "n1")])
    middle = lambda k: F.array(F.floor((F.col("alln" + k) - 1) / 2), F.floor(F.col("alln" + k) / 2))
    inside = lambda k: F.filter(F.transform(middle(k), lambda p: p - F.col("startn" + k)), lambda p: (p >= 0) & (p < F.col("n" + k)))
    wanted = starts.select("c", "r", inside("0").alias("p0"), inside("1").alias("p1")).filter((F.size("p0") > 0) | (F.size("p1") > 0))
    places = {(r.c, r.r): [*((0, p) for p in r.p0), *((1, p) for p in r.p1)] for r in wanted.collect()}  # four rows a column at most
    ranked = range_ranks(sorted_cells(df, columns, "__flag", bounds), places).join(starts, ["c", "r"])
    both = lambda k: F.flatten(F.collect_list(f"at{k}"))
    return ranked.groupBy("c").agg(
        F.sum(F.col("n0") + F.col("n1")).alias("n"), F.sum("n1").alias("n1"), F.sum(F.col("s") + F.col("n1") * (F.col("startn0") + F.col("startn1"))).alias("rank_sum"),
        *[F.try_divide(F.sum(f"sum{k}"), F.sum(f"n{k}")).alias(f"mean{k}") for k in (0, 1)],
        *[F.when(F.size(both(k)) > 0, (F.array_min(both(k)) + F.array_max(both(k))) / 2).alias(f"median{k}") for k in (0, 1)],
        F.min("least").alias("least"), F.max("most").alias("most"), F.sum("others").alias("others"),
    )

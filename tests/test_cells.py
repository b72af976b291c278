"""Columns of a wide table compared between classes: by arrays of sorted values, not by a row for each cell."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from weftline.operators.cells import range_bounds, range_sizes
from weftline.operators.ranking import class_comparison
from weftline.selection import constant_columns


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(4)
    made = [(rng.choice([0, 0, 1, None]), rng.choice([None, rng.gauss(0, 1)]), rng.randrange(2), rng.choice([0.0, -0.0, 1.5, None]), None) for _ in range(900)]
    return spark.createDataFrame(made, "y int, a double, b int, `c.d` double, e double").repartition(5).persist()


def test_cells_are_not_turned_into_rows(rows):
    plan = class_comparison(rows, "y", ["a", "b", "c.d"])._jdf.queryExecution().executedPlan().toString()
    assert "Generate " not in plan and "FlatMapGroupsInArrow" in plan


@pytest.mark.parametrize("ranges", [2, 7, 64])
def test_classes_compared_by_ranges(rows, ranges):
    columns = ["a", "b", "c.d", "e"]
    found = {columns[r.c]: r for r in class_comparison(rows, "y", columns, ranges).collect()}
    df = rows.toPandas().dropna(subset=["y"])
    assert set(found) == set(columns[:3])
    for c, r in found.items():
        of = df.dropna(subset=[c])
        rank, one, zero = of[c].rank(), of[of.y == 1][c], of[of.y == 0][c]
        assert (r.n, r.n1, r.others) == (len(of), len(one), (~of[c].isin([0, 1])).sum())
        expected = (rank[of.y == 1].sum(), zero.mean(), one.mean(), zero.median(), one.median(), of[c].min(), of[c].max())
        assert (r.rank_sum, r.mean0, r.mean1, r.median0, r.median1, r.least, r.most) == pytest.approx(expected)


def test_ranges_hold_about_as_many_values(spark):
    df = spark.range(40000).select((F.col("id") % 3).cast("int").alias("y"), F.exp(F.col("id") / 4000).alias("x")).repartition(4)
    bounds = range_bounds(df, ["x"], "y", 8)
    sizes = [r.n0 + r.n1 for r in range_sizes(df.withColumn("y", F.col("y").cast("boolean").cast("int")), ["x"], "y", bounds).collect()]
    assert len(sizes) == 8 and sum(sizes) == 40000 and max(sizes) < 8000


def test_large_numbers_that_doubles_cannot_tell_apart_differ(spark):
    df = spark.createDataFrame([(2**53, 7, None), (2**53 + 1, 7, None)], "a long, b long, c long")
    assert constant_columns(df, ["a", "b", "c"]) == ["b", "c"]

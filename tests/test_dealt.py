"""Rows dealt by key before they are summed up: tasks grow in number with the rows, keys of very many rows stay in parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.plans.fusion import Agg, aggregate
from weftline.sources.adapters import view

AGGS = [Agg("kinds", "nunique", "n"), Agg("mean", "mean", "x"), Agg("var", "var", "x"), Agg("rows", "size")]


def plain(df) -> list[tuple]:
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())


def test_tasks_grow_in_number_with_the_rows(spark):
    df = spark.range(600).select((F.col("id") % 40).alias("k"), (F.col("id") % 7).alias("n"), F.sqrt("id").alias("x"))
    whole, made = aggregate(df, ["k"], AGGS), aggregate(df, ["k"], AGGS, dealt=True, in_task=60)
    assert made.rdd.getNumPartitions() == 10 and plain(made) == plain(whole)
    assert made._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Exchange hashpartitioning") == 1


def test_keys_of_many_rows_are_not_gathered(spark):
    df = spark.range(600).select(F.when(F.col("id") < 300, -1).otherwise(F.col("id") % 40).alias("k"), (F.col("id") % 7).alias("n"), F.sqrt("id").alias("x"))
    made = aggregate(df, ["k"], AGGS, dealt=True, hot=100)
    assert "Union" in made._jdf.queryExecution().analyzed().toString() and plain(made) == plain(aggregate(df, ["k"], AGGS))


def test_a_join_of_many_rows_has_more_tasks_than_a_shuffle(spark):
    few, many = (view(spark, "/root/testdata/sf0.001", "installments", n) for n in (1 << 20, 600))
    assert plain(few.select(*few.columns[:4])) == plain(many.select(*few.columns[:4]))
    assert many.rdd.getNumPartitions() >= 10

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from weftline import config, ensemble, models, nulls, selection
from weftline.operators.encode import dummies, factorize, vocabulary
from weftline.operators.folds import fold_of
from weftline.operators.joins import one_to_one, star
from weftline.operators.ranking import auc, class_comparison, rank_sum_test, with_rank
from weftline.plans.fusion import Agg, aggregate
from weftline.sources.credit import Sources


def test_missing_values_and_zero_divisors(spark):
    df = spark.createDataFrame([(1.0, 0.0), (float("nan"), 2.0), (None, 1.0), (3.0, 2.0)], "a double, b double")
    found = [tuple(r) for r in nulls.without_nan(df).select(nulls.ratio(F.col("a"), F.col("b")), nulls.ratio_or_zero(F.col("a"), F.col("b")), nulls.flag(F.col("a") > 2)).collect()]
    assert found == [(None, 0.0, 0), (None, None, 0), (None, None, 0), (1.5, 1.5, 1)]


def test_conditional_and_last_rows_share_one_aggregation(spark):
    df = spark.createDataFrame([(1, 3, 5.0, "a"), (1, 2, None, "a"), (1, 1, 7.0, "b"), (2, 1, 1.0, "b"), (None, 1, 9.0, "b")], "k bigint, t int, x double, s string")
    aggs = [Agg("n", "size"), Agg("a_sum", "sum", "x", where="s = 'a'"), Agg("last2", "mean", "x", last=2), Agg("slope", "trend", "t", last=3)]
    found = {r.k: (r.n, r.a_sum, r.last2, r.slope) for r in aggregate(df, ["k"], aggs, [F.desc("t")]).collect()}
    assert found == {1: (3, 5.0, 5.0, -1.0), 2: (1, None, 1.0, 0.0)}
    with pytest.raises(ValueError, match="one name"):
        aggregate(df, ["k"], aggs + aggs[:1])


def test_vocabulary_and_dummies_with_odd_names(spark):
    df = spark.createDataFrame([("it's",), ("b c",), (None,)], "`the col` string")
    made = dummies(vocabulary(df, ["the col"]))
    found = df.select(*[F.expr(e).alias(n) for n, e in made.items()])
    assert found.columns == ["the col_b c", "the col_it's", "the col_nan"]
    assert sorted(tuple(r) for r in found.collect()) == [(0, 0, 1), (0, 1, 0), (1, 0, 0)]
    assert vocabulary(df.limit(0), ["the col"]) == {"the col": []}


def test_ranks_and_tests_against_numpy(spark):
    rng = np.random.default_rng(3)
    x, y = rng.integers(0, 30, 400), rng.integers(0, 2, 400)
    df = spark.createDataFrame(pd.DataFrame({"i": range(400), "x": x, "y": y, "z": np.where(x % 5 == 0, np.nan, x)}))
    ranks = pd.Series(x).rank(method="average")
    got = with_rank(df, "x", "r", average=True).orderBy("i").toPandas()["r"]
    assert np.allclose(got, ranks)
    n1, n0 = y.sum(), (1 - y).sum()
    assert math.isclose(auc(df, "y", "x").first()[0], (ranks[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * n0))
    r = {r.c: r for r in class_comparison(nulls.without_nan(df), "y", ["x", "z"]).collect()}
    assert (r[0].median0, r[0].median1) == (np.median(x[y == 0]), np.median(x[y == 1]))
    z, p = rank_sum_test(df, "y", "x")
    assert selection.difference_stats(df, ["x"], "y")["x"][2] == pytest.approx(p)
    assert r[1].n == (x % 5 != 0).sum()


def test_clean_data_keeps_what_tells_classes_apart(spark):
    n = 200
    df = spark.createDataFrame(pd.DataFrame({"SK_ID_CURR": range(n), "TARGET": [float(i % 2) if i < 160 else None for i in range(n)], "one": 1.0, "tells": [float(i % 2 * 50 + i % 7) for i in range(n)], "noise": [float(i // 2 % 10) for i in range(n)]}))
    assert selection.clean_data(nulls.without_nan(df)).columns == ["SK_ID_CURR", "TARGET", "tells"]


def test_folds_are_even_and_stable(spark):
    df = spark.range(1003).select(F.col("id").alias("k"), (F.col("id") % 10 == 0).cast("int").alias("t"))
    sizes = fold_of(df, "k", "t").groupBy("t", "fold").count().collect()
    for t in (0, 1):
        counts = [r["count"] for r in sizes if r.t == t]
        assert len(counts) == 5 and max(counts) - min(counts) <= 1


def test_codes_joins_and_stacks(spark):
    df = spark.createDataFrame([(1, "b"), (2, None), (3, "a"), (4, "b")], "k bigint, s string")
    assert [r.s for r in factorize(df, ["s"], [F.col("k")]).orderBy("k").collect()] == [0, -1, 1, 0]
    with pytest.raises(ValueError):
        star(df, [df], "k")
    with pytest.raises(ValueError):
        one_to_one(df.union(df), df, ["k"])
    wide = ensemble.stack(df.select("k"), [df.select("k", F.lit(0.5).alias("r_PREDICTION")).filter("k < 3")], "k")
    assert [r[1] for r in wide.orderBy("k").collect()] == [0.5, 0.5, None, None]


def test_cross_validation_predicts_every_client(spark):
    rows = [(i, float(i % 2) if i < 200 else None, float(i % 2 * 2 + i % 5), None if i % 9 == 0 else 1.0) for i in range(240)]
    df = spark.createDataFrame(rows, "SK_ID_CURR bigint, TARGET double, x double, y double")
    made = models.cross_validate(df, "LogisticRegression", folds=3)
    assert made.score > 0.7 and made.oof.count() == 200 and made.test.count() == 40


def test_csv_sources_and_configuration(spark, tmp_path):
    (tmp_path / "application_train.csv").write_text("SK_ID_CURR,TARGET,CODE_GENDER,DAYS_EMPLOYED\n1,0,XNA,365243\n2,1,F,-5\n")
    (tmp_path / "application_test.csv").write_text("SK_ID_CURR,CODE_GENDER,DAYS_EMPLOYED\n3,M,-7\n")
    found = Sources(spark, str(tmp_path))["application"].orderBy("SK_ID_CURR").select("SK_ID_CURR", "TARGET", "CODE_GENDER", "DAYS_EMPLOYED").collect()
    assert [tuple(r) for r in found] == [(1, 0, None, None), (2, 1, "F", -5), (3, None, "M", -7)]
    made = config.parse("{'features': ['ApplicationFeatures'], 'model': {'name': 'LogisticRegression', 'kfold_params': {'n_splits': 4}}, 'normalize_feature': True}")
    assert made.folds == 4 and made.normalize_feature and made.model == "LogisticRegression"
    with pytest.raises(ValueError):
        config.parse('{"features": [], "model": {"name": "LightGBM"}}')

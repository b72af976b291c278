"""Nearest neighbours over blocks of training rows and of queries."""

from __future__ import annotations

import numpy as np
import pytest

from weftline import models


def test_blocks_of_rows_and_queries_give_the_nearest_of_all(spark):
    rng = np.random.default_rng(3)
    x, y, q = rng.standard_normal((130, 3)), rng.integers(0, 2, 130), rng.standard_normal((70, 3))
    train = spark.createDataFrame([(*map(float, v), float(t)) for v, t in zip(x, y)], "f0 double, f1 double, f2 double, label double")
    asked = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(q)], "id bigint, f0 double, f1 double, f2 double")
    expected = {i: y[np.argsort(((x - v) ** 2).sum(1))[:5]].mean() for i, v in enumerate(q)}
    found = models.knn(train, asked, 3, {}, ["id"], block_rows=40)
    assert {r.id: r.prediction for r in found.collect()} == pytest.approx(expected)

"""Searches for weights score their candidates on all training rows."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from weftline import ensemble
from weftline.features.topics import category_vectors
from weftline.operators.ranking import auc, with_rank
from weftline.sources.credit import CLIENT, TARGET


def test_searches_score_on_all_rows(spark, monkeypatch):
    monkeypatch.setattr(ensemble, "MAX_SEARCH_ROWS", 50, raising=False)  # where a sample was taken beyond
    rng = random.Random(4)
    rows = []
    for i in range(600):
        y = float(rng.random() < 0.3)
        rows.append((i, y if i % 10 else None, *(round(min(0.99, max(0.01, 0.4 + 0.2 * y + rng.gauss(0, 0.3))), 3) for _ in range(2))))
    df = spark.createDataFrame(rows, f"{CLIENT} bigint, {TARGET} double, `a b` double, c double")
    train = df.filter(f"{TARGET} is not null")
    score, weights, power, _ = ensemble.search_power_blend(df, ["a b", "c"], evals=6)
    assert score == pytest.approx(auc(ensemble.power_blend(train, weights, power), TARGET, "prediction").first()[0], abs=1e-9)
    score, weights, _ = ensemble.search_rank_average(df, ["a b", "c"], evals=6)
    ranked = with_rank(with_rank(train, "a b", "r0"), "c", "r1")
    mixed = ranked.withColumn("mix", F.lit(weights["a b"]) * F.col("r0") + F.lit(weights["c"]) * F.col("r1"))
    assert score == pytest.approx(auc(mixed, TARGET, "mix").first()[0], abs=1e-9)


def test_parzen_estimators_beat_random_draws():
    space = {"x": ensemble.Stepped(-5.0, 5.0, 0.01), "y": ensemble.Stepped(0.0, 1.0, 0.001), "n": ensemble.Stepped(1, 300, 1)}
    value = lambda p: -((p["x"] - 1.3) ** 2) - 40 * (p["y"] - 0.2) ** 2 - ((p["n"] - 40) / 60) ** 2
    by = {"parzen": [], "random": []}
    for seed in range(12):
        for batch in (1, 4):
            search = ensemble.Parzen(space, seed, start=15)
            best, point = search.run_batches(lambda points: [value(p) for p in points], 80, batch)
            by["parzen"].append(best)
            assert len(search.trials) == 80 and best == max(t[0] for t in search.trials) == value(point)
            assert all(s.low <= p[k] <= s.high and abs(s.snap(p[k]) - p[k]) < 1e-9 for _, p in search.trials for k, s in space.items())
        draw = random.Random(seed)
        by["random"] += [max(value({k: d(draw) for k, d in space.items()}) for _ in range(80))] * 2
    assert sum(by["parzen"]) / 24 > 0.5 * sum(by["random"]) / 24
    assert sum(a > b for a, b in zip(by["parzen"], by["random"])) >= 18


def test_parzen_mixtures_are_densities():
    m = ensemble.Mixture([0.1, 0.1, 0.7], 0.0, 2.0)
    grid = [2 * (i + 0.5) / 4000 for i in range(4000)]
    assert sum(map(m.density, grid)) * 2 / 4000 == pytest.approx(1, abs=1e-3)
    assert m.density(0.1) > m.density(1.9) > 0 and all(0 <= m.draw(random.Random(i)) <= 2 for i in range(50))


def test_topic_mixtures_of_planted_topics(spark):
    """Categories of two kinds occur with words of two kinds; mixtures tell the kinds apart, and a category without words is none."""
    rng = random.Random(3)
    rows = [(i, f"c{i % 6}", f"{'ab'[i % 6 % 2]}{rng.randrange(4)}" if rng.random() < 0.95 else "a0") for i in range(600)] + [(600, None, "a1"), (601, "c9", None)]
    df = spark.createDataFrame(rows, f"{CLIENT} bigint, job string, place string")
    found = {r[CLIENT]: [r[f"job_LDA_place_dim{k}"] for k in range(2)] for r in category_vectors(df, CLIENT, "job", "place", topics=2).collect()}
    assert len(found) == 602 and found[600] == found[601] == [None, None]
    main = {f"c{i}": max(range(2), key=lambda k: found[i][k]) for i in range(6)}
    assert main["c0"] == main["c2"] == main["c4"] != main["c1"] == main["c3"] == main["c5"]
    assert all(max(found[i]) > 0.8 and sum(found[i]) == pytest.approx(1) for i in range(6))
    assert {str(found[i]) for i in range(0, 600, 6)} == {str(found[0])}

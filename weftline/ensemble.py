"""Stacking, blending and searches over earlier predictions."""

from __future__ import annotations

import json
import math
import random
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .models import Result, cross_validate
from .nulls import col
from .operators.ranking import auc, class_comparison, with_rank
from .settle import settle
from .sources.credit import CLIENT, TARGET, split
from .sources.runs import OOF, TEST, prediction_column, read_run, run_folders, runs_above, stack

SEARCH_BATCH = 20


def power_blend(df: DataFrame, weights: dict[str, float], power: float, name: str = "prediction") -> DataFrame:
    """df with the weighted sum of powers of prediction columns; weights are scaled to sum to 1."""
    total = sum(weights.values())
    terms = [F.lit(w / total) * F.pow(col(c), F.lit(float(power))) for c, w in weights.items()]
    return df.withColumn(name, sum(terms[1:], terms[0]))


def rank_average(df: DataFrame, weights: dict[str, float], name: str = "prediction") -> DataFrame:
    """df with the mean of weighted ranks of prediction columns, scaled to 0 to 1. Ranks are among df's own rows."""
    out = df
    for i, c in enumerate(weights):
        out = with_rank(out, c, f"__rank{i}")
    terms = [F.col(f"__rank{i}") * F.lit(w) for i, w in enumerate(weights.values())]
    mixed = out.withColumn("__mix", sum(terms[1:], terms[0]) / len(weights))
    low, high = mixed.agg(F.min("__mix"), F.max("__mix")).first()
    spread = (high or 0) - (low or 0)
    scaled = (F.col("__mix") - F.lit(low)) / spread if spread else F.lit(0.0)
    return mixed.select(*[col(c) for c in df.columns], scaled.alias(name))


class Search:
    """Seeded search for a maximum: random points first, then points near the best ones with a narrowing spread."""

    def __init__(self, space: dict[str, Callable[[random.Random], float]], seed: int = 0, start: int = 20, best: int = 5) -> None:
        self.space, self.random, self.start, self.best = space, random.Random(seed), start, best
        self.trials: list[tuple[float, dict]] = []

    def ask(self) -> dict:
        fresh = {k: draw(self.random) for k, draw in self.space.items()}
        if len(self.trials) < self.start:
            return fresh
        parent = self.random.choice(sorted(self.trials, key=lambda t: -t[0])[: self.best])[1]
        share = max(0.15, self.start / len(self.trials))
        return {k: fresh[k] if self.random.random() < share else parent[k] for k in self.space}

    def run(self, objective: Callable[[dict], float], evals: int) -> tuple[float, dict]:
        for _ in range(evals):
            point = self.ask()
            self.trials.append((objective(point), point))
        return max(self.trials, key=lambda t: t[0])

    def run_batches(self, objective: Callable[[list[dict]], list[float]], evals: int, batch: int = SEARCH_BATCH) -> tuple[float, dict]:
        """As run, but points of a batch are drawn before any of them is scored."""
        while len(self.trials) < evals:
            points = [self.ask() for _ in range(min(batch, evals - len(self.trials)))]
            self.trials += zip(objective(points), points)
        return max(self.trials, key=lambda t: t[0])


def _predictions(df: DataFrame, columns: list[str], target: str) -> tuple[DataFrame, list[str]]:
    """(__y, __p0, ...) of all training rows with every prediction, and the names of the predictions."""
    names = [f"__p{i}" for i in range(len(columns))]
    train = split(df, target)[0].select(col(target).cast("double").alias("__y"), *[col(c).cast("double").alias(n) for c, n in zip(columns, names)])
    return train.na.drop(), names


def aucs(df: DataFrame, target: str, scores: list[Column]) -> list[float]:
    """Exact AUC of each score over all rows in one pass, ties counting half; 0 unless both classes occur."""
    names = [f"__s{i}" for i in range(len(scores))]
    rows = class_comparison(df.select(col(target).alias("__y"), *[s.alias(n) for s, n in zip(scores, names)]), "__y", names).select("c", "n", "n1", "rank_sum").collect()
    found = {r.c: (r.rank_sum - r.n1 * (r.n1 + 1) / 2) / (r.n1 * (r.n - r.n1)) for r in rows if 0 < r.n1 < r.n}
    return [found.get(i, 0.0) for i in range(len(scores))]


def _mixed(terms: list[Column]) -> Column:
    return sum(terms[1:], terms[0])


def search_power_blend(df: DataFrame, columns: list[str], target: str = TARGET, evals: int = 200, seed: int = 0) -> tuple[float, dict[str, float], int, Search]:
    """(AUC, weights that sum to 1, power, search) of the best power blend found; every blend is scored on all rows."""
    made, names = _predictions(df, columns, target)
    train = settle(made, "predictions")
    space = {c: (lambda r: round(r.random(), 3)) for c in columns} | {"power": lambda r: r.randint(1, 8)}

    def objective(points: list[dict]) -> list[float]:
        usable = [p for p in points if sum(p[c] for c in columns) > 0]
        blends = []
        for p in usable:
            total = sum(p[c] for c in columns)
            blends.append(_mixed([F.lit(p[c] / total) * F.pow(F.col(n), F.lit(float(p["power"]))) for c, n in zip(columns, names)]))
        scored = iter(aucs(train, "__y", blends) if blends else [])
        return [next(scored) if sum(p[c] for c in columns) > 0 else 0.0 for p in points]

    search = Search(space, seed)
    score, best = search.run_batches(objective, evals)
    total = sum(best[c] for c in columns) or 1.0
    return score, {c: best[c] / total for c in columns}, int(best["power"]), search


def search_rank_average(df: DataFrame, columns: list[str], target: str = TARGET, evals: int = 200, seed: int = 0) -> tuple[float, dict[str, float], Search]:
    """(AUC, weights, search) of the best weighted rank average found; ranks are among all training rows."""
    made, names = _predictions(df, columns, target)
    ranked = settle(made, "predictions")
    for n in names:
        ranked = with_rank(ranked, n, f"{n}_rank")
    train = settle(ranked.select("__y", *[f"{n}_rank" for n in names]), "ranks")
    space = {c: (lambda r: round(r.random(), 3)) for c in columns}

    def objective(points: list[dict]) -> list[float]:
        return aucs(train, "__y", [_mixed([F.lit(p[c]) * F.col(f"{n}_rank") for c, n in zip(columns, names)]) for p in points])

    search = Search(space, seed)
    score, best = search.run_batches(objective, evals)
    return score, best, search


def greedy_stacking(df: DataFrame, candidates: list[str], model: str = "LogisticRegression", params: dict | None = None, key: str = CLIENT, target: str = TARGET, folds: int = 5, max_rounds: int | None = None, at_once: int = 4) -> tuple[float, list[str], Result | None]:
    """(score, columns, result): the candidate that raises the out-of-fold AUC most is added until none does. A round's
    candidates are independent: `at_once` of them are fitted side by side."""
    chosen: list[str] = []
    best, result = -1.0, None
    while len(chosen) < min(len(candidates), max_rounds or len(candidates)):
        left = [c for c in candidates if c not in chosen]
        with ThreadPoolExecutor(at_once) as pool:
            tried = list(pool.map(lambda c: cross_validate(df, model, params, key, target, folds, columns=[*chosen, c]), left))  # noqa: B023
        score, c, r = max(((r.score, c, r) for c, r in zip(left, tried)), key=lambda t: (t[0], t[1]))
        if score <= best:
            break
        best, result = score, r
        chosen.append(c)
    return best, chosen, result


#: What tune() draws: steps between two bounds.
# Names and ranges of parameters.
SPACE = {
    "learning_rate": (0.01, 0.02, 0.001),
    "max_bin": (5, 500, 5),
    "num_leaves": (16, 128, 1),
    "min_child_samples": (1, 300, 1),
    "colsample_bytree": (0.01, 0.2, 0.01),
    "subsample": (0.01, 0.8, 0.01),
    "min_gain_to_split": (0.0, 5.0, 0.1),
    "reg_alpha": (0, 100, 0.1),
    "reg_lambda": (0, 100, 0.1),
}


@dataclass(frozen=True)
class Stepped:
    """A number between two bounds, in steps; called with a random.Random it draws one."""

    low: float
    high: float
    step: float

    def snap(self, x: float) -> float:
        return min(self.high, max(self.low, round(round(x / self.step) * self.step, 6)))

    def __call__(self, r: random.Random) -> float:
        return self.snap(r.uniform(self.low, self.high))


class Mixture:
    """A Parzen estimate on an interval: a normal kernel on each value, as wide as the way to the farther neighbour, cut off at the
    bounds, and one flat share that keeps every place possible."""

    def __init__(self, values: list[float], low: float, high: float) -> None:
        self.low, self.high, self.at = low, high, sorted(values)
        span, ends = high - low, [low, *sorted(values), high]
        least = span / min(100, len(values) + 1)
        self.wide = [min(span, max(least, b - a, c - b)) or 1.0 for a, b, c in zip(ends, ends[1:], ends[2:])]

    def draw(self, r: random.Random) -> float:
        k = r.randrange(len(self.at) + 1)
        if k == len(self.at):
            return r.uniform(self.low, self.high)
        return min(self.high, max(self.low, r.gauss(self.at[k], self.wide[k])))

    def density(self, x: float) -> float:
        flat = 1 / (self.high - self.low) if self.high > self.low else 1.0
        below = lambda y, m, s: 0.5 * (1 + math.erf((y - m) / (s * math.sqrt(2))))
        kernels = 0.0
        for m, s in zip(self.at, self.wide):
            inside = max(1e-12, below(self.high, m, s) - below(self.low, m, s))
            kernels += math.exp(-(((x - m) / s) ** 2) / 2) / (s * math.sqrt(2 * math.pi) * inside)
        return (flat + kernels) / (len(self.at) + 1)


class Parzen(Search):
    """Tree-structured Parzen estimators (Bergstra et al., 2011): after `start` random trials each parameter is drawn from the
    density of the good trials' values, and of DRAWS of them the one is taken that is likeliest under the good against the others.
    Points that are asked for and not scored yet count with the others, so several trials may run at once."""

    DRAWS = 24

    def __init__(self, space: dict[str, Callable[[random.Random], float]], seed: int = 0, start: int = 20) -> None:
        super().__init__(space, seed, start)
        self.pending: list[dict] = []

    def ask(self) -> dict:
        if len(self.trials) < self.start:
            point = {k: draw(self.random) for k, draw in self.space.items()}
        else:
            ranked = [p for _, p in sorted(self.trials, key=lambda t: -t[0])]
            many = min(25, math.ceil(0.25 * math.sqrt(len(ranked))) + 1)
            good, rest = ranked[:many], [*ranked[many:], *self.pending]
            point = {k: self._drawn(k, [p[k] for p in good], [p[k] for p in rest]) for k in self.space}
        self.pending.append(point)
        return point

    def _drawn(self, name: str, good: list[float], rest: list[float]) -> float:
        of = self.space[name]
        if not isinstance(of, Stepped):  # no bounds to estimate over
            return self.random.choice([*good, of(self.random)])
        a, b = Mixture(good, of.low, of.high), Mixture(rest, of.low, of.high)
        drawn = [of.snap(a.draw(self.random)) for _ in range(self.DRAWS)]
        return max(drawn, key=lambda x: a.density(x) / b.density(x))

    def run_batches(self, objective: Callable[[list[dict]], list[float]], evals: int, batch: int = SEARCH_BATCH) -> tuple[float, dict]:
        while len(self.trials) < evals:
            points = [self.ask() for _ in range(min(batch, evals - len(self.trials)))]
            self.trials += zip(objective(points), points)
            self.pending.clear()
        return max(self.trials, key=lambda t: t[0])


def tune(
    df: DataFrame, space: dict[str, Callable] | None = None, model: str = "LightGBM", evals: int = 20, seed: int = 0, fixed: dict | None = None, at_once: int = 2, **options
) -> tuple[float, dict, Search]:
    """(AUC, parameters, search) of the best of `evals` cross-validated models, of which `at_once` run together; `fixed`
    parameters are never drawn."""
    search = Parzen(space or {k: Stepped(*v) for k, v in SPACE.items()}, seed, start=max(2, evals // 4))

    def scored(points: list[dict]) -> list[float]:
        with ThreadPoolExecutor(at_once) as pool:
            return list(pool.map(lambda p: cross_validate(df, model, {**(fixed or {}), **p}, **options).score or 0.0, points))

    score, best = search.run_batches(scored, evals, at_once)
    return score, best, search


def blended(df: DataFrame, columns: list[str], evals: int = 200, seed: int = 0, target: str = TARGET, key: str = CLIENT) -> tuple[Result, Search]:
    """The best power blend found, applied to training rows and to rows to predict, and the search."""
    score, weights, power, search = search_power_blend(df, columns, target, evals, seed)
    oof, test = (power_blend(x, weights, power).select(*[col(c) for c in (key, target)], "prediction") for x in split(df, target))
    return Result(oof, test.drop(target), {"Full": {"score": score, "weights": weights, "power": power}}), search


def rank_averaged(df: DataFrame, columns: list[str], evals: int = 200, seed: int = 0, target: str = TARGET, key: str = CLIENT) -> tuple[Result, Search]:
    """The best weighted rank average found, applied to training rows and to rows to predict, whose ranks are among
    themselves, and the search."""
    score, weights, search = search_rank_average(df, columns, target, evals, seed)
    oof, test = (rank_average(x, weights).select(*[col(c) for c in (key, target)], "prediction") for x in split(df, target))
    return Result(oof, test.drop(target), {"Full": {"score": score, "weights": weights}}), search


def column_samples(df: DataFrame, columns: list[str], share: float, runs: int, seed: int = 0, **options) -> list[tuple[list[str], Result]]:
    """Cross-validated models over random subsets of the columns, seeded; each subset has one column at least."""
    draw, out = random.Random(seed), []
    for _ in range(runs):
        chosen = [c for c in columns if draw.random() < share] or [draw.choice(columns)]
        out.append((chosen, cross_validate(df, columns=chosen, **options)))
    return out


def write_run(result: Result, folder: str, config: dict, features: list[str], key: str = CLIENT, target: str = TARGET, search: Search | None = None) -> None:
    """A run's folder: out-of-fold and test predictions as CSV, result.json, and as Parquet the importances and, after a
    search, its trials in order."""
    spark = result.test.sparkSession
    for part, name in ((result.oof, OOF), (result.test, TEST)):
        if part is not None:
            part.select(key, col("prediction").alias(target)).write.mode("overwrite").csv(f"{folder}/{name}", header=True)
    record = {"trials": result.trials, "config": config, "features_detail": {"number": len(features), "names": features}}
    spark.createDataFrame([(json.dumps(record),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/result.json")
    if result.importance:
        rows = sorted(result.importance.items(), key=lambda x: (-x[1], x[0]))
        spark.createDataFrame(rows, "feature string, importance double").coalesce(1).write.mode("overwrite").parquet(f"{folder}/importance.parquet")
    if search:
        tried = [(i, float(score), json.dumps(point)) for i, (score, point) in enumerate(search.trials)]
        spark.createDataFrame(tried, "trial int, score double, parameters string").coalesce(1).write.mode("overwrite").parquet(f"{folder}/trials.parquet")


__all__ = ["auc", "greedy_stacking", "power_blend", "prediction_column", "rank_average", "read_run", "run_folders", "runs_above", "stack", "write_run"]

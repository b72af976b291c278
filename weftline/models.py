"""Cross-validated models on pyspark.ml: out-of-fold and test predictions, scores, importances."""

from __future__ import annotations

import math
import re
import time
from collections.abc import Mapping
from dataclasses import dataclass, field

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler, VectorSlicer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .nulls import col, finite_or_zero
from .operators.blocks import Blocks, class_vectors
from .operators.folds import fold_of
from .operators.ranking import auc, class_comparison
from .selection import numeric
from .settle import settle, unsettle
from .sources.credit import CLIENT, TARGET, split

MISSING = -999999.0  # trees have no missing values here: a value apart from all others


@dataclass
class Result:
    """oof: (key, target, prediction) of training rows; test: (key, prediction); trials: by fold and Full."""

    oof: DataFrame | None
    test: DataFrame
    trials: dict = field(default_factory=dict)
    importance: dict[str, float] = field(default_factory=dict)

    @property
    def score(self) -> float:
        return self.trials["Full"]["score"]


def _rename(params: Mapping, names: Mapping[str, str]) -> dict:
    return {names[k]: v for k, v in params.items() if k in names}


ROWS = "__rows"  # of training, told to those who make an estimator
STOP = ("early_stopping_rounds", "early_stopping_round", "early_stopping")


def _share(x: float) -> str:
    """A share of the columns as pyspark.ml's text, which takes decimals above 0 and up to 1."""
    return str(float(min(1.0, max(1e-6, float(x)))))


def lightgbm(params: Mapping):
    """Grown by leaves there, by levels here: a tree of n leaves has log2(n) levels."""
    known = {
        "n_estimators": "maxIter", "num_boost_round": "maxIter", "num_iterations": "maxIter", "max_depth": "maxDepth", "learning_rate": "stepSize", "subsample": "subsamplingRate",
        "bagging_fraction": "subsamplingRate", "random_state": "seed", "seed": "seed", "min_child_samples": "minInstancesPerNode", "min_data_in_leaf": "minInstancesPerNode",
        "min_gain_to_split": "minInfoGain", "min_split_gain": "minInfoGain", "max_bin": "maxBins",
    }
    made = {"maxIter": 20, "maxDepth": 4, "seed": 0}
    if "num_leaves" in params:
        made["maxDepth"] = max(1, min(30, math.ceil(math.log2(max(2, params["num_leaves"])))))
    return _boosted({**made, **_rename(params, known)}, params, ("colsample_bytree", "feature_fraction"))


def xgboost(params: Mapping):
    """Grown by levels, six of them if nothing else is said."""
    known = {
        "n_estimators": "maxIter", "num_boost_round": "maxIter", "max_depth": "maxDepth", "eta": "stepSize", "learning_rate": "stepSize", "subsample": "subsamplingRate", "random_state": "seed",
        "seed": "seed", "min_child_weight": "minInstancesPerNode", "gamma": "minInfoGain", "max_bin": "maxBins",
    }
    return _boosted({"maxIter": 20, "maxDepth": 6, "stepSize": 0.3, "seed": 0, **_rename(params, known)}, params, ("colsample_bytree", "colsample_bylevel"))


def _boosted(made: dict, params: Mapping, shares: tuple[str, ...]):
    for whole in ("maxIter", "maxDepth", "minInstancesPerNode", "maxBins", "seed"):
        if whole in made:
            made[whole] = max(0 if whole == "seed" else 2 if whole == "maxBins" else 1, int(made[whole]))
    if made["maxDepth"] > 30:
        made["maxDepth"] = 30
    for name in shares:
        if name in params:
            made["featureSubsetStrategy"] = _share(params[name])
    return GBTClassifier(**made)


def patience(params: Mapping) -> int:
    """Rounds without a better score after which boosting stops; 0: never."""
    return next((int(params[k]) for k in STOP if params.get(k)), 0)


def forest(params: Mapping):
    """Trees of regression on the 0/1 target: their variance is half of Gini's impurity, so they grow alike, and a leaf's mean is
    its share of 1. The classifier's own trees are cut back to where leaves predict different classes, which leaves nothing of
    them where one class is rare."""
    known = {"n_estimators": "numTrees", "max_depth": "maxDepth", "random_state": "seed", "min_samples_leaf": "minInstancesPerNode"}
    return RandomForestRegressor(**{"numTrees": 20, "maxDepth": 5, "seed": 0, "featureSubsetStrategy": "sqrt", **_rename(params, known)})


def logistic(params: Mapping):
    """The penalty is half the squared weights against C times the sum of the rows' losses, so the library's share falls
    with the number of rows; weights are penalised as they are, not by their columns' spread."""
    made = {"maxIter": params.get("max_iter", 100), "regParam": 1.0 / (params.get("C", 1.0) * max(1, params.get(ROWS, 1)))}
    return LogisticRegression(**made, standardization=False)


#: model name -> (estimator of its parameters, whether missing values become 0 rather than a value apart)
MODELS = {
    "LightGBM": (lightgbm, False),
    "XGBoost": (xgboost, False),
    "LogisticRegression": (logistic, True),
    "RandomForest": (forest, True),
    "KNN": (None, True),
}


def register_model(name: str, make, zero: bool = True) -> None:
    """A model of one's own: make(params) gives a pyspark.ml classifier; zero: missing values become 0."""
    if name in MODELS:
        raise ValueError(f"{name} is registered")
    MODELS[name] = (make, zero)


def features_of(df: DataFrame, key: str = CLIENT, target: str = TARGET) -> list[str]:
    """Numeric columns that aren't keys, target or ordinals."""
    return [c for c in numeric(df, (key, target, "index", "fold")) if not c.startswith("SK_ID_")]


def prepared(df: DataFrame, key: str, target: str, columns: list[str], zero: bool) -> DataFrame:
    """(key, target, fold if there, f0 f1 ...): names are numbered, as an assembler can't take names with dots."""
    value = (lambda c: finite_or_zero(col(c))) if zero else (lambda c: F.coalesce(F.nanvl(col(c).cast("double"), F.lit(None)), F.lit(MISSING)))
    keep = [c for c in (key, target, "fold") if c in df.columns]
    return df.select(*[col(c) for c in keep], *[value(c).alias(f"f{i}") for i, c in enumerate(columns)])


def pipeline(model: str, params: Mapping, n: int, scale: bool = False, rows: int = 1) -> Pipeline:
    stages = [VectorAssembler(inputCols=[f"f{i}" for i in range(n)], outputCol="x", handleInvalid="keep")]
    at = "x"
    if scale:
        stages.append(StandardScaler(inputCol="x", outputCol="scaled", withMean=True, withStd=True))
        at = "scaled"
    estimator = MODELS[model][0]({**params, ROWS: rows})
    return Pipeline(stages=[*stages, estimator.setFeaturesCol(at).setLabelCol("label")])


def predicted(fitted, df: DataFrame, keep: list[str]) -> DataFrame:
    made = fitted.transform(df)
    value = vector_to_array("probability")[1] if "probability" in made.columns else F.col("prediction")
    return made.select(*map(col, keep), value.alias("prediction"))


def split_counts(trees: list, n: int) -> list[int]:
    """How many inner nodes of the trees split by each of n columns."""
    out = [0] * n
    for tree in trees:
        for feature in re.findall(r"If \(feature (\d+) ", tree.toDebugString):
            out[int(feature)] += 1
    return out


#: Models whose importance of a column is the number of its splits; that of others is its share of the gain.
BY_SPLITS = {"LightGBM"}


def importances(fitted, columns: list[str], model: str = "", trees: int | None = None) -> dict[str, float]:
    """Importance of each column, of the first `trees` trees if that is said and splits are counted."""
    last = fitted.stages[-1]
    if model in BY_SPLITS and hasattr(last, "trees"):
        values = split_counts(last.trees[:trees], len(columns))
    else:
        values = last.featureImportances.toArray() if hasattr(last, "featureImportances") else np.abs(last.coefficients.toArray()) if hasattr(last, "coefficients") else []
    return dict(zip(columns, map(float, values)))


def staged(fitted, df: DataFrame, keep: list[str], first: int | None = None) -> tuple[DataFrame, list[str]]:
    """(keep, s0, s1, ...): the margin of each row after the first tree, the second, ...; and the names of the margins."""
    last = fitted.stages[-1]
    for stage in fitted.stages[:-1]:
        df = stage.transform(df)
    trees, weights, at = last.trees[:first], last.treeWeights, last.getFeaturesCol()
    rows = df.select(*map(col, keep), at)
    for i, tree in enumerate(trees):
        rows = tree.setFeaturesCol(at).setPredictionCol(f"__t{i}").transform(rows)
    margins, sum_ = [], F.lit(0.0)
    for i, w in enumerate(weights[: len(trees)]):
        sum_ = sum_ + F.col(f"__t{i}") * float(w)
        margins.append(sum_.alias(f"s{i}"))
    return rows.select(*map(col, keep), *margins), [f"s{i}" for i in range(len(trees))]


def best_iteration(scores: list[float | None], patience: int) -> int:
    """The number of trees of the best score when boosting stops `patience` rounds after it; of equal ones the first."""
    best, at = -math.inf, 0
    for i, s in enumerate(scores):
        if s is not None and s > best:
            best, at = s, i
        elif i - at >= patience:
            break
    return at + 1


def stopped(fitted, held: DataFrame, target: str, rounds: int) -> tuple[int, list[float | None]]:
    """Trees up to the best round, and the AUC after each tree on the rows held out. All rounds' AUCs come from one pass."""
    margins, names = staged(fitted, held, [target])
    found = {r.c: r for r in class_comparison(margins, target, names).collect()}  # a row for each tree
    scores = []
    for i in range(len(names)):
        r = found.get(i)
        n1, n0 = (float(r.n1), float(r.n - r.n1)) if r else (0.0, 0.0)
        scores.append((float(r.rank_sum) - n1 * (n1 + 1) / 2) / (n1 * n0) if n1 and n0 else None)
    return best_iteration(scores, rounds), scores


def of_trees(fitted, df: DataFrame, keep: list[str], trees: int) -> DataFrame:
    """Predictions of the first trees of a boosted model, by the probability that all of them would give."""
    margins, names = staged(fitted, df, keep, trees)
    return margins.select(*map(col, keep), (1 / (1 + F.exp(-2 * F.col(names[-1])))).alias("prediction"))


def cross_validate(
    df: DataFrame, model: str = "LightGBM", params: Mapping | None = None, key: str = CLIENT, target: str = TARGET, folds: int = 5, seed: int = 47,
    columns: list[str] | None = None, scale: bool = False,
) -> Result:
    """Fit on all folds but one, predict that one and the rows without a target; test predictions are means over folds.

    Boosted trees with early stopping in their parameters grow all their trees; the fold left out tells after how many of
    them the score was best when it hadn't risen for that many rounds, and these predict. Tables are written once and read by
    every fold; they are deleted at the end."""
    params, columns = params or {}, columns or features_of(df, key, target)
    train, test = split(df, target)
    zero = MODELS[model][1]
    train = settle(prepared(fold_of(train, key, target, folds, seed), key, target, columns, zero).withColumn("label", col(target).cast("double")), "train")
    test = settle(prepared(test, key, target, columns, zero), "test")
    sizes = {r["fold"]: r["count"] for r in train.groupBy("fold").count().collect()}
    oof, tests, trials, weight = None, None, {}, {}
    for f in range(folds):
        began = time.time()
        part, held = train.filter(F.col("fold") != f), train.filter(F.col("fold") == f)
        trials[f"Fold{f + 1}"] = {}
        if model == "KNN":
            own, other = knn(part, held, len(columns), params, [key, target]), knn(part, test, len(columns), params, [key])
        else:
            fitted = pipeline(model, params, len(columns), scale, sum(sizes.values()) - sizes.get(f, 0)).fit(part)
            trees = None
            if patience(params) and isinstance(fitted.stages[-1], GBTClassificationModel):
                trees, scores = stopped(fitted, held, target, patience(params))
                own, other = of_trees(fitted, held, [key, target], trees), of_trees(fitted, test, [key], trees)
                trials[f"Fold{f + 1}"] |= {"best_iteration": trees, "scores": scores}
            else:
                own, other = predicted(fitted, held, [key, target]), predicted(fitted, test, [key])
                if hasattr(fitted.stages[-1], "getNumTrees"):
                    trials[f"Fold{f + 1}"]["best_iteration"] = fitted.stages[-1].getNumTrees
            for c, v in importances(fitted, columns, model, trees).items():
                weight[c] = weight.get(c, 0.0) + v / folds
        own = own.withColumn("fold", F.lit(f))
        oof = own if oof is None else oof.unionByName(own)
        tests = other if tests is None else tests.unionByName(other)
        trials[f"Fold{f + 1}"]["elapsed_time"] = time.time() - began
    oof = settle(oof, "oof")
    tests = settle(tests.groupBy(key).agg(F.avg("prediction").alias("prediction")), "predictions")
    unsettle(train, test)
    for f in range(folds):
        trials[f"Fold{f + 1}"]["val_score"] = auc(oof.filter(F.col("fold") == f), target, "prediction").first()[0]
    scores = [t["val_score"] for t in trials.values() if t["val_score"] is not None]
    top = dict(sorted(weight.items(), key=lambda x: (-x[1], x[0]))[:10])
    trials["Full"] = {"score": auc(oof, target, "prediction").first()[0], "val_score_mean": float(np.mean(scores)) if scores else None, "val_score_std": float(np.std(scores)) if scores else None, "feature_importance_top10": top}
    return Result(oof.drop("fold"), tests, trials, weight)


def full_train(df: DataFrame, model: str, params: Mapping | None = None, key: str = CLIENT, target: str = TARGET, columns: list[str] | None = None, scale: bool = False) -> Result:
    """Fit on every row with a target; predict the others."""
    params, columns = params or {}, columns or features_of(df, key, target)
    train, test = (prepared(x, key, target, columns, MODELS[model][1]) for x in split(df, target))
    train = settle(train.withColumn("label", col(target).cast("double")), "train")
    if model == "KNN":
        return Result(None, knn(train, test, len(columns), params, [key]))
    fitted = pipeline(model, params, len(columns), scale, train.count()).fit(train)  # nothing is left out to watch
    unsettle(train)
    return Result(None, predicted(fitted, test, [key]), {}, importances(fitted, columns, model))


KNN_ROWS = 20_000


def knn(train: DataFrame, asked: DataFrame, n: int, params: Mapping, keep: list[str], block_rows: int = KNN_ROWS) -> DataFrame:
    """The share of label 1 among the k nearest training rows (Euclidean; ties by the row's label).

    Training rows and queries are dealt to blocks of about block_rows; each query keeps its k best of each block,
    and the best of these count. Work grows with the product of both, as exact neighbours do; no task holds more
    than a block of each."""
    import pandas as pd

    k = int(params.get("n_neighbors", 5))
    names = [f"f{i}" for i in range(n)]
    row_blocks, query_blocks = (max(1, -(-x.count() // block_rows)) for x in (train, asked))
    # by the key, else by the values: the same block whenever a task runs again
    of = lambda df: F.xxhash64(col(keep[0]) if keep[0] in df.columns else F.array(*names))
    dealt = lambda df, blocks: F.pmod(of(df), F.lit(blocks))
    every = lambda blocks: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint")))
    rows = train.select(F.array(*names).alias("v"), "label", dealt(train, row_blocks).alias("block")).withColumn("asked", every(query_blocks))
    queries = asked.select(*map(col, keep), F.array(*names).alias("v"), dealt(asked, query_blocks).alias("asked")).withColumn("block", every(row_blocks))

    def nearest(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({**{c: left[c][:0] for c in keep}, "d": [], "label": []})
        right = right.sort_values("label", kind="stable")
        a, b, y = np.stack(left["v"]), np.stack(right["v"]), right["label"].to_numpy()
        out, step = [], max(1, 4_000_000 // max(1, n * len(b)))
        for at in range(0, len(a), step):
            d = ((a[at : at + step, None] - b[None]) ** 2).sum(axis=2)
            best = np.argsort(d, axis=1, kind="stable")[:, :k]
            out.append((np.take_along_axis(d, best, 1), y[best]))
        d, labels = np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])
        made = left[keep].loc[left.index.repeat(d.shape[1])].reset_index(drop=True)
        return made.assign(d=d.ravel(), label=labels.ravel())

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in asked.select(*map(col, keep)).schema)
    found = queries.groupBy("block", "asked").cogroup(rows.groupBy("block", "asked")).applyInPandas(nearest, f"{fields}, d double, label double")
    best = F.slice(F.sort_array(F.collect_list(F.struct("d", "label"))), 1, k)
    return found.groupBy(*map(col, keep)).agg(best.alias("b")).select(*map(col, keep), F.aggregate("b", F.lit(0.0), lambda s, x: s + x["label"], lambda s: s / F.size("b")).alias("prediction"))


def shuffled_target(df: DataFrame, key: str, target: str, seed: int) -> DataFrame:
    """df whose targets are dealt anew: each row takes the target of the row of the same place in another order."""
    by = lambda s: fold_places(df, key, s)
    a, b = by(seed), by(seed + 1)
    dealt = a.select(col(key), "place").join(b.select(col(target).alias("__t"), "place"), "place").select(col(key), "__t")
    return df.drop(target).join(dealt, key).withColumnRenamed("__t", target)


def fold_places(df: DataFrame, key: str, seed: int) -> DataFrame:
    """df with a place 0 to n - 1 by a hash of key and seed."""
    everyone = df.withColumn("__all", F.lit(0))
    return fold_of(everyone.withColumn("__h", F.pmod(F.xxhash64(col(key), F.lit(seed)), F.lit(4294967296))), "__h", "__all", 2**31 - 1, seed).withColumnRenamed("fold", "place").drop("__all", "__h")


def null_importance(df: DataFrame, runs: int = 100, model: str = "RandomForest", params: Mapping | None = None, key: str = CLIENT, target: str = TARGET, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(actual, null) importances as (feature, importance_gain, importance_split, run): of the real target and of `runs` shuffled ones."""
    params, columns = params or {}, features_of(df, key, target)
    train = split(df, target)[0]

    # every run reads this table; what is shuffled are keys and targets alone
    ready = settle(prepared(train, key, target, columns, MODELS[model][1]), "ready")
    targets, rows = ready.select(col(key), col(target)), ready.count()

    def fit(data: DataFrame, run: int) -> list[tuple]:
        fitted = pipeline(model, params, len(columns), rows=rows).fit(data.withColumn("label", col(target).cast("double")))
        gain, splits = importances(fitted, columns), split_counts(getattr(fitted.stages[-1], "trees", []), len(columns))
        return [(c, gain.get(c, 0.0), s, run) for c, s in zip(columns, splits)]

    spark, schema = df.sparkSession, "feature string, importance_gain double, importance_split int, run int"
    null = [row for r in range(runs) for row in fit(ready.drop(target).join(shuffled_target(targets, key, target, seed + 2 * r), key), r)]
    out = spark.createDataFrame(fit(ready, 0), schema), spark.createDataFrame(null, schema)
    unsettle(ready)
    return out


TARGET_MODEL = {"n_estimators": 20, "max_depth": 5, "min_samples_leaf": 20}


def target_model(train: DataFrame, columns: list[str], target: str = TARGET, params: Mapping | None = None):
    """ask(columns) -> (AUC on the training rows, columns used) of a forest that tells targets apart: the fourth stage of
    :func:`selection.clean_data`. All columns are put into one vector and written once; each answer reads that table and picks
    its columns' places from the vector. Without both kinds of target the AUC is 0."""
    place = {c: i for i, c in enumerate(columns)}
    rows = prepared(train, target, target, columns, False).withColumn("label", col(target).cast("double"))
    vectors = VectorAssembler(inputCols=[f"f{i}" for i in range(len(columns))], outputCol="all", handleInvalid="keep")
    return answers(settle(vectors.transform(rows).select("label", "all"), "vectors"), place, params)


def target_model_of_blocks(blocks: Blocks, columns: list[str], params: Mapping | None = None):
    """:func:`target_model` of the columns of blocks, which become a vector without a table of as many columns."""
    rows = class_vectors(blocks, columns, MISSING).select("label", array_to_vector("all").alias("all"))
    return answers(settle(rows, "vectors"), {c: i for i, c in enumerate(columns)}, params)


def answers(table: DataFrame, place: Mapping[str, int], params: Mapping | None):
    """What :func:`target_model` gives, of (label, all): vectors in which the columns have these places."""
    both = table.agg(F.min("label"), F.max("label")).first()

    def ask(of: list[str]) -> tuple[float, list[str]]:
        if both[0] is None or both[0] == both[1]:
            return 0.0, []
        picked = VectorSlicer(inputCol="all", outputCol="x", indices=[place[c] for c in of]).transform(table)
        fitted = forest({**TARGET_MODEL, **(params or {})}).setFeaturesCol("x").setLabelCol("label").fit(picked)
        scored = predicted(fitted, picked, ["label"])
        used = [c for c, v in zip(of, fitted.featureImportances.toArray()) if v > 0]
        return auc(scored, "label", "prediction").first()[0] or 0.0, used

    return ask


def kept_score(df: DataFrame, columns: list[str], model: str = "LightGBM", params: Mapping | None = None, folds: int = 5) -> tuple[float | None, float | None]:
    """(mean, standard deviation) of the AUC over folds of a model on some of the columns; None without columns."""
    if not columns:
        return None, None
    full = cross_validate(df, model, params, folds=folds, columns=columns).trials["Full"]
    return full["val_score_mean"], full["val_score_std"]

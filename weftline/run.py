"""Config-driven runs: feature sets to one table, pruning, models, ensembles.

    python -m weftline.run train config.json [--full-train]
    python -m weftline.run null-importance | blend | rank-average | greedy-stack | colsample | tune config.json
"""

from __future__ import annotations

import argparse
import hashlib
import json
from datetime import datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from . import config as configs
from . import ensemble, features, models, selection
from .operators.joins import star
from .session import get_session
from .sources.credit import CLIENT, TARGET, Sources, kept_by
from .sources.runs import Runs, read_run, runs_above, stack


BASE = "base"


def cache_path(folder: str, name: str, conf: dict, inputs: str) -> str:
    """Where a feature set lies: by its name, its parameters and what it was made from."""
    digest = hashlib.sha256(json.dumps([name, conf, inputs], sort_keys=True, default=str).encode()).hexdigest()[:16]
    return f"{folder.rstrip('/')}/{name}-{digest}"


def cached(spark: SparkSession, folder: str | None, name: str, conf: dict, sources: Sources) -> DataFrame:
    """The feature set, written once below folder and read from there, in as many buckets of the client as the session has
    partitions; not written without a folder. Earlier predictions are tables of their own already. BASE: clients and targets."""
    make = lambda: sources.base if name == BASE else features.build(name, sources, conf)
    if not folder or name.startswith("Preds"):
        return make()
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = cache_path(folder, name, {**conf, "buckets": buckets}, f"{sources.folder} {sources.fingerprint()}")
    return kept_by(spark, path, make, CLIENT, buckets)


def assemble(spark: SparkSession, config: configs.Config, sources: Sources) -> DataFrame:
    """Clients with target and all features of the configuration."""
    conf = {"n_splits": config.folds, "random_state": config.seed, **config.options.get("features", {})}
    repeated = "drop" if config.options.get("drop_duplicate_column_on_merge") else "error"
    cache = config.dataset.get("cache_directory")
    tables = [cached(spark, cache, name, conf, sources) for name in config.features]
    for t in range(len(tables)):
        if TARGET in tables[t].columns:
            tables[t] = tables[t].drop(TARGET)
    out = star(cached(spark, cache, BASE, {}, sources), tables, CLIENT, repeated)
    if config.stacking_features:
        named = [f for f in config.stacking_features if f in features.names()]
        out = star(out, [features.build(f, sources, conf) for f in named], CLIENT, repeated)
        out = stack(out, [read_run(spark, f) for f in config.stacking_features if f not in named])
    if path := config.options.get("drop_features"):
        out = selection.drop_columns(out, selection.read_drop_list(path))
    if config.options.get("clean_data"):
        out = selection.clean_data(out, model=models.target_model)
    return out


def output_folder(config: configs.Config, name: str, score: float | None) -> str:
    stamp = datetime.now().strftime("%m%d%H%M")
    base = config.dataset.get("output_directory", "output").rstrip("/")
    return f"{base}/{stamp}_{name}" + (f"_{score:.6f}" if score is not None else "")


def train(spark: SparkSession, config: configs.Config, sources: Sources, name: str = "run", full: bool = False) -> models.Result:
    df = assemble(spark, config, sources)
    columns = models.features_of(df)
    if full:
        result = models.full_train(df, config.model, config.params, columns=columns, scale=config.normalize_feature)
    else:
        result = models.cross_validate(df, config.model, config.params, folds=config.folds, seed=config.seed, columns=columns, scale=config.normalize_feature)
    written(result, config, name, columns)
    return result


def written(result: models.Result, config: configs.Config, name: str, columns: list[str], search: ensemble.Search | None = None) -> None:
    """The run's folder, if the configuration has an output directory."""
    if config.dataset.get("output_directory"):
        folder = output_folder(config, name, result.trials.get("Full", {}).get("score"))
        ensemble.write_run(result, folder, json.loads(json.dumps(config.__dict__, default=list)), columns, search=search)


THRESHOLDS = (99, 95, 90, 80, 70, 60, 50, 40, 30, 20, 10, 0)


def null_importance(df: DataFrame, config: configs.Config, runs: int, folder: str = ".") -> list[dict]:
    """Drop lists below each threshold of both scores, written to folder, with the score of a model without them."""
    actual, null = models.null_importance(df, runs)
    columns, out = models.features_of(df), []
    for kind, score in (("gain", selection.null_importance_gain), ("corr", selection.null_importance_share)):
        scores = score(actual, null).cache()
        for threshold in THRESHOLDS:
            dropped = selection.under_threshold(scores, threshold)
            selection.write_drop_list(f"{folder}/{kind}_under_threshold_{threshold}.txt", dropped)
            mean, std = models.kept_score(df, [c for c in columns if c not in set(dropped)], config.model, config.params, config.folds)
            out.append({"score": kind, "threshold": threshold, "kept": len(columns) - len(dropped), "auc_mean": mean, "auc_std": std})
    return out


def greedy_stack(spark: SparkSession, df: DataFrame, config: configs.Config, name: str) -> tuple[float, list[str]]:
    """Greedy stacking of the predictions in df and of the runs whose scores are above the configuration's threshold."""
    found = runs_above(spark, config.dataset["output_directory"], config.threshold) if config.threshold and config.dataset.get("output_directory") else []
    runs = [r for r in (read_run(spark, f) for f in found) if not set(r.columns) - {CLIENT} <= set(df.columns)]
    score, chosen, result = ensemble.greedy_stacking(stack(df, runs), [c for c in stack(df, runs).columns if c.endswith("_PREDICTION")] or models.features_of(df), config.model, config.params, folds=config.folds)
    if result is not None:
        written(result, config, f"{name}_stacking", chosen)
    return score, chosen


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("task", choices=["train", "null-importance", "blend", "rank-average", "greedy-stack", "colsample", "tune"])
    parser.add_argument("config")
    parser.add_argument("--full-train", action="store_true")
    parser.add_argument("--evals", type=int, default=200)
    parser.add_argument("--runs", type=int, default=100)
    parser.add_argument("--form", default="csv")
    given = parser.parse_args(args)
    spark, config = get_session(), configs.read(given.config)
    output = config.dataset.get("output_directory")
    sources = Sources(spark, config.dataset.get("input_directory"), given.form, cache=config.dataset.get("cache_directory"), runs=Runs(spark, output))
    name = Path(given.config).stem
    if given.task == "train":
        print(json.dumps(train(spark, config, sources, name, given.full_train).trials))
        return
    df = assemble(spark, config, sources)
    columns = models.features_of(df)
    if given.task == "null-importance":
        for row in null_importance(df, config, given.runs):
            print(json.dumps(row))
    elif given.task in ("blend", "rank-average"):
        result, search = (ensemble.blended if given.task == "blend" else ensemble.rank_averaged)(df, columns, given.evals)
        written(result, config, f"{name}_{given.task}", columns, search)
        print(json.dumps(result.trials))
    elif given.task == "greedy-stack":
        print(json.dumps(greedy_stack(spark, df, config, name)))
    elif given.task == "colsample":
        for i, (chosen, result) in enumerate(ensemble.column_samples(df, columns, config.feature_sample_rate, given.runs, model=config.model, params=config.params)):
            written(result, config, f"{name}_colsample{i}", chosen)
            print(json.dumps({"score": result.score, "features": chosen}))
    else:
        score, best, search = ensemble.tune(df, model=config.model, evals=given.evals, fixed=config.params, folds=config.folds)
        result = models.cross_validate(df, config.model, {**config.params, **best}, folds=config.folds, seed=config.seed, columns=columns)
        written(result, config, f"{name}_tuned", columns, search)
        print(json.dumps([score, best]))


if __name__ == "__main__":
    main()

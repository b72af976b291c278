"""Runs end to end: configured training, stacking of written runs, blends, drop lists, caches."""

from __future__ import annotations

import json
import random

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F

from weftline import config, ensemble, features, models, run, selection
from weftline.sources.credit import Sources, declared
from weftline.sources.runs import Runs, read_run, run_folders, runs_above

N = 240


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """Application files whose AMT_CREDIT tells the target, and an output directory."""
    path = tmp_path_factory.mktemp("credit")
    rng = random.Random(1)
    names = ["SK_ID_CURR", "TARGET", "CODE_GENDER", "NAME_FAMILY_STATUS", "ORGANIZATION_TYPE", "AMT_CREDIT", "DAYS_EMPLOYED", "DAYS_LAST_PHONE_CHANGE"]
    rows = [[i, i % 2, "FM"[i % 3 % 2], "Married", "School", 100 + 60 * (i % 2) + rng.randint(0, 80), -i, -1] for i in range(N)]
    (path / "application_train.csv").write_text("\n".join(",".join(map(str, r)) for r in [names, *rows[:200]]) + "\n")
    (path / "application_test.csv").write_text("\n".join(",".join(map(str, r[:1] + r[2:])) for r in [names, *rows[200:]]) + "\n")
    (path / "output").mkdir()
    return path


def configured(folder, **more) -> config.Config:
    raw = {"features": ["ApplicationFeaturesSingleValueCounts"], "model": {"name": "LogisticRegression", "kfold_params": {"n_splits": 3}}}
    raw |= {"dataset": {"input_directory": str(folder), "output_directory": str(folder / "output"), "cache_directory": str(folder / "cache")}}
    return config.parse(json.dumps(raw | more))


@pytest.fixture(scope="module")
def sources(spark, folder):
    return Sources(spark, str(folder), cache=str(folder / "cache"), runs=Runs(spark, str(folder / "output")))


@pytest.fixture(scope="module")
def written(spark, folder, sources):
    """Three runs: two of the right kind and one without a score in its name."""
    df = sources["application"].select("SK_ID_CURR", "TARGET", "AMT_CREDIT", "DAYS_EMPLOYED")
    out = {}
    for name, columns in (("08191504_lgbm_1-1_0.793821", ["AMT_CREDIT"]), ("08192245_logreg_0_0.777166", ["AMT_CREDIT", "DAYS_EMPLOYED"]), ("dev_stacking_0.9", ["DAYS_EMPLOYED"])):
        result = models.cross_validate(df, "LogisticRegression", folds=3, columns=columns)
        ensemble.write_run(result, str(folder / "output" / name), {"name": name}, columns)
        out[name] = result
    return out


def test_types_follow_from_names(sources):
    assert [declared(c).simpleString() for c in ("SK_ID_PREV", "TARGET", "NAME_X", "AMT_CREDIT", "STATUS", "HOUSETYPE_MODE", "APARTMENTS_MODE")] == ["bigint", "int", "string", "double", "string", "string", "double"]
    assert dict(sources["application"].dtypes)["AMT_CREDIT"] == "double" and sources["application"].filter("TARGET is null").count() == 40


def test_cached_sets_join_without_a_shuffle(spark, folder, sources):
    names = ["ApplicationFeaturesSingleValueCounts", "ApplicationFeaturesPairValueCounts", "ApplicationFeaturesLeakyTargetEncoding"]
    raw = {"features": names, "model": {"name": "LogisticRegression"}, "dataset": {"input_directory": str(folder), "cache_directory": str(folder / "buckets")}}
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plain = run.assemble(spark, config.parse(json.dumps({**raw, "dataset": {"input_directory": str(folder)}})), sources)
        for again in range(2):
            made = run.assemble(spark, config.parse(json.dumps(raw)), sources)
            plan = made._jdf.queryExecution().executedPlan().toString()
            assert "Exchange" not in plan and plan.count("SortMergeJoin") >= 3 and "Exchange" in plain._jdf.queryExecution().executedPlan().toString()
            assert sorted(map(str, made.collect())) == sorted(map(str, plain.select(made.columns).collect()))
            for t in spark.catalog.listTables():  # as in a session that has only the files
                if t.name.startswith("weftline_"):
                    spark.sql(f"drop table {t.name}")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_raw_cache_follows_the_files(spark, folder, sources):
    sources["application"].count()
    before = {p.name for p in (folder / "cache").glob("raw-application-*")}
    assert len(before) == 1
    sources.__class__(spark, str(folder), cache=str(folder / "cache"))["application"].count()
    assert {p.name for p in (folder / "cache").glob("raw-application-*")} == before
    file = folder / "application_train.csv"
    text = file.read_text()
    file.write_text(text + "9999,1,F,Married,School,1,-1,-1\n")
    assert Sources(spark, str(folder), cache=str(folder / "cache"))["application"].count() == N + 1
    file.write_text(text)


def test_runs_are_found_and_read(spark, folder, written):
    output = str(folder / "output")
    names = {f.rsplit("/", 1)[1] for f in run_folders(spark, output)}
    assert set(written) <= names
    above = [f.rsplit("/", 1)[1] for f in runs_above(spark, output, 0.78)]
    assert above == ["08191504_lgbm_1-1_0.793821"] and runs_above(spark, output + "/none", 0.1) == []
    found = read_run(spark, f"{output}/08192245_logreg_0_0.777166")
    assert found.columns == ["SK_ID_CURR", "08192245_logreg_0_0.777166_PREDICTION"] and found.count() == N
    trials = json.loads(spark.read.text(f"{output}/08192245_logreg_0_0.777166/result.json").first()[0])["trials"]
    assert trials["Full"]["score"] > 0.6 and spark.read.parquet(f"{output}/08192245_logreg_0_0.777166/importance.parquet").count() == 2


def test_prediction_sets_and_stacking_from_a_configuration(spark, folder, sources, written):
    assert features.build("PredsLGBM1_1", sources).count() == N
    assert len(features.build("PredsAll", sources).columns) >= 4
    conf = configured(folder, features=[], stacking_features=["PredsLGBM1_1", str(folder / "output" / "08192245_logreg_0_0.777166")])
    df = run.assemble(spark, conf, sources)
    assert sorted(models.features_of(df)) == ["08191504_lgbm_1-1_0.793821_PREDICTION", "08192245_logreg_0_0.777166_PREDICTION"]
    before = set(run_folders(spark, str(folder / "output")))
    assert run.train(spark, conf, sources, "stacking_1").score > 0.6
    assert len(set(run_folders(spark, str(folder / "output"))) - before) == 1
    score, chosen = run.greedy_stack(spark, df, configured(folder, threshold=0.79), "greedy")
    assert score > 0.6 and 1 <= len(chosen) <= 2


def test_blends_are_written_with_their_trials(spark, folder, sources, written):
    conf = configured(folder, features=["PredsLGBM1_1", "PredsLogReg0"])
    df = run.assemble(spark, conf, sources)
    for make, name in ((ensemble.blended, "blend"), (ensemble.rank_averaged, "rank")):
        result, search = make(df, models.features_of(df), evals=4)
        ensemble.write_run(result, str(folder / name), {}, [], search=search)
        assert result.oof.count() == 200 and result.test.count() == 40 and result.trials["Full"]["score"] > 0.6
        assert spark.read.parquet(str(folder / name / "trials.parquet")).count() == 4 and read_run(spark, str(folder / name)).count() == N


def test_early_stopping_keeps_the_best_iteration(sources):
    df = sources["application"].select("SK_ID_CURR", "TARGET", "AMT_CREDIT", "DAYS_EMPLOYED")
    made = models.cross_validate(df, "XGBoost", {"n_estimators": 7, "early_stopping_rounds": 3, "max_depth": 3}, folds=2, columns=["AMT_CREDIT", "DAYS_EMPLOYED"])
    for f in (1, 2):
        trial = made.trials[f"Fold{f}"]
        assert len(trial["scores"]) == 7 and trial["best_iteration"] == models.best_iteration(trial["scores"], 3)
        # the fold's own score is that of its best round, by another way
        assert trial["val_score"] == pytest.approx(trial["scores"][trial["best_iteration"] - 1], abs=1e-9)
    assert models.lightgbm({"num_leaves": 31}).getMaxDepth() == 5 and models.xgboost({}).getMaxDepth() == 6
    assert models.lightgbm({"colsample_bytree": 0.1, "min_gain_to_split": 2.5, "max_bin": 5.0}).getFeatureSubsetStrategy() == "0.1"


def test_patience_counts_rounds_since_the_best():
    scores = [0.5, 0.6, 0.6, 0.55, 0.59, 0.7, 0.1, 0.1, 0.1, 0.9]
    assert [models.best_iteration(scores, k) for k in (1, 3, 4, 5)] == [2, 2, 10, 10]
    for k in range(1, 11):
        best = 0
        for i in range(1, 10):  # by the definition: stop once k rounds in a row haven't been better
            if scores[i] > scores[best]:
                best = i
            elif i - best >= k:
                break
        assert models.best_iteration(scores, k) == best + 1


def test_prefixes_of_boosted_trees_and_split_counts(sources):
    df = sources["application"].select("SK_ID_CURR", "TARGET", "AMT_CREDIT", "DAYS_EMPLOYED").filter("TARGET is not null")
    ready = models.prepared(df, "SK_ID_CURR", "TARGET", ["AMT_CREDIT", "DAYS_EMPLOYED"], False).withColumn("label", df.TARGET.cast("double"))
    fitted = models.pipeline("LightGBM", {"n_estimators": 4, "max_depth": 2}, 2).fit(ready)
    whole = {r.SK_ID_CURR: r.prediction for r in models.predicted(fitted, ready, ["SK_ID_CURR"]).collect()}
    assert whole == pytest.approx({r.SK_ID_CURR: r.prediction for r in models.of_trees(fitted, ready, ["SK_ID_CURR"], 4).collect()})
    first = {r.SK_ID_CURR: r.prediction for r in models.of_trees(fitted, ready, ["SK_ID_CURR"], 1).collect()}
    one = models.pipeline("LightGBM", {"n_estimators": 1, "max_depth": 2}, 2).fit(ready)
    assert first == pytest.approx({r.SK_ID_CURR: r.prediction for r in models.predicted(one, ready, ["SK_ID_CURR"]).collect()})

    class Tree:
        toDebugString = "If (feature 1 <= 2.0)\n If (feature 0 in {1.0})\n  Predict: 1\n Else (feature 0 not in {1.0})\nElse (feature 1 > 2.0)"

    assert models.split_counts([Tree(), Tree()], 3) == [2, 2, 0]
    trees = fitted.stages[-1].trees
    assert sum(models.split_counts(trees, 2)) == sum((t.numNodes - 1) // 2 for t in trees)


def test_logistic_regression_is_penalised_by_c_and_rows(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 2)) * [1, 30]
    y = (x[:, 0] + 0.02 * x[:, 1] + rng.normal(size=300) > 0).astype(float)
    rows = [(i, float(t), *map(float, v)) for i, (t, v) in enumerate(zip(y, x))]
    df = spark.createDataFrame(rows, "SK_ID_CURR bigint, TARGET double, f0 double, f1 double").withColumn("label", F.col("TARGET"))
    for c in (0.01, 1.0):
        weights = np.zeros(3)  # by Newton's method, the intercept without a penalty
        design = np.column_stack([x, np.ones(300)])
        for _ in range(50):
            p = 1 / (1 + np.exp(-design @ weights))
            penalty = np.diag([1 / c, 1 / c, 0])
            weights -= np.linalg.solve(design.T @ (design * (p * (1 - p))[:, None]) + penalty, design.T @ (p - y) + penalty @ weights)
        fitted = models.pipeline("LogisticRegression", {"C": c}, 2, rows=300).fit(df).stages[-1]
        assert [*fitted.coefficients, fitted.intercept] == pytest.approx(weights.tolist(), rel=1e-3, abs=1e-4)


def test_a_model_of_ones_own(sources):
    models.register_model("Plain", lambda params: LogisticRegression(maxIter=5))
    with pytest.raises(ValueError):
        models.register_model("Plain", None)
    assert models.cross_validate(sources["application"], "Plain", folds=2, columns=["AMT_CREDIT"]).score > 0.6
    del models.MODELS["Plain"]


def test_cleaning_by_model_keeps_what_tells_targets_apart(spark):
    rng = random.Random(4)
    rows = []
    for i in range(900):
        t = i % 2
        # `weak` passes the test of medians yet says too little alone; `twin` is needed once `good` has left the candidates
        rows.append((i, float(t) if i % 9 else None, t * 1.6 + rng.gauss(0, 1), t * 1.2 + rng.gauss(0, 1), 1 + t * 0.35 + rng.gauss(0, 1), rng.gauss(5, 1), 3.0))
    df = spark.createDataFrame(rows, "SK_ID_CURR bigint, TARGET double, good double, twin double, weak double, noise double, same double")
    assert selection.clean_data(df).columns == ["SK_ID_CURR", "TARGET", "good", "twin", "weak"]
    one = lambda *a: models.target_model(*a, params={"n_estimators": 1, "max_depth": 1})
    assert {"good", "twin"} <= set(selection.clean_data(df, model=one).columns) and "weak" not in selection.clean_data(df, model=one).columns
    kept = selection.clean_data(df, model=models.target_model).columns
    assert {"good", "twin"} <= set(kept) and not {"noise", "same"} & set(kept)
    auc, used = models.target_model(df.filter("TARGET is not null"), ["good", "noise"])(["good"])
    assert auc > 0.8 and used == ["good"]


def test_columns_no_model_needs():
    told = {("a", "b", "c", "d"): (0.9, ["b"]), ("a", "c", "d"): (0.71, ["a", "d"]), ("c",): (0.7, ["c"])}
    assert selection.not_needed(["a", "b", "c", "d"], lambda left: told[tuple(left)]) == ["c"]
    assert selection.not_needed(["a"], lambda left: (0.99, ["a"])) == [] and selection.not_needed(["a"], lambda left: (0.99, [])) == ["a"]
    assert selection.not_needed([f"c{i}" for i in range(30)], lambda left: (0.8, left[:1])) == []  # thirty rounds


def test_a_cleaned_set_keeps_what_models_of_the_target_use(spark):
    from weftline import catalog

    name, folder = "InstallmentsPaymentsFeaturesAntonova", "/root/testdata/sf0.01"
    whole, cleaned = (catalog.QUERIES[f"feature_set_{name}{end}"](spark, folder) for end in ("", "Cleaned"))
    kept = set(cleaned.columns) - {"SK_ID_CURR", "TARGET"}
    assert {"INS_AMT_INSTALMENT_VAR", "INS_AMT_PAYMENT_MIN"} <= kept < set(whole.columns)
    rows = {r.SK_ID_CURR: r for r in whole.collect()}
    for r in cleaned.collect():
        assert r.SK_ID_CURR not in rows or all(r[c] == rows[r.SK_ID_CURR][c] for c in kept)


def test_null_importance_sweep_scores_what_is_kept(spark, sources, tmp_path, monkeypatch):
    monkeypatch.setattr(run, "THRESHOLDS", (99, 0))
    df = sources["application"].select("SK_ID_CURR", "TARGET", "AMT_CREDIT", "DAYS_EMPLOYED")
    rows = run.null_importance(df, config.parse('{"features": ["x"], "model": {"name": "LogisticRegression", "kfold_params": {"n_splits": 2}}}'), 2, str(tmp_path))
    assert [r["threshold"] for r in rows] == [99, 0, 99, 0] and any(r["auc_mean"] for r in rows)
    assert selection.read_drop_list(tmp_path / "gain_under_threshold_0.txt") is not None

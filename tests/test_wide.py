"""Statistics of many columns, key sets, pair counts, last rows and medians: results and plans."""

from __future__ import annotations

import random

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weftline.features.grouped import join_back
from weftline.operators import encode
from weftline.operators.ranking import group_medians
from weftline.plans.fusion import MOMENTS, Agg, aggregate, by_size
from weftline.plans.moments import Moments
from weftline.sources.adapters import view


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(2)
    made = [
        (rng.randrange(40) or None, i, rng.choice(["a", "b", None]), rng.choice([None, rng.gauss(5, 3), float(rng.randrange(4))]), rng.choice([None, rng.randrange(9)]), rng.choice(["x", "y", "z", None]))
        for i in range(600)
    ]
    return spark.createDataFrame(made, "k int, t int, `s t` string, `x.y` double, n int, u string").repartition(3).persist()


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def plain(df) -> list[tuple]:
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect()), key=str)


def test_turned_statistics_are_those_of_one_aggregation(rows):
    aggs = []
    for prefix, where in (("", None), ("a_", "`s t` = 'a'"), ("zero_", "n = 0")):
        for f in MOMENTS:
            aggs += [Agg(f"{prefix}{c}_{f}", f, c, where) for c in ("x.y", "n", "t")]
        aggs += [Agg(f"{prefix}rows", "size", None, where), Agg(f"{prefix}flag", "mean", where=where, expr="cast(u <=> 'x' as int)")]
    aggs += [Agg("none", "sum", "n", "n > 100"), Agg("zero", "count", "n", "n > 100", empty_is_null=False)]
    wide, narrow = aggregate(rows, ["k"], aggs, wide=0), aggregate(rows, ["k"], aggs, wide=10**6)
    assert wide.columns == narrow.columns and dict(wide.dtypes) == dict(narrow.dtypes)
    assert plain(wide) == plain(narrow) and len(plain(wide)) == 39
    assert aggregate(rows.limit(0), ["k"], aggs, wide=0).count() == 0


def wide_aggs() -> list[Agg]:
    return [Agg(f"{p}{c}_{f}", f, c, w) for p, w in (("", None), ("a_", "`s t` = 'a'"), ("odd_", "twice % 4 = 2")) for f in MOMENTS for c in ("x.y", "n", "twice")]


def twice(df):
    return df.withColumn("twice", F.col("n") * 2)


def test_wide_statistics_shuffle_each_row_once_and_underived(rows):
    made = aggregate(rows, ["k"], wide_aggs(), wide=0, derive=twice)
    own = plan(made).split("InMemoryTableScan")[0]
    assert "Generate " not in own and own.count("Exchange hashpartitioning") == 1 and "twice" not in own.split("Exchange hashpartitioning")[1]
    assert plain(made) == plain(aggregate(rows, ["k"], wide_aggs(), derive=twice, wide=10**6))


def test_keys_of_many_rows_are_summed_up_by_parts(rows):
    sizes = {r["count"] for r in rows.groupBy("k").count().collect()}
    made = aggregate(rows, ["k"], wide_aggs(), wide=0, derive=twice, hot=sorted(sizes)[len(sizes) // 2])
    narrow = aggregate(rows, ["k"], wide_aggs(), derive=twice, wide=10**6)
    assert "Generate " in plan(made) and plain(made) == plain(narrow) and dict(made.dtypes) == dict(narrow.dtypes)


def test_tasks_of_gathered_rows_grow_in_number_with_the_rows(rows):
    made = by_size(rows.filter("k is not null"), ["k"], wide_aggs()[:6], twice, rows.filter("k is not null"), 10**6, in_task=60)
    assert made.rdd.getNumPartitions() == 10 and plain(made) == plain(aggregate(rows, ["k"], wide_aggs()[:6], derive=twice))


@pytest.mark.parametrize("at_once", [1, 7, 1000])
def test_moments_of_runs_over_batches(rows, at_once):
    df = rows.toPandas().dropna(subset=["k"]).sort_values("k")
    df = pd.concat([df, df[df.k == df.k.max()].assign(n=2.1)])  # one value in each batch of a key
    wanted = [(f, 0, k, k == 0) for f in MOMENTS for k in (-1, 0)]
    table = pa.table({"k": pa.array(df.k, pa.int32()), "v": pa.array(df.n, pa.float64(), from_pandas=True), "w": pa.array(df.u == "x")})
    moments = Moments(1, 1, wanted, [f"{f}{k}" for f, _, k, _ in wanted], ["bigint" if f in ("count", "size") else "double" for f, *_ in wanted])
    found = pa.Table.from_batches(moments.over(iter(table.combine_chunks().to_batches(at_once)))).to_pandas().set_index("k0")
    for k, test in ((-1, df.k > 0), (0, df.u == "x")):
        of = df[test].groupby("k")["n"]
        for f in MOMENTS:
            expected = of.agg(f).reindex(found.index)
            expected = expected if f != "sum" or k == 0 else expected.fillna(0)
            assert found[f"{f}{k}"].astype(float).to_numpy() == pytest.approx(expected.to_numpy(), nan_ok=True), (f, k)
    assert list(moments.over(iter([]))) == []


def test_key_sets_in_one_scan(rows):
    recipes = [(["u"], [("n", "mean"), ("x.y", "sum")]), (["s t", "u"], [("n", "max"), ("x.y", "var")]), (["n"], [("t", "min")])]
    found = {r.t: r for r in join_back(rows, "t", "S", recipes).collect()}
    df = rows.toPandas()
    by_u, by_both, by_n = df.groupby("u")["n"].mean(), df.groupby(["s t", "u"])["n"].max(), df.groupby("n")["t"].min()
    assert len(found) == len(df)
    for _, r in df.iterrows():
        f = found[r.t]
        assert f["S_u_mean_n"] == (None if r.u is None else pytest.approx(by_u[r.u]))
        assert f["S_s t_u_max_n"] == (None if r.u is None or r["s t"] is None else by_both[r["s t"], r.u])
        assert f["S_n_min_t"] == (None if pd.isna(r.n) else by_n[r.n])


def test_pair_counts_from_the_plan_and_by_a_join(rows):
    columns = ["s t", "u"]
    near = encode.pair_counts(rows, "t", columns, "{} {}")
    cells = [F.struct(F.col("`s t`").alias("a"), F.col("u").alias("b"))]
    far = encode._counts(rows, "t", cells, ["a", "b"], ["s t u"], max_cells=0)
    assert plain(near) == plain(far)
    assert "Join" in plan(far) and "Join" not in plan(near) and "hashpartitioning" not in plan(near)
    df = rows.toPandas()
    counted = df.groupby(columns).size()
    found = {r.t: r["s t u"] for r in near.collect()}
    assert all(found[r.t] == (None if r["s t"] is None or r.u is None else counted[r["s t"], r.u]) for _, r in df.iterrows())
    empty = encode.pair_counts(rows.withColumn("u", F.lit(None).cast("string")), "t", columns, "{} {}")
    assert {r["s t u"] for r in empty.collect()} == {None}


def test_last_rows_are_picked_before_the_shuffle(rows):
    aggs = [Agg("n_rows", "size"), Agg("last", "max", "t", last=1), Agg("two", "mean", "n", last=2), Agg("all", "sum", "x.y")]
    made = aggregate(rows, ["k"], aggs, [F.desc("t")])
    assert "WindowGroupLimit" in plan(made) and made.columns == ["k", "n_rows", "last", "two", "all"]
    df = rows.toPandas().dropna(subset=["k"]).sort_values("t", ascending=False)
    for r in made.collect():
        of = df[df.k == r.k]
        assert (r.n_rows, r["last"]) == (len(of), of.t.max())
        two = of.head(2)["n"].mean()
        assert r.two == (None if pd.isna(two) else pytest.approx(two))


@pytest.mark.parametrize("ranges", [1, 7])
def test_exact_medians_of_groups(rows, ranges):
    found = {r.g: r.median for r in group_medians(rows, "s t", "x.y", ranges).collect()}
    expected = rows.filter("`s t` is not null").groupBy("s t").agg(F.median(F.col("`x.y`")).alias("m")).collect()
    assert found == pytest.approx({r["s t"]: r.m for r in expected})
    one = {r.g: r.median for r in group_medians(rows.withColumn("one", F.lit(1)), "one", "n", ranges).collect()}
    assert one == {1: rows.agg(F.median("n")).first()[0]}
    assert group_medians(rows.limit(0), "u", "n").count() == 0


def test_clients_of_one_small_file_are_dealt_to_tasks(spark):
    rows = view(spark, "/root/testdata/sf0.001", "application")
    own = plan(rows).split("Exchange hashpartitioning(c_custkey")
    assert len(own) == 2 and "AMT_CREDIT" in own[0] and "AMT_CREDIT" not in own[1]
    assert rows.rdd.getNumPartitions() == 4
    assert rows.count() == spark.read.parquet("/root/testdata/sf0.001/customer.parquet").count()

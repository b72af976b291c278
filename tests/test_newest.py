"""Statistics of the newest rows of keys, from rows side by side: results are those of the aggregation, plans shuffle rows once."""

from __future__ import annotations

import random

import pyarrow as pa
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from weftline import features
from weftline.functions.aggregates import AGGREGATES
from weftline.plans.fusion import Agg, aggregate
from weftline.plans.newest import STATISTICS, Newest
from weftline.sources.adapters import sources

FUNCS = sorted(STATISTICS.keys() - {"size", "trend"})


def order() -> list:
    return [F.desc("t"), F.desc("i")]


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(4)
    odd = [float("inf"), -float("inf"), 1e9]
    made = [
        (k, rng.randrange(30), i, None if k % 5 == 0 and rng.random() < 0.2 else rng.choice([rng.gauss(5, 3), float(rng.randrange(3))]), 7.1 if k % 3 else rng.choice([2.0, 4.0]),
         rng.choice([None, *range(5)]), None if k == 4 else rng.choice(odd) if k == 5 else 0.5, rng.randrange(6))
        for i, k in enumerate(min(int(rng.expovariate(0.15)), 30) for _ in range(900))
    ]
    return spark.createDataFrame([*made, *[(None, *r[1:]) for r in made[:3]], (99, *made[0][1:])], "k int, t int, i int, `x.y` double, same double, n int, odd double, loan int").repartition(3).persist()


def aggs() -> list[Agg]:
    columns = ("x.y", "same", "n", "odd")
    made = [Agg(f"{last}_{c}_{f}", f, c, last=last) for last in (None, 1, 2, 5, 500) for c in columns for f in FUNCS]
    made += [Agg(f"w{last}_{c}_{f}", f, c, where="loan = 2", last=last) for last in (None, 4) for c in columns for f in FUNCS]
    made += [Agg(f"{last}_{w}_trend_{c}", "trend", c, where=w, last=last) for last in (1, 3, 50) for w in (None, "loan > 2") for c in columns]
    return [*made, Agg("rows", "size"), Agg("newest", "size", where="newest = 1"), Agg("five", "size", last=5), Agg("none", "sum", "n", "loan > 9"), Agg("zero", "count", "n", "loan > 9", empty_is_null=False)]


def derive(df):
    window = Window.partitionBy("k").orderBy(*order()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("newest", (F.first("loan").over(window) == F.col("loan")).cast("int"))


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString().split("InMemoryTableScan")[0]


def same(found, expected) -> None:
    assert found.columns == expected.columns and dict(found.dtypes) == dict(expected.dtypes)
    a, b = ({r.k: r for r in df.collect()} for df in (found, expected))
    assert a.keys() == b.keys() and len(a) > 20
    for k, r in a.items():
        for c in found.columns:
            x, y = r[c], b[k][c]
            assert (x is None) == (y is None) and (x is None or x == pytest.approx(y, rel=1e-9, abs=1e-9, nan_ok=True)), (k, c, x, y)


def test_every_statistic_is_that_of_the_aggregation():
    assert STATISTICS.keys() - {"trend"} == AGGREGATES.keys() - {"nunique", "approx_nunique"}


def test_statistics_of_newest_rows(rows):
    made = aggregate(rows, ["k"], aggs(), order(), derive=derive, side_by_side=True)
    assert "Aggregate" not in plan(made) and plan(made).count("Exchange hashpartitioning") == 1
    same(made, aggregate(rows, ["k"], aggs(), order(), derive=derive))


def test_keys_of_many_rows_are_summed_up_by_the_aggregation(rows):
    made = aggregate(rows, ["k"], aggs()[::7], order(), derive=derive, side_by_side=True, hot=60)
    assert "Union" in made._jdf.queryExecution().analyzed().toString()
    same(made, aggregate(rows, ["k"], aggs()[::7], order(), derive=derive))


def test_tasks_grow_in_number_with_the_rows_and_no_rows_are_no_keys(rows):
    assert aggregate(rows, ["k"], aggs()[:9], order(), derive=derive, side_by_side=True, in_task=90).rdd.getNumPartitions() == 11
    assert aggregate(rows.limit(0), ["k"], aggs()[:9], order(), derive=derive, side_by_side=True).count() == 0


@pytest.mark.parametrize("at_once", [1, 8, 1000])
def test_runs_over_batches(at_once):
    keys = [i // 7 for i in range(70)] + list(range(10, 6010))
    table = pa.table({"k": pa.array(keys), "v": pa.array([float(i) for i in range(len(keys))])})
    wanted = [("median", 0, -1, None, False), ("sum", 0, -1, 3, False), ("size", 0, -1, None, False)]
    newest = Newest(1, 1, wanted, ["median", "three", "rows"], ["double", "double", "bigint"], at_once)
    batches = list(newest.over(iter(table.to_batches(5))))
    found = pa.Table.from_batches(batches).to_pydict()
    assert found["k0"] == list(range(6010)) and found["rows"] == [7] * 10 + [1] * 6000 and max(b.num_rows for b in batches) <= 4096
    assert found["median"][:10] == [7 * g + 3.0 for g in range(10)] and found["three"][:10] == [21 * g + 3.0 for g in range(10)]
    assert list(newest.over(iter([]))) == []


def test_payments_are_shuffled_once_by_client(spark):
    made = features.build("InstallmentsPaymentsFeaturesOpenSolution", sources(spark, "/root/testdata/sf0.001"), {"vocabulary": {}})
    own = plan(made)
    assert own.count("Exchange hashpartitioning(SK_ID_CURR") == 1 and own.count("Sort [SK_ID_CURR") == 1 and "Aggregate" not in own and "percentile" not in own


def test_states_of_loans_are_shuffled_once_by_client(spark):
    own = plan(features.build("PosCashFeaturesOpenSolution", sources(spark, "/root/testdata/sf0.001"), {"vocabulary": {}}))
    assert own.count("Exchange hashpartitioning(SK_ID_CURR") == 1 and own.count("Sort [SK_ID_CURR") == 1 and "Aggregate" not in own

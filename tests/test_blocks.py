"""Wide sets as blocks of columns: cleaned, compared and made into rows again without a table of all their columns."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from weftline.features.bureau import month_columns, month_history
from weftline.models import target_model, target_model_of_blocks
from weftline.operators.blocks import ROWS, SCHEMA, Blocks, class_sizes, class_vectors, compared, packed_rows, unpacked
from weftline.operators.ranking import class_comparison
from weftline.plans.fusion import Agg, aggregate, blocks_of
from weftline.selection import clean_blocks, clean_data
from weftline.settle import METHODS, short_methods


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(6)
    made = [
        (i, rng.choice([0, 0, 1, None]), rng.choice([None, rng.gauss(0, 1)]), rng.randrange(2), rng.choice([0.0, -0.0, 1.5, None]), None, rng.choice([1.0, float("nan")]))
        for i in range(900)
    ]
    return spark.createDataFrame(made, "k long, y int, a double, b int, `c.d` double, e double, f double").repartition(5).persist()


@pytest.fixture(scope="module")
def clients(spark):
    rng = random.Random(7)
    base = [(i, rng.choice([0, 1, None])) for i in range(300)]
    sizes = {50: 90, 51: 0, **{i: rng.randrange(7) for i in range(52, 310)}}  # 0 to 49 have no rows, 300 to 309 aren't in base
    told = dict(base)
    made = [(k, rng.choice("AB"), rng.gauss(3.0 * (told.get(k) or 0), 1), rng.choice([None, rng.randrange(5)]), 7.0) for k, n in sizes.items() for _ in range(n)]
    made += [(None, "A", 1.0, 1, 7.0)] * 3
    return spark.createDataFrame(base, "k long, t int").repartition(3).persist(), spark.createDataFrame(made, "k long, s string, x double, n int, `o.o` double").repartition(4).persist()


def plain(df) -> list[tuple]:
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect()), key=str)


FUNCS = ["min", "max", "size", "mean", "var", "sum", "count", "std"]
AGGS = [Agg(f"{p}{c}_{f}{again}", f, c, w) for p, w in (("", None), ("a_", "s = 'A'")) for c in ("x", "n", "o.o", "twice") for f in FUNCS for again in ("", "_2")]
AGGS += [Agg("none", "sum", "n", "n > 9"), Agg("zero", "count", "n", "n > 9", empty_is_null=False), Agg("is_a", "mean", expr="cast(s <=> 'A' as int)")]


def twice(df):
    return df.withColumn("twice", F.col("n") * 2)


@pytest.mark.parametrize("hot", [1 << 17, 20])
def test_a_set_in_blocks_is_cleaned_like_a_table(clients, hot):
    base, df = clients
    blocks = blocks_of(base, "t", df, ["k"], AGGS, twice, hot=hot)
    assert len(blocks.table.columns) == SCHEMA.count(",") + 1 < 30 and len(set(blocks.place.values())) < len(AGGS) / 2
    assert class_sizes(blocks.table) == tuple(base.filter(c).count() for c in ("t = 0", "t = 1", "t is null"))
    whole = base.join(aggregate(df, ["k"], AGGS, derive=twice), "k", "left")
    again = base.join(unpacked(blocks, [a.name for a in AGGS], "k", "t").drop("t"), "k", "left")
    assert again.dtypes == whole.dtypes and plain(again) == plain(whole)
    found, expected = clean_blocks(base, blocks, "k", "t"), clean_data(whole, "k", "t")
    assert found.dtypes == expected.dtypes and plain(found) == plain(expected) and 2 < len(found.columns) < len(whole.columns)


def test_a_model_sees_the_training_rows_of_blocks(clients):
    base, df = clients
    asked = []

    def model(blocks, columns):
        asked.append(class_vectors(blocks, columns, -9.0).collect())
        table = {tuple(r) for r in unpacked(blocks, columns, "k", "t").drop("k").filter("t is not null").collect()}
        assert {(int(r.label), *r["all"]) for r in asked[0]} == {tuple(-9.0 if v is None else v for v in r) for r in table}
        return lambda left: (0.9, [c for c in left if c == "x_mean"]) if "x_mean" in left else (0.5, [])

    found = clean_blocks(base, blocks_of(base, "t", df, ["k"], AGGS, twice), "k", "t", model)
    assert len(asked[0]) == base.filter("t is not null").count() and found.columns == ["k", "t", "x_mean"] and found.count() == base.count()
    nothing = clean_blocks(base, blocks_of(base, "t", df.limit(0), ["k"], AGGS, twice), "k", "t", model)
    assert nothing.columns == ["k", "t"] and nothing.count() == base.count()


def test_a_model_of_blocks_answers_like_one_of_a_table(clients):
    base, df = clients
    blocks = blocks_of(base, "t", df, ["k"], AGGS, twice)
    columns = ["x_mean", "n_max", "o.o_size"]
    auc, used = target_model_of_blocks(blocks, columns)(["x_mean", "n_max"])
    expected, _ = target_model(unpacked(blocks, columns, "k", "t").filter("t is not null"), columns, "t")(["x_mean", "n_max"])
    assert auc == pytest.approx(expected, abs=0.05) and auc > 0.8 and "x_mean" in used


def test_generated_methods_are_short_while_blocks_are_made(spark):
    before = spark.conf.get(METHODS)
    with short_methods(spark):
        assert int(spark.conf.get(METHODS)) <= 8000
    assert spark.conf.get(METHODS) == before


@pytest.mark.parametrize("in_range", [1 << 20, 60])
def test_blocks_compare_as_columns_do(rows, in_range):
    columns = ["a", "b", "c.d", "e", "f"]
    blocks = packed_rows(rows, columns, "y", "k")
    found = compared(blocks, in_range, in_task=100)
    known = rows.withColumn("known", F.col("y").isNotNull().cast("int"))
    for flag, at in (("y", 1), ("known", 2)):
        expected = {r.c: r for r in class_comparison(known, flag, columns, 7).collect()}
        assert set(found) == set(expected) == {0, 1, 2, 4}
        for c, r in expected.items():
            for name in r.asDict():
                if name != "c":
                    assert getattr(found[c][at], name) == pytest.approx(r[name], nan_ok=True), (flag, columns[c], name)
    a = rows.agg(F.min("a"), F.max("a"), F.avg("a")).first()
    assert found[0][0] == pytest.approx(tuple(a))


def test_blocks_hold_a_bounded_number_of_rows(spark):
    df = spark.range(3 * ROWS).select("id", (F.col("id") % 2).alias("y"), F.sqrt("id").alias("x")).coalesce(1)
    table = packed_rows(df, ["x"], "y", "id").persist()
    assert table.filter("c = 0").agg(F.max("distinct")).first()[0] < ROWS + 10000 and table.select("b").distinct().count() > 1
    assert plain(unpacked(Blocks(table, {"x": 0}, {"x": "double"}), ["x"], "id", "y")) == plain(df)


@pytest.mark.parametrize("kind", ["bigint", "double"])
def test_first_and_last_states_are_numbers(spark, kind):
    rng = random.Random(8)
    states = ["0", "1", "C", "X", "", "9", None]
    rows = [(i % 30, rng.randrange(-20, 1), rng.choice(states)) for i in range(200)]
    months = spark.createDataFrame(rows, "SK_ID_BUREAU long, MONTHS_BALANCE long, STATUS string").withColumn("MONTHS_BALANCE", F.col("MONTHS_BALANCE").cast(kind))
    vocab = {"STATUS": ["X", "0", "1", "C"]}
    history = month_history(months, vocab)
    assert ("SortAggregate" in history._jdf.queryExecution().executedPlan().toString()) == (kind == "double")
    made = {n: c for n, c in month_columns(history.columns, vocab).items() if n.startswith(("First_", "Last_"))}
    for r in history.select("SK_ID_BUREAU", *[c.alias(n) for n, c in made.items()]).collect():
        known = sorted((m, s) for k, m, s in rows if k == r.SK_ID_BUREAU and s is not None)
        for name, (_, state) in (("First", known[0]), ("Last", known[-1])):
            assert [r[f"{name}_status_{v}_MEAN"] for v in (*vocab["STATUS"], "nan")] == [float(v == state) for v in (*vocab["STATUS"], "nan")]


def test_the_cleaned_loans_are_never_a_table_of_all_columns(spark, monkeypatch):
    from weftline import catalog
    from weftline.features import bureau

    def no_table(*a, **k):
        raise AssertionError("the set became a table")

    monkeypatch.setattr(bureau, "aggregate", lambda df, keys, *a, **k: no_table() if keys == ["SK_ID_CURR"] else aggregate(df, keys, *a, **k))
    found = catalog.QUERIES["feature_set_BureauFeaturesAntonovaCleaned"](spark, "/root/testdata/sf0.001")
    assert found.columns[:2] == ["SK_ID_CURR", "TARGET"]
    assert found.count() == found.select("SK_ID_CURR").distinct().count() == spark.read.parquet("/root/testdata/sf0.001/customer.parquet").count()

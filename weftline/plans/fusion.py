"""Features as data, fused into one window pass and one aggregation for each source and key.

A feature is an `Agg`. Whatever its condition, its last-k rows or its statistic, all features over the same source
and key become columns of one groupBy: conditions turn into CASE inside the aggregate, last-k into a comparison
with one row number.

Features of the last k rows are made from the k newest rows of each group, which every task picks from its own rows before
the shuffle; all other features go through partial sums. So a group of very many rows is never sorted or held in one task.

Hundreds of CASE aggregates in one operator are beyond what Spark compiles. Sets of over WIDE simple statistics are therefore
made from rows that lie side by side by key (:func:`gathered`): the rows are shuffled and sorted once, as they are, and tasks sum
up runs of a key batch by batch. Partial sums of hundreds of statistics would be many times as large as the few rows of a key.

Only a key of over HOT rows, for which partial sums are the smaller, is turned: each value of a row becomes a row (key, place of
the column, value), so that one short, compiled aggregation makes the moments of all columns, for all rows and for each
condition, and such a key is no single task; the columns of a group then meet in one array.

Sets of many medians, quartiles and last rows of several lengths are made from gathered rows as well, sorted from new to old
(`side_by_side`): an aggregation would keep a map of values for each percentile and update every statistic row by row. Keys of
over HOT rows are summed up by the aggregation.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.aggregates import AGGREGATES, trend
from ..nulls import col
from ..operators.blocks import SCHEMA, Blocks, class_of, packed, packed_rows
from ..settle import settle, short_methods
from .moments import Moments
from .newest import Newest

ROW = "__row"
WIDE = 300
HOT = 1 << 17
IN_TASK = 1 << 20
MOMENTS = ("min", "max", "mean", "sum", "var", "std", "count", "size")


@dataclass(frozen=True)
class Agg:
    """name: column made; func: a key of AGGREGATES or "trend"; source: column, or None for "size";
    where: SQL condition of the rows that count; last: newest rows that count; empty: for a group without a
    counting row, whether counts and sums are NULL (a filtered table has no such group) or 0."""

    name: str
    func: str
    source: str | None = None
    where: str | None = None
    last: int | None = None
    empty_is_null: bool = True
    expr: str | None = None  # SQL instead of a source column

    def column(self) -> Column:
        tests = [F.expr(self.where)] if self.where else []
        if self.last:
            tests.append(F.col(ROW) <= self.last)
        value = F.expr(self.expr) if self.expr else col(self.source) if self.source else F.lit(1)
        if not tests:
            rows = F.lit(1)
        else:
            test = tests[0]
            for t in tests[1:]:
                test = test & t
            rows = F.when(F.coalesce(test, F.lit(False)), 1).otherwise(0)
            value = F.when(test, value)
        out = trend(value, F.col(ROW), rows) if self.func == "trend" else AGGREGATES[self.func](value, rows)
        if self.where and self.empty_is_null and self.func in ("sum", "count", "size", "nunique"):
            out = F.when(F.sum(rows) > 0, out)
        return out.alias(self.name)


def numbered(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """df with the place of each row in its group, 1 for the first by `order`. The order has to be total but for
    rows that are alike."""
    return df.withColumn(ROW, F.row_number().over(Window.partitionBy(*map(col, keys)).orderBy(*order)))


def aggregate(
    df: DataFrame, keys: list[str], aggs: list[Agg], order: list[Column] | None = None, extra: list[Column] = (), wide: int = WIDE,
    derive: Callable[[DataFrame], DataFrame] | None = None, keyed: DataFrame | None = None, hot: int = HOT, dealt: bool = False, in_task: int = IN_TASK,
    side_by_side: bool = False,
) -> DataFrame:
    """One row for each group of `keys` with every feature. Groups with a missing key are left out.

    order: newest first; needed by features that look at the last rows. extra: more aggregate columns. wide: over so many simple
    statistics are made from gathered rows. derive: adds columns to those of df, row by row; it may come after a shuffle. keyed:
    a table with the keys of df's rows that is cheaper to count than df. hot: a key of over so many rows is summed up by parts.
    dealt: rows are dealt by key before they are summed up, about `in_task` of them a task. side_by_side: they are also sorted from
    new to old and summed up key by key; derive may then look at all rows of a key."""
    names = [a.name for a in aggs]
    if len(set(names)) < len(names):
        raise ValueError(f"features of one name: {sorted({n for n in names if names.count(n) > 1})}")
    for k in keys:
        df = df.filter(col(k).isNotNull())
    if len(aggs) > wide and not extra and all(a.func in MOMENTS and not a.last for a in aggs):
        return by_size(df, keys, aggs, derive or (lambda d: d), df if keyed is None else keyed, hot)
    if side_by_side:
        few, many, parts = split_by_size(df, keys, df if keyed is None else keyed, hot, in_task)
        made = gathered(few, keys, aggs, derive or (lambda d: d), parts, order or [])
        return made if many is None else made.union(aggregate(many, keys, aggs, order, derive=derive))
    if dealt:
        few, many, parts = split_by_size(df, keys, df if keyed is None else keyed, hot, in_task)
        made = [aggregate(dealt_by_key(few, keys, parts), keys, aggs, order, extra, wide, derive)]
        if many is not None:
            made.append(aggregate(many, keys, aggs, order, extra, wide, derive))
        return made[0] if many is None else made[0].union(made[1])
    df = derive(df) if derive else df
    if not any(a.last or a.func == "trend" for a in aggs):
        return df.groupBy(*map(col, keys)).agg(*[a.column() for a in aggs], *extra)
    if not order:
        raise ValueError("features of the last rows need an order")
    if any(a.func == "trend" and not a.last for a in aggs):
        return numbered(df, keys, order).groupBy(*map(col, keys)).agg(*[a.column() for a in aggs], *extra)
    newest = numbered(df, keys, order).filter(F.col(ROW) <= max(a.last for a in aggs if a.last))
    last = newest.groupBy(*map(col, keys)).agg(*[a.column() for a in aggs if a.last])
    whole = [a.column() for a in aggs if not a.last]
    if not whole and not extra:
        return last
    rest = df.groupBy(*map(col, keys)).agg(*whole, *extra)
    made = [c for c in rest.columns if c not in keys and c not in names]
    return rest.join(last, keys).select(*map(col, [*keys, *names, *made]))


def by_size(df: DataFrame, keys: list[str], aggs: list[Agg], derive: Callable[[DataFrame], DataFrame], keyed: DataFrame, hot: int, in_task: int = IN_TASK) -> DataFrame:
    """:func:`aggregate`: keys of over `hot` rows by partial sums, all others from gathered rows, about `in_task` of them a task."""
    few, many, parts = split_by_size(df, keys, keyed, hot, in_task)
    made = gathered(few, keys, aggs, derive, parts)
    return made if many is None else made.union(turned(derive(many), keys, aggs))


def split_by_size(df: DataFrame, keys: list[str], keyed: DataFrame, hot: int, in_task: int) -> tuple[DataFrame, DataFrame | None, int]:
    """(rows of keys of at most `hot` rows, the rest if there is any, tasks of about `in_task` rows)."""
    sizes = keyed.groupBy(*map(col, keys)).agg(F.count(F.lit(1)).alias("__n"))
    total, most = sizes.agg(F.sum("__n"), F.max("__n")).first()
    parts = -(-(total or 0) // in_task)
    if (most or 0) <= hot:
        return df, None, parts
    large = sizes.filter(F.col("__n") > hot).select(*map(col, keys))
    return df.join(F.broadcast(large), keys, "left_anti"), df.join(F.broadcast(large), keys, "left_semi"), parts


def dealt_by_key(df: DataFrame, keys: list[str], parts: int) -> DataFrame:
    """df with the rows of a key in one task, in `parts` tasks if a shuffle has fewer."""
    number = [parts] if parts > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else []
    return df.repartition(*number, *map(col, keys))


def gathered(df: DataFrame, keys: list[str], aggs: list[Agg], derive: Callable[[DataFrame], DataFrame], parts: int = 0, order: list[Column] | None = None) -> DataFrame:
    """:func:`aggregate` from the rows of each key side by side, in `parts` tasks if a shuffle has fewer. Derived columns are made
    after the shuffle; a task sorts its rows and then holds a batch of them and the moments of one key. With an order, which may be
    empty, statistics need not be moments and may look at the last rows; a task then holds the rows of one key at least."""
    rows, runs, schema = run_of_keys(df, keys, aggs, derive, parts, order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return runs.over(batches)

    return rows.mapInArrow(run, schema)


def run_of_keys(
    df: DataFrame, keys: list[str], aggs: list[Agg], derive: Callable[[DataFrame], DataFrame], parts: int, order: list[Column] | None = None
) -> tuple[DataFrame, Moments | Newest, T.StructType]:
    """(values and conditions of rows that lie side by side by key, what sums them up, the columns made)."""
    sorted_ = derive(dealt_by_key(df, keys, parts).sortWithinPartitions(*map(col, keys), *(order or [])))
    values = list(dict.fromkeys((a.source, a.expr) for a in aggs))
    tests = [w for w in dict.fromkeys(a.where for a in aggs) if w]
    cells = [F.expr(e) if e else col(c) if c else F.lit(1) for c, e in values]
    kinds = [f.dataType for f in sorted_.select(*cells).schema]
    flags = [F.coalesce(F.expr(w), F.lit(False)).alias(f"__w{k}") for k, w in enumerate(tests)]
    rows = sorted_.select(*map(col, keys), *[c.cast("double").alias(f"__v{i}") for i, c in enumerate(cells)], *flags)
    place, test = {v: i for i, v in enumerate(values)}, {None: -1, **{w: k for k, w in enumerate(tests)}}
    wanted = [(a.func, place[a.source, a.expr], test[a.where], a.last, bool(a.where and a.empty_is_null)) for a in aggs]

    def kind(func: str, of: T.DataType) -> T.DataType:
        if func in ("count", "size"):
            return T.LongType()
        return of if func in ("min", "max") and isinstance(of, (T.IntegralType, T.BooleanType)) else T.DoubleType()

    made = [T.StructField(a.name, kind(a.func, kinds[w[1]])) for a, w in zip(aggs, wanted)]
    names, types = [a.name for a in aggs], [f.dataType.simpleString() for f in made]
    if order is None:
        runs = Moments(len(keys), len(values), [(f, i, k, or_null) for f, i, k, _, or_null in wanted], names, types)
    else:
        runs = Newest(len(keys), len(values), wanted, names, types)
    return rows, runs, T.StructType([*[sorted_.schema[k] for k in keys], *made])


def blocks_of(
    base: DataFrame, flag: str, df: DataFrame, keys: list[str], aggs: list[Agg], derive: Callable[[DataFrame], DataFrame] | None = None, keyed: DataFrame | None = None, hot: int = HOT
) -> Blocks:
    """base, a row for each key with its flag, left joined to the moments of its rows in df, as blocks that are written.

    Such a table never has its hundreds of columns for Spark: base's rows are sorted in beside those of their keys, and tasks put
    what they sum up into blocks. Equal statistics of the same values are made once. derive keeps columns that it doesn't know."""
    (key,), derive = keys, derive or (lambda d: d)
    few, many, parts = split_by_size(df.filter(col(key).isNotNull()), keys, df if keyed is None else keyed, hot, IN_TASK)
    cells: dict[tuple, int] = {}
    place = {a.name: cells.setdefault((a.func, *((None, None) if a.func == "size" else (a.source, a.expr)), a.where, bool(a.where and not a.empty_is_null)), len(cells)) for a in aggs}
    once = list({place[a.name]: a for a in reversed(aggs)}.items())
    once = [a for _, a in sorted(once, key=lambda x: x[0])]

    there = base.filter(col(key).isNotNull()).select(col(key), class_of(flag).alias("__class"))
    table = None
    if many is not None:
        large = many.select(col(key)).distinct()
        hot_rows = base.join(F.broadcast(large), key, "left_semi").join(turned(derive(many), keys, once), key, "left")
        table = packed_rows(hot_rows, [a.name for a in once], flag, key, 1 << 60)
        there = there.join(F.broadcast(large), key, "left_anti")
    rows = few.withColumn("__there", F.lit(True)).unionByName(there.withColumn("__there", F.lit(False)), allowMissingColumns=True)
    own = [replace(a, where=f"__there and ({a.where})" if a.where else "__there") for a in once]
    own += [Agg("__class", "max", "__class"), Agg("__of_base", "size", where="not __there"), Agg("__own", "size", where="__there")]
    values, runs, schema = run_of_keys(rows, keys, own, derive, parts)
    or_zero = [i for i, a in enumerate(once) if not a.empty_is_null]  # but not of a key without rows

    def part(keys: list[pa.Array], moments: dict) -> tuple:
        *made, (classes, _), (of_base, _), (own, _) = runs.statistics(moments)
        for i in or_zero:
            made[i] = made[i][0], made[i][1] | (own == 0)
        at = slice(None) if (of_base > 0).all() else of_base > 0
        return keys[0].to_numpy()[at], classes[at].astype(np.int64), [(x[at].astype(np.float64), ~missing[at]) for x, missing in made]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return packed(runs.over(batches, part), TaskContext.get().partitionId() << 20)

    found = values.mapInArrow(run, SCHEMA)
    with short_methods(base.sparkSession):
        table = settle(found if table is None else found.union(table), "blocks")
    kinds = {f.name: f.dataType.simpleString() for f in schema}
    return Blocks(table, place, {a.name: kinds[once[place[a.name]].name] for a in aggs})


def turned(df: DataFrame, keys: list[str], aggs: list[Agg]) -> DataFrame:
    """:func:`aggregate` by rows of (keys, c, x) for the value x of each column c. Partial sums of a key are made before the
    shuffle, by column, so a key of very many rows is no single task."""
    values = list(dict.fromkeys((a.source, a.expr) for a in aggs))
    place = {v: i for i, v in enumerate(values)}
    tests = list(dict.fromkeys(a.where for a in aggs))
    kinds = dict(df.select(*[(F.expr(e) if e else col(c) if c else F.lit(1)).alias(f"v{i}") for i, (c, e) in enumerate(values)]).dtypes)
    cells = F.array(*[F.struct(F.lit(i).alias("c"), (F.expr(e) if e else col(c) if c else F.lit(1)).cast("double").alias("x")) for i, (c, e) in enumerate(values)])
    flags = [F.coalesce(F.expr(w), F.lit(False)).alias(f"__w{k}") for k, w in enumerate(tests) if w]
    tall = df.select(*map(col, keys), *flags, F.explode(cells).alias("__cell"))
    made = []
    for k, where in enumerate(tests):
        x = F.col("__cell.x") if where is None else F.when(F.col(f"__w{k}"), F.col("__cell.x"))
        rows = F.lit(1) if where is None else F.when(F.col(f"__w{k}"), 1).otherwise(0)
        used = {a.func for a in aggs if a.where == where}
        stats = {"size": F.sum(rows), "count": F.count(x), "sum": F.sum(x), "min": F.min(x), "max": F.max(x), "mean": F.avg(x), "var": F.var_samp(x), "std": F.stddev_samp(x)}
        made += [c.alias(f"{f}{k}") for f, c in stats.items() if f in used or f == "size"]
    long = tall.groupBy(*map(col, keys), F.col("__cell.c").alias("__c")).agg(*made)
    fields = [c for c in long.columns if c not in keys]
    grouped = long.groupBy(*map(col, keys)).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("__all"))  # a cell for each column

    def out(a: Agg) -> Column:
        k, i = tests.index(a.where), place[a.source, a.expr]
        cell = F.col("__all")[i]
        value, kind = cell[f"{a.func}{k}"], kinds[f"v{i}"]
        whole = kind in ("tinyint", "smallint", "int", "bigint", "boolean")
        if a.func == "sum":
            value = F.coalesce(value, F.lit(0.0))
        elif a.func in ("min", "max") and whole:
            value = value.cast(kind)
        if a.where and a.empty_is_null and a.func in ("sum", "count", "size", "nunique"):
            value = F.when(cell[f"size{k}"] > 0, value)
        return value.alias(a.name)

    return grouped.select(*map(col, keys), *map(out, aggs))


def recipes(prefix: str, aggs: dict[str, list[str]], where: str | None = None) -> list[Agg]:
    """Agg for each column and function, named PREFIX + column + _ + FUNCTION."""
    return [Agg(f"{prefix}{c}_{f.upper()}", f, c, where) for c, funcs in aggs.items() for f in funcs]


def group_recipes(source: str, keys: list[str], pairs: list[tuple[str, str]]) -> list[Agg]:
    """Agg for each (column, function), named Source_keys_function_column."""
    return [Agg(f"{source}_{'_'.join(keys)}_{f}_{c}", f, c) for c, f in pairs]

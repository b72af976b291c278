"""Encoders of categories: one-hot shares, first-appearance codes, counts, target means."""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..nulls import col
from ..plans.fusion import Agg
from ..settle import settle
from .folds import fold_of
from .joins import lookup

MAX_CATEGORIES = 10_000


def categoricals(df: DataFrame) -> list[str]:
    """String columns."""
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def vocabulary(df: DataFrame, columns: list[str], max_categories: int = MAX_CATEGORIES) -> dict[str, list[str]]:
    """Sorted values of each column, in one pass over df; more than max_categories in one of them is an error.

    Distinct values are counted before any comes to the driver, so a column of keys does no harm."""
    if not columns:
        return {}
    cells = F.array(*[F.struct(F.lit(i).alias("c"), col(c).alias("v")) for i, c in enumerate(columns)])
    found = settle(df.select(F.explode(cells).alias("cell")).select("cell.*").filter("v is not null").distinct(), "vocabulary")
    sizes = {r.c: r.n for r in found.groupBy("c").agg(F.count(F.lit(1)).alias("n")).collect()}
    if wide := [c for i, c in enumerate(columns) if sizes.get(i, 0) > max_categories]:
        raise ValueError(f"too many categories in {wide}")
    out: dict[str, list[str]] = {c: [] for c in columns}
    for r in found.orderBy("c", "v").collect():
        out[columns[r.c]].append(r.v)
    return out


def sql_text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def dummies(vocab: dict[str, list[str]]) -> dict[str, str]:
    """SQL of each 0/1 column by its name: column_value for every value, and column_nan for missing ones."""
    out = {}
    for c, values in vocab.items():
        for v in values:
            out[f"{c}_{v}"] = f"cast(`{c}` <=> {sql_text(v)} as int)"
        out[f"{c}_nan"] = f"cast(`{c}` is null as int)"
    return out


def one_hot(df: DataFrame, columns: list[str] | None = None, vocab: dict[str, list[str]] | None = None) -> tuple[DataFrame, list[str]]:
    """(df with dummies after its other columns, names of the dummies)"""
    columns = categoricals(df) if columns is None else columns
    made = dummies(vocab or vocabulary(df, columns))
    rest = [col(c) for c in df.columns if c not in columns]
    return df.select(*rest, *[F.expr(e).alias(n) for n, e in made.items()]), list(made)


def shares(vocab: dict[str, list[str]], prefix: str) -> list[Agg]:
    """The share of each category among the rows of a group."""
    return [Agg(f"{prefix}{n}_MEAN", "mean", expr=e) for n, e in dummies(vocab).items()]


def factorize(df: DataFrame, columns: list[str], order: list[Column]) -> DataFrame:
    """columns as codes 0, 1, ... of their values by first appearance in `order`; missing is -1.

    The least place of each value comes from an aggregation of (order) structs, so rows are never sorted."""
    for c in columns:
        seen = df.filter(col(c).isNotNull()).groupBy(col(c).alias("__v")).agg(F.min(F.struct(*order)).alias("__first"))
        codes = seen.select("__v", (F.row_number().over(Window.orderBy("__first")) - 1).alias("__code"))  # categories
        df = lookup(df, codes, {c: "__v"}, {c: F.coalesce("__code", F.lit(-1)).cast("bigint")})
    return df


def _tall(df: DataFrame, keep: list[Column], cells: list[Column]) -> DataFrame:
    """keep, c and the fields of each cell: a row for each row of df and cell."""
    numbered = F.array(*[F.struct(F.lit(i).alias("c"), cell.alias("x")) for i, cell in enumerate(cells)])
    return df.select(*keep, F.explode(numbered).alias("cell")).select(*[c.alias(f"__k{i}") for i, c in enumerate([F.col(f"`{n}`") for n in df.select(*keep).columns])], "cell.c", "cell.x.*")


def _wide(tall: DataFrame, names: list[str], key: str, value: Column, func=F.max) -> DataFrame:
    """(key, names): value of each cell, put together by key. A key's cells lie in one task, so they meet before
    the shuffle."""
    return tall.groupBy(F.col("__k0").alias(key)).agg(*[func(F.when(F.col("c") == i, value)).alias(n) for i, n in enumerate(names)])


def value_counts(df: DataFrame, key: str, columns: list[str], name: str = "app_{}_value_count") -> DataFrame:
    """key and, for each column, how many rows have the row's value (NULL for a missing one). key is unique."""
    return _counts(df, key, [F.struct(col(c).alias("a")) for c in columns], ["a"], [name.format(c) for c in columns])


def pair_counts(df: DataFrame, key: str, columns: list[str], name: str = "app_{}_{}_value_count") -> DataFrame:
    """value_counts of every pair of columns. All pairs are counted in one pass."""
    pairs = list(combinations(columns, 2))
    cells = [F.struct(col(a).alias("a"), col(b).alias("b")) for a, b in pairs]
    return _counts(df, key, cells, ["a", "b"], [name.format(*p) for p in pairs])


MAX_CELLS = 1_000_000  # numbers that the counts put into the plan at most


def _counts(df: DataFrame, key: str, cells: list[Column], fields: list[str], names: list[str], max_cells: int = MAX_CELLS, max_values: int = 512) -> DataFrame:
    """key and for each cell, a struct of `fields`, how many rows have the same.

    One pass counts all cells. If the counts, laid out as an array over the values of each field, are few enough, they go into
    the plan: each row finds the places of its values and looks its counts up, and rows aren't shuffled. Beyond `max_cells`
    numbers in all or `max_values` of a field the counts are joined to the cells."""
    tall = _tall(df, [col(key)], cells)
    known = tall
    for f in fields:
        known = known.filter(F.col(f).isNotNull())
    counts = settle(known.groupBy("c", *fields).agg(F.count(F.lit(1)).alias("n")), "counts")
    many = counts.groupBy("c").agg(*[F.countDistinct(f).alias(f) for f in fields]).collect()  # a row for each cell
    laid_out = sum(math.prod(r[f] for f in fields) for r in many)
    if laid_out > max_cells or any(r[f] > max_values for r in many for f in fields):
        return _wide(tall.join(counts, ["c", *fields], "left"), names, key, F.col("n"))
    held: list[dict[tuple, int]] = [{} for _ in cells]
    for r in counts.collect():
        held[r.c][tuple(r[f] for f in fields)] = r.n
    out = []
    for cell, of, name in zip(cells, held, names):
        values = [sorted({k[i] for k in of}) for i in range(len(fields))]
        numbers, place = [0] * math.prod(map(len, values)), F.lit(0)
        for k, n in of.items():
            at = 0
            for v, all_ in zip(k, values):
                at = at * len(all_) + all_.index(v)
            numbers[at] = n
        if not of:
            out.append(F.lit(None).cast("bigint").alias(name))
            continue
        for f, all_ in zip(fields, values):
            place = place * len(all_) + F.array_position(F.array(*map(F.lit, all_)), cell[f]) - 1
        array = F.split(F.lit(",".join(map(str, numbers))), ",").cast("array<bigint>")  # a literal once it is folded
        out.append(array[place.cast("int")].alias(name))
    return df.select(col(key), *out)


def smoothed(n: Column, mean: Column, prior: Column, min_samples: float = 1.0, smoothing: float = 1.0) -> Column:
    """Category mean drawn to the prior; a category of one row, and none at all, get the prior."""
    weight = F.lit(1.0) / (F.lit(1.0) + F.exp(-(n - min_samples) / smoothing))
    return F.when(n > 1, prior * (1 - weight) + mean * weight).otherwise(prior)


def target_encode(df: DataFrame, key: str, columns: list[str], target: str, name: str = "{}_target_encode") -> DataFrame:
    """(key, columns): the smoothed target mean of each value, learned from rows with a target and averaged over the
    rows of a key. Leaky: a row sees its own target."""
    train = df.filter(col(target).isNotNull())
    prior = F.lit(train.agg(F.avg(col(target))).first()[0]).cast("double")
    cells = [F.struct(col(c).alias("v")) for c in columns]
    known = _tall(train, [col(target)], cells).filter(F.col("v").isNotNull())
    stats = known.groupBy("c", "v").agg(F.count(F.lit(1)).alias("n"), F.avg("__k0").alias("m"))
    encoded = _tall(df, [col(key)], cells).join(stats, ["c", "v"], "left")
    return _wide(encoded, [name.format(c) for c in columns], key, smoothed(F.coalesce("n", F.lit(0)), F.col("m"), prior), F.avg)


def target_encode_folds(df: DataFrame, key: str, columns: list[str], target: str, folds: int = 5, seed: int = 47, name: str = "{}") -> DataFrame:
    """(key, columns) encoded out of fold: a training row by the other folds, others by the mean over the folds.

    One aggregation gives every fold's sums; the other folds' are the totals less those, so there are no K passes."""
    dealt = fold_of(df.select(col(key), col(target), *[col(c) for c in columns]), key, target, folds, seed)
    train = dealt.filter(col(target).isNotNull())
    own = {r.fold: (r.n, r.s) for r in train.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.sum(col(target)).alias("s")).collect()}
    every = (sum(n for n, _ in own.values()), sum(s for _, s in own.values()))
    cells = [F.struct(col(c).alias("v")) for c in columns]
    known = _tall(train, [col(target), F.col("fold")], cells).filter(F.col("v").isNotNull())
    of = lambda f, x: F.sum(F.when(F.col("__k1") == f, x).otherwise(0))
    stats = known.groupBy("c", "v").agg(
        F.count(F.lit(1)).alias("n"), F.sum("__k0").alias("s"), *[of(f, F.lit(1)).alias(f"n{f}") for f in range(folds)], *[of(f, F.col("__k0")).alias(f"s{f}") for f in range(folds)]
    )
    outside = F.array(*[F.struct((F.col("n") - F.col(f"n{f}")).alias("n"), (F.col("s") - F.col(f"s{f}")).alias("s")) for f in range(folds)])
    stats = stats.select("c", "v", outside.alias("outside"))
    encoded = _tall(dealt, [col(key), col(target), F.col("fold")], cells).join(stats, ["c", "v"], "left")
    priors = []
    for f in range(folds):
        n0, s0 = own.get(f, (0, 0))
        priors.append(F.lit((every[1] - s0) / (every[0] - n0) if every[0] > n0 else None).cast("double"))

    def without(f: Column) -> Column:
        """f: place of the fold, from 1."""
        rest, prior = F.element_at("outside", f), F.element_at(F.array(*priors), f)
        n = F.coalesce(rest["n"], F.lit(0))
        return smoothed(n, rest["s"] / F.nullif(n, F.lit(0)), prior)

    mean = F.aggregate(F.sequence(F.lit(1), F.lit(folds)), F.lit(0.0), lambda a, f: a + without(f)) / folds
    value = F.when(F.col("__k1").isNull(), mean).otherwise(without(F.col("__k2") + 1))
    return _wide(encoded, [name.format(c) for c in columns], key, value)

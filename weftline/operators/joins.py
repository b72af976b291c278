"""Joins of features: by client, by lookup, with checks of what they assume."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..nulls import col


def lookup(df: DataFrame, table: DataFrame, keys: dict[str, str], values: dict[str, Column]) -> DataFrame:
    """df with `values` (over df and table) set from the row of table that matches; table has one row for each key.

    A table of categories is small; Spark broadcasts it by its size and shuffles it if it isn't."""
    on = reduce(lambda a, b: a & b, [df["`" + a + "`"] == table["`" + b + "`"] for a, b in keys.items()])
    joined = df.join(table, on, "left")
    kept = [df["`" + c + "`"] if c not in values else values[c].alias(c) for c in df.columns]
    return joined.select(*kept, *[v.alias(n) for n, v in values.items() if n not in df.columns])


def unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """df, whose execution fails if a key repeats."""
    n = F.count(F.lit(1))
    bad = df.groupBy(*map(col, keys)).agg(n.alias("n")).filter("n > 1").limit(1).count()
    if bad:
        raise ValueError(f"{keys} isn't unique")
    return df


def one_to_one(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join of two tables in which no key repeats."""
    return unique(a, keys).join(unique(b, keys), keys)


def drop_repeated(base: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """incoming without columns whose names base has already."""
    return incoming.drop(*[c for c in incoming.columns if c in base.columns and c not in keys])


def star(base: DataFrame, features: list[DataFrame], key: str, repeated: str = "error") -> DataFrame:
    """base left-joined with feature tables of one row a key. A repeated column name is an error, or with
    repeated="drop" the later one goes.

    All joins are on one key: written tables bucketed by it join without a shuffle."""
    out = base
    for f in features:
        clash = [c for c in f.columns if c in out.columns and c != key]
        if clash and repeated == "error":
            raise ValueError(f"columns come twice: {clash[:5]}")
        out = out.join(drop_repeated(out, f, [key]), key, "left")
    return out

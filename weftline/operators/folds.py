"""Stratified folds by arithmetic on the key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..nulls import col

# Knuth's multiplicative hash and its modulus.
MULTIPLIER, MODULUS = 2654435761, 4294967296


def fold_of(df: DataFrame, key: str, target: str, folds: int = 5, seed: int = 47, ranges: int = 256) -> DataFrame:
    """df with `fold` 0 to folds - 1: rows of each target value are dealt in turn by a hash of the key, so the folds
    of a class differ by one row at most. Rows without a target are dealt as a class of their own.

    Places are counted within equal ranges of the hash, from the sizes of the ranges below, so no task holds a class."""
    hashed = (F.pmod(col(key).cast("bigint"), F.lit(1 << 31)) * MULTIPLIER + seed) % MODULUS  # no overflow
    ranged = df.withColumn("__hash", F.pmod(hashed, F.lit(MODULUS))).withColumn("__range", F.floor(F.col("__hash") * ranges / MODULUS).cast("int"))
    sizes = ranged.groupBy(col(target).alias("__class"), "__range").agg(F.count(F.lit(1)).alias("__n"))
    below = Window.partitionBy("__class").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("__class", F.col("__range").alias("__of"), F.coalesce(F.sum("__n").over(below), F.lit(0)).alias("__start"))
    place = F.row_number().over(Window.partitionBy(col(target), "__range").orderBy("__hash", col(key)))
    placed = ranged.withColumn("__place", place)
    joined = placed.join(F.broadcast(starts), placed[f"`{target}`"].eqNullSafe(starts["__class"]) & (placed["__range"] == starts["__of"]))
    return joined.select(*[df["`" + c + "`"] for c in df.columns], ((F.col("__start") + F.col("__place") - 1) % folds).cast("int").alias("fold"))

"""Places of rows in a total order, without a window over all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialize

IN_PARTITION = 33  # bits of the row's place in monotonically_increasing_id


def whole_numbers(values: list[int], kind: str = "bigint") -> Column:
    """An array literal: one text, split and cast, which the optimizer folds. An expression for each value would swell the plan."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def numbered(df: DataFrame, order: list[Column], at: str, name: str) -> DataFrame:
    """df with `at`, the place from 0 of each row in the order, which has to be total: without ties.

    Rows are dealt to ranges of the order and sorted inside each; a row's place is its place in the range plus the rows of
    the ranges before. Only the number of rows of each range comes to the driver. Both df and the result are tables of
    the shared folder, so that ranges are the same whenever a task runs again."""
    own = F.monotonically_increasing_id()
    sorted_ = materialize(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__own", own), name)
    part = F.shiftright("__own", IN_PARTITION).cast("int")
    sizes = {r["part"]: r["count"] for r in sorted_.groupBy(part.alias("part")).count().collect()}
    starts, before = [], 0
    for p in range(max(sizes, default=0) + 1):
        starts.append(before)
        before += sizes.get(p, 0)
    inside = F.col("__own").bitwiseAND(F.lit((1 << IN_PARTITION) - 1))
    out = sorted_.withColumn(at, whole_numbers(starts)[part] + inside).drop("__own")
    out.written_to = sorted_.written_to
    return out

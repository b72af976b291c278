"""Passes over the columns of a wide table, batch by batch: a task gives a few numbers for each column, or the column's cells as
sorted arrays, and never a row for each cell."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..nulls import col

POINTS = 64  # of a column in a batch, from which its ranges follow
AT_END = 256  # of them in a task
IN_BATCH = 1 << 22  # bytes of cells in a batch of arrays


def doubles(df: DataFrame, columns: list[str], flag: str | None = None) -> DataFrame:
    """The columns as doubles, after the flag (0 without one)."""
    mark = F.lit(0) if flag is None else col(flag).cast("int")
    return df.select(mark.alias("f"), *[col(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns)])


def known(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(place of the column, values that aren't missing, their flags) of each column with such values."""
    flags = batch.column(0).to_numpy(zero_copy_only=False)
    for i, column in enumerate(batch.columns[1:]):
        if column.null_count < len(column):
            there = column.is_valid().to_numpy(zero_copy_only=False) if column.null_count else slice(None)
            yield i, column.drop_null().to_numpy(zero_copy_only=False), flags[there]


def evenly(x: np.ndarray, n: int) -> np.ndarray:
    """n of the sorted numbers x at even distances, all of them if they are fewer."""
    return x if len(x) <= n else x[np.linspace(0, len(x) - 1, n).astype(np.int64)]


def cut_points(points: list[bytes], sizes: list[int], ranges: int) -> np.ndarray:
    """Bounds of about `ranges` ranges of as many values each, from points at even distances in parts of these sizes."""
    parts = [np.frombuffer(p) for p in points]
    weight = np.concatenate([np.full(len(p), n / len(p)) for p, n in zip(parts, sizes)])
    x = np.concatenate(parts)
    order = np.argsort(x)
    below = np.cumsum(weight[order])
    at = np.searchsorted(below, below[-1] * np.arange(1, ranges) / ranges)
    return np.unique(x[order][np.minimum(at, len(x) - 1)])


def merged(x: np.ndarray, *counts: np.ndarray) -> list[np.ndarray]:
    """The distinct ones of values, which may be runs in order, and the sums of their counts."""
    order = np.argsort(x, kind="stable")
    x = x[order]
    new = np.flatnonzero(np.concatenate(([True], (x[1:] != x[:-1]) & ~np.isnan(x[:-1]))))
    return [x[new], *(np.add.reduceat(n[order], new) for n in counts)]


def range_bounds(df: DataFrame, columns: list[str], flag: str, ranges: int) -> list[np.ndarray]:
    """Bounds that cut each column into `ranges` ranges of about as many values. They only deal out the work: whatever they are,
    what is made by ranges is exact."""
    n_columns = len(columns)

    def points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [[] for _ in range(n_columns)], [0] * n_columns
        for batch in batches:
            for i, x, _ in known(batch):
                held[i].append(evenly(np.sort(x), POINTS))
                n[i] += len(x)
                if len(held[i]) > POINTS:
                    held[i] = [evenly(np.sort(np.concatenate(held[i])), 8 * AT_END)]
        there = [i for i in range(n_columns) if n[i]]
        made = [evenly(np.sort(np.concatenate(held[i])), AT_END).tobytes() for i in there]
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array([n[i] for i in there], pa.int64()), pa.array(made, pa.binary())], names=["c", "n", "points"])

    def bounds(table: pa.Table) -> pa.Table:
        made = cut_points(table["points"].to_pylist(), table["n"].to_pylist(), ranges)
        return pa.table({"c": table["c"][:1].cast(pa.int32()), "bounds": pa.array([made.tolist()], pa.list_(pa.float64()))})

    found = doubles(df, columns, flag).mapInArrow(points, "c int, n bigint, points binary").groupBy("c").applyInArrow(bounds, "c int, bounds array<double>")
    of = {r.c: np.array(r.bounds, float) for r in found.collect()}  # a row for each column
    return [of.get(i, np.zeros(0)) for i in range(n_columns)]


def range_sizes(df: DataFrame, columns: list[str], flag: str | None, bounds: list[np.ndarray]) -> DataFrame:
    """(c, r, n0, n1, sum0, sum1, least, most, others) of each range of a column that has values: how many of each flag, their sums,
    how many are neither 0 nor 1, and the least and the greatest value (of some ranges of the column at least)."""
    n_columns = len(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros((5, len(b) + 1)) for b in bounds]
        ends = np.tile([[np.nan], [-np.inf]], n_columns)
        with np.errstate(invalid="ignore", over="ignore"):
            for batch in batches:
                for i, x, f in known(batch):
                    n = len(bounds[i]) + 1
                    r = np.searchsorted(bounds[i], x, "right")
                    one = np.flatnonzero(f)
                    zero = np.flatnonzero(f == 0)
                    sums[i][0] += np.bincount(r[zero], minlength=n)
                    sums[i][1] += np.bincount(r[one], minlength=n)
                    sums[i][2] += np.bincount(r[zero], x[zero], n)
                    sums[i][3] += np.bincount(r[one], x[one], n)
                    sums[i][4] += np.bincount(r[(x != 0) & (x != 1)], minlength=n)
                    ends[0, i], ends[1, i] = np.fmin(ends[0, i], np.fmin.reduce(x)), np.maximum(ends[1, i], np.maximum.reduce(x))
        c = np.repeat(np.arange(n_columns), [s.shape[1] for s in sums])
        r = np.concatenate([np.arange(s.shape[1]) for s in sums])
        n0, n1, sum0, sum1, others = np.concatenate(sums, axis=1)
        at = np.flatnonzero(n0 + n1)
        made = [(c, pa.int32()), (r, pa.int32()), (n0, pa.int64()), (n1, pa.int64()), (sum0, pa.float64()), (sum1, pa.float64()), (ends[0][c], pa.float64()), (ends[1][c], pa.float64()), (others, pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array(x[at].astype(t.to_pandas_dtype()), t) for x, t in made], names=["c", "r", "n0", "n1", "sum0", "sum1", "least", "most", "others"])

    rows = doubles(df, columns, flag).mapInArrow(run, "c int, r int, n0 bigint, n1 bigint, sum0 double, sum1 double, least double, most double, others bigint")
    return rows.groupBy("c", "r").agg(*[F.sum(k).alias(k) for k in ("n0", "n1", "sum0", "sum1")], F.min("least").alias("least"), F.max("most").alias("most"), F.sum("others").alias("others"))


def column_summary(df: DataFrame, columns: list[str]) -> dict[int, tuple[float, float, float]]:
    """place of the column -> (least, greatest, mean) of each column that has a value."""
    found = range_sizes(df, columns, None, [np.zeros(0)] * len(columns)).collect()  # a row for each column
    return {r.c: (r.least, r.most, r.sum0 / r.n0) for r in found}


def _narrow(n: np.ndarray) -> np.ndarray:
    return n.astype(np.uint8 if n.max(initial=0) < 256 else np.uint32)


def _counts(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, np.uint8 if len(data) == n else np.uint32).astype(np.int64)


def _binary(x: np.ndarray, cuts: np.ndarray) -> pa.Array:
    data = pa.py_buffer(np.ascontiguousarray(x))
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer((cuts * x.itemsize).astype(np.int32)), data])


def sorted_cells(df: DataFrame, columns: list[str], flag: str, bounds: list[np.ndarray]) -> DataFrame:
    """(c, r, x, n0, n1): the distinct values of a batch in a range of a column, in order, as one array of 8 bytes each, and how
    many of each flag they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made, size = [], 0
            for i, x, f in known(batch):
                order = np.argsort(x)
                x, f = x[order] + 0.0, f[order]
                new = np.flatnonzero(np.concatenate(([True], (x[1:] != x[:-1]) & ~np.isnan(x[:-1]))))
                n = np.diff(np.append(new, len(x)))
                n1 = np.add.reduceat(f, new, dtype=np.int64)
                cuts = np.concatenate(([0], np.searchsorted(x[new], bounds[i], "left"), [len(new)]))
                r = np.flatnonzero(np.diff(cuts))
                cuts = np.append(cuts[r], len(new))
                both = [_binary(c, cuts) for c in (x[new], _narrow(n - n1), _narrow(n1))]
                made.append(pa.RecordBatch.from_arrays([pa.array(np.full(len(r), i), pa.int32()), pa.array(r, pa.int32()), *both], names=["c", "r", "x", "n0", "n1"]))
                size += x.nbytes
                if size > IN_BATCH:
                    yield from pa.Table.from_batches(made).combine_chunks().to_batches()
                    made, size = [], 0
            if made:
                yield from pa.Table.from_batches(made).combine_chunks().to_batches()

    return doubles(df, columns, flag).mapInArrow(run, "c int, r int, x binary, n0 binary, n1 binary")


def range_ranks(cells: DataFrame, places: dict[tuple[int, int], list[tuple[int, int]]]) -> DataFrame:
    """(c, r, s, at0, at1) of cells: s is the sum over the values of flag 1 of their average rank in the range. places has the
    places, counted from 0 in a flag's values of a range, whose values are wanted; at0 and at1 hold these, in that order."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        parts = [(np.frombuffer(x), a, b) for x, a, b in zip(*(table[k].to_pylist() for k in ("x", "n0", "n1")))]
        x = np.concatenate([p[0] for p in parts])
        n0, n1 = (np.concatenate([_counts(p[k], len(p[0])) for p in parts]) for k in (1, 2))
        x, n0, n1 = merged(x, n0, n1)
        n = n0 + n1
        s = float((n1 * (np.cumsum(n) - n + (n + 1) / 2)).sum())
        ends, at = (np.cumsum(n0), np.cumsum(n1)), ([], [])
        for k, place in places.get((key[0].as_py(), key[1].as_py()), ()):
            at[k].append(float(x[np.searchsorted(ends[k], place, "right")]))
        kinds = pa.int32(), pa.int32(), pa.float64(), pa.list_(pa.float64()), pa.list_(pa.float64())
        return pa.table([pa.array([v], t) for v, t in zip((key[0].as_py(), key[1].as_py(), s, *at), kinds)], names=["c", "r", "s", "at0", "at1"])

    return cells.groupBy("c", "r").applyInArrow(run, "c int, r int, s double, at0 array<double>, at1 array<double>")

"""Moments of many columns over runs of equal keys, batch by batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

TYPES = {"double": pa.float64(), "bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "tinyint": pa.int8(), "boolean": pa.bool_()}


class Moments:
    """Batches of n_keys keys, n_values doubles and one flag for each condition, sorted by the keys, become a row for each key.

    wanted: (statistic, place of the value, place of the condition or -1, whether sums and counts are NULL where the condition
    marks no row) of each column made; names and kinds are those columns'. What is kept between batches is the last key's
    moments, however many rows it has."""

    def __init__(self, n_keys: int, n_values: int, wanted: list[tuple[str, int, int, bool]], names: list[str], kinds: list[str]) -> None:
        self.n_keys, self.n_values, self.wanted, self.names, self.kinds = n_keys, n_values, wanted, names, kinds
        self.cells = list(dict.fromkeys((i, k) for _, i, k, _ in wanted))
        self.tests = list(dict.fromkeys(k for _, k in self.cells))

    def over(self, batches: Iterator[pa.RecordBatch], made: Callable | None = None) -> Iterator:
        """What `made`, else :meth:`rows`, makes of keys and their moments."""
        last, made = None, made or self.rows
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, moments = self.of(batch)
            if last is not None:
                if all(a[0] == b[0] for a, b in zip(last[0], keys)):
                    self.merge(last[1], moments)
                else:
                    yield made(*last)
            n = len(keys[0]) - 1
            if n:
                yield made([k.slice(0, n) for k in keys], {c: m[:, :n] for c, m in moments.items()})
            last = [k.slice(n) for k in keys], {c: m[:, n:].copy() for c, m in moments.items()}
        if last is not None:
            yield made(*last)

    def of(self, batch: pa.RecordBatch) -> tuple[list[pa.Array], dict]:
        """The batch's keys, and by (value, condition) a matrix of count, sum, squared deviations, least and greatest; by a condition
        alone the number of rows."""
        keys = batch.columns[: self.n_keys]
        starts = run_starts(keys)
        group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, batch.num_rows)))
        marks = {k: np.ones(batch.num_rows, bool) if k < 0 else batch.column(self.n_keys + self.n_values + k).to_numpy(zero_copy_only=False) for k in self.tests}
        made = {k: np.add.reduceat(m, starts, dtype=np.int64)[None, :] for k, m in marks.items()}
        held = {}
        for i, k in self.cells:
            if i not in held:
                column = batch.column(self.n_keys + i)
                held = {i: (column.fill_null(0.0).to_numpy(), column.is_valid().to_numpy(zero_copy_only=False))}
            x, known = held[i]
            made[i, k] = column_moments(x, known & marks[k], starts, group)
        return [k.take(pa.array(starts)) for k in keys], made

    @staticmethod
    def merge(a: dict, b: dict) -> None:
        """The moments of one key, a, into those of the first key of b."""
        for c, x in a.items():
            y = b[c][:, :1]
            if len(x) == 1:
                y += x
                continue
            n = x[0] + y[0]
            if x[0] and y[0]:
                d = y[1] / y[0] - x[1] / x[0]
                y[2] += x[2] + d * d * (x[0] * y[0] / n)
            else:
                y[2] += x[2]
            y[0], y[1], y[3], y[4] = n, y[1] + x[1], np.fmin(x[3], y[3]), np.maximum(x[4], y[4])
            y[2][y[3] == y[4]] = 0.0

    def statistics(self, moments: dict) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(values, which are missing) of each statistic that is wanted."""
        with np.errstate(divide="ignore", invalid="ignore"):
            for func, i, k, or_null in self.wanted:
                n, total, squares, least, most = moments[i, k]
                size = moments[k][0]
                if func in ("size", "count", "sum"):
                    value, missing = {"size": size, "count": n, "sum": total}[func], (size == 0) & or_null
                elif func in ("var", "std"):
                    value, missing = squares / (n - 1), n < 2
                    value = np.sqrt(value) if func == "std" else value
                else:
                    value, missing = {"mean": total / n, "min": least, "max": most}[func], n == 0
                yield value, missing

    def rows(self, keys: list[pa.Array], moments: dict) -> pa.RecordBatch:
        columns = list(keys)
        for (value, missing), kind in zip(self.statistics(moments), self.kinds):
            if kind != "double":
                value = np.where(missing, 0, value).astype(TYPES[kind].to_pandas_dtype())
            columns.append(pa.array(value, TYPES[kind], mask=missing))
        return pa.RecordBatch.from_arrays(columns, names=[f"k{j}" for j in range(self.n_keys)] + self.names)


def run_starts(keys: list[pa.Array]) -> np.ndarray:
    """The first row of each run of equal keys."""
    new = np.zeros(len(keys[0]), bool)
    new[0] = True
    for k in keys:
        new[1:] |= pc.not_equal(k[1:], k[:-1]).to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def column_moments(x: np.ndarray, known: np.ndarray, starts: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Rows: count, sum, sum of squared deviations from the run's mean, least and greatest (NaN is greater than all numbers, and
    without a known value they are NaN and -inf)."""
    n = np.add.reduceat(known, starts, dtype=np.int64)
    with np.errstate(divide="ignore", invalid="ignore"):
        total = np.add.reduceat(np.where(known, x, 0.0), starts)
        least = np.fmin.reduceat(np.where(known, x, np.nan), starts)
        off = np.where(known, x - least[group], 0.0)  # 0 where a run has one value
        off = np.where(known, off - (np.add.reduceat(off, starts) / n)[group], 0.0)
        squares = np.add.reduceat(off * off, starts)
        most = np.maximum.reduceat(np.where(known, x, -np.inf), starts)
    return np.stack([n.astype(float), total, squares, least, most])

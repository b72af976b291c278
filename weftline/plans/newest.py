"""Statistics of runs of equal keys and of their newest rows, many runs at a time."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa

from ..functions.aggregates import NO_SKEW
from .moments import TYPES, run_starts

AT_ONCE = 1 << 16
KEYS_AT_ONCE = 1 << 12


class Newest:
    """Batches of n_keys keys, n_values doubles and one flag for each condition, sorted by the keys and then from new to old,
    become a row for each key.

    wanted: (statistic, place of the value, place of the condition or -1, newest rows that count or None, whether sums and counts
    are NULL where no row counts) of each column made; names and kinds are those columns'. Whole runs are summed up together,
    about `at_once` rows and at most KEYS_AT_ONCE keys; a run is held whole, so keys of very many rows don't belong here."""

    def __init__(self, n_keys: int, n_values: int, wanted: list[tuple[str, int, int, int | None, bool]], names: list[str], kinds: list[str], at_once: int = AT_ONCE) -> None:
        self.n_keys, self.n_values, self.wanted, self.names, self.kinds, self.at_once = n_keys, n_values, wanted, names, kinds, at_once

    def over(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            n += batch.num_rows
            if n < self.at_once:
                continue
            rows = joined(held)
            starts = run_starts(rows.columns[: self.n_keys])
            yield from self.by_keys(rows, starts[:-1], starts[-1])  # the last run may go on
            held, n = [rows.slice(starts[-1])], n - starts[-1]
        if n:
            rows = joined(held)
            yield from self.by_keys(rows, run_starts(rows.columns[: self.n_keys]), n)

    def by_keys(self, rows: pa.RecordBatch, starts: np.ndarray, end: int) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(starts), KEYS_AT_ONCE):
            some = starts[i : i + KEYS_AT_ONCE + 1]
            stop = some[KEYS_AT_ONCE] if len(some) > KEYS_AT_ONCE else end
            yield self.of(rows.slice(some[0], stop - some[0]), some[:KEYS_AT_ONCE] - some[0])

    def of(self, batch: pa.RecordBatch, starts: np.ndarray) -> pa.RecordBatch:
        sizes = np.diff(np.append(starts, batch.num_rows))
        group = np.repeat(np.arange(len(starts)), sizes)
        place = np.arange(batch.num_rows) - starts[group]
        longest = sizes.max()
        columns, values, marks, cells, made = [k.take(pa.array(starts)) for k in batch.columns[: self.n_keys]], {}, {}, {}, {}
        for (func, i, k, last, or_null), kind in zip(self.wanted, self.kinds):
            last = None if last is None or last >= longest else last  # the last 100 of no more than 100 are all
            if i not in values:
                values[i] = Values(batch.column(self.n_keys + i), group)
            if (k, last) not in marks:
                mark = np.ones(batch.num_rows, bool) if k < 0 else batch.column(self.n_keys + self.n_values + k).to_numpy(zero_copy_only=False)
                mark = mark if last is None else mark & (place < last)
                marks[k, last] = mark, np.bincount(group[mark], minlength=len(starts))
            if (i, k, last) not in cells:
                cells[i, k, last] = Cell(values[i], *marks[k, last], place)
            if (func, i, k, last) not in made:
                with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
                    made[func, i, k, last] = STATISTICS[func](cells[i, k, last])
            value, missing = made[func, i, k, last]
            if or_null and func in ("sum", "count", "size"):
                missing = missing | (marks[k, last][1] == 0)
            if kind != "double":
                value = np.where(missing, 0, value).astype(TYPES[kind].to_pandas_dtype())
            columns.append(pa.array(value, TYPES[kind], mask=missing))
        return pa.RecordBatch.from_arrays(columns, names=[f"k{j}" for j in range(self.n_keys)] + self.names)


def joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return batches[0] if len(batches) == 1 else pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


class Values:
    """A column of rows in groups: values, which of them are known, and the known rows of each group by rising value."""

    def __init__(self, column: pa.Array, group: np.ndarray) -> None:
        self.x, self.known, self.group = column.fill_null(0.0).to_numpy(), column.is_valid().to_numpy(zero_copy_only=False), group

    @cached_property
    def rising(self) -> np.ndarray:
        order = np.lexsort((self.x, self.group))
        return order[self.known[order]]


class Cell:
    """The known values of the rows that count: n of them in each group, of `size` rows."""

    def __init__(self, values: Values, mark: np.ndarray, size: np.ndarray, place: np.ndarray) -> None:
        self.values, self.mark, self.size = values, mark, size
        self.rows = np.flatnonzero(mark & values.known)
        self.n = np.bincount(values.group[self.rows], minlength=len(size))
        self.x, self.place = values.x[self.rows], place[self.rows]
        self.has = self.n > 0
        self.starts = np.cumsum(self.n) - self.n

    def reduced(self, ufunc: np.ufunc, x: np.ndarray) -> np.ndarray:
        """ufunc over the values of each group; 0 for a group without any."""
        out = np.zeros(len(self.n), x.dtype)
        out[self.has] = ufunc.reduceat(x, self.starts[self.has])
        return out

    def spread(self, of_groups: np.ndarray) -> np.ndarray:
        return np.repeat(of_groups, self.n)

    @cached_property
    def total(self) -> np.ndarray:
        return self.reduced(np.add, self.x)

    @cached_property
    def off(self) -> np.ndarray:
        """Deviations from the mean, 0 where a group has one value."""
        off = self.x - np.repeat(self.x[self.starts[self.has]], self.n[self.has])
        return off - self.spread(self.reduced(np.add, off) / self.n)

    def power(self, k: int) -> np.ndarray:
        return self.reduced(np.add, self.off**k)

    @cached_property
    def squares(self) -> np.ndarray:
        return self.power(2)

    @cached_property
    def rising(self) -> np.ndarray:
        return self.values.x[self.values.rising[self.mark[self.values.rising]]]

    @property
    def incomplete(self) -> np.ndarray:
        return (self.n < self.size) | ~self.has

    def percentile(self, p: float) -> np.ndarray:
        at = (self.n[self.has] - 1) * p
        low, high = np.floor(at), np.ceil(at)
        a, b = (self.rising[self.starts[self.has] + i.astype(np.int64)] for i in (low, high))
        out = np.zeros(len(self.n))
        out[self.has] = np.where((low == high) | (a == b), a, (high - at) * a + (at - low) * b)
        return out

    def slope(self) -> np.ndarray:
        x = self.place - self.spread(self.reduced(np.add, self.place) / self.n)
        return np.where(self.n == 1, 0.0, self.reduced(np.add, x * self.off) / self.reduced(np.add, x * x))

    def skew(self) -> np.ndarray:
        skew = np.sqrt(self.n) * self.power(3) / np.sqrt(self.squares**3)
        return np.where((self.squares == 0) | (np.abs(skew) < NO_SKEW), 0.0, skew)

    def kurt(self) -> np.ndarray:
        return np.where(self.squares == 0, -3.0, self.n * self.power(4) / self.squares**2 - 3.0)


#: As functions.aggregates.AGGREGATES and trend: name -> (value, where it is NULL).
STATISTICS = {
    "size": lambda c: (c.size, np.zeros(len(c.n), bool)),
    "count": lambda c: (c.n, np.zeros(len(c.n), bool)),
    "sum": lambda c: (c.total, np.zeros(len(c.n), bool)),
    "mean": lambda c: (c.total / c.n, ~c.has),
    "min": lambda c: (c.reduced(np.fmin, c.x), ~c.has),  # NaN is greater than all numbers
    "max": lambda c: (c.reduced(np.maximum, c.x), ~c.has),
    "var": lambda c: (c.squares / (c.n - 1), c.n < 2),
    "std": lambda c: (np.sqrt(c.squares / (c.n - 1)), c.n < 2),
    "median": lambda c: (c.percentile(0.5), ~c.has),
    "iqr": lambda c: (c.percentile(0.75) - c.percentile(0.25), c.incomplete),
    "skew": lambda c: (c.skew(), c.incomplete),
    "kurt": lambda c: (c.kurt(), c.incomplete),
    "trend": lambda c: (c.slope(), c.incomplete),
}

"""Wide tables as blocks of rows, for Spark a table of a few columns however many the wide one has.

A row of the table of blocks is one column of some thousand rows: its distinct values in order, how many of them are of class 0, of
class 1 and of neither, and the place of each row's value among them. What is known of whole columns follows from the values and
their numbers; rows are made again from the places, and only of the columns that are asked for.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..nulls import col
from ..settle import settle
from .cells import POINTS, _counts, _narrow, cut_points, doubles, evenly, known, merged
from .ranking import IN_RANGE

ROWS = 1 << 14  # of a block
IN_BATCH = 1 << 22  # bytes of cells in a batch
IN_TASK = 1 << 22  # distinct values of blocks that a task puts together
KEYS = -1  # c of the row of a block that has its keys and classes
FIELDS = {
    "b": pa.int64(), "c": pa.int32(), "x": pa.binary(), "n0": pa.binary(), "n1": pa.binary(), "n2": pa.binary(), "codes": pa.binary(), "distinct": pa.int64(),
    "size0": pa.int64(), "size1": pa.int64(), "size2": pa.int64(), "sum0": pa.float64(), "sum1": pa.float64(), "sum2": pa.float64(),
    "least": pa.float64(), "most": pa.float64(), "others": pa.int64(), "least01": pa.float64(), "most01": pa.float64(), "others01": pa.int64(),
}
SQL = {pa.int64(): "bigint", pa.int32(): "int", pa.float64(): "double", pa.binary(): "binary"}
SCHEMA = ", ".join(f"{n} {SQL[t]}" for n, t in FIELDS.items())
SIZES = "size0", "size1", "size2"


@dataclass
class Blocks:
    """table: what :func:`packed` gives; place: column -> its c, the same for columns of the same values; kinds: column -> type."""

    table: DataFrame
    place: dict[str, int]
    kinds: dict[str, str]


def class_of(flag: str) -> Column:
    """0 or 1, 2 where the flag is missing."""
    return F.when(col(flag).isNull(), 2).otherwise((col(flag).cast("int") != 0).cast("int"))


def packed(parts: Iterable[tuple], first: int, rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """The blocks, numbered from `first`, of parts (keys, classes, (values, which of them are known) of each column)."""
    held, n = [], 0
    for part in parts:
        held.append(part)
        n += len(part[0])
        if n >= rows:
            yield from _block(held, first)
            held, n, first = [], 0, first + 1
    if n:
        yield from _block(held, first)


def _block(held: list[tuple], b: int) -> Iterator[pa.RecordBatch]:
    keys, classes = (np.concatenate([p[k] for p in held]) for k in (0, 1))
    made, size = [{"c": KEYS, "x": keys.astype(np.int64).tobytes(), "codes": classes.astype(np.uint8).tobytes(), **dict(zip(SIZES, np.bincount(classes, minlength=3).tolist()))}], 0
    for c in range(len(held[0][2])):
        x, there = (np.concatenate([p[2][c][k] for p in held]) for k in (0, 1))
        if there.any():
            made.append({"c": c, **column(x, there, classes)})
            size += len(made[-1]["x"]) + len(made[-1]["codes"])
            if size > IN_BATCH:
                yield _batch(made, b)
                made, size = [], 0
    if made:
        yield _batch(made, b)


def _batch(made: list[dict], b: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([b if n == "b" else r.get(n) for r in made], t) for n, t in FIELDS.items()], names=list(FIELDS))


def column(x: np.ndarray, there: np.ndarray, classes: np.ndarray) -> dict:
    """The fields of one column of a block, of which a value at least is there."""
    at = np.flatnonzero(there)
    x = x[at]
    order = np.argsort(x)
    x, at = x[order] + 0.0, at[order]
    new = np.concatenate(([True], (x[1:] != x[:-1]) & ~np.isnan(x[:-1])))
    place, x = np.cumsum(new), x[new]
    codes = np.zeros(len(there), np.min_scalar_type(len(x)))
    codes[at] = place
    n = np.bincount((place - 1) * 3 + classes[at], minlength=3 * len(x)).reshape(-1, 3).T
    with np.errstate(invalid="ignore", over="ignore"):
        sums = [float((x[k > 0] * k[k > 0]).sum()) for k in n]
    of = {"x": x.tobytes(), "codes": codes.tobytes(), "distinct": len(x), **{f"n{k}": _narrow(n[k]).tobytes() for k in range(3)}}
    of |= {**dict(zip(SIZES, n.sum(axis=1).tolist())), **{f"sum{k}": s for k, s in enumerate(sums)}}
    for end, some in (("", n[0] + n[1] + n[2]), ("01", n[0] + n[1])):
        v = x[some > 0]
        if len(v):
            of |= {"least" + end: float(v[0]), "most" + end: float(v[-1]), "others" + end: int(some[(x != 0) & (x != 1)].sum())}
    return of


def packed_rows(df: DataFrame, columns: list[str], flag: str, key: str, first: int = 0) -> DataFrame:
    """Blocks of a table whose rows are wide already; the key is a whole number."""
    n = len(columns)
    cells = doubles(df.withColumn("__class", class_of(flag)), [key, *columns], "__class")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts() -> Iterator[tuple]:
            for batch in batches:
                made = [(np.zeros(batch.num_rows), np.zeros(batch.num_rows, bool))] * (n + 1)
                for i, x, _ in known(batch):
                    there = batch.column(i + 1).is_valid().to_numpy(zero_copy_only=False)
                    whole = np.zeros(batch.num_rows)
                    whole[there] = x
                    made[i] = whole, there
                yield made[0][0], batch.column(0).to_numpy(zero_copy_only=False), made[1:]

        return packed(parts(), first + (TaskContext.get().partitionId() << 20))

    return cells.mapInArrow(run, SCHEMA)


def in_ranges(columns: DataFrame, ranges: dict[int, int]) -> DataFrame:
    """(c, r, x, n0, n1, n2, size0, size1, size2) of blocks' columns; those of `ranges` are cut into about so many ranges of values."""
    fields = ("x", "n0", "n1", "n2")
    if not ranges:
        return columns.select("c", F.lit(0).alias("r"), *fields, *SIZES)

    def points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [evenly(np.frombuffer(v.as_py()), POINTS).tobytes() for v in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(x, pa.binary())], names=["c", "n", "points"])

    def bounds(table: pa.Table) -> pa.Table:
        c = table["c"][0].as_py()
        made = cut_points(table["points"].to_pylist(), table["n"].to_pylist(), ranges[c])
        return pa.table({"c": pa.array([c], pa.int32()), "bounds": pa.array([made.tolist()], pa.list_(pa.float64()))})

    some = columns.filter(F.col("c").isin(list(ranges))).select("c", "x", "distinct")
    found = some.mapInArrow(points, "c int, n bigint, points binary").groupBy("c").applyInArrow(bounds, "c int, bounds array<double>")
    of = {r.c: np.array(r.bounds, float) for r in found.collect()}  # a row for each column

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for c, *data in zip(*(batch.column(n).to_pylist() for n in ("c", *fields))):
                x = np.frombuffer(data[0])
                n = [_counts(d, len(x)) for d in data[1:]]
                cuts = np.concatenate(([0], np.searchsorted(x, of.get(c, np.zeros(0)), "left"), [len(x)]))
                for r in np.flatnonzero(np.diff(cuts)).tolist():
                    at = slice(cuts[r], cuts[r + 1])
                    made.append((c, r, x[at].tobytes(), *(_narrow(k[at]).tobytes() for k in n), *(int(k[at].sum()) for k in n)))
            kinds = {"c": pa.int32(), "r": pa.int32(), **dict.fromkeys(fields, pa.binary()), **dict.fromkeys(SIZES, pa.int64())}
            yield pa.RecordBatch.from_arrays([pa.array([m[i] for m in made], t) for i, t in enumerate(kinds.values())], names=list(kinds))

    return columns.select("c", *fields).mapInArrow(cut, "c int, r int, x binary, n0 binary, n1 binary, n2 binary, size0 bigint, size1 bigint, size2 bigint")


@dataclass
class Compared:
    """A column between two classes: see :func:`operators.ranking.class_comparison`, whose fields these are."""

    n: int
    n1: int
    rank_sum: float
    mean0: float | None
    mean1: float | None
    median0: float | None
    median1: float | None
    least: float | None
    most: float | None
    others: int


def compared(blocks: DataFrame, in_range: int = IN_RANGE, in_task: int = IN_TASK) -> dict[int, tuple[tuple[float, float, float], Compared, Compared]]:
    """c -> ((least, greatest, mean), class 0 against 1, neither against both of them) of each column that has a value.

    The values of all blocks meet by column, those of a column of over `in_range` distinct ones in a block each by ranges: no
    task holds more than about so many of a column. Ranks and medians of both comparisons come from the one merge."""
    columns = blocks.filter(F.col("c") >= 0)
    ends = [f("{}{}".format(n, e)).alias(n + e) for e in ("", "01") for n, f in (("least", F.min), ("most", F.max), ("others", F.sum))]
    whole = {r.c: r for r in columns.groupBy("c").agg(*[F.sum(n).alias(n) for n in ("distinct", *SIZES, "sum0", "sum1", "sum2")], *ends).collect()}  # a row for each column
    cells = in_ranges(columns, {c: -(-r.distinct // in_range) for c, r in whole.items() if r.distinct > in_range})
    sizes = settle(cells.groupBy("c", "r").agg(*[F.sum(n).alias(n) for n in SIZES]).withColumn("size3", F.col("size0") + F.col("size1")), "range-sizes")
    lower, all_ = Window.partitionBy("c").orderBy("r").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("c")
    starts = sizes.select("*", *[F.coalesce(F.sum(f"size{k}").over(lower), F.lit(0)).alias(f"start{k}") for k in range(4)], *[F.sum(f"size{k}").over(all_).alias(f"all{k}") for k in range(4)])
    middle = lambda k: F.array(F.floor((F.col(f"all{k}") - 1) / 2), F.floor(F.col(f"all{k}") / 2))
    inside = lambda k: F.filter(F.transform(middle(k), lambda p: p - F.col(f"start{k}")), lambda p: (p >= 0) & (p < F.col(f"size{k}")))
    wanted = starts.select("c", "r", F.array(*map(inside, range(4))).alias("p")).filter(F.size(F.flatten("p")) > 0).collect()  # eight rows a column at most
    places = {(r.c, r.r): r.p for r in wanted}

    def run(key: tuple, table: pa.Table) -> pa.Table:
        c, r = (k.as_py() for k in key)
        parts = [(np.frombuffer(x), *n) for x, *n in zip(*(table[k].to_pylist() for k in ("x", "n0", "n1", "n2")))]
        x, *n = merged(np.concatenate([p[0] for p in parts]), *(np.concatenate([_counts(p[k], len(p[0])) for p in parts]) for k in (1, 2, 3)))
        both = n[0] + n[1]
        ranks = lambda some, of: float((some * (np.cumsum(of) - of + (of + 1) / 2)).sum())
        at = [[float(x[np.searchsorted(np.cumsum(k), p, "right")]) for p in of] for k, of in zip((*n, both), places.get((c, r), [[]] * 4))]
        kinds = pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.list_(pa.list_(pa.float64()))
        return pa.table([pa.array([v], t) for v, t in zip((c, r, ranks(n[1], both), ranks(both, both + n[2]), at), kinds)], names=["c", "r", "s01", "s2", "at"])

    tasks = -(-sum(r.distinct for r in whole.values()) // in_task)
    number = [tasks] if tasks > int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")) else []
    dealt = cells.select("c", "r", "x", "n0", "n1", "n2").repartition(*number, "c", "r")
    ranked = dealt.groupBy("c", "r").applyInArrow(run, "c int, r int, s01 double, s2 double, at array<array<double>>").join(starts, ["c", "r"])
    medians = [F.flatten(F.collect_list(F.col("at")[k])) for k in range(4)]
    found = ranked.groupBy("c").agg(
        F.sum(F.col("s01") + F.col("size1") * (F.col("start0") + F.col("start1"))).alias("s01"),
        F.sum(F.col("s2") + F.col("size3") * (F.col("start0") + F.col("start1") + F.col("start2"))).alias("s2"),
        *[F.when(F.size(m) > 0, (F.array_min(m) + F.array_max(m)) / 2).alias(f"median{k}") for k, m in enumerate(medians)],
    )
    out = {}
    for f in found.collect():  # a row for each column
        r = whole[f.c]
        n, sums = (*(r[s] for s in SIZES), r.size0 + r.size1), (r.sum0, r.sum1, r.sum2, r.sum0 + r.sum1)
        mean = [s / k if k else None for s, k in zip(sums, n)]
        by_class = Compared(n[3], n[1], f.s01, mean[0], mean[1], f.median0, f.median1, r.least01, r.most01, r.others01)
        by_known = Compared(n[3] + n[2], n[3], f.s2, mean[2], mean[3], f.median2, f.median3, r.least, r.most, r.others)
        out[f.c] = (r.least, r.most, sum(sums[:3]) / sum(n[:3])), by_class, by_known
    return out


def class_sizes(blocks: DataFrame) -> tuple[int, int, int]:
    """Rows of class 0, of class 1 and of neither."""
    return tuple(n or 0 for n in blocks.filter(F.col("c") == KEYS).agg(*map(F.sum, SIZES)).first())


def by_block(blocks: Blocks, cells: list[int], made: Callable[[np.ndarray, np.ndarray, Callable], list[pa.RecordBatch]], schema: str) -> DataFrame:
    """What `made` gives of each block's keys, classes and what gives (values, which are missing) of a column."""
    kept = blocks.table.filter(F.col("c").isin([KEYS, *dict.fromkeys(cells)])).select("b", "c", "x", "codes")

    def run(table: pa.Table) -> pa.Table:
        of = {c: (x, codes) for c, x, codes in zip(*(table[k].to_pylist() for k in ("c", "x", "codes")))}
        keys, classes = np.frombuffer(of[KEYS][0], np.int64), np.frombuffer(of[KEYS][1], np.uint8)
        n = len(keys)

        def values(c: int) -> tuple[np.ndarray, np.ndarray]:
            if c not in of:
                return np.zeros(n), np.ones(n, bool)
            codes = np.frombuffer(of[c][1], f"u{len(of[c][1]) // n}")
            return np.concatenate(([0.0], np.frombuffer(of[c][0])))[codes], codes == 0

        return pa.Table.from_batches(made(keys, classes, values))

    return kept.groupBy("b").applyInArrow(run, schema)


def unpacked(blocks: Blocks, columns: list[str], key: str, flag: str) -> DataFrame:
    """Rows of the key, the class as `flag` (NULL for neither) and some of the columns."""
    cells = [blocks.place[c] for c in columns]
    names = ["k", "f", *[f"x{i}" for i in range(len(cells))]]

    def made(keys: np.ndarray, classes: np.ndarray, values: Callable) -> list[pa.RecordBatch]:
        of = {c: pa.array(x, pa.float64(), mask=missing) for c in dict.fromkeys(cells) for x, missing in [values(c)]}
        return [pa.RecordBatch.from_arrays([pa.array(keys), pa.array(classes.astype(np.int32), mask=classes == 2), *[of[c] for c in cells]], names=names)]

    rows = by_block(blocks, cells, made, ", ".join(["k bigint", "f int", *[f"x{i} double" for i in range(len(cells))]]))
    return rows.select(F.col("k").alias(key), F.col("f").alias(flag), *[F.col(f"x{i}").cast(blocks.kinds[c]).alias(c) for i, c in enumerate(columns)])


def class_vectors(blocks: Blocks, columns: list[str], missing: float) -> DataFrame:
    """(label, all) of the rows of class 0 or 1: the columns as one array, in which `missing` stands for missing values."""
    cells = [blocks.place[c] for c in columns]

    def made(keys: np.ndarray, classes: np.ndarray, values: Callable) -> list[pa.RecordBatch]:
        rows = np.flatnonzero(classes < 2)
        all_ = np.empty((len(rows), len(cells)))
        for j, c in enumerate(cells):
            x, absent = (v[rows] for v in values(c))
            all_[:, j] = np.where(absent | np.isnan(x), missing, x)
        step = max(1, IN_BATCH // (8 * len(cells)))
        parts = [(classes[rows[at : at + step]], all_[at : at + step]) for at in range(0, max(1, len(rows)), step)]
        lists = lambda x: pa.ListArray.from_arrays(np.arange(0, x.size + 1, len(cells), dtype=np.int32), pa.array(x.ravel()))
        return [pa.RecordBatch.from_arrays([pa.array(y.astype(np.float64)), lists(x)], names=["label", "all"]) for y, x in parts]

    return by_block(blocks, cells, made, "label double, all array<double>")

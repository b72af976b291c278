"""Column selection: constant columns, group differences, rank-sum tests, importance against shuffled targets."""

from __future__ import annotations

import ast
import math
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .nulls import col, ratio
from .operators.blocks import Blocks, class_sizes, compared, unpacked
from .operators.cells import column_summary
from .operators.ranking import NO_TEST, class_comparison, rank_sum, value_ranks
from .settle import settle
from .sources.credit import CLIENT, TARGET

P_LIMIT, DIFF_LIMIT = 0.05, 0.5
TEST_P_LIMIT, TEST_DIFF_LIMIT = 0.05, 1.0
AUC_LIMIT = 0.7


def numeric(df: DataFrame, but: Iterable[str] = ()) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, (T.NumericType, T.BooleanType)) and f.name not in set(but)]


def constant_columns(df: DataFrame, columns: list[str]) -> list[str]:
    """Columns of at most one distinct value, in one pass: least and greatest value are the same."""
    if not columns:
        return []
    found = column_summary(df, columns)
    same = [c for i, c in enumerate(columns) if i not in found or found[i][0] == found[i][1]]
    far = [c for i, c in enumerate(columns) if c in set(same) and i in found and abs(found[i][0]) >= 1 << 53]  # beyond what doubles tell apart
    if far:
        row = df.agg(*[(F.min(col(c)) < F.max(col(c))).alias(f"d{i}") for i, c in enumerate(far)]).first()
        same = [c for c in same if c not in {f for f, differs in zip(far, row) if differs}]
    return same


def difference_stats(df: DataFrame, columns: list[str], flag: str, overall: DataFrame | None = None, written: bool = False) -> dict[str, tuple[float, float, float]]:
    """column -> (difference, difference over the mean of `overall`, p) between rows of flag 0 and 1: of means for
    0/1 columns without missing values, else of medians; p is that of the rank-sum test. All columns are compared
    at once, means take one pass over overall. written: df is read from files, so it isn't written to be read again."""
    if not columns:
        return {}
    n_rows = df.filter(col(flag).isNotNull()).count()
    of = {r.c: r for r in class_comparison(df, flag, columns, written=written).collect()}  # one row for each column
    means = {i: m for i, (_, _, m) in column_summary(overall or df, columns).items()}
    out = {}
    for i, c in enumerate(columns):
        out[c] = difference(of.get(i), n_rows, means.get(i))
    return out


def difference(r, n_rows: int, mean: float | None) -> tuple[float, float, float]:
    """(difference, difference over the mean, p) of a column compared between classes of n_rows rows; r is None without a value."""
    d = math.nan
    if r is not None:
        binary = r.n == n_rows and not r.others and r.least == 0 and r.most == 1
        a, b = (r.mean0, r.mean1) if binary else (r.median0, r.median1)
        d = math.nan if a is None or b is None else abs(a - b)
    norm = math.nan if mean is None else abs(d / mean) if mean else (math.nan if d == 0 else math.inf)
    return d, norm, rank_sum(r.rank_sum, r.n1, r.n)[1] if r is not None else NO_TEST


def useless(diff: float, norm: float, p: float) -> bool:
    """Columns that don't tell the classes apart."""
    return p > P_LIMIT and (diff == 0 or norm < DIFF_LIMIT)


def of_split(by_target: tuple[float, float, float], by_split: tuple[float, float, float]) -> bool:
    """Columns that tell training rows from others only."""
    return by_split[1] > TEST_DIFF_LIMIT and by_target[1] == 0 and by_split[2] < TEST_P_LIMIT


def not_needed(columns: list[str], ask, limit: float = AUC_LIMIT) -> list[str]:
    """What is left of columns once a model of the rest is no better than `limit`.

    ask(columns) -> (AUC, columns that the model uses). The columns that a model uses have served and leave the candidates; the
    next model is fitted on the others, until one says so little of the target that what it has goes as a whole. Every round
    takes a column at least, so rounds come to an end."""
    left = list(columns)
    while left:
        auc, used = ask(left)
        if auc <= limit or not set(used) & set(left):
            break
        left = [c for c in left if c not in set(used)]
    return left


def clean_data(df: DataFrame, key: str = CLIENT, target: str = TARGET, model=None) -> DataFrame:
    """df without columns that are constant, tell nothing of the target, or tell training rows from others only.

    1. constant columns go. 2. On training rows columns go whose difference between targets is 0 or small and not
    significant. 3. Columns whose difference between training and other rows is large and significant and whose
    difference between targets is 0 go. 4. With `model`, such as :func:`models.target_model`, the columns go that no model of
    the target needs (see :func:`not_needed`): model(training rows, columns, target) gives what answers for some of the
    columns. The key and the target always stay; without both kinds of target stages 2 to 4 have nothing to go by."""
    df = settle(df, "uncleaned")
    columns = numeric(df, (key, target))
    gone = set(constant_columns(df, columns))
    columns = [c for c in columns if c not in gone]
    train = df.filter(col(target).isNotNull())
    by_target = difference_stats(train, columns, target, df, written=True)
    gone |= {c for c in columns if useless(*by_target[c])}
    left = [c for c in columns if c not in gone]
    marked = df.withColumn("__is_train", col(target).isNotNull().cast("int"))
    by_split = difference_stats(marked, left, "__is_train", written=True)
    gone |= {c for c in left if of_split(by_target[c], by_split[c])}
    left = [c for c in left if c not in gone]
    if model is not None and left:
        gone |= set(not_needed(left, model(train, left, target)))
    return df.drop(*gone)


def clean_blocks(base: DataFrame, blocks: Blocks, key: str = CLIENT, target: str = TARGET, model=None) -> DataFrame:
    """:func:`clean_data` of base (key, target), left joined to what `blocks` holds of its keys; columns of the same values are
    compared once, and a table is made of the columns that stay. model, such as :func:`models.target_model_of_blocks`, takes the
    blocks and columns."""
    found, (n0, n1, other) = compared(blocks.table), class_sizes(blocks.table)
    left = []
    for c, i in blocks.place.items():
        if i not in found or found[i][0][0] == found[i][0][1]:
            continue
        (_, _, mean), by_class, by_known = found[i]
        by_target, by_split = difference(by_class, n0 + n1, mean), difference(by_known, n0 + n1 + other, mean)
        if not useless(*by_target) and not of_split(by_target, by_split):
            left.append(c)
    if model is not None and left:
        gone = set(not_needed(left, model(blocks, left)))
        left = [c for c in left if c not in gone]
    return base.join(unpacked(blocks, left, key, target).drop(target), key, "left") if left else base


def null_importance_gain(actual: DataFrame, null: DataFrame, importance: str = "importance_gain") -> DataFrame:
    """(feature, score): ln(1e-10 + mean actual / (1 + 75th percentile of those with shuffled targets))."""
    a = actual.groupBy("feature").agg(F.avg(importance).alias("a"))
    n = null.groupBy("feature").agg(F.percentile(importance, F.lit(0.75)).alias("n"))
    return a.join(n, "feature").select("feature", F.log(F.lit(1e-10) + F.col("a") / (1 + F.col("n"))).alias("score"))


def null_importance_share(actual: DataFrame, null: DataFrame, importance: str = "importance_gain") -> DataFrame:
    """(feature, score): 100 times the share of shuffled importances below the 25th percentile of the actual ones."""
    a = actual.groupBy("feature").agg(F.percentile(importance, F.lit(0.25)).alias("a"))
    return null.join(a, "feature").groupBy("feature").agg((100 * F.avg((F.col(importance) < F.col("a")).cast("int"))).alias("score"))


def under_threshold(scores: DataFrame, threshold: float) -> list[str]:
    """Features whose score is below the threshold, by name."""
    return [r.feature for r in scores.filter(F.col("score") < threshold).select("feature").orderBy("feature").collect()]


def read_drop_list(path: str | Path) -> list[str]:
    """A file with one literal list of names; it is parsed, never run."""
    names = ast.literal_eval(Path(path).read_text().strip() or "[]")
    if not isinstance(names, list) or not all(isinstance(n, str) for n in names):
        raise ValueError(f"{path} doesn't hold a list of names")
    return names


def write_drop_list(path: str | Path, names: list[str]) -> None:
    Path(path).write_text(repr(list(names)) + "\n")


def drop_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """df without the named columns; names it doesn't have are ignored."""
    return df.select(*[col(c) for c in df.columns if c not in set(names)])


__all__ = ["clean_blocks", "clean_data", "constant_columns", "difference_stats", "drop_columns", "null_importance_gain", "null_importance_share", "ratio", "value_ranks"]

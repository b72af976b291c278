"""Folders of earlier runs: their out-of-fold and test predictions, and the tables that hold them."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..nulls import col
from .credit import CLIENT, TARGET, run_score

OOF, TEST = "oof_predictions.csv", "submission.csv"


def prediction_column(run: str) -> str:
    return f"{run}_PREDICTION"


def read_run(spark: SparkSession, folder: str, key: str = CLIENT, target: str = TARGET) -> DataFrame:
    """(key, <run>_PREDICTION) of a run's folder: its out-of-fold and test predictions."""
    schema = f"`{key}` bigint, `{target}` double"
    parts = [spark.read.schema(schema).csv(f"{folder}/{name}", header=True) for name in (OOF, TEST)]
    return parts[0].unionByName(parts[1]).select(key, col(target).alias(prediction_column(PurePosixPath(folder).name)))


def files_below(spark: SparkSession, folder: str) -> list[tuple[str, int, int]]:
    """(path, bytes, time of change) of every file below folder, on whatever file system it lies; none if it isn't there."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(str(folder))
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = []
    if system.exists(path):
        found = system.listFiles(path, True)
        while found.hasNext():
            f = found.next()
            out.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return sorted(out)


def run_folders(spark: SparkSession, output: str) -> list[str]:
    """Folders below output that hold both prediction files, which may be files or folders of Spark's."""
    held: dict[str, set[str]] = {}
    for path, _, _ in files_below(spark, output):
        parts = path.split("/")
        for name in (OOF, TEST):
            if name in parts:
                held.setdefault("/".join(parts[: parts.index(name)]), set()).add(name)
    return sorted(f for f, names in held.items() if len(names) == 2)


def runs_above(spark: SparkSession, output: str, threshold: float) -> list[str]:
    """Run folders below output whose name ends in a score above threshold, but for stacking runs."""
    named = [(f, PurePosixPath(f).name) for f in run_folders(spark, output)]
    return [f for f, name in named if (score := run_score(name)) is not None and score > threshold and "stacking" not in name]


def stack(base: DataFrame, runs: list[DataFrame], key: str = CLIENT) -> DataFrame:
    """base with a prediction column of each run: the runs are united to long rows and put side by side by one
    aggregation, so there is one join however many runs there are."""
    return base.join(side_by_side(runs, key), key, "left") if runs else base


def side_by_side(runs: list[DataFrame], key: str = CLIENT) -> DataFrame:
    """(key, a column for each run) of every key that a run has."""
    names = [next(c for c in r.columns if c != key) for r in runs]
    tall = None
    for n, r in zip(names, runs):
        part = r.select(col(key), F.lit(n).alias("run"), col(n).cast("double").alias("p"))
        tall = part if tall is None else tall.unionByName(part)
    return tall.groupBy(col(key)).agg(*[F.max(F.when(F.col("run") == n, F.col("p"))).alias(n) for n in names])


class Runs:
    """Earlier runs by name: given as DataFrames (key, <run>_PREDICTION), or folders of an output directory."""

    def __init__(self, spark: SparkSession, folder: str | None = None, tables: dict[str, DataFrame] | None = None) -> None:
        self.spark, self.folder, self.tables = spark, folder, dict(tables or {})

    def names(self) -> list[str]:
        found = {PurePosixPath(f).name for f in run_folders(self.spark, self.folder)} if self.folder else set()
        return sorted(found | set(self.tables))

    def __getitem__(self, name: str) -> DataFrame:
        if name in self.tables:
            return self.tables[name]
        for folder in run_folders(self.spark, self.folder) if self.folder else ():
            if PurePosixPath(folder).name == name:
                return read_run(self.spark, folder)
        raise KeyError(f"no run {name}")

"""Checkpoint tables in the folder that the whole cluster shares.

Every stage that is read twice, or whose lineage would grow, is written as Parquet under the folder that the
session names in ``spark.checkpoint.dir``; an executor that is lost later takes nothing with it.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT = "spark.checkpoint.dir"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
ROWS_PER_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
TEXT_ROWS = 1000


def text_batches(spark: SparkSession, rows: int = TEXT_ROWS) -> None:
    """Rows of whole texts are large: from now on the session hands rows to Python in Arrow batches of at most `rows`,
    as queries run after they are made. A smaller number that is set stays."""
    if int(spark.conf.get(ROWS_PER_BATCH)) > rows:
        spark.conf.set(ROWS_PER_BATCH, rows)


@contextmanager
def _set(spark: SparkSession, key: str, value: object) -> Iterator[None]:
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def rows_per_batch(spark: SparkSession, rows: int):
    """Jobs that start inside hand their rows to Python in Arrow batches of at most `rows`."""
    return _set(spark, ROWS_PER_BATCH, rows)


def shared_folder(spark: SparkSession) -> str:
    """The session's shared folder; a temporary one of this machine only where none is set and the master is local, as
    in tests, since executors elsewhere wouldn't see it."""
    folder = spark.conf.get(CHECKPOINT, None) or spark.sparkContext.getConf().get(CHECKPOINT)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{CHECKPOINT} has to name a folder that the whole cluster shares")
        folder = "file://" + tempfile.mkdtemp(prefix="weftline-")
        spark.conf.set(CHECKPOINT, folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/weftline-{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read again; ``df.written_to`` has the path for :func:`discard`. The shuffle
    files of the plan go once it is written."""
    spark = df.sparkSession
    path = new_path(spark, name)
    with _set(spark, CLEANUP, "true"):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def delete(spark: SparkSession, path: str) -> None:
    """Delete a file or folder and what is in it; nothing if it isn't there."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def discard(df: DataFrame) -> None:
    """Delete a table made by :func:`materialize` that nothing reads any more."""
    delete(df.sparkSession, df.written_to)

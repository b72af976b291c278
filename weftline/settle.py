"""Intermediate tables in the folder that the cluster shares, so that what is read twice is made once."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
METHODS = "spark.sql.codegen.hugeMethodLimit"
LONGEST = 8000  # bytes, beyond which the JVM interprets a method


@contextmanager
def short_methods(spark: SparkSession) -> Iterator[None]:
    """Jobs that start inside aren't compiled to methods that are too long for the JVM to make machine code of: a projection of
    close to a hundred columns runs several times as fast in several short ones."""
    before = spark.conf.get(METHODS)
    spark.conf.set(METHODS, min(int(before), LONGEST))
    try:
        yield
    finally:
        spark.conf.set(METHODS, before)


def settle(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet below the session's ``spark.checkpoint.dir`` and read again.

    Where none is set, a temporary folder of this machine becomes the session's, which only a local master can read."""
    spark = df.sparkSession
    folder = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{SETTING} has to name a folder that the whole cluster shares")
        folder = "file://" + tempfile.mkdtemp(prefix="weftline-")
        spark.conf.set(SETTING, folder)
    path = f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.settled_at = path
    return out


def unsettle(*tables: DataFrame) -> None:
    """Delete tables of :func:`settle` that nothing reads any more."""
    for df in tables:
        path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df.settled_at)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

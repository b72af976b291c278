"""The eight credit tables: readers with declared types, and cleaning of their sentinels.

The type of a CSV column follows from its name, so a read takes no pass to infer it and the parts of a table agree. A
table is cleaned by one projection; feature sets are functions of cleaned tables and never change them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..nulls import col, null_if, null_where, without_nan

CLIENT, TARGET = "SK_ID_CURR", "TARGET"

# Sentinels of the source data.
NO_DAY = 365243
TOO_LONG_AGO = -40000


@dataclass(frozen=True)
class Table:
    files: tuple[str, ...]
    clean: dict[str, Callable[[Column], Column]] = field(default_factory=dict)
    #: columns by which rows of a client run from new to old
    newest_first: tuple[str, ...] = ()


def _sentinel(value) -> Callable[[Column], Column]:
    return lambda c: null_if(c, value)


def _below(least: float) -> Callable[[Column], Column]:
    return lambda c: null_where(c, c < least)


TABLES: dict[str, Table] = {
    "application": Table(
        ("application_train", "application_test"),
        {
            "CODE_GENDER": _sentinel("XNA"),
            "DAYS_EMPLOYED": _sentinel(NO_DAY),
            "DAYS_LAST_PHONE_CHANGE": _sentinel(0),
            "NAME_FAMILY_STATUS": _sentinel("Unknown"),
            "ORGANIZATION_TYPE": _sentinel("XNA"),
        },
    ),
    "bureau": Table(("bureau",), dict.fromkeys(("DAYS_CREDIT_ENDDATE", "DAYS_CREDIT_UPDATE", "DAYS_ENDDATE_FACT"), _below(TOO_LONG_AGO))),
    "bureau_balance": Table(("bureau_balance",)),
    "previous_application": Table(
        ("previous_application",),
        dict.fromkeys(("DAYS_FIRST_DRAWING", "DAYS_FIRST_DUE", "DAYS_LAST_DUE_1ST_VERSION", "DAYS_LAST_DUE", "DAYS_TERMINATION"), _sentinel(NO_DAY)),
        ("DAYS_DECISION", "SK_ID_PREV"),
    ),
    "pos_cash": Table(("POS_CASH_balance",), {}, ("MONTHS_BALANCE", "SK_ID_PREV", "CNT_INSTALMENT_FUTURE", "CNT_INSTALMENT", "SK_DPD", "SK_DPD_DEF", "NAME_CONTRACT_STATUS")),
    "credit_card": Table(
        ("credit_card_balance",),
        dict.fromkeys(("AMT_DRAWINGS_ATM_CURRENT", "AMT_DRAWINGS_CURRENT"), _below(0)),
        ("MONTHS_BALANCE", "SK_ID_PREV", "AMT_BALANCE"),
    ),
    "installments": Table(
        ("installments_payments",), {}, ("DAYS_INSTALMENT", "SK_ID_PREV", "NUM_INSTALMENT_NUMBER", "NUM_INSTALMENT_VERSION", "DAYS_ENTRY_PAYMENT", "AMT_PAYMENT", "AMT_INSTALMENT")
    ),
}


# Names of text columns, by their beginning, whole, and by what they end in.
TEXT_BEGINS = ("NAME_", "CODE_", "CREDIT_ACTIVE", "CREDIT_CURRENCY", "CREDIT_TYPE", "WEEKDAY_", "PRODUCT_COMBINATION", "CHANNEL_TYPE")
TEXT_NAMES = (
    "OCCUPATION_TYPE", "ORGANIZATION_TYPE", "FLAG_OWN_CAR", "FLAG_OWN_REALTY", "FLAG_LAST_APPL_PER_CONTRACT", "STATUS", "FONDKAPREMONT_MODE", "HOUSETYPE_MODE",
    "WALLSMATERIAL_MODE", "EMERGENCYSTATE_MODE",
)


def declared(name: str) -> T.DataType:
    """The type of a column of the credit tables: text, whole numbers for keys and the target, else doubles."""
    if name.startswith(TEXT_BEGINS) or name in TEXT_NAMES:
        return T.StringType()
    if name.startswith("SK_ID_"):
        return T.LongType()
    return T.IntegerType() if name == TARGET else T.DoubleType()


def newest_first(table: str) -> list[Column]:
    return [F.desc_nulls_last(col(c)) for c in TABLES[table].newest_first]


def clean(table: str, df: DataFrame) -> DataFrame:
    """df with NaN and the table's sentinels as NULL, in one projection."""
    rules = TABLES[table].clean
    df = without_nan(df)
    return df.select(*[rules[c](col(c)).alias(c) if c in rules else col(c) for c in df.columns])


def read(spark: SparkSession, folder: str, table: str, schema: T.StructType | None = None, form: str = "csv") -> DataFrame:
    """The cleaned table from folder. Files of several parts are united by name; columns that a part lacks are NULL
    there, so rows to predict have no target. CSV columns have declared types unless a schema is given; only the line of
    names is read for that."""
    parts = []
    for name in TABLES[table].files:
        path = f"{folder.rstrip('/')}/{name}.{form}"
        if form != "csv":
            parts.append((spark.read.schema(schema) if schema else spark.read).format(form).load(path))
            continue
        names = schema.names if schema else spark.read.csv(path, header=True).columns
        parts.append(spark.read.schema(schema or T.StructType([T.StructField(n, declared(n)) for n in names])).csv(path, header=True))
    return clean(table, united(parts))


def united(parts: list[DataFrame]) -> DataFrame:
    """The rows of all parts by column name; a column that a part lacks is NULL there."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def _finished(spark: SparkSession, path: str) -> bool:
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
    return done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done)


def kept(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """What lies at path as Parquet; made and written there first unless a finished write is there."""
    if not _finished(spark, path):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def kept_by(spark: SparkSession, path: str, make: Callable[[], DataFrame], key: str, buckets: int) -> DataFrame:
    """As :func:`kept`, dealt to buckets of the key and sorted by it, so that tables of as many buckets join on it without a
    shuffle. The files alone don't tell of buckets; each session has a table of its catalog over them."""
    name = "weftline_" + hashlib.sha256(f"{path} {key} {buckets}".encode()).hexdigest()[:24]
    if not _finished(spark, path):
        spark.sql(f"drop table if exists {name}")
        made = make()
        made.repartition(buckets, col(key)).write.mode("overwrite").option("path", path).bucketBy(buckets, key).sortBy(key).saveAsTable(name)
    elif not spark.catalog.tableExists(name):
        fields = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema)
        spark.sql(f"create table {name} ({fields}) using parquet clustered by (`{key}`) sorted by (`{key}`) into {buckets} buckets location '{path}'")
    return spark.table(name)


class Sources:
    """Cleaned tables by name, each built once: from a folder, or from DataFrames as given. With `cache`, a folder, a
    table read from files is kept there as Parquet, by its name and the state of its files. runs: earlier predictions."""

    def __init__(
        self, spark: SparkSession, folder: str | None = None, form: str = "csv", tables: dict[str, DataFrame] | None = None, cache: str | None = None, runs=None
    ) -> None:
        from .runs import Runs

        self.spark, self.folder, self.form, self.cache = spark, folder, form, cache
        self.runs = runs if runs is not None else Runs(spark)
        self._tables = {name: clean(name, df) for name, df in (tables or {}).items()}

    def fingerprint(self, table: str | None = None) -> str:
        """The files of a table, or of all, with their sizes and times of change, as a digest."""
        from .runs import files_below

        names = [f"{n}.{self.form}" for t in ([table] if table else TABLES) for n in TABLES[t].files]
        state = [files_below(self.spark, f"{self.folder.rstrip('/')}/{n}") for n in names] if self.folder else []
        return hashlib.sha256(repr((self.form, names, state)).encode()).hexdigest()[:16]

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._tables:
            if self.folder is None:
                raise KeyError(f"no table {name}")
            if self.cache:
                path = f"{self.cache.rstrip('/')}/raw-{name}-{self.fingerprint(name)}"
                self._tables[name] = kept(self.spark, path, lambda: read(self.spark, self.folder, name, form=self.form))
            else:
                self._tables[name] = read(self.spark, self.folder, name, form=self.form)
        return self._tables[name]

    @property
    def base(self) -> DataFrame:
        """Clients with their target, which is NULL for rows to predict."""
        return self["application"].select(CLIENT, TARGET)


def split(df: DataFrame, target: str = TARGET) -> tuple[DataFrame, DataFrame]:
    """(rows with a target, rows to predict)"""
    return df.filter(col(target).isNotNull()), df.filter(col(target).isNull())


def run_score(folder: str) -> float | None:
    """The score at the end of the name of a run's folder."""
    try:
        return float(PurePosixPath(folder).name.rsplit("_", 1)[-1])
    except ValueError:
        return None

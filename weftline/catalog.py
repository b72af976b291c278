"""Every query by name, with its SQL: feature sets over the adapted credit tables, and the operators one by one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import features, oracle
from .nulls import col
from .operator_queries import OPERATOR_QUERIES, OPERATOR_SQL
from .sources.adapters import VOCABULARY, sources
from .sources.credit import CLIENT

FLAGSHIP = "feature_set_BureauFeatures"

TABLE_OF = {
    "Application": "application", "Bureau": "bureau", "PreviousApplication": "previous_application", "PosCash": "pos_cash",
    "InstallmentsPayments": "installments", "CreditCardBalance": "credit_card",
}


def rounded(df: DataFrame, key: str = CLIENT, digits: int = 4) -> DataFrame:
    """Numbers as doubles rounded up from just below the half: shares of small counts often lie at a half exactly,
    where sums in another order would round either way. Variances of keys keep their first six digits."""

    def made(f: T.StructField):
        if not isinstance(f.dataType, T.NumericType) or f.name == key:
            return col(f.name)
        quoted = "`" + f.name.replace("`", "``") + "`"
        if not oracle.is_id_variance(f.name):  # as text, as there are up to 1,800 columns
            return F.expr(f"round(cast({quoted} as double) + {oracle.OFF_TIES!r}D, {digits}) + 0.0D as {quoted}")
        x = col(f.name).cast("double")
        scale = F.pow(F.lit(10.0), F.floor(F.log10(x)) - (oracle.ID_DIGITS - 1))
        return F.when(x < 1e-6, 0.0).when(x.isNotNull(), F.round(x * oracle.OFF_ID_TIES / scale) * scale).alias(f.name)

    return df.select(*map(made, df.schema))


def vocabulary_of(name: str) -> dict:
    if name.startswith("Preds"):
        return {}
    table = TABLE_OF[name.removeprefix("AggregateFeature").split("Features")[0].removesuffix("OpenSolution")]
    return VOCABULARY[table]


def _feature_set(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        made = features.build(name, sources(spark, sf_dir), {"vocabulary": vocabulary_of(name)})
        left_out = name in oracle.BUT_ID_VARIANCES
        return rounded(made.select(*[col(c) for c in made.columns if not (left_out and oracle.is_id_variance(c))]))

    query.__name__ = f"feature_set_{name}"
    return query


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    **{f"feature_set_{name}": _feature_set(name) for name in features.names()},
    **OPERATOR_QUERIES,
}
ORACLE_SQL: dict[str, str] = {
    **{f"feature_set_{name}": sql() for name, sql in oracle.FEATURE_SETS.items()},
    **OPERATOR_SQL,
}

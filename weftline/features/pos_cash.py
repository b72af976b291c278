"""Monthly states of point-of-sale and cash loans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..nulls import col, flag, null_where
from ..operators.encode import shares
from ..plans.fusion import Agg, aggregate, recipes
from ..sources.credit import CLIENT, newest_first
from . import feature, vocab_of
from .bureau import SIX


def of_last_loan(df: DataFrame, table: str) -> DataFrame:
    """df with __last_loan: 1 on the rows of the loan that a client's newest row belongs to."""
    window = Window.partitionBy(CLIENT).orderBy(*newest_first(table)).rowsBetween(Window.unboundedPreceding, Window.currentRow)  # no rows are held
    return df.withColumn("__last_loan", (F.first("SK_ID_PREV").over(window).eqNullSafe(col("SK_ID_PREV"))).cast("int"))


@feature("PosCashFeatures")
def pos_cash(sources, conf) -> DataFrame:
    df = sources["pos_cash"]
    aggs = recipes("POS_", {"MONTHS_BALANCE": ["max", "mean", "size"], "SK_DPD": ["max", "mean"], "SK_DPD_DEF": ["max", "mean"]})
    return aggregate(df, [CLIENT], aggs + shares(vocab_of(df, conf), "POS_") + [Agg("POS_COUNT", "size")])


@feature("PosCashFeaturesOpenSolution")
def open_solution(sources, conf) -> DataFrame:
    def derive(rows: DataFrame) -> DataFrame:
        return of_last_loan(rows, "pos_cash").select(
            "*",
            flag(col("NAME_CONTRACT_STATUS") == "Completed").alias("__completed"),
            flag(col("SK_DPD") > 0).alias("pos_cash_paid_late"),
            flag(col("SK_DPD_DEF") > 0).alias("pos_cash_paid_late_with_tolerance"),
        )

    aggs = [
        Agg("pos_cash_remaining_installments", "max", "CNT_INSTALMENT_FUTURE", last=1),
        Agg("pos_cash_completed_contracts", "sum", "__completed"),
    ]
    for k, name in ((None, "all_installment_"), (6, "last_6_"), (12, "last_12_"), (30, "last_30_")):
        for c in ("pos_cash_paid_late", "pos_cash_paid_late_with_tolerance"):
            aggs += [Agg(f"{name}{c}_{f}", f, c, last=k) for f in ("count", "mean")]
        for c in ("SK_DPD", "SK_DPD_DEF"):
            aggs += [Agg(f"{name}{c}_{f}", f, c, last=k) for f in ("sum", "mean", "max", "std", "skew", "kurt")]
    for k in (6, 12):
        aggs += [Agg(f"{k}_period_trend_{c}", "trend", c, last=k) for c in ("SK_DPD", "SK_DPD_DEF", "CNT_INSTALMENT_FUTURE")]
    last = {
        "pos_cash_paid_late": ("count", "sum", "mean"),
        "pos_cash_paid_late_with_tolerance": ("mean",),
        "SK_DPD": ("sum", "mean", "max", "std"),
        "SK_DPD_DEF": ("sum", "mean", "max", "std"),
    }
    aggs += [Agg(f"last_loan_{c}_{f}", f, c, where="__last_loan = 1") for c, funcs in last.items() for f in funcs]
    return aggregate(sources["pos_cash"], [CLIENT], aggs, newest_first("pos_cash"), derive=derive, side_by_side=True)


@feature("PosCashFeaturesAntonova")
def antonova(sources, conf) -> DataFrame:
    df = sources["pos_cash"]
    vocab = vocab_of(df, conf)
    df = df.withColumn("CNT_INSTALMENT_FUTURE", null_where(col("CNT_INSTALMENT_FUTURE"), col("CNT_INSTALMENT_FUTURE") > 60))
    df = df.withColumn("pos CNT_INSTALMENT more CNT_INSTALMENT_FUTURE", flag(col("CNT_INSTALMENT") > col("CNT_INSTALMENT_FUTURE")))
    aggs = recipes("POS_", {c: SIX for c in df.columns if c not in vocab})
    return aggregate(df, [CLIENT], aggs + shares(vocab, "POS_") + [Agg("POS_COUNT", "size")])

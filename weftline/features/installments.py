"""Payments of instalments."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..nulls import at_least_zero, col, flag, null_where, ratio, ratio_or_zero
from ..operators.encode import shares
from ..plans.fusion import Agg, aggregate, recipes
from ..sources.credit import CLIENT, newest_first
from . import feature, vocab_of
from .bureau import SIX
from .pos_cash import of_last_loan

# Columns, statistics, periods and pairs of periods that name the features.
NUMERIC = {
    "NUM_INSTALMENT_VERSION": ["nunique"],
    "DPD": ["max", "mean", "sum"],
    "DBD": ["max", "mean", "sum"],
    "PAYMENT_PERC": ["mean", "var"],
    "PAYMENT_DIFF": ["mean", "var"],
    "AMT_INSTALMENT": ["max", "mean", "sum"],
    "AMT_PAYMENT": ["min", "max", "mean", "sum"],
    "DAYS_ENTRY_PAYMENT": ["max", "mean", "sum"],
}
EIGHT = ("sum", "mean", "max", "min", "std", "median", "skew", "iqr")
IN_PERIOD = {
    "NUM_INSTALMENT_VERSION": EIGHT,
    "installment_paid_late_in_days": EIGHT,
    "installment_paid_late": ("count", "mean"),
    "installment_paid_over_amount": EIGHT,
    "installment_paid_over": ("count", "mean"),
}
PERIODS = (1, 5, 10, 20, 50, 100)
FRACTIONS = ((5, 20), (5, 50), (10, 50), (10, 100), (20, 100))
TRENDS = (10, 50, 100, 500)


@feature("InstallmentsPaymentsFeatures")
def installments(sources, conf) -> DataFrame:
    df = sources["installments"]
    vocab = vocab_of(df, conf)
    late = col("DAYS_ENTRY_PAYMENT") - col("DAYS_INSTALMENT")
    df = df.select(
        "*",
        ratio(col("AMT_PAYMENT"), col("AMT_INSTALMENT")).alias("PAYMENT_PERC"),
        (col("AMT_INSTALMENT") - col("AMT_PAYMENT")).alias("PAYMENT_DIFF"),
        at_least_zero(late).alias("DPD"),
        at_least_zero(-late).alias("DBD"),
    )
    return aggregate(df, [CLIENT], recipes("INSTAL_", NUMERIC) + shares(vocab, "INSTAL_") + [Agg("INSTAL_COUNT", "size")], dealt=True)


@feature("InstallmentsPaymentsFeaturesOpenSolution")
def open_solution(sources, conf) -> DataFrame:
    late, over = col("DAYS_ENTRY_PAYMENT") - col("DAYS_INSTALMENT"), col("AMT_PAYMENT") - col("AMT_INSTALMENT")

    def derive(rows: DataFrame) -> DataFrame:
        return of_last_loan(rows, "installments").select(
            "*",
            late.alias("installment_paid_late_in_days"),
            flag(late > 0).alias("installment_paid_late"),
            over.alias("installment_paid_over_amount"),
            flag(over > 0).alias("installment_paid_over"),
        )

    aggs = []
    for k, name in ((None, "all_installment_"), *((k, f"last_{k}_") for k in PERIODS)):
        aggs += [Agg(f"{name}{c}_{f}", f, c, last=k) for c, funcs in IN_PERIOD.items() for f in funcs]
    for k in TRENDS:
        aggs += [Agg(f"{k}_period_trend_{c}", "trend", c, last=k) for c in ("installment_paid_late_in_days", "installment_paid_over_amount")]
    five = ("sum", "mean", "max", "min", "std")
    last = {"installment_paid_late_in_days": five, "installment_paid_late": ("count", "mean"), "installment_paid_over_amount": five, "installment_paid_over": ("count", "mean")}
    aggs += [Agg(f"last_loan_{c}_{f}", f, c, where="__last_loan = 1") for c, funcs in last.items() for f in funcs]
    made = aggregate(sources["installments"], [CLIENT], aggs, newest_first("installments"), derive=derive, side_by_side=True)
    fractions = [
        ratio_or_zero(col(f"last_{a}_{c}_{f}"), col(f"last_{b}_{c}_{f}")).alias(f"last_{a}by{b}_fraction_{c}_{f}")
        for a, b in FRACTIONS
        for c, funcs in IN_PERIOD.items()
        for f in funcs
    ]
    return made.select("*", *fractions)


@feature("InstallmentsPaymentsFeaturesAntonova")
def antonova(sources, conf) -> DataFrame:
    df = sources["installments"]
    vocab = vocab_of(df, conf)
    version, entry = col("NUM_INSTALMENT_VERSION"), col("DAYS_ENTRY_PAYMENT")
    df = df.withColumns({"NUM_INSTALMENT_VERSION": null_where(version, version > 70), "DAYS_ENTRY_PAYMENT": null_where(entry, entry < -4000)})

    def derive(rows: DataFrame) -> DataFrame:
        return rows.select(
            "*",
            (col("DAYS_ENTRY_PAYMENT") - col("DAYS_INSTALMENT")).alias("ins DAYS_ENTRY_PAYMENT - DAYS_INSTALMENT"),
            flag(col("NUM_INSTALMENT_NUMBER") == 100).alias("ins NUM_INSTALMENT_NUMBER_100"),
            flag(col("DAYS_INSTALMENT") > col("NUM_INSTALMENT_NUMBER") * 50 / 3 - 11500 / 3).alias("ins DAYS_INSTALMENT more NUM_INSTALMENT_NUMBER"),
            (col("AMT_INSTALMENT") - col("AMT_PAYMENT")).alias("ins AMT_INSTALMENT - AMT_PAYMENT"),
            ratio(col("AMT_PAYMENT"), col("AMT_INSTALMENT")).alias("ins AMT_PAYMENT / AMT_INSTALMENT"),
        )

    aggs = recipes("INS_", {c: SIX for c in derive(df).columns if c not in vocab})
    # gathered though not so wide: sums of some 70 statistics for the few payments of a client are larger than they are
    return aggregate(df, [CLIENT], aggs + shares(vocab, "INS_") + [Agg("INSTAL_COUNT", "size")], derive=derive, wide=0)

"""Monthly states of credit cards."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rowwise import row_nulls
from ..nulls import col, null_where, ratio
from ..operators.encode import dummies, shares
from ..plans.fusion import Agg, aggregate, recipes
from ..sources.credit import CLIENT, newest_first
from . import feature, vocab_of
from .bureau import SIX

LOAN = "SK_ID_PREV"
DIFFERENCES = [
    ("SK_DPD", "MONTHS_BALANCE"),
    ("SK_DPD_DEF", "MONTHS_BALANCE"),
    ("SK_DPD", "SK_DPD_DEF"),
    ("AMT_TOTAL_RECEIVABLE", "AMT_RECIVABLE"),
    ("AMT_TOTAL_RECEIVABLE", "AMT_RECEIVABLE_PRINCIPAL"),
    ("AMT_RECIVABLE", "AMT_RECEIVABLE_PRINCIPAL"),
    ("AMT_BALANCE", "AMT_RECIVABLE"),
    ("AMT_BALANCE", "AMT_RECEIVABLE_PRINCIPAL"),
    ("AMT_BALANCE", "AMT_TOTAL_RECEIVABLE"),
    ("AMT_DRAWINGS_CURRENT", "AMT_DRAWINGS_ATM_CURRENT"),
    ("AMT_DRAWINGS_CURRENT", "AMT_DRAWINGS_OTHER_CURRENT"),
    ("AMT_DRAWINGS_CURRENT", "AMT_DRAWINGS_POS_CURRENT"),
]


@feature("CreditCardBalanceFeatures")
def credit_card(sources, conf) -> DataFrame:
    df = sources["credit_card"]
    vocab = vocab_of(df, conf)
    four = ["max", "mean", "sum", "var"]
    aggs = recipes("CC_", {c: four for c in df.columns if c not in (*vocab, CLIENT, LOAN)})
    aggs += [Agg(f"CC_{n}_{f.upper()}", f, expr=e) for n, e in dummies(vocab).items() for f in four]
    return aggregate(df, [CLIENT], aggs + [Agg("CC_COUNT", "size")])


@feature("CreditCardBalanceFeaturesOpenSolution")
def open_solution(sources, conf) -> DataFrame:
    """Instalments are the sum over a client's loans of each loan's highest count; the load is the mean over loans
    and limits of highest balance to limit."""
    df = sources["credit_card"]
    by_limit = df.groupBy(CLIENT, LOAN, "AMT_CREDIT_LIMIT_ACTUAL").agg(
        F.max("AMT_BALANCE").alias("balance"), F.max("CNT_INSTALMENT_MATURE_CUM").alias("mature"), F.sum("SK_DPD").alias("dpd"), F.count("SK_DPD").alias("n_dpd"),
        F.sum("AMT_DRAWINGS_ATM_CURRENT").alias("atm"), F.sum("AMT_DRAWINGS_CURRENT").alias("drawn"),
    )
    load = F.when(col("AMT_CREDIT_LIMIT_ACTUAL").isNotNull(), ratio(F.col("balance"), col("AMT_CREDIT_LIMIT_ACTUAL")))
    by_loan = by_limit.groupBy(CLIENT, LOAN).agg(
        F.max("mature").alias("mature"), F.sum(load).alias("load"), F.count(load).alias("n_load"), F.sum("dpd").alias("dpd"), F.sum("n_dpd").alias("n_dpd"),
        F.sum("atm").alias("atm"), F.sum("drawn").alias("drawn"),
    )
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0.0))
    static = by_loan.filter(col(CLIENT).isNotNull()).groupBy(CLIENT).agg(
        F.count(LOAN).alias("credit_card_number_of_loans"),
        ratio(F.sum("dpd"), F.sum("n_dpd")).alias("credit_card_average_of_days_past_due"),
        zero("atm").alias("credit_card_drawings_atm"),
        zero("drawn").alias("credit_card_drawings_total"),
        zero("mature").alias("credit_card_total_installments"),
        ratio(F.sum("load"), F.sum("n_load")).alias("credit_card_avg_loading_of_credit_limit"),
    )
    static = static.select(
        "*",
        ratio(col("credit_card_drawings_atm"), col("credit_card_drawings_total")).alias("credit_card_cash_card_ratio"),
        ratio(col("credit_card_total_installments"), col("credit_card_number_of_loans")).alias("credit_card_installments_per_loan"),
    )
    oldest_first = [F.asc_nulls_first(col(c)) for c in ("MONTHS_BALANCE", "SK_ID_PREV", "AMT_BALANCE")]
    diff = col("AMT_BALANCE") - F.lag("AMT_BALANCE").over(Window.partitionBy(CLIENT).orderBy(*oldest_first))
    dynamic = df.filter(col(CLIENT).isNotNull()).select(CLIENT, diff.alias("d")).groupBy(CLIENT).agg(F.avg("d").alias("credit_card_monthly_diff"))
    return static.join(dynamic, CLIENT)  # both have one row for each client


@feature("CreditCardBalanceFeaturesAntonova")
def antonova(sources, conf) -> DataFrame:
    df = sources["credit_card"]
    vocab = vocab_of(df, conf)
    # Bounds beyond which a figure is an error.
    bad = {"AMT_PAYMENT_CURRENT": 4000000, "AMT_CREDIT_LIMIT_ACTUAL": 1000000}
    df = df.select(*[null_where(col(c), col(c) > bad[c]).alias(c) if c in bad else col(c) for c in df.columns])
    df = df.select(
        "*",
        row_nulls([col(c) for c in df.columns]).alias("card missing"),
        *[(col(a) - col(b)).alias(f"card {a} - {b}") for a, b in DIFFERENCES],
    )
    aggs = recipes("CARD_", {c: SIX for c in df.columns if c not in vocab})
    return aggregate(df, [CLIENT], aggs + shares(vocab, "CARD_") + [Agg("CARD_COUNT", "size")])

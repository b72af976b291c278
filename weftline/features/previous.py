"""Earlier applications."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.rowwise import row_nulls
from ..nulls import col, flag, null_where, ratio
from ..operators.encode import dummies, shares
from ..plans.fusion import Agg, aggregate, recipes
from ..sources.credit import CLIENT, newest_first
from . import feature, vocab_of
from .bureau import SIX

NUMERIC = {
    "AMT_ANNUITY": ["max", "mean"],
    "AMT_APPLICATION": ["max", "mean"],
    "AMT_CREDIT": ["max", "mean"],
    "APP_CREDIT_PERC": ["max", "mean"],
    "AMT_DOWN_PAYMENT": ["max", "mean"],
    "AMT_GOODS_PRICE": ["max", "mean"],
    "HOUR_APPR_PROCESS_START": ["max", "mean"],
    "RATE_DOWN_PAYMENT": ["max", "mean"],
    "DAYS_DECISION": ["max", "mean"],
    "CNT_PAYMENT": ["mean", "sum"],
}
APPROVED, REFUSED = "NAME_CONTRACT_STATUS = 'Approved'", "NAME_CONTRACT_STATUS = 'Refused'"


@feature("PreviousApplicationFeatures")
def previous(sources, conf) -> DataFrame:
    df = sources["previous_application"]
    vocab = vocab_of(df, conf)
    df = df.withColumn("APP_CREDIT_PERC", ratio(col("AMT_APPLICATION"), col("AMT_CREDIT")))
    aggs = recipes("PREV_", NUMERIC) + recipes("APPROVED_", NUMERIC, APPROVED) + recipes("REFUSED_", NUMERIC, REFUSED)
    return aggregate(df, [CLIENT], aggs + shares(vocab, "PREV_"))


@feature("PreviousApplicationFeaturesOpenSolution")
def open_solution(sources, conf) -> DataFrame:
    df = sources["previous_application"].select(
        "*",
        flag(col("NAME_CONTRACT_STATUS") == "Approved").alias("__approved"),
        flag(col("NAME_CONTRACT_STATUS") == "Refused").alias("__refused"),
        flag(col("NAME_CONTRACT_TYPE") == "Revolving loans").alias("__revolving"),
    )
    aggs = [
        Agg("previous_application_prev_was_approved", "max", "__approved", last=1),
        Agg("previous_application_prev_was_refused", "max", "__refused", last=1),
        Agg("previous_application_number_of_prev_application", "nunique", "SK_ID_PREV"),
        Agg("previous_application_fraction_of_refused_applications", "mean", "__refused"),
        Agg("prev_applications_prev_was_revolving_loan", "max", "__revolving", last=1),
    ]
    for k in range(1, 6):
        aggs += [
            Agg(f"previous_application_term_of_last_{k}_credits_mean", "mean", "CNT_PAYMENT", last=k),
            Agg(f"previous_application_days_decision_about_last_{k}_credits_mean", "mean", "DAYS_DECISION", last=k),
            Agg(f"previous_application_days_first_drawing_last_{k}_credits_mean", "mean", "DAYS_FIRST_DRAWING", last=k),
        ]
    return aggregate(df, [CLIENT], aggs, newest_first("previous_application"))


@feature("PreviousApplicationFeaturesAntonova")
def antonova(sources, conf) -> DataFrame:
    df = sources["previous_application"]
    vocab = vocab_of(df, conf)
    # Bounds beyond which a figure is an error.
    bad = {"AMT_CREDIT": 6000000, "SELLERPLACE_AREA": 3500000}
    df = df.select(*[null_where(col(c), col(c) > bad[c]).alias(c) if c in bad else col(c) for c in df.columns])

    def derive(rows: DataFrame) -> DataFrame:
        return rows.select(
            "*",
            row_nulls([col(c) for c in rows.columns]).alias("prev missing"),
            ratio(col("AMT_APPLICATION"), col("AMT_CREDIT")).alias("prev AMT_APPLICATION / AMT_CREDIT"),
            *[
                (col(a) - col(b)).alias(f"prev {a} - {b}")
                for a, b in (
                    ("AMT_APPLICATION", "AMT_CREDIT"),
                    ("AMT_APPLICATION", "AMT_GOODS_PRICE"),
                    ("AMT_GOODS_PRICE", "AMT_CREDIT"),
                    ("DAYS_FIRST_DRAWING", "DAYS_FIRST_DUE"),
                )
            ],
            flag(col("DAYS_TERMINATION") < -500).alias("prev DAYS_TERMINATION less -500"),
        )

    numeric = [c for c in derive(df).columns if c not in vocab]
    aggs = []
    for prefix, where in (("PREV_", None), ("APPROVED_", APPROVED), ("REFUSED_", REFUSED)):
        aggs += recipes(prefix, {c: SIX for c in numeric}, where)
        aggs += [Agg(f"{prefix}{n}_MEAN", "mean", where=where, expr=e) for n, e in dummies(vocab).items()]
    return aggregate(df, [CLIENT], aggs, derive=derive)

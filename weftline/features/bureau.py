"""Loans at other lenders and their monthly states: two-level aggregates, all loans and by state."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.aggregates import first_known, last_known
from ..nulls import col, differs, flag, keep_unless, null_where, ratio
from ..operators.encode import dummies, shares
from ..plans.fusion import Agg, aggregate, recipes
from ..sources.credit import CLIENT
from . import feature, vocab_of

LOAN = "SK_ID_BUREAU"
NUMERIC = {
    "DAYS_CREDIT": ["mean", "var"],
    "DAYS_CREDIT_ENDDATE": ["mean"],
    "DAYS_CREDIT_UPDATE": ["mean"],
    "CREDIT_DAY_OVERDUE": ["mean"],
    "AMT_CREDIT_MAX_OVERDUE": ["mean"],
    "AMT_CREDIT_SUM": ["mean", "sum"],
    "AMT_CREDIT_SUM_DEBT": ["mean", "sum"],
    "AMT_CREDIT_SUM_OVERDUE": ["mean"],
    "AMT_CREDIT_SUM_LIMIT": ["mean", "sum"],
    "AMT_ANNUITY": ["max", "mean"],
    "CNT_CREDIT_PROLONG": ["sum"],
    "MONTHS_BALANCE_MIN": ["min"],
    "MONTHS_BALANCE_MAX": ["max"],
    "MONTHS_BALANCE_SIZE": ["mean", "sum"],
}
ACTIVE, CLOSED = "CREDIT_ACTIVE = 'Active'", "CREDIT_ACTIVE = 'Closed'"
SIX = ["min", "max", "size", "mean", "var", "sum"]


@feature("BureauFeatures")
def bureau(sources, conf) -> DataFrame:
    loans, months = sources["bureau"], sources["bureau_balance"]
    month_vocab, loan_vocab = vocab_of(months, conf), vocab_of(loans, conf)
    per_loan = aggregate(months, [LOAN], recipes("", {"MONTHS_BALANCE": ["min", "max", "size"]}) + shares(month_vocab, ""))
    month_shares = [Agg(f"BURO_{n}_MEAN_MEAN", "mean", f"{n}_MEAN") for n in dummies(month_vocab)]
    joined = loans.join(per_loan, LOAN, "left")
    numbers = recipes("BURO_", NUMERIC) + recipes("ACTIVE_", NUMERIC, ACTIVE) + recipes("CLOSED_", NUMERIC, CLOSED)
    return aggregate(joined, [CLIENT], numbers + shares(loan_vocab, "BURO_") + month_shares)


@feature("BureauFeaturesOpenSolution")
def open_solution(sources, conf) -> DataFrame:
    df = sources["bureau"].select(
        "*", differs(col("CREDIT_ACTIVE"), "Closed").alias("__active"), flag(col("DAYS_CREDIT_ENDDATE") > 0).alias("__future")
    )
    aggs = [
        Agg("bureau_number_of_past_loans", "count", "DAYS_CREDIT"),
        Agg("bureau_number_of_loan_types", "nunique", "CREDIT_TYPE"),
        Agg("bureau_credit_active_binary", "mean", "__active"),
        Agg("bureau_total_customer_debt", "sum", "AMT_CREDIT_SUM_DEBT"),
        Agg("bureau_total_customer_credit", "sum", "AMT_CREDIT_SUM"),
        Agg("bureau_total_customer_overdue", "sum", "AMT_CREDIT_SUM_OVERDUE"),
        Agg("bureau_average_creditdays_prolonged", "sum", "CNT_CREDIT_PROLONG"),
        Agg("bureau_credit_enddate_percentage", "mean", "__future"),
    ]
    past, types, debt = col("bureau_number_of_past_loans"), col("bureau_number_of_loan_types"), col("bureau_total_customer_debt")
    return aggregate(df, [CLIENT], aggs).select(
        "*",
        ratio(past, types).alias("bureau_average_of_past_loans_per_type"),
        ratio(debt, col("bureau_total_customer_credit")).alias("bureau_debt_credit_ratio"),
        ratio(col("bureau_total_customer_overdue"), debt).alias("bureau_overdue_debt_ratio"),
    )


def status_code(vocab: list[str]) -> Column:
    """A number in the order of STATUS: 1, 3, 5, ... for the values of vocab in order, even ones for others between them."""
    return sum((flag(col("STATUS") > v) + flag(col("STATUS") >= v) for v in vocab), F.lit(0))


def month_history(months: DataFrame, vocab: dict[str, list[str]]) -> DataFrame:
    """One row for each loan: statistics over its month rows, from which :func:`month_columns` follow.

    The first and the last known state are numbers, put behind whole months in one number, as sums of numbers alone need no sort."""
    month, known, n = col("MONTHS_BALANCE"), F.when(col("STATUS").isNotNull(), status_code(vocab["STATUS"])), 2 * len(vocab["STATUS"]) + 1
    if isinstance(months.schema["MONTHS_BALANCE"].dataType, T.IntegralType):
        place = month.cast("bigint") * n + known
        ends = [F.pmod(F.min(place), F.lit(n)), F.pmod(F.max(place), F.lit(n))]
    else:
        ends = [first_known(known, F.struct(month, known)), last_known(known, F.struct(month, known))]
    extra = [
        ends[0].alias("__first"),
        ends[1].alias("__last"),
        F.abs(F.min(month)).alias("Month"),
        F.abs(F.min(F.when(col("STATUS") == "C", month))).alias("When_closed"),
    ] + [F.count(F.when(col("STATUS") == str(k), month)).alias(f"__d{k}") for k in range(6)]
    return aggregate(months, [LOAN], recipes("", {"MONTHS_BALANCE": ["min", "max", "size"]}) + shares({"STATUS": vocab["STATUS"]}, ""), extra=extra)


def month_columns(history: list[str], vocab: dict[str, list[str]]) -> dict[str, Column | str]:
    """Columns of a loan from those of its history, named `history`, by name; a name stands for the column of that name. All are
    NULL without a history.

    A loan's own values are the same on all its month rows, so their minimum, maximum are the value itself."""
    size = F.col("MONTHS_BALANCE_SIZE")
    there = size.isNotNull()
    # a count of no month is missing: the loan has no row of that state
    counts = {f"DPD_{k}_cnt": F.when(F.col(f"__d{k}") > 0, F.col(f"__d{k}")) for k in range(6)}
    values = {"Month": F.col("Month"), "When_closed": F.col("When_closed"), "Month_closed_to_end": F.col("Month") - F.col("When_closed")}
    for k in range(6):
        values[f"DPD_{k}_cnt"] = counts[f"DPD_{k}_cnt"]
        values[f"DPD_{k} / Month"] = ratio(counts[f"DPD_{k}_cnt"], F.col("Month"))
    values["Non_zero_DPD_cnt"] = F.when(there, sum((F.coalesce(counts[f"DPD_{k}_cnt"], F.lit(0)) for k in range(1, 6)), F.lit(0)))
    kept = [c for c in history if not c.startswith("__") and c not in (LOAN, "Month", "When_closed")]
    made = {c: col(c) for c in kept[:3]}
    for n, v in {LOAN: F.when(there, F.col(LOAN)), **{c: None for c in kept[3:]}, **values}.items():
        made |= {n: col(n)} if v is None else {f"{n}_MIN": v, f"{n}_MAX": f"{n}_MIN", f"{n}_SIZE": "MONTHS_BALANCE_SIZE"}
    for name, source in (("First_status", "__first"), ("Last_status", "__last")):
        for v in vocab["STATUS"]:
            made[f"{name}_{v}_MEAN"] = F.when(there, F.coalesce(F.col(source) == 2 * sorted(vocab["STATUS"]).index(v) + 1, F.lit(False)).cast("double"))
        made[f"{name}_nan_MEAN"] = F.when(there, F.col(source).isNull().cast("double"))
    return made


def without_outliers(loans: DataFrame) -> DataFrame:
    # Bounds beyond which a figure is an error.
    bad = {
        "AMT_ANNUITY": lambda c: c > 0.8e8,
        "AMT_CREDIT_SUM": lambda c: c > 3e8,
        "AMT_CREDIT_SUM_DEBT": lambda c: c > 1e8,
        "AMT_CREDIT_MAX_OVERDUE": lambda c: c > 0.8e8,
        "DAYS_ENDDATE_FACT": lambda c: c < -10000,
        "DAYS_CREDIT_UPDATE": lambda c: (c > 0) | (c < -40000),
        "DAYS_CREDIT_ENDDATE": lambda c: c < -10000,
    }
    clean = loans.select(*[null_where(col(c), bad[c](col(c))).alias(c) if c in bad else col(c) for c in loans.columns])
    return clean.filter(keep_unless(col("DAYS_ENDDATE_FACT") < col("DAYS_CREDIT")))


DIFFERENCES = [
    ("AMT_CREDIT_SUM", "AMT_CREDIT_SUM_DEBT"),
    ("AMT_CREDIT_SUM", "AMT_CREDIT_SUM_LIMIT"),
    ("AMT_CREDIT_SUM", "AMT_CREDIT_SUM_OVERDUE"),
    ("DAYS_CREDIT", "CREDIT_DAY_OVERDUE"),
    ("DAYS_CREDIT", "DAYS_CREDIT_ENDDATE"),
    ("DAYS_CREDIT", "DAYS_ENDDATE_FACT"),
    ("DAYS_CREDIT_ENDDATE", "DAYS_ENDDATE_FACT"),
    ("DAYS_CREDIT_UPDATE", "DAYS_CREDIT_ENDDATE"),
]


def antonova_rows(sources, conf) -> dict:
    """What :func:`plans.fusion.aggregate` makes the set of."""
    months, loans = sources["bureau_balance"], sources["bureau"]
    month_vocab, loan_vocab = vocab_of(months, conf), vocab_of(loans, conf)
    df = without_outliers(loans)
    history = month_history(months, month_vocab)
    joined = df.join(history, LOAN, "left")
    of_months = month_columns(history.columns, month_vocab)
    differences = {f"bureau {a} - {b}": col(a) - col(b) for a, b in DIFFERENCES}
    unseen = set(history.columns) - {LOAN}

    def derive(rows: DataFrame) -> DataFrame:
        made = {**differences, **{n: c for n, c in of_months.items() if not isinstance(c, str)}}
        return rows.select(*[col(c) for c in rows.columns if c not in unseen], *[c.alias(n) for n, c in made.items()])

    aggs = []
    for prefix, where in (("BURO_", None), ("ACTIVE_", ACTIVE), ("CLOSED_", CLOSED)):
        for c in (*df.columns, *differences, *of_months):
            if c not in (LOAN, *loan_vocab):
                same = of_months.get(c)
                aggs += [replace(a, source=same if isinstance(same, str) else c) for a in recipes(prefix, {c: SIX}, where)]
        aggs += [Agg(f"{prefix}{n}_MEAN", "mean", where=where, expr=e) for n, e in dummies(loan_vocab).items()]
    return {"df": joined, "keys": [CLIENT], "aggs": aggs, "derive": derive, "keyed": df}


@feature("BureauFeaturesAntonova")
def antonova(sources, conf) -> DataFrame:
    return aggregate(**antonova_rows(sources, conf))

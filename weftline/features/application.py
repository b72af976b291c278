"""Features of the application row itself."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rowwise import row_kurtosis, row_max, row_mean, row_median, row_min, row_std, row_sum
from ..nulls import col, flag, ratio
from ..operators.encode import factorize, one_hot
from ..operators.joins import lookup
from ..operators.ranking import group_medians
from ..sources.credit import CLIENT, TARGET
from . import feature, vocab_of

EXT = ["EXT_SOURCE_1", "EXT_SOURCE_2", "EXT_SOURCE_3"]
BINARY = ["CODE_GENDER", "FLAG_OWN_CAR", "FLAG_OWN_REALTY"]
# Prices that occur most.
MOST_POPULAR_PRICES = [225000, 450000, 675000, 900000]
POPULAR_PRICES = [1125000, 1350000, 1575000, 1800000, 2250000]

RATIOS = {
    "annuity_income_percentage": ("AMT_ANNUITY", "AMT_INCOME_TOTAL"),
    "car_to_birth_ratio": ("OWN_CAR_AGE", "DAYS_BIRTH"),
    "car_to_employ_ratio": ("OWN_CAR_AGE", "DAYS_EMPLOYED"),
    "children_ratio": ("CNT_CHILDREN", "CNT_FAM_MEMBERS"),
    "credit_to_annuity_ratio": ("AMT_CREDIT", "AMT_ANNUITY"),
    "credit_to_goods_ratio": ("AMT_CREDIT", "AMT_GOODS_PRICE"),
    "credit_to_income_ratio": ("AMT_CREDIT", "AMT_INCOME_TOTAL"),
    "days_employed_percentage": ("DAYS_EMPLOYED", "DAYS_BIRTH"),
    "income_credit_percentage": ("AMT_INCOME_TOTAL", "AMT_CREDIT"),
    "income_per_person": ("AMT_INCOME_TOTAL", "CNT_FAM_MEMBERS"),
    "payment_rate": ("AMT_ANNUITY", "AMT_CREDIT"),
    "phone_to_birth_ratio": ("DAYS_LAST_PHONE_CHANGE", "DAYS_BIRTH"),
    "phone_to_employ_ratio": ("DAYS_LAST_PHONE_CHANGE", "DAYS_EMPLOYED"),
    "credit_per_person": ("AMT_CREDIT", "CNT_FAM_MEMBERS"),
}


@feature("ApplicationFeaturesOpenSolution")
def ratios(sources, conf) -> DataFrame:
    ext = [col(c) for c in EXT]
    grown = col("CNT_FAM_MEMBERS") - col("CNT_CHILDREN")
    made = {n: ratio(col(a), col(b)) for n, (a, b) in RATIOS.items()} | {
        "income_per_child": ratio(col("AMT_INCOME_TOTAL"), 1 + col("CNT_CHILDREN")),
        "credit_per_child": ratio(col("AMT_CREDIT"), 1 + col("CNT_CHILDREN")),
        "external_sources_weighted": ext[0] * 2 + ext[1] * 3 + ext[2] * 4,
        "cnt_non_child": grown,
        "child_to_non_child_ratio": ratio(col("CNT_CHILDREN"), grown),
        "income_per_non_child": ratio(col("AMT_INCOME_TOTAL"), grown),
        "credit_per_non_child": ratio(col("AMT_CREDIT"), grown),
        "external_sources_min": row_min(ext),
        "external_sources_max": row_max(ext),
        "external_sources_sum": row_sum(ext),
        "external_sources_mean": row_mean(ext),
        "external_sources_nanmedian": row_median(ext),
        "short_employment": flag(col("DAYS_EMPLOYED") < -2000),
        "young_age": flag(col("DAYS_BIRTH") < -14000),
    }
    return sources["application"].select(CLIENT, *[c.alias(n) for n, c in made.items()])


@feature("ApplicationFeaturesAntonova")
def products(sources, conf) -> DataFrame:
    made = {f"app {EXT[a]} * {EXT[b]}": col(EXT[a]) * col(EXT[b]) for a, b in ((0, 1), (0, 2), (1, 2))}
    made |= {f"app {e} * DAYS_EMPLOYED": col(e) * col("DAYS_EMPLOYED") for e in EXT}
    made |= {f"app {e} / DAYS_BIRTH": ratio(col(e), col("DAYS_BIRTH")) for e in EXT}
    made |= {
        "app AMT_CREDIT - AMT_GOODS_PRICE": col("AMT_CREDIT") - col("AMT_GOODS_PRICE"),
        "app AMT_INCOME_TOTAL / 12 - AMT_ANNUITY": col("AMT_INCOME_TOTAL") / 12 - col("AMT_ANNUITY"),
        "app AMT_INCOME_TOTAL / AMT_ANNUITY": ratio(col("AMT_INCOME_TOTAL"), col("AMT_ANNUITY")),
        "app AMT_INCOME_TOTAL - AMT_GOODS_PRICE": col("AMT_INCOME_TOTAL") - col("AMT_GOODS_PRICE"),
        "app most popular AMT_GOODS_PRICE": flag(col("AMT_GOODS_PRICE").isin(MOST_POPULAR_PRICES)),
        "app popular AMT_GOODS_PRICE": flag(col("AMT_GOODS_PRICE").isin(POPULAR_PRICES)),
        "app DAYS_EMPLOYED - DAYS_BIRTH": col("DAYS_EMPLOYED") - col("DAYS_BIRTH"),
    }
    return sources["application"].select(CLIENT, *[c.alias(n) for n, c in made.items()])


def new_columns(df: DataFrame) -> DataFrame:
    """df with the sixteen NEW_ columns. Flags that are text don't count as live flags."""
    docs = [c for c in df.columns if "FLAG_DOC" in c]
    texts = {c for c, kind in df.dtypes if kind == "string"}
    live = [c for c in df.columns if "FLAG_" in c and "FLAG_DOC" not in c and "_FLAG_" not in c and c not in texts]
    ext = [col(c) for c in EXT]
    by_org = group_medians(df, "ORGANIZATION_TYPE", "AMT_INCOME_TOTAL").select(F.col("g").alias("__org"), F.col("median").alias("__income"))
    deviation = row_std(ext)
    mean_deviation = F.lit(df.agg(F.avg(deviation)).first()[0]).cast("double")
    made = {
        "NEW_CREDIT_TO_ANNUITY_RATIO": ratio(col("AMT_CREDIT"), col("AMT_ANNUITY")),
        "NEW_CREDIT_TO_GOODS_RATIO": ratio(col("AMT_CREDIT"), col("AMT_GOODS_PRICE")),
        "NEW_DOC_IND_KURT": row_kurtosis([col(c) for c in docs]),
        "NEW_LIVE_IND_SUM": row_sum([col(c) for c in live]),
        "NEW_INC_PER_CHLD": ratio(col("AMT_INCOME_TOTAL"), 1 + col("CNT_CHILDREN")),
        "NEW_EMPLOY_TO_BIRTH_RATIO": ratio(col("DAYS_EMPLOYED"), col("DAYS_BIRTH")),
        "NEW_ANNUITY_TO_INCOME_RATIO": ratio(col("AMT_ANNUITY"), 1 + col("AMT_INCOME_TOTAL")),
        "NEW_SOURCES_PROD": ext[0] * ext[1] * ext[2],
        "NEW_EXT_SOURCES_MEAN": row_mean(ext),
        "NEW_SCORES_STD": F.coalesce(deviation, mean_deviation),
        "NEW_CAR_TO_BIRTH_RATIO": ratio(col("OWN_CAR_AGE"), col("DAYS_BIRTH")),
        "NEW_CAR_TO_EMPLOY_RATIO": ratio(col("OWN_CAR_AGE"), col("DAYS_EMPLOYED")),
        "NEW_PHONE_TO_BIRTH_RATIO": ratio(col("DAYS_LAST_PHONE_CHANGE"), col("DAYS_BIRTH")),
        "NEW_PHONE_TO_BIRTH_RATIO_EMPLOYER": ratio(col("DAYS_LAST_PHONE_CHANGE"), col("DAYS_EMPLOYED")),
        "NEW_CREDIT_TO_INCOME_RATIO": ratio(col("AMT_CREDIT"), col("AMT_INCOME_TOTAL")),
    }
    out = df.select("*", *[c.alias(n) for n, c in made.items()])
    return lookup(out, by_org, {"ORGANIZATION_TYPE": "__org"}, {"NEW_INC_BY_ORG": F.col("__income")})


@feature("ApplicationFeatures")
def application(sources, conf) -> DataFrame:
    df = factorize(new_columns(sources["application"]), BINARY, [col(CLIENT)])
    df, _ = one_hot(df, vocab=vocab_of(df, conf))
    return df.drop(TARGET, *[f"FLAG_DOCUMENT_{i}" for i in range(2, 22) if i != 3])



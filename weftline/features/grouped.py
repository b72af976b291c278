"""Feature sets that are lists of recipes: group keys with (column, function) pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..nulls import col
from ..operators.joins import lookup
from ..plans.fusion import Agg, aggregate, group_recipes
from ..settle import settle
from ..sources.credit import CLIENT
from . import feature

FIVE = ("mean", "min", "max", "sum", "var")
# Columns of each source.
CHILD_RECIPES = {
    "Bureau": ("bureau", (
        "AMT_ANNUITY", "AMT_CREDIT_SUM", "AMT_CREDIT_SUM_DEBT", "AMT_CREDIT_SUM_LIMIT", "AMT_CREDIT_SUM_OVERDUE", "AMT_CREDIT_MAX_OVERDUE",
        "CNT_CREDIT_PROLONG", "CREDIT_DAY_OVERDUE", "DAYS_CREDIT", "DAYS_CREDIT_ENDDATE", "DAYS_CREDIT_UPDATE",
    )),
    "PreviousApplication": ("previous_application", (
        "AMT_ANNUITY", "AMT_APPLICATION", "AMT_CREDIT", "AMT_DOWN_PAYMENT", "AMT_GOODS_PRICE", "CNT_PAYMENT", "DAYS_DECISION",
        "HOUR_APPR_PROCESS_START", "RATE_DOWN_PAYMENT",
    )),
    "PosCash": ("pos_cash", (
        "MONTHS_BALANCE", "SK_DPD", "SK_DPD_DEF",
    )),
    "InstallmentsPayments": ("installments", (
        "AMT_INSTALMENT", "AMT_PAYMENT", "DAYS_ENTRY_PAYMENT", "DAYS_INSTALMENT", "NUM_INSTALMENT_NUMBER", "NUM_INSTALMENT_VERSION",
    )),
    "CreditCardBalance": ("credit_card", (
        "AMT_BALANCE", "AMT_CREDIT_LIMIT_ACTUAL", "AMT_DRAWINGS_ATM_CURRENT", "AMT_DRAWINGS_CURRENT", "AMT_DRAWINGS_OTHER_CURRENT",
        "AMT_DRAWINGS_POS_CURRENT", "AMT_PAYMENT_CURRENT", "CNT_DRAWINGS_ATM_CURRENT", "CNT_DRAWINGS_CURRENT", "CNT_DRAWINGS_OTHER_CURRENT",
        "CNT_INSTALMENT_MATURE_CUM", "MONTHS_BALANCE", "SK_DPD", "SK_DPD_DEF",
    )),
}


def child_recipes(source: str) -> list[Agg]:
    pairs = [(c, f) for f in FIVE for c in CHILD_RECIPES[source][1]]
    first = [("CREDIT_TYPE", "count"), ("CREDIT_ACTIVE", "size")] if source == "Bureau" else []
    return group_recipes(source, [CLIENT], first + pairs)


def _child(source: str):
    @feature(f"AggregateFeature{source}OpenSolution")
    def make(sources, conf) -> DataFrame:
        return aggregate(sources[CHILD_RECIPES[source][0]], [CLIENT], child_recipes(source))


for _source in CHILD_RECIPES:
    _child(_source)

# Columns of the client table.
_COLUMNS = (
    "AMT_CREDIT", "AMT_ANNUITY", "AMT_INCOME_TOTAL", "AMT_GOODS_PRICE", "EXT_SOURCE_1", "EXT_SOURCE_2", "EXT_SOURCE_3", "OWN_CAR_AGE",
    "REGION_POPULATION_RELATIVE", "DAYS_REGISTRATION", "CNT_CHILDREN", "CNT_FAM_MEMBERS", "DAYS_ID_PUBLISH", "DAYS_BIRTH", "DAYS_EMPLOYED",
)
_ALL = [(c, f) for c in _COLUMNS for f in ("min", "mean", "max", "sum", "var")]


def _means(*columns: str) -> list[tuple[str, str]]:
    return [(c, "mean") for c in columns]


# Keys of groups, and what is taken of each.
APPLICATION_RECIPES: list[tuple[list[str], list[tuple[str, str]]]] = [
    (["NAME_EDUCATION_TYPE", "CODE_GENDER"], _ALL),
    (["NAME_FAMILY_STATUS", "NAME_EDUCATION_TYPE"], _ALL),
    (["NAME_FAMILY_STATUS", "CODE_GENDER"], _ALL),
    (["CODE_GENDER", "ORGANIZATION_TYPE"], _means("AMT_ANNUITY", "AMT_INCOME_TOTAL", "DAYS_REGISTRATION", "EXT_SOURCE_1")),
    (["CODE_GENDER", "REG_CITY_NOT_WORK_CITY"], _means("AMT_ANNUITY", "CNT_CHILDREN", "DAYS_ID_PUBLISH")),
    (["CODE_GENDER", "NAME_EDUCATION_TYPE", "OCCUPATION_TYPE", "REG_CITY_NOT_WORK_CITY"], _means("EXT_SOURCE_1", "EXT_SOURCE_2")),
    (
        ["NAME_EDUCATION_TYPE", "OCCUPATION_TYPE"],
        _means("AMT_CREDIT", "AMT_REQ_CREDIT_BUREAU_YEAR", "APARTMENTS_AVG", "BASEMENTAREA_AVG", "EXT_SOURCE_1", "EXT_SOURCE_2", "EXT_SOURCE_3", "NONLIVINGAREA_AVG", "OWN_CAR_AGE", "YEARS_BUILD_AVG"),
    ),
    (["NAME_EDUCATION_TYPE", "OCCUPATION_TYPE", "REG_CITY_NOT_WORK_CITY"], _means("ELEVATORS_AVG", "EXT_SOURCE_1")),
    (
        ["OCCUPATION_TYPE"],
        _means("AMT_ANNUITY", "CNT_CHILDREN", "CNT_FAM_MEMBERS", "DAYS_BIRTH", "DAYS_EMPLOYED", "DAYS_ID_PUBLISH", "DAYS_REGISTRATION", "EXT_SOURCE_1", "EXT_SOURCE_2", "EXT_SOURCE_3"),
    ),
]


def grouping(df: DataFrame, source: str, recipes: list[tuple[list[str], list[tuple[str, str]]]]) -> DataFrame:
    """The statistics of all key sets by GROUPING SETS, in one pass over df: (g0, g1, ... the keys in order of appearance, __set:
    the set's number, statistics by function and column). A statistic that a set has no use for is made all the same."""
    used = list(dict.fromkeys(k for keys, _ in recipes for k in keys))
    pairs = list(dict.fromkeys(p for _, pairs in recipes for p in pairs))
    sets = [[col(k) for k in keys] for keys, _ in recipes]
    made = [a.column().alias(f"{f}_{c}") for a, (c, f) in zip(group_recipes(source, ["all"], pairs), pairs)]
    stats = df.select(*map(col, dict.fromkeys([*used, *[c for c, _ in pairs]]))).groupingSets(sets, *map(col, used)).agg(F.grouping_id().alias("__id"), *made)
    bits = {sum(1 << (len(used) - 1 - i) for i, k in enumerate(used) if k not in keys): n for n, (keys, _) in enumerate(recipes)}
    number = F.lit(None).cast("int")
    for b, n in bits.items():
        number = F.when(F.col("__id") == b, n).otherwise(number)
    return stats.select(*[col(k).alias(f"g{i}") for i, k in enumerate(used)], number.alias("__set"), *[col(f"{f}_{c}") for c, f in pairs])


def join_back(df: DataFrame, key: str, source: str, recipes: list[tuple[list[str], list[tuple[str, str]]]]) -> DataFrame:
    """(key, features): each row with the statistics of its groups; a row that misses a group key has none.

    One aggregation makes the statistics of all key sets and is written once; it has a row for each combination of categories,
    so the table of each set is one that Spark broadcasts by size, and the rows themselves aren't shuffled."""
    used = list(dict.fromkeys(k for keys, _ in recipes for k in keys))
    stats = settle(grouping(df, source, recipes), "groups")
    out, made = df.select(col(key), *[col(c) for c in used]), []
    for i, (keys, pairs) in enumerate(recipes):
        names = [a.name for a in group_recipes(source, keys, pairs)]
        at = [f"g{used.index(k)}" for k in keys]
        of = stats.filter(F.col("__set") == i)
        for g in at:
            of = of.filter(F.col(g).isNotNull())
        of = of.select(*[F.col(g).alias(f"__{i}_{k}") for g, k in zip(at, keys)], *[col(f"{f}_{c}").alias(n) for (c, f), n in zip(pairs, names)])
        out = lookup(out, of, {k: f"__{i}_{k}" for k in keys}, {n: col(n) for n in names})
        made += names
    return out.select(col(key), *map(col, made))


@feature("AggregateFeatureApplicationOpenSolution")
def application_groups(sources, conf) -> DataFrame:
    return join_back(sources["application"], CLIENT, "Application", APPLICATION_RECIPES)

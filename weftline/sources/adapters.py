"""Credit tables as views of the order tables.

The texts are SQL that Spark and DuckDB both run, with {names} for the tables they read. Clients are customers,
earlier loans are orders, monthly states and payments are order lines and events. Columns without a counterpart
are arithmetic on keys, so that every rule about missing values, zero divisors and ties finds its case.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..features.predictions import FAILED, PINNED
from .credit import Sources
from .runs import Runs, prediction_column


def _pick(expr: str, values: list[str | None]) -> str:
    whens = " ".join(f"when {i} then '{v}'" if v is not None else f"when {i} then null" for i, v in enumerate(values))
    return f"case ({expr}) % {len(values)} {whens} end"


def _number(expr: str, null_if: str | None = None) -> str:
    return f"cast(case when {null_if} then null else {expr} end as double)" if null_if else f"cast({expr} as double)"


def _int(expr: str) -> str:
    return f"cast({expr} as bigint)"


# A few categories of each kind that feature names and rules refer to.
GENDERS = ["F", "M", "F", "XNA"]
YES_NO = ["Y", "N"]
EDUCATION = ["Secondary / secondary special", "Higher education", "Incomplete higher", "Lower secondary"]
FAMILY = ["Married", "Single / not married", "Civil marriage", "Unknown", "Widow"]
ORGANIZATIONS = ["Business Entity Type 3", "Self-employed", "School", "XNA", "Medicine", "Bank", "Police"]
OCCUPATIONS = ["Laborers", "Core staff", None, "Managers", "Drivers", "Sales staff"]
CREDIT_TYPES = ["Consumer credit", "Credit card", "Car loan", "Mortgage", "Microloan"]
CURRENCIES = ["currency 1", "currency 1", "currency 2", None]
STATUSES = ["C", "X", "0", "0", "1", "2", "3"]
POS_STATUSES = ["Active", "Active", "Completed", "Signed"]
CARD_STATUSES = ["Active", "Active", "Completed"]

APPLICATION_NUMBERS = {
    "AMT_INCOME_TOTAL": ("50 + k * 7 % 400", None),
    "AMT_CREDIT": ("100 + k * 13 % 900", None),
    "AMT_ANNUITY": ("k * 11 % 50", "k % 17 = 3"),
    "AMT_GOODS_PRICE": ("case when k % 9 = 0 then 225000 when k % 9 = 1 then 1125000 else 90 + k * 13 % 900 end", "k % 23 = 5"),
    "CNT_CHILDREN": ("k % 4", None),
    "CNT_FAM_MEMBERS": ("k % 4 + k % 3", "k % 31 = 7"),
    "DAYS_BIRTH": ("0 - 8000 - k * 17 % 15000", None),
    "DAYS_EMPLOYED": ("case when k % 6 = 0 then 365243 else 0 - k * 19 % 5000 end", None),
    "DAYS_REGISTRATION": ("0 - k * 23 % 90", None),
    "DAYS_ID_PUBLISH": ("0 - k * 29 % 70", None),
    "DAYS_LAST_PHONE_CHANGE": ("0 - k % 40", None),
    "OWN_CAR_AGE": ("k % 25", "k % 3 = 0"),
    "EXT_SOURCE_1": ("k * 31 % 97", "k % 2 = 0"),
    "EXT_SOURCE_2": ("k * 37 % 89", "k % 19 = 0"),
    "EXT_SOURCE_3": ("k * 41 % 83", "k % 5 = 1"),
    "REGION_POPULATION_RELATIVE": ("k * 43 % 70", None),
    "AMT_REQ_CREDIT_BUREAU_YEAR": ("k % 7", "k % 11 = 0"),
    "APARTMENTS_AVG": ("k * 3 % 50", "k % 2 = 1"),
    "BASEMENTAREA_AVG": ("k * 5 % 40", "k % 3 = 1"),
    "NONLIVINGAREA_AVG": ("k * 7 % 30", "k % 4 = 1"),
    "YEARS_BUILD_AVG": ("k * 9 % 60", "k % 4 = 2"),
    "ELEVATORS_AVG": ("k * 11 % 20", "k % 4 = 3"),
}
APPLICATION_FLAGS = ["FLAG_MOBIL", "FLAG_EMP_PHONE", "FLAG_WORK_PHONE", "FLAG_CONT_MOBILE", "FLAG_PHONE", "FLAG_EMAIL"]
APPLICATION_CATEGORIES = {
    "NAME_CONTRACT_TYPE": ["Cash loans", "Cash loans", "Revolving loans"],
    "CODE_GENDER": GENDERS,
    "FLAG_OWN_CAR": YES_NO,
    "FLAG_OWN_REALTY": ["Y", "Y", "N"],
    "NAME_TYPE_SUITE": ["Unaccompanied", "Family", None],
    "NAME_INCOME_TYPE": ["Working", "Commercial associate", "Pensioner"],
    "NAME_EDUCATION_TYPE": EDUCATION,
    "NAME_FAMILY_STATUS": FAMILY,
    "NAME_HOUSING_TYPE": ["House / apartment", "With parents", "Rented apartment"],
    "OCCUPATION_TYPE": OCCUPATIONS,
    "WEEKDAY_APPR_PROCESS_START": ["MONDAY", "TUESDAY", "FRIDAY", "SUNDAY"],
    "ORGANIZATION_TYPE": ORGANIZATIONS,
    "FONDKAPREMONT_MODE": ["reg oper account", None, "not specified"],
    "HOUSETYPE_MODE": ["block of flats", None],
    "WALLSMATERIAL_MODE": ["Panel", "Stone, brick", None, "Block"],
    "EMERGENCYSTATE_MODE": ["No", None, "No", "Yes"],
}

_APPLICATION = ", ".join(
    [f"{_number(e, n)} as {c}" for c, (e, n) in APPLICATION_NUMBERS.items()]
    + [f"{_int(f'(k + {i}) % {i + 2} % 2')} as {c}" for i, c in enumerate(APPLICATION_FLAGS)]
    + [f"{_int(f'case when k % {i + 3} = 0 then 1 else 0 end')} as FLAG_DOCUMENT_{i}" for i in range(2, 22)]
    + [f"{_int('k % 3 % 2')} as REG_CITY_NOT_WORK_CITY"]
    + [f"{_pick(f'k * {2 * i + 3} + s * {i} + k % {i + 5}', v)} as {c}" for i, (c, v) in enumerate(APPLICATION_CATEGORIES.items())]
)

VIEWS: dict[str, str] = {
    "application": f"select k as SK_ID_CURR, TARGET, {_APPLICATION} from (select c_custkey as k, length(c_mktsegment) as s, "
    "case when c_custkey % 5 = 0 then null when c_acctbal < 0 then 1 else 0 end as TARGET from {customer})",
    "bureau": f"""
select c as SK_ID_CURR, k as SK_ID_BUREAU, case o when 'F' then 'Closed' when 'O' then 'Active' else 'Sold' end as CREDIT_ACTIVE,
{_pick('k', CURRENCIES)} as CREDIT_CURRENCY, {_pick('k * 3 + c', CREDIT_TYPES)} as CREDIT_TYPE,
{_number('0 - k * 7 % 290')} as DAYS_CREDIT,
{_number('case when k % 13 = 0 then -42000 else k * 11 % 300 - 150 end', 'k % 7 = 0')} as DAYS_CREDIT_ENDDATE,
{_number('case when k % 97 = 0 then -20000 else 0 - k * 5 % 280 end', 'k % 4 = 0')} as DAYS_ENDDATE_FACT,
{_number('case when k % 29 = 0 then 3 else 0 - k * 3 % 90 end')} as DAYS_CREDIT_UPDATE,
{_int('k % 9 % 4')} as CREDIT_DAY_OVERDUE, {_int('k % 5 % 2')} as CNT_CREDIT_PROLONG,
{_number('p')} as AMT_CREDIT_SUM,
{_number('case when k % 6 = 0 then 0 else p % 70 end', 'k % 5 = 0')} as AMT_CREDIT_SUM_DEBT,
{_number('p % 30', 'k % 3 = 0')} as AMT_CREDIT_SUM_LIMIT, {_number('k % 8 % 3')} as AMT_CREDIT_SUM_OVERDUE,
{_number('p % 20', 'k % 2 = 0')} as AMT_CREDIT_MAX_OVERDUE, {_number('p % 40', 'c % 3 = 0')} as AMT_ANNUITY
from (select o_custkey as c, o_orderkey as k, o_orderstatus as o, cast(floor(o_totalprice / 4000) as bigint) as p from {{orders}})""",
    "bureau_balance": f"""
select l_orderkey as SK_ID_BUREAU, {_int('12 * extract(year from l_shipdate) + extract(month from l_shipdate) - 24024')} as MONTHS_BALANCE,
{_pick('l_partkey + l_linenumber', STATUSES)} as STATUS from {{lineitem}}""",
    "previous_application": f"""
select c as SK_ID_CURR, k as SK_ID_PREV, {_pick('k * 7', ['Cash loans', 'Consumer loans', 'Revolving loans'])} as NAME_CONTRACT_TYPE,
case o when 'F' then 'Approved' when 'O' then 'Refused' else 'Canceled' end as NAME_CONTRACT_STATUS,
{_pick('k + c', ['XAP', 'HC', 'LIMIT', None])} as CODE_REJECT_REASON, {_pick('k', ['Repeater', 'New'])} as NAME_CLIENT_TYPE,
{_number('p % 45', 'k % 8 = 0')} as AMT_ANNUITY, {_number('p')} as AMT_APPLICATION,
{_number('case when k % 10 = 0 then 0 else p % 90 end')} as AMT_CREDIT,
{_number('p % 9', 'k % 2 = 0')} as AMT_DOWN_PAYMENT, {_number('p % 95', 'k % 6 = 0')} as AMT_GOODS_PRICE,
{_number('k % 12', 'k % 2 = 0')} as RATE_DOWN_PAYMENT, {_number('k % 60', 'k % 9 = 0')} as CNT_PAYMENT,
{_int('k % 24')} as HOUR_APPR_PROCESS_START, {_int('0 - k % 40')} as DAYS_DECISION, {_int('case when k % 83 = 0 then 7000000 else k * 3 % 100 end')} as SELLERPLACE_AREA,
{_number('case when k % 3 = 0 then 365243 else 0 - k % 300 end')} as DAYS_FIRST_DRAWING,
{_number('case when k % 11 = 0 then 365243 else 0 - k % 500 end', 'k % 12 = 0')} as DAYS_FIRST_DUE,
{_number('case when k % 4 = 0 then 365243 else 0 - k % 450 end')} as DAYS_LAST_DUE_1ST_VERSION,
{_number('case when k % 5 = 0 then 365243 else 0 - k % 400 end')} as DAYS_LAST_DUE,
{_number('case when k % 6 = 0 then 365243 else 0 - k % 900 end')} as DAYS_TERMINATION
from (select o_custkey as c, o_orderkey as k, o_orderstatus as o, cast(floor(o_totalprice / 4000) as bigint) as p from {{orders}})""",
    "pos_cash": f"""
select user_id as SK_ID_CURR, user_id * 10 + event_id % 3 as SK_ID_PREV, {_int('0 - event_id % 61')} as MONTHS_BALANCE,
{_number('event_id % 37', 'event_id % 19 = 0')} as CNT_INSTALMENT,
{_number('event_id * 3 % 71', 'event_id % 43 = 0')} as CNT_INSTALMENT_FUTURE,
{_int('case when event_id % 4 = 0 then event_id % 30 else 0 end')} as SK_DPD,
{_int('case when user_id % 7 = 0 then 0 when event_id % 5 = 0 then event_id % 11 else 0 end')} as SK_DPD_DEF,
{_pick('event_id', POS_STATUSES)} as NAME_CONTRACT_STATUS from {{events}}""",
    "credit_card": "select user_id as SK_ID_CURR, user_id * 10 + event_id % 2 as SK_ID_PREV, "
    + ", ".join(
        f"{_number(e, n)} as {c}"
        for c, (e, n) in {
            "AMT_BALANCE": ("event_id * 7 % 90", "event_id % 53 = 0"),
            "AMT_CREDIT_LIMIT_ACTUAL": ("event_id % 4 * 25", None),
            "AMT_DRAWINGS_ATM_CURRENT": ("case when event_id % 41 = 0 then -5 else event_id % 20 end", "event_id % 3 = 0"),
            "AMT_DRAWINGS_CURRENT": ("case when event_id % 47 = 0 then -6 else event_id % 33 end", None),
            "AMT_DRAWINGS_OTHER_CURRENT": ("event_id % 6", "event_id % 3 = 0"),
            "AMT_DRAWINGS_POS_CURRENT": ("event_id % 13", "event_id % 3 = 0"),
            "AMT_INST_MIN_REGULARITY": ("event_id % 15", "event_id % 8 = 0"),
            "AMT_PAYMENT_CURRENT": ("event_id % 25", "event_id % 7 = 0"),
            "AMT_PAYMENT_TOTAL_CURRENT": ("event_id % 24", None),
            "AMT_RECEIVABLE_PRINCIPAL": ("event_id * 7 % 80", None),
            "AMT_RECIVABLE": ("event_id * 7 % 85", None),
            "AMT_TOTAL_RECEIVABLE": ("event_id * 7 % 86", None),
            "CNT_DRAWINGS_ATM_CURRENT": ("event_id % 5", "event_id % 3 = 0"),
            "CNT_DRAWINGS_OTHER_CURRENT": ("event_id % 2", "event_id % 3 = 0"),
            "CNT_DRAWINGS_POS_CURRENT": ("event_id % 9", "event_id % 3 = 0"),
            "CNT_INSTALMENT_MATURE_CUM": ("event_id % 31", "event_id % 10 = 0"),
        }.items()
    )
    + f", {_int('event_id % 8')} as CNT_DRAWINGS_CURRENT, {_int('0 - event_id % 67')} as MONTHS_BALANCE, {_int('event_id % 6 % 4')} as SK_DPD, "
    f"{_int('event_id % 10 % 3')} as SK_DPD_DEF, {_pick('event_id', CARD_STATUSES)} as NAME_CONTRACT_STATUS from {{events}}",
    "installments": f"""
select c as SK_ID_CURR, k as SK_ID_PREV, {_number('case when k % 89 = 0 then 71 else n % 3 end')} as NUM_INSTALMENT_VERSION,
{_int('case when k % 31 = 0 then 100 else n end')} as NUM_INSTALMENT_NUMBER,
{_number('0 - t % 200')} as DAYS_INSTALMENT, {_number('0 - t % 200 + t % 23 - 11', 't % 37 = 0')} as DAYS_ENTRY_PAYMENT,
{_number('t % 50')} as AMT_INSTALMENT, {_number('t % 50 + n - 3', 't % 37 = 0')} as AMT_PAYMENT
from (select o_custkey as c, l_orderkey as k, l_linenumber as n, l_partkey * 3 + l_suppkey as t from {{lineitem}} join {{orders}} on l_orderkey = o_orderkey)""",
}

VOCABULARY = {
    "application": {c: sorted({v for v in values if v is not None and (c, v) not in {("CODE_GENDER", "XNA"), ("NAME_FAMILY_STATUS", "Unknown"), ("ORGANIZATION_TYPE", "XNA")}}) for c, values in APPLICATION_CATEGORIES.items()},
    "bureau": {"CREDIT_ACTIVE": ["Active", "Closed", "Sold"], "CREDIT_CURRENCY": ["currency 1", "currency 2"], "CREDIT_TYPE": sorted(CREDIT_TYPES), "STATUS": sorted(set(STATUSES))},
    "previous_application": {
        "NAME_CONTRACT_TYPE": ["Cash loans", "Consumer loans", "Revolving loans"],
        "NAME_CONTRACT_STATUS": ["Approved", "Canceled", "Refused"],
        "CODE_REJECT_REASON": ["HC", "LIMIT", "XAP"],
        "NAME_CLIENT_TYPE": ["New", "Repeater"],
    },
    "pos_cash": {"NAME_CONTRACT_STATUS": sorted(set(POS_STATUSES))},
    "credit_card": {"NAME_CONTRACT_STATUS": sorted(set(CARD_STATUSES))},
    "installments": {},
}

READS = {
    "application": ["customer"], "bureau": ["orders"], "bureau_balance": ["lineitem"], "previous_application": ["orders"],
    "pos_cash": ["events"], "credit_card": ["events"], "installments": ["lineitem", "orders"],
}


#: Tables whose rows of a few bytes become wide rows that cost much each: a file that Spark reads in one task by its size holds
#: very many of them. They are dealt by key first, to as many tasks as a shuffle has or as there are cores; a bare repartition
#: would be coalesced by its few bytes.
DEALT = {"application": {"customer": ("c_custkey", "c_mktsegment", "c_acctbal")}}


#: Tables that a view joins: both sides are dealt by the key to as many tasks as there are PER_TASK rows of the first one, if a
#: shuffle has fewer, so that a task's part of the join doesn't grow with the tables.
JOINED = {"installments": {"lineitem": "l_orderkey", "orders": "o_orderkey"}}
PER_TASK = 1 << 20


def view(spark: SparkSession, sf_dir: str, name: str, per_task: int = PER_TASK) -> DataFrame:
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in READS[name]}
    for t, columns in DEALT.get(name, {}).items():
        parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
        tables[t] = tables[t].select(*columns).repartition(parts, columns[0])
    if keys := JOINED.get(name):
        parts = -(-tables[next(iter(keys))].count() // per_task)  # from the files' footers
        if parts > int(spark.conf.get("spark.sql.shuffle.partitions")):
            tables |= {t: tables[t].repartition(parts, k) for t, k in keys.items()}
    return spark.sql(VIEWS[name], **tables)


#: Earlier runs: a factor of each, from which its predictions follow. Every run but the last knows all customers.
RUN_FACTORS = {**dict(zip(PINNED.values(), (37, 61, 73, 89))), "09010101_logreg_x_0.5": 97, FAILED[0]: 11}


def run_sql(name: str) -> str:
    """(SK_ID_CURR, p) of a run over the customers."""
    some = " where c_custkey % 3 = 0" if name.startswith("0901") else ""
    return f"select cast(c_custkey as bigint) as SK_ID_CURR, (c_custkey * {RUN_FACTORS[name]} % 1009) / cast(1009 as double) as p from {{customer}}{some}"


def runs(spark: SparkSession, sf_dir: str) -> Runs:
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet")
    made = {n: spark.sql(run_sql(n), customer=customers).selectExpr("SK_ID_CURR", f"cast(p as double) as `{prediction_column(n)}`") for n in RUN_FACTORS}
    return Runs(spark, tables=made)


def sources(spark: SparkSession, sf_dir: str) -> Sources:
    """All credit tables over the order tables in sf_dir, cleaned."""
    return Sources(spark, tables={name: view(spark, sf_dir, name) for name in VIEWS}, runs=runs(spark, sf_dir))


def duck(name: str) -> str:
    """The view's SQL over tables of their own names."""
    return VIEWS[name].format(**{t: t for t in READS[name]})

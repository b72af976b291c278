"""The queries' SQL for DuckDB: the same features written as text, from the same declarations.

Only declarations (names, functions, columns, conditions) are shared with the engine; every statistic, window and
rule about missing values is written here once more in SQL.
"""

from __future__ import annotations

from .features.bureau import ACTIVE, CLOSED, LOAN, SIX
from .features.bureau import DIFFERENCES as LOAN_DIFFERENCES
from .features.bureau import NUMERIC as LOAN_NUMERIC
from .features.credit_card import DIFFERENCES as CARD_DIFFERENCES
from .features.grouped import APPLICATION_RECIPES, CHILD_RECIPES, child_recipes
from .features.installments import FRACTIONS, IN_PERIOD, PERIODS, TRENDS
from .features.installments import NUMERIC as PAYMENT_NUMERIC
from .features.previous import APPROVED, REFUSED
from .features.previous import NUMERIC as PREVIOUS_NUMERIC
from .operators.encode import dummies, shares
from .plans.fusion import Agg, group_recipes, recipes
from .features.predictions import FAILED, PINNED
from .sources.adapters import APPLICATION_NUMBERS, RUN_FACTORS, VOCABULARY, duck, run_sql
from .sources.credit import CLIENT, TABLES
from .sources.runs import prediction_column

#: Added before results are rounded to four digits.
OFF_TIES = 0.0000027
#: Variances of keys are large and depend in their last digits on the order of summation: they are compared by digits.
ID_DIGITS, OFF_ID_TIES = 6, 1.000000001

# Columns of each view, in order.
COLUMNS = {
    "bureau": [
        "SK_ID_CURR", "SK_ID_BUREAU", "CREDIT_ACTIVE", "CREDIT_CURRENCY", "CREDIT_TYPE", "DAYS_CREDIT", "DAYS_CREDIT_ENDDATE", "DAYS_ENDDATE_FACT",
        "DAYS_CREDIT_UPDATE", "CREDIT_DAY_OVERDUE", "CNT_CREDIT_PROLONG", "AMT_CREDIT_SUM", "AMT_CREDIT_SUM_DEBT", "AMT_CREDIT_SUM_LIMIT",
        "AMT_CREDIT_SUM_OVERDUE", "AMT_CREDIT_MAX_OVERDUE", "AMT_ANNUITY",
    ],
    "previous_application": [
        "SK_ID_CURR", "SK_ID_PREV", "NAME_CONTRACT_TYPE", "NAME_CONTRACT_STATUS", "CODE_REJECT_REASON", "NAME_CLIENT_TYPE", "AMT_ANNUITY",
        "AMT_APPLICATION", "AMT_CREDIT", "AMT_DOWN_PAYMENT", "AMT_GOODS_PRICE", "RATE_DOWN_PAYMENT", "CNT_PAYMENT", "HOUR_APPR_PROCESS_START",
        "DAYS_DECISION", "SELLERPLACE_AREA", "DAYS_FIRST_DRAWING", "DAYS_FIRST_DUE", "DAYS_LAST_DUE_1ST_VERSION", "DAYS_LAST_DUE",
        "DAYS_TERMINATION",
    ],
    "pos_cash": [
        "SK_ID_CURR", "SK_ID_PREV", "MONTHS_BALANCE", "CNT_INSTALMENT", "CNT_INSTALMENT_FUTURE", "SK_DPD", "SK_DPD_DEF", "NAME_CONTRACT_STATUS",
    ],
    "credit_card": [
        "SK_ID_CURR", "SK_ID_PREV", "AMT_BALANCE", "AMT_CREDIT_LIMIT_ACTUAL", "AMT_DRAWINGS_ATM_CURRENT", "AMT_DRAWINGS_CURRENT",
        "AMT_DRAWINGS_OTHER_CURRENT", "AMT_DRAWINGS_POS_CURRENT", "AMT_INST_MIN_REGULARITY", "AMT_PAYMENT_CURRENT", "AMT_PAYMENT_TOTAL_CURRENT",
        "AMT_RECEIVABLE_PRINCIPAL", "AMT_RECIVABLE", "AMT_TOTAL_RECEIVABLE", "CNT_DRAWINGS_ATM_CURRENT", "CNT_DRAWINGS_OTHER_CURRENT",
        "CNT_DRAWINGS_POS_CURRENT", "CNT_INSTALMENT_MATURE_CUM", "CNT_DRAWINGS_CURRENT", "MONTHS_BALANCE", "SK_DPD", "SK_DPD_DEF",
        "NAME_CONTRACT_STATUS",
    ],
    "installments": [
        "SK_ID_CURR", "SK_ID_PREV", "NUM_INSTALMENT_VERSION", "NUM_INSTALMENT_NUMBER", "DAYS_INSTALMENT", "DAYS_ENTRY_PAYMENT", "AMT_INSTALMENT",
        "AMT_PAYMENT",
    ],
}

CLEANING = {
    "application": "nullif(CODE_GENDER, 'XNA') as CODE_GENDER, nullif(DAYS_EMPLOYED, 365243) as DAYS_EMPLOYED, nullif(DAYS_LAST_PHONE_CHANGE, 0) as DAYS_LAST_PHONE_CHANGE, nullif(NAME_FAMILY_STATUS, 'Unknown') as NAME_FAMILY_STATUS, nullif(ORGANIZATION_TYPE, 'XNA') as ORGANIZATION_TYPE",
    "bureau": ", ".join(f"case when {c} < -40000 then null else {c} end as {c}" for c in ("DAYS_CREDIT_ENDDATE", "DAYS_CREDIT_UPDATE", "DAYS_ENDDATE_FACT")),
    "previous_application": ", ".join(f"nullif({c}, 365243) as {c}" for c in ("DAYS_FIRST_DRAWING", "DAYS_FIRST_DUE", "DAYS_LAST_DUE_1ST_VERSION", "DAYS_LAST_DUE", "DAYS_TERMINATION")),
    "credit_card": ", ".join(f"case when {c} < 0 then null else {c} end as {c}" for c in ("AMT_DRAWINGS_ATM_CURRENT", "AMT_DRAWINGS_CURRENT")),
}


def source(table: str) -> str:
    """The cleaned table as a subquery."""
    star = f"* replace ({CLEANING[table]})" if table in CLEANING else "*"
    return f"(select {star} from ({duck(table)}))"


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def duck_expr(expr: str) -> str:
    """A dummy's or condition's Spark SQL for DuckDB."""
    return expr.replace("`", '"').replace("<=>", "is not distinct from")


def number(sql: str, name: str) -> str:
    if is_id_variance(name):  # six significant digits
        scale = f"power(10, floor(log10({sql})) - {ID_DIGITS - 1})"
        return f"case when {sql} < 1e-6 then 0.0 when {sql} is not null then round({sql} * {OFF_ID_TIES} / {scale}) * {scale} end as {quoted(name)}"
    return f"round(cast({sql} as double) + {OFF_TIES}, 4) + 0.0 as {quoted(name)}"


def ratio(a: str, b: str) -> str:
    return f"cast({a} as double) / nullif(cast({b} as double), 0)"


def statistic(func: str, x: str, rows: str | None) -> str:
    """func of x over the group's rows that meet the condition rows."""
    f = f" filter (where {rows})" if rows else ""
    complete = f"count({x}){f} = count(*){f}"
    x = f"cast({x} as double)" if func not in ("count", "size", "nunique") else x
    m = lambda k: f"avg(power({x}, {k})){f}"
    if func == "skew":
        value = f"({m(3)} - 3 * {m(1)} * {m(2)} + 2 * power({m(1)}, 3)) / power({m(2)} - power({m(1)}, 2), 1.5)"
        return f"case when {complete} then case when stddev_pop({x}){f} = 0 or abs({value}) < 1e-8 then 0.0 else {value} end end"
    if func == "kurt":
        return f"case when {complete} then case when stddev_pop({x}){f} = 0 then -3.0 else kurtosis_pop({x}){f} end end"
    if func == "iqr":
        return f"case when {complete} then quantile_cont({x}, 0.75){f} - quantile_cont({x}, 0.25){f} end"
    if func == "trend":
        return f"case when {complete} then case when count(*){f} = 1 then 0.0 else regr_slope({x}, cast(rn - 1 as double)){f} end end"
    simple = {
        "min": f"min({x})", "max": f"max({x})", "mean": f"avg({x})", "sum": f"sum({x})", "var": f"var_samp({x})", "std": f"stddev_samp({x})",
        "count": f"count({x})", "size": "count(*)", "nunique": f"count(distinct {x})", "median": f"median({x})",
    }[func] + f
    return f"coalesce({simple}, 0)" if func == "sum" else simple


def column(a: Agg) -> str:
    tests = [duck_expr(a.where)] if a.where else []
    if a.last:
        tests.append(f"rn <= {a.last}")
    rows = " and ".join(f"({t})" for t in tests) or None
    x = duck_expr(a.expr) if a.expr else quoted(a.source) if a.source else "1"
    sql = statistic(a.func, x, rows)
    if a.where and a.empty_is_null and a.func in ("sum", "count", "size", "nunique"):
        sql = f"case when count(*) filter (where {rows}) > 0 then {sql} end"
    return sql


def ordering(table: str) -> str:
    return ", ".join(f"{c} desc nulls last" for c in TABLES[table].newest_first)


def aggregate(frm: str, aggs: list[Agg], table: str | None = None, key: str = CLIENT, extra: list[str] = ()) -> str:
    """One row for each key; with table, rows are numbered by its order first."""
    if table:
        frm = f"(select *, row_number() over (partition by {key} order by {ordering(table)}) as rn from {frm})"
    made = ", ".join([number(column(a), a.name) for a in aggs] + list(extra))
    return f"select {key}, {made} from {frm} where {key} is not null group by {key}"


# ---- feature sets -------------------------------------------------------------------------------------------


def bureau() -> str:
    vocab = VOCABULARY["bureau"]
    status = {"STATUS": vocab["STATUS"]}
    loans = {c: v for c, v in vocab.items() if c != "STATUS"}
    months = ", ".join(
        [f"{statistic(f, 'MONTHS_BALANCE', None)} as MONTHS_BALANCE_{f.upper()}" for f in ("min", "max", "size")]
        + [f"avg({duck_expr(e)}) as {quoted(n + '_MEAN')}" for n, e in dummies(status).items()]
    )
    frm = f"(select b.*, m.* exclude ({LOAN}) from {source('bureau')} b left join (select {LOAN}, {months} from {source('bureau_balance')} group by {LOAN}) m using ({LOAN}))"
    aggs = recipes("BURO_", LOAN_NUMERIC) + recipes("ACTIVE_", LOAN_NUMERIC, ACTIVE) + recipes("CLOSED_", LOAN_NUMERIC, CLOSED) + shares(loans, "BURO_")
    return aggregate(frm, aggs + [Agg(f"BURO_{n}_MEAN_MEAN", "mean", f"{n}_MEAN") for n in dummies(status)])


def bureau_open_solution() -> str:
    past, types, debt = "count(DAYS_CREDIT)", "count(distinct CREDIT_TYPE)", "coalesce(sum(AMT_CREDIT_SUM_DEBT), 0)"
    made = {
        "bureau_number_of_past_loans": past,
        "bureau_number_of_loan_types": types,
        "bureau_credit_active_binary": "avg(case when CREDIT_ACTIVE = 'Closed' then 0 else 1 end)",
        "bureau_total_customer_debt": debt,
        "bureau_total_customer_credit": "coalesce(sum(AMT_CREDIT_SUM), 0)",
        "bureau_total_customer_overdue": "coalesce(sum(AMT_CREDIT_SUM_OVERDUE), 0)",
        "bureau_average_creditdays_prolonged": "coalesce(sum(CNT_CREDIT_PROLONG), 0)",
        "bureau_credit_enddate_percentage": "avg(case when DAYS_CREDIT_ENDDATE > 0 then 1 else 0 end)",
        "bureau_average_of_past_loans_per_type": ratio(past, types),
        "bureau_debt_credit_ratio": ratio(debt, "coalesce(sum(AMT_CREDIT_SUM), 0)"),
        "bureau_overdue_debt_ratio": ratio("coalesce(sum(AMT_CREDIT_SUM_OVERDUE), 0)", debt),
    }
    return f"select {CLIENT}, {', '.join(number(e, n) for n, e in made.items())} from {source('bureau')} group by {CLIENT}"


def bureau_antonova() -> str:
    vocab = VOCABULARY["bureau"]
    status, loans = vocab["STATUS"], {c: v for c, v in vocab.items() if c != "STATUS"}
    month, closed = "abs(min(MONTHS_BALANCE))", "abs(min(MONTHS_BALANCE) filter (where STATUS = 'C'))"
    count = {k: f"nullif(count(MONTHS_BALANCE) filter (where STATUS = '{k}'), 0)" for k in range(6)}
    values = {"Month": month, "When_closed": closed, "Month_closed_to_end": f"{month} - {closed}"}
    for k in range(6):
        values |= {f"DPD_{k}_cnt": count[k], f"DPD_{k} / Month": ratio(count[k], month)}
    values["Non_zero_DPD_cnt"] = " + ".join(f"coalesce({count[k]}, 0)" for k in range(1, 6))
    cells = {f"MONTHS_BALANCE_{f.upper()}": statistic(f, "MONTHS_BALANCE", None) for f in ("min", "max", "size")}
    cells |= {f"{LOAN}_MIN": LOAN, f"{LOAN}_MAX": LOAN, f"{LOAN}_SIZE": "count(*)"}
    cells |= {f"{n}_MEAN": f"avg({duck_expr(e)})" for n, e in dummies({"STATUS": status}).items()}
    for n, v in values.items():
        cells |= {f"{n}_MIN": v, f"{n}_MAX": v, f"{n}_SIZE": "count(*)"}
    for name, way in (("First_status", "asc"), ("Last_status", "desc")):
        value = f"(list(STATUS order by MONTHS_BALANCE {way}, STATUS {way}) filter (where STATUS is not null))[1]"
        cells |= {f"{name}_{v}_MEAN": f"cast(coalesce({value} = '{v}', false) as int)" for v in status}
        cells[f"{name}_nan_MEAN"] = f"cast({value} is null as int)"
    history = f"select {LOAN}, {', '.join(f'{e} as {quoted(n)}' for n, e in cells.items())} from {source('bureau_balance')} group by {LOAN}"
    bad = {
        "AMT_ANNUITY": "> 0.8e8", "AMT_CREDIT_SUM": "> 3e8", "AMT_CREDIT_SUM_DEBT": "> 1e8", "AMT_CREDIT_MAX_OVERDUE": "> 0.8e8", "DAYS_ENDDATE_FACT": "< -10000",
        "DAYS_CREDIT_UPDATE": "not between -40000 and 0", "DAYS_CREDIT_ENDDATE": "< -10000",
    }
    clean = f"(select * replace ({', '.join(f'case when {c} {t} then null else {c} end as {c}' for c, t in bad.items())}) from {source('bureau')})"
    rows = f"(select *, {', '.join(f'{a} - {b} as {quoted(f'bureau {a} - {b}')}' for a, b in LOAN_DIFFERENCES)} from {clean} where not coalesce(DAYS_ENDDATE_FACT < DAYS_CREDIT, false))"
    frm = f"(select b.* exclude ({LOAN}), h.* exclude ({LOAN}) from {rows} b left join ({history}) h using ({LOAN}))"
    numeric = [c for c in COLUMNS["bureau"] if c not in (LOAN, *loans)] + [f"bureau {a} - {b}" for a, b in LOAN_DIFFERENCES] + list(cells)
    aggs = []
    for prefix, where in (("BURO_", None), ("ACTIVE_", ACTIVE), ("CLOSED_", CLOSED)):
        aggs += recipes(prefix, {c: SIX for c in numeric}, where) + [Agg(f"{prefix}{n}_MEAN", "mean", where=where, expr=e) for n, e in dummies(loans).items()]
    return aggregate(frm, [a for a in aggs if not is_id_variance(a.name)])


#: Sets whose variances of keys neither query nor SQL returns.
BUT_ID_VARIANCES = {"BureauFeaturesAntonova"}


def is_id_variance(name: str) -> bool:
    return "SK_ID_" in name and name.endswith("_VAR")


def previous() -> str:
    frm = f"(select *, {ratio('AMT_APPLICATION', 'AMT_CREDIT')} as APP_CREDIT_PERC from {source('previous_application')})"
    aggs = recipes("PREV_", PREVIOUS_NUMERIC) + recipes("APPROVED_", PREVIOUS_NUMERIC, APPROVED) + recipes("REFUSED_", PREVIOUS_NUMERIC, REFUSED)
    return aggregate(frm, aggs + shares(VOCABULARY["previous_application"], "PREV_"))


def previous_open_solution() -> str:
    latest = lambda test: f"max(case when {test} then 1 else 0 end) filter (where rn = 1)"
    made = {
        "previous_application_prev_was_approved": latest("NAME_CONTRACT_STATUS = 'Approved'"),
        "previous_application_prev_was_refused": latest("NAME_CONTRACT_STATUS = 'Refused'"),
        "previous_application_number_of_prev_application": "count(distinct SK_ID_PREV)",
        "previous_application_fraction_of_refused_applications": "avg(case when NAME_CONTRACT_STATUS = 'Refused' then 1 else 0 end)",
        "prev_applications_prev_was_revolving_loan": latest("NAME_CONTRACT_TYPE = 'Revolving loans'"),
    }
    for k in range(1, 6):
        for name, c in (("term_of_last_{}_credits", "CNT_PAYMENT"), ("days_decision_about_last_{}_credits", "DAYS_DECISION"), ("days_first_drawing_last_{}_credits", "DAYS_FIRST_DRAWING")):
            made[f"previous_application_{name.format(k)}_mean"] = f"avg({c}) filter (where rn <= {k})"
    frm = f"(select *, row_number() over (partition by {CLIENT} order by {ordering('previous_application')}) as rn from {source('previous_application')})"
    return f"select {CLIENT}, {', '.join(number(e, n) for n, e in made.items())} from {frm} group by {CLIENT}"


def previous_antonova() -> str:
    vocab, columns = VOCABULARY["previous_application"], COLUMNS["previous_application"]
    clean = f"(select * replace (case when AMT_CREDIT > 6000000 then null else AMT_CREDIT end as AMT_CREDIT, case when SELLERPLACE_AREA > 3500000 then null else SELLERPLACE_AREA end as SELLERPLACE_AREA) from {source('previous_application')})"
    made = {
        "prev missing": " + ".join(f"cast({c} is null as int)" for c in columns),
        "prev AMT_APPLICATION / AMT_CREDIT": ratio("AMT_APPLICATION", "AMT_CREDIT"),
        "prev AMT_APPLICATION - AMT_CREDIT": "AMT_APPLICATION - AMT_CREDIT",
        "prev AMT_APPLICATION - AMT_GOODS_PRICE": "AMT_APPLICATION - AMT_GOODS_PRICE",
        "prev AMT_GOODS_PRICE - AMT_CREDIT": "AMT_GOODS_PRICE - AMT_CREDIT",
        "prev DAYS_FIRST_DRAWING - DAYS_FIRST_DUE": "DAYS_FIRST_DRAWING - DAYS_FIRST_DUE",
        "prev DAYS_TERMINATION less -500": "case when DAYS_TERMINATION < -500 then 1 else 0 end",
    }
    frm = f"(select *, {', '.join(f'{e} as {quoted(n)}' for n, e in made.items())} from {clean})"
    numeric = [c for c in columns if c not in vocab] + list(made)
    aggs = []
    for prefix, where in (("PREV_", None), ("APPROVED_", APPROVED), ("REFUSED_", REFUSED)):
        aggs += recipes(prefix, {c: SIX for c in numeric}, where) + [Agg(f"{prefix}{n}_MEAN", "mean", where=where, expr=e) for n, e in dummies(vocab).items()]
    return aggregate(frm, aggs)


def pos_cash() -> str:
    aggs = recipes("POS_", {"MONTHS_BALANCE": ["max", "mean", "size"], "SK_DPD": ["max", "mean"], "SK_DPD_DEF": ["max", "mean"]})
    return aggregate(source("pos_cash"), aggs + shares(VOCABULARY["pos_cash"], "POS_") + [Agg("POS_COUNT", "size")])


def _last_loan(table: str) -> str:
    return f"(first_value(SK_ID_PREV) over (partition by {CLIENT} order by {ordering(table)}) is not distinct from SK_ID_PREV) as last_loan"


def pos_open_solution() -> str:
    frm = f"""(select *, case when SK_DPD > 0 then 1 else 0 end as pos_cash_paid_late, case when SK_DPD_DEF > 0 then 1 else 0 end as pos_cash_paid_late_with_tolerance,
{_last_loan('pos_cash')} from {source('pos_cash')})"""
    late = ("pos_cash_paid_late", "pos_cash_paid_late_with_tolerance")
    aggs = [Agg("pos_cash_remaining_installments", "max", "CNT_INSTALMENT_FUTURE", last=1), Agg("pos_cash_completed_contracts", "sum", expr="case when NAME_CONTRACT_STATUS = 'Completed' then 1 else 0 end")]
    for k, name in ((None, "all_installment_"), (6, "last_6_"), (12, "last_12_"), (30, "last_30_")):
        aggs += [Agg(f"{name}{c}_{f}", f, c, last=k) for c in late for f in ("count", "mean")]
        aggs += [Agg(f"{name}{c}_{f}", f, c, last=k) for c in ("SK_DPD", "SK_DPD_DEF") for f in ("sum", "mean", "max", "std", "skew", "kurt")]
    aggs += [Agg(f"{k}_period_trend_{c}", "trend", c, last=k) for k in (6, 12) for c in ("SK_DPD", "SK_DPD_DEF", "CNT_INSTALMENT_FUTURE")]
    aggs += [Agg(f"last_loan_{late[0]}_{f}", f, late[0], "last_loan") for f in ("count", "sum", "mean")] + [Agg(f"last_loan_{late[1]}_mean", "mean", late[1], "last_loan")]
    aggs += [Agg(f"last_loan_{c}_{f}", f, c, "last_loan") for c in ("SK_DPD", "SK_DPD_DEF") for f in ("sum", "mean", "max", "std")]
    return aggregate(frm, aggs, "pos_cash")


def pos_antonova() -> str:
    vocab = VOCABULARY["pos_cash"]
    clean = f"(select * replace (case when CNT_INSTALMENT_FUTURE > 60 then null else CNT_INSTALMENT_FUTURE end as CNT_INSTALMENT_FUTURE) from {source('pos_cash')})"
    name = "pos CNT_INSTALMENT more CNT_INSTALMENT_FUTURE"
    frm = f"(select *, case when CNT_INSTALMENT > CNT_INSTALMENT_FUTURE then 1 else 0 end as {quoted(name)} from {clean})"
    numeric = [c for c in COLUMNS["pos_cash"] if c not in vocab] + [name]
    return aggregate(frm, recipes("POS_", {c: SIX for c in numeric}) + shares(vocab, "POS_") + [Agg("POS_COUNT", "size")])


def installments() -> str:
    late = "(DAYS_ENTRY_PAYMENT - DAYS_INSTALMENT)"
    frm = f"""(select *, {ratio('AMT_PAYMENT', 'AMT_INSTALMENT')} as PAYMENT_PERC, AMT_INSTALMENT - AMT_PAYMENT as PAYMENT_DIFF,
case when {late} > 0 then {late} else 0 end as DPD, case when {late} < 0 then -{late} else 0 end as DBD from {source('installments')})"""
    return aggregate(frm, recipes("INSTAL_", PAYMENT_NUMERIC) + [Agg("INSTAL_COUNT", "size")])


def installments_open_solution() -> str:
    late, over = "DAYS_ENTRY_PAYMENT - DAYS_INSTALMENT", "AMT_PAYMENT - AMT_INSTALMENT"
    frm = f"""(select *, {late} as installment_paid_late_in_days, case when {late} > 0 then 1 else 0 end as installment_paid_late,
{over} as installment_paid_over_amount, case when {over} > 0 then 1 else 0 end as installment_paid_over, {_last_loan('installments')} from {source('installments')})"""
    aggs = []
    for k, name in ((None, "all_installment_"), *((k, f"last_{k}_") for k in PERIODS)):
        aggs += [Agg(f"{name}{c}_{f}", f, c, last=k) for c, funcs in IN_PERIOD.items() for f in funcs]
    aggs += [Agg(f"{k}_period_trend_{c}", "trend", c, last=k) for k in TRENDS for c in ("installment_paid_late_in_days", "installment_paid_over_amount")]
    five, two = ("sum", "mean", "max", "min", "std"), ("count", "mean")
    last = {"installment_paid_late_in_days": five, "installment_paid_late": two, "installment_paid_over_amount": five, "installment_paid_over": two}
    aggs += [Agg(f"last_loan_{c}_{f}", f, c, "last_loan") for c, funcs in last.items() for f in funcs]
    raw = ", ".join(f"{column(a)} as {quoted(a.name)}" for a in aggs)
    numbered = f"(select *, row_number() over (partition by {CLIENT} order by {ordering('installments')}) as rn from {frm})"
    names = {a.name: quoted(a.name) for a in aggs}
    for a, b in FRACTIONS:
        for c, funcs in IN_PERIOD.items():
            for f in funcs:
                x, y = quoted(f"last_{a}_{c}_{f}"), quoted(f"last_{b}_{c}_{f}")
                names[f"last_{a}by{b}_fraction_{c}_{f}"] = f"case when {y} = 0 then 0.0 else cast({x} as double) / {y} end"
    return f"select {CLIENT}, {', '.join(number(e, n) for n, e in names.items())} from (select {CLIENT}, {raw} from {numbered} group by {CLIENT})"


def installments_antonova() -> str:
    clean = f"(select * replace (case when NUM_INSTALMENT_VERSION > 70 then null else NUM_INSTALMENT_VERSION end as NUM_INSTALMENT_VERSION, case when DAYS_ENTRY_PAYMENT < -4000 then null else DAYS_ENTRY_PAYMENT end as DAYS_ENTRY_PAYMENT) from {source('installments')})"
    made = {
        "ins DAYS_ENTRY_PAYMENT - DAYS_INSTALMENT": "DAYS_ENTRY_PAYMENT - DAYS_INSTALMENT",
        "ins NUM_INSTALMENT_NUMBER_100": "case when NUM_INSTALMENT_NUMBER = 100 then 1 else 0 end",
        "ins DAYS_INSTALMENT more NUM_INSTALMENT_NUMBER": "case when DAYS_INSTALMENT > NUM_INSTALMENT_NUMBER * 50.0 / 3 - 11500.0 / 3 then 1 else 0 end",
        "ins AMT_INSTALMENT - AMT_PAYMENT": "AMT_INSTALMENT - AMT_PAYMENT",
        "ins AMT_PAYMENT / AMT_INSTALMENT": ratio("AMT_PAYMENT", "AMT_INSTALMENT"),
    }
    frm = f"(select *, {', '.join(f'{e} as {quoted(n)}' for n, e in made.items())} from {clean})"
    return aggregate(frm, recipes("INS_", {c: SIX for c in COLUMNS["installments"] + list(made)}) + [Agg("INSTAL_COUNT", "size")])


def credit_card() -> str:
    vocab, four = VOCABULARY["credit_card"], ["max", "mean", "sum", "var"]
    aggs = recipes("CC_", {c: four for c in COLUMNS["credit_card"] if c not in (*vocab, CLIENT, "SK_ID_PREV")})
    aggs += [Agg(f"CC_{n}_{f.upper()}", f, expr=e) for n, e in dummies(vocab).items() for f in four]
    return aggregate(source("credit_card"), aggs + [Agg("CC_COUNT", "size")])


def credit_card_open_solution() -> str:
    mature = f"(select {CLIENT}, sum(m) as mature from (select {CLIENT}, SK_ID_PREV, max(CNT_INSTALMENT_MATURE_CUM) as m from {source('credit_card')} group by 1, 2) group by 1)"
    load = f"(select {CLIENT}, avg(l) as load from (select {CLIENT}, SK_ID_PREV, {ratio('max(AMT_BALANCE)', 'AMT_CREDIT_LIMIT_ACTUAL')} as l from {source('credit_card')} group by 1, 2, AMT_CREDIT_LIMIT_ACTUAL) group by 1)"
    diff = f"(select {CLIENT}, avg(d) as diff from (select {CLIENT}, AMT_BALANCE - lag(AMT_BALANCE) over (partition by {CLIENT} order by MONTHS_BALANCE nulls first, SK_ID_PREV nulls first, AMT_BALANCE nulls first) as d from {source('credit_card')}) group by 1)"
    base = f"(select {CLIENT}, count(distinct SK_ID_PREV) as loans, avg(SK_DPD) as dpd, coalesce(sum(AMT_DRAWINGS_ATM_CURRENT), 0) as atm, coalesce(sum(AMT_DRAWINGS_CURRENT), 0) as drawn from {source('credit_card')} group by 1)"
    made = {
        "credit_card_number_of_loans": "loans",
        "credit_card_average_of_days_past_due": "dpd",
        "credit_card_drawings_atm": "atm",
        "credit_card_drawings_total": "drawn",
        "credit_card_total_installments": "coalesce(mature, 0)",
        "credit_card_avg_loading_of_credit_limit": "load",
        "credit_card_cash_card_ratio": ratio("atm", "drawn"),
        "credit_card_installments_per_loan": ratio("coalesce(mature, 0)", "loans"),
        "credit_card_monthly_diff": "diff",
    }
    return f"select {CLIENT}, {', '.join(number(e, n) for n, e in made.items())} from {base} join {mature} using ({CLIENT}) join {load} using ({CLIENT}) join {diff} using ({CLIENT})"


def credit_card_antonova() -> str:
    vocab, columns = VOCABULARY["credit_card"], COLUMNS["credit_card"]
    clean = f"(select * replace (case when AMT_PAYMENT_CURRENT > 4000000 then null else AMT_PAYMENT_CURRENT end as AMT_PAYMENT_CURRENT, case when AMT_CREDIT_LIMIT_ACTUAL > 1000000 then null else AMT_CREDIT_LIMIT_ACTUAL end as AMT_CREDIT_LIMIT_ACTUAL) from {source('credit_card')})"
    made = {"card missing": " + ".join(f"cast({c} is null as int)" for c in columns)} | {f"card {a} - {b}": f"{a} - {b}" for a, b in CARD_DIFFERENCES}
    frm = f"(select *, {', '.join(f'{e} as {quoted(n)}' for n, e in made.items())} from {clean})"
    numeric = [c for c in columns if c not in vocab] + list(made)
    return aggregate(frm, recipes("CARD_", {c: SIX for c in numeric}) + shares(vocab, "CARD_") + [Agg("CARD_COUNT", "size")])


def child_groups(name: str) -> str:
    return aggregate(source(CHILD_RECIPES[name][0]), child_recipes(name))


def application_groups() -> str:
    joins, names = [], []
    for i, (keys, pairs) in enumerate(APPLICATION_RECIPES):
        aggs = group_recipes("Application", keys, pairs)
        made = ", ".join(f"{column(a)} as {quoted(a.name)}" for a in aggs)
        where = " and ".join(f"{k} is not null" for k in keys)
        on = " and ".join(f"a.{k} = g{i}.{k}" for k in keys)
        joins.append(f"left join (select {', '.join(keys)}, {made} from {source('application')} where {where} group by {', '.join(keys)}) g{i} on {on}")
        names += [number(f"g{i}.{quoted(a.name)}", a.name) for a in aggs]
    return f"select a.{CLIENT}, {', '.join(names)} from {source('application')} a {' '.join(joins)}"


EXTS = ["EXT_SOURCE_1", "EXT_SOURCE_2", "EXT_SOURCE_3"]


def _row(stat: str) -> str:
    return f"list_{stat}(list_filter([{', '.join(EXTS)}], lambda x: x is not null))"


def application_open_solution() -> str:
    from .features.application import RATIOS

    grown = "(CNT_FAM_MEMBERS - CNT_CHILDREN)"
    made = {n: ratio(a, b) for n, (a, b) in RATIOS.items()} | {
        "income_per_child": ratio("AMT_INCOME_TOTAL", "(1 + CNT_CHILDREN)"),
        "credit_per_child": ratio("AMT_CREDIT", "(1 + CNT_CHILDREN)"),
        "external_sources_weighted": "EXT_SOURCE_1 * 2 + EXT_SOURCE_2 * 3 + EXT_SOURCE_3 * 4",
        "cnt_non_child": grown,
        "child_to_non_child_ratio": ratio("CNT_CHILDREN", grown),
        "income_per_non_child": ratio("AMT_INCOME_TOTAL", grown),
        "credit_per_non_child": ratio("AMT_CREDIT", grown),
        "external_sources_min": f"least({', '.join(EXTS)})",
        "external_sources_max": f"greatest({', '.join(EXTS)})",
        "external_sources_sum": f"coalesce({_row('sum')}, 0)",
        "external_sources_mean": _row("avg"),
        "external_sources_nanmedian": _row("median"),
        "short_employment": "case when DAYS_EMPLOYED < -2000 then 1 else 0 end",
        "young_age": "case when DAYS_BIRTH < -14000 then 1 else 0 end",
    }
    return f"select {CLIENT}, {', '.join(number(e, n) for n, e in made.items())} from {source('application')}"


def application_antonova() -> str:
    made = {f"app {EXTS[a]} * {EXTS[b]}": f"{EXTS[a]} * {EXTS[b]}" for a, b in ((0, 1), (0, 2), (1, 2))}
    made |= {f"app {e} * DAYS_EMPLOYED": f"{e} * DAYS_EMPLOYED" for e in EXTS} | {f"app {e} / DAYS_BIRTH": ratio(e, "DAYS_BIRTH") for e in EXTS}
    made |= {
        "app AMT_CREDIT - AMT_GOODS_PRICE": "AMT_CREDIT - AMT_GOODS_PRICE",
        "app AMT_INCOME_TOTAL / 12 - AMT_ANNUITY": "AMT_INCOME_TOTAL / 12.0 - AMT_ANNUITY",
        "app AMT_INCOME_TOTAL / AMT_ANNUITY": ratio("AMT_INCOME_TOTAL", "AMT_ANNUITY"),
        "app AMT_INCOME_TOTAL - AMT_GOODS_PRICE": "AMT_INCOME_TOTAL - AMT_GOODS_PRICE",
        "app most popular AMT_GOODS_PRICE": "case when AMT_GOODS_PRICE in (225000, 450000, 675000, 900000) then 1 else 0 end",
        "app popular AMT_GOODS_PRICE": "case when AMT_GOODS_PRICE in (1125000, 1350000, 1575000, 1800000, 2250000) then 1 else 0 end",
        "app DAYS_EMPLOYED - DAYS_BIRTH": "DAYS_EMPLOYED - DAYS_BIRTH",
    }
    return f"select {CLIENT}, {', '.join(number(e, n) for n, e in made.items())} from {source('application')}"


def application() -> str:
    vocab = VOCABULARY["application"]
    docs = [f"FLAG_DOCUMENT_{i}" for i in range(2, 22)]
    live = ["FLAG_MOBIL", "FLAG_EMP_PHONE", "FLAG_WORK_PHONE", "FLAG_CONT_MOBILE", "FLAG_PHONE", "FLAG_EMAIL"]
    n, mean = len(docs), f"(({' + '.join(docs)}) / {len(docs)}.0)"
    m2, m4 = (" + ".join(f"power({d} - {mean}, {k})" for d in docs) for k in (2, 4))
    kurt = f"case when {m2} = 0 then 0.0 else {n * (n + 1) * (n - 1)}.0 * ({m4}) / ({(n - 2) * (n - 3)}.0 * power({m2}, 2)) - {3 * (n - 1) ** 2 / ((n - 2) * (n - 3))!r} end"
    dev = _row("stddev_samp")
    binary = ["CODE_GENDER", "FLAG_OWN_CAR", "FLAG_OWN_REALTY"]
    code = {c: f"(select row_number() over (order by f) - 1 as code, v from (select {c} as v, min({CLIENT}) as f from src where {c} is not null group by 1))" for c in binary}
    made = {c: c for c in [*APPLICATION_NUMBERS, *live, "FLAG_DOCUMENT_3", "REG_CITY_NOT_WORK_CITY"]}
    made |= {
        "NEW_CREDIT_TO_ANNUITY_RATIO": ratio("AMT_CREDIT", "AMT_ANNUITY"),
        "NEW_CREDIT_TO_GOODS_RATIO": ratio("AMT_CREDIT", "AMT_GOODS_PRICE"),
        "NEW_DOC_IND_KURT": kurt,
        "NEW_LIVE_IND_SUM": " + ".join(live),
        "NEW_INC_PER_CHLD": ratio("AMT_INCOME_TOTAL", "(1 + CNT_CHILDREN)"),
        "NEW_INC_BY_ORG": "o.income",
        "NEW_EMPLOY_TO_BIRTH_RATIO": ratio("DAYS_EMPLOYED", "DAYS_BIRTH"),
        "NEW_ANNUITY_TO_INCOME_RATIO": ratio("AMT_ANNUITY", "(1 + AMT_INCOME_TOTAL)"),
        "NEW_SOURCES_PROD": " * ".join(EXTS),
        "NEW_EXT_SOURCES_MEAN": _row("avg"),
        "NEW_SCORES_STD": f"coalesce({dev}, (select avg({dev}) from src))",
        "NEW_CAR_TO_BIRTH_RATIO": ratio("OWN_CAR_AGE", "DAYS_BIRTH"),
        "NEW_CAR_TO_EMPLOY_RATIO": ratio("OWN_CAR_AGE", "DAYS_EMPLOYED"),
        "NEW_PHONE_TO_BIRTH_RATIO": ratio("DAYS_LAST_PHONE_CHANGE", "DAYS_BIRTH"),
        "NEW_PHONE_TO_BIRTH_RATIO_EMPLOYER": ratio("DAYS_LAST_PHONE_CHANGE", "DAYS_EMPLOYED"),
        "NEW_CREDIT_TO_INCOME_RATIO": ratio("AMT_CREDIT", "AMT_INCOME_TOTAL"),
    }
    made |= {c: f"coalesce({c.lower()}_codes.code, -1)" for c in binary}
    made |= {n: duck_expr(e) for n, e in dummies({c: v for c, v in vocab.items() if c not in binary}).items()}
    joins = " ".join(f"left join {code[c]} {c.lower()}_codes on src.{c} = {c.lower()}_codes.v" for c in binary)
    return f"""with src as {source('application').replace('(select', '(select', 1)}
select src.{CLIENT}, {', '.join(number(e, n) for n, e in made.items())} from src
left join (select ORGANIZATION_TYPE as org, median(AMT_INCOME_TOTAL) as income from src where ORGANIZATION_TYPE is not null group by 1) o on src.ORGANIZATION_TYPE = o.org {joins}"""


def value_counts() -> str:
    names = [number(f"case when {c} is not null then count(*) over (partition by {c}) end", f"app_{c}_value_count") for c in VOCABULARY["application"]]
    return f"select {CLIENT}, {', '.join(names)} from {source('application')}"


def pair_counts() -> str:
    columns = list(VOCABULARY["application"])
    names = [
        number(f"case when {a} is not null and {b} is not null then count(*) over (partition by {a}, {b}) end", f"app_{a}_{b}_value_count")
        for i, a in enumerate(columns)
        for b in columns[i + 1 :]
    ]
    return f"select {CLIENT}, {', '.join(names)} from {source('application')}"


def _smoothed(n: str, mean: str, prior: str) -> str:
    return f"case when coalesce({n}, 0) > 1 then {prior} * (1 - 1 / (1 + exp(-({n} - 1.0)))) + {mean} / (1 + exp(-({n} - 1.0))) else {prior} end"


def target_encoding(table: str | None) -> str:
    """Leaky encoding of the application, or of a child table averaged over a client's rows."""
    columns = list(VOCABULARY[table or "application"]) if table != "bureau" else ["CREDIT_ACTIVE", "CREDIT_CURRENCY", "CREDIT_TYPE"]
    src = source("application") if table is None else f"(select a.{CLIENT}, a.TARGET, {', '.join('t.' + c for c in columns)} from {source('application')} a left join {source(table)} t using ({CLIENT}))"
    prior = "(select avg(TARGET) from src where TARGET is not null)"
    joins = " ".join(f"left join (select {c} as v, count(*) as n, avg(TARGET) as m from src where TARGET is not null and {c} is not null group by 1) t{i} on src.{c} = t{i}.v" for i, c in enumerate(columns))
    names = [number(f"avg({_smoothed(f't{i}.n', f't{i}.m', prior)})", f"{c}_target_encode") for i, c in enumerate(columns)]
    return f"with src as (select * from {src}) select src.{CLIENT}, {', '.join(names)} from src {joins} group by src.{CLIENT}"


FOLD = "(row_number() over (partition by TARGET order by (SK_ID_CURR * 2654435761 + 47) % 4294967296, SK_ID_CURR) - 1) % 5"


def target_encoding_folds() -> str:
    columns, parts = list(VOCABULARY["application"]), []
    names = []
    for i, c in enumerate(columns):
        stats = f"(select f.k, v.v, (select avg(TARGET) from train where fold <> f.k) as prior, count(t.TARGET) as n, avg(t.TARGET) as m from (select distinct {c} as v from train where {c} is not null) v cross join (select unnest(range(5)) as k) f left join train t on t.{c} = v.v and t.fold <> f.k group by 1, 2)"
        parts.append(f"e{i} as (select k, v, {_smoothed('n', 'm', 'prior')} as e from {stats}), p{i} as (select k, avg(TARGET) as prior from (select unnest(range(5)) as k) f join train on fold <> k group by 1)")
        own = f"coalesce((select e from e{i} where e{i}.v = src.{c} and e{i}.k = src.fold), (select prior from p{i} where k = src.fold))"
        mean = f"(select avg(coalesce(e{i}.e, p{i}.prior)) from p{i} left join e{i} on e{i}.k = p{i}.k and e{i}.v = src.{c})"
        names.append(number(f"case when TARGET is null then {mean} else {own} end", c))
    return f"with src as (select *, cast({FOLD} as bigint) as fold from {source('application')}), train as (select * from src where TARGET is not null), {', '.join(parts)} select {CLIENT}, {', '.join(names)} from src"


def predictions(run: str) -> str:
    return f"select SK_ID_CURR, {number('p', prediction_column(run))} from ({run_sql(run).format(customer='customer')})"


def every_prediction() -> str:
    names = sorted(n for n in RUN_FACTORS if n not in FAILED)
    cells = ", ".join(number(f"max(case when run = '{n}' then p end)", prediction_column(n)) for n in names)
    tall = " union all ".join(f"select '{n}' as run, * from ({run_sql(n).format(customer='customer')})" for n in names)
    return f"select SK_ID_CURR, {cells} from ({tall}) group by SK_ID_CURR"


FEATURE_SETS = {
    **{name: (lambda run=run: predictions(run)) for name, run in PINNED.items()},
    "PredsAll": every_prediction,
    "ApplicationFeatures": application,
    "ApplicationFeaturesOpenSolution": application_open_solution,
    "ApplicationFeaturesAntonova": application_antonova,
    "ApplicationFeaturesSingleValueCounts": value_counts,
    "ApplicationFeaturesPairValueCounts": pair_counts,
    "ApplicationFeaturesLeakyTargetEncoding": lambda: target_encoding(None),
    "ApplicationFeaturesTargetEncoding": target_encoding_folds,
    "AggregateFeatureApplicationOpenSolution": application_groups,
    "BureauFeatures": bureau,
    "BureauFeaturesOpenSolution": bureau_open_solution,
    "BureauFeaturesAntonova": bureau_antonova,
    "BureauFeaturesLeakyTargetEncoding": lambda: target_encoding("bureau"),
    "PreviousApplicationFeatures": previous,
    "PreviousApplicationFeaturesOpenSolution": previous_open_solution,
    "PreviousApplicationFeaturesAntonova": previous_antonova,
    "PreviousApplicationFeaturesLeakyTargetEncoding": lambda: target_encoding("previous_application"),
    "PosCashFeatures": pos_cash,
    "PosCashFeaturesOpenSolution": pos_open_solution,
    "PosCashFeaturesAntonova": pos_antonova,
    "PosCashFeaturesLeakyTargetEncoding": lambda: target_encoding("pos_cash"),
    "InstallmentsPaymentsFeatures": installments,
    "InstallmentsPaymentsFeaturesOpenSolution": installments_open_solution,
    "InstallmentsPaymentsFeaturesAntonova": installments_antonova,
    "CreditCardBalanceFeatures": credit_card,
    "CreditCardBalanceFeaturesOpenSolution": credit_card_open_solution,
    "CreditCardBalanceFeaturesAntonova": credit_card_antonova,
    "CreditCardBalanceFeaturesLeakyTargetEncoding": lambda: target_encoding("credit_card"),
    **{f"AggregateFeature{n}OpenSolution": (lambda n=n: child_groups(n)) for n in CHILD_RECIPES},
}

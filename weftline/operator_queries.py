"""The table operators one by one over the order tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ensemble import power_blend, rank_average, stack
from .functions import rowwise
from .nulls import finite_or_zero, ratio, ratio_or_zero
from .operators.encode import factorize, one_hot
from .operators.folds import MODULUS, MULTIPLIER, fold_of
from .operators.joins import drop_repeated, one_to_one, star
from .operators.ranking import auc, class_comparison, rank_sum, with_rank
from .selection import clean_data, constant_columns, difference_stats, drop_columns, null_importance_gain, null_importance_share, under_threshold
from .sources.credit import united


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.floor(F.col("o_totalprice") / 1000).cast("bigint")
    return _table(spark, sf_dir, "orders").select("o_orderkey", price.alias("p"), (F.col("o_orderkey") % 97).alias("q"), (F.col("o_orderstatus") == "F").cast("int").alias("closed"))


_ORDERS = "(select o_orderkey, cast(floor(o_totalprice / 1000) as bigint) as p, o_orderkey % 97 as q, case when o_orderstatus = 'F' then 1 else 0 end as closed from orders)"


def rank_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_rank(_orders(spark, sf_dir), "p", "rank_p").select("o_orderkey", "rank_p")


def rank_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_rank(_orders(spark, sf_dir), "p", "rank_p", average=True).select("o_orderkey", "rank_p")


def exact_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return auc(_orders(spark, sf_dir), "closed", "p").select(F.round("auc", 9).alias("auc"))


def compare_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = class_comparison(_orders(spark, sf_dir), "closed", ["p", "q"])
    return found.select("c", "n", "n1", *[F.round(c, 6).alias(c) for c in ("rank_sum", "mean0", "mean1", "median0", "median1")], "least", "most")


def first_appearance_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = _table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return factorize(customers, ["c_mktsegment"], [F.col("c_custkey")])


def dummy_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return one_hot(_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), vocab={"o_orderstatus": ["F", "O", "P"]})[0]


def stratified_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold_of(_orders(spark, sf_dir), "o_orderkey", "closed").select("o_orderkey", "fold")


def blend_powers(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _orders(spark, sf_dir).select("o_orderkey", (F.col("p") / 1000).alias("a"), (F.col("q") / 97).alias("b"))
    return power_blend(scored, {"a": 1.0, "b": 3.0}, 2.0).select("o_orderkey", F.round("prediction", 6).alias("prediction"))


def average_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_average(_orders(spark, sf_dir), {"p": 0.25, "q": 0.75}).select("o_orderkey", F.round("prediction", 6).alias("prediction"))


def stack_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _orders(spark, sf_dir)
    runs = [orders.filter("o_orderkey % 2 = 0").select("o_orderkey", F.col("p").alias("a_PREDICTION")), orders.filter("o_orderkey % 3 = 0").select("o_orderkey", F.col("q").alias("b_PREDICTION"))]
    return stack(orders.select("o_orderkey"), runs, "o_orderkey")


def row_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _table(spark, sf_dir, "lineitem")
    x = [F.nullif(F.col("l_partkey") % 7, F.lit(0)), F.nullif(F.col("l_suppkey") % 5, F.lit(1)), F.nullif(F.col("l_orderkey") % 11, F.lit(2)), F.col("l_linenumber")]
    x = [c.cast("double") for c in x]
    made = {"rmean": rowwise.row_mean(x), "rstd": rowwise.row_std(x), "rmedian": rowwise.row_median(x), "rsum": rowwise.row_sum(x), "rmin": rowwise.row_min(x), "rmax": rowwise.row_max(x), "rnulls": rowwise.row_nulls(x)}
    return lines.select("l_orderkey", "l_linenumber", *[F.round(v.cast("double"), 6).alias(k) for k, v in made.items()])


def ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("p"), F.col("q")
    return _orders(spark, sf_dir).select("o_orderkey", F.round(ratio(a, b), 6).alias("null_for_zero"), F.round(ratio_or_zero(a, b), 6).alias("zero_for_zero"))


def scan_union_train_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = _table(spark, sf_dir, "customer")
    train = customers.filter("c_custkey % 5 != 0").select("c_custkey", (F.col("c_acctbal") < 0).cast("double").alias("target"), "c_mktsegment")
    return united([train, customers.filter("c_custkey % 5 = 0").select("c_mktsegment", "c_custkey")])


def feature_star_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _orders(spark, sf_dir).join(_table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey")), "o_orderkey")
    made = orders.groupBy("c_custkey").agg(F.count(F.lit(1)).alias("n_orders"), F.sum("p").alias("p_sum"))
    closed = orders.filter("closed = 1").groupBy("c_custkey").agg(F.count(F.lit(1)).alias("n_orders"), F.max("q").alias("q_max"))
    joined = star(_table(spark, sf_dir, "customer").select("c_custkey"), [made, closed], "c_custkey", "drop")
    return joined.select("c_custkey", *[F.col(c).cast("double") for c in joined.columns[1:]])


def one_to_one_inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _orders(spark, sf_dir)
    return one_to_one(orders.filter("p > 100").select("o_orderkey", "p"), orders.filter("q > 10").select("o_orderkey", "q"), ["o_orderkey"])


def column_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _orders(spark, sf_dir)
    return drop_repeated(orders.select("o_orderkey", "p"), orders, ["o_orderkey"])


def ranksum_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    compared = class_comparison(_orders(spark, sf_dir), "closed", ["p", "q"]).collect()  # a row for each column
    tested = [(r.c, *rank_sum(r.rank_sum, r.n1, r.n)) for r in compared]
    return spark.createDataFrame([(c, round(z, 6), int(p <= 0.05)) for c, z, p in tested], "c int, z double, significant int")


def _for_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as clients: a target for three in four, a constant, and columns that tell classes or parts apart."""
    target = F.when(F.col("o_orderkey") % 4 != 0, F.col("closed"))
    shifted = F.when(target.isNull(), F.col("q") * 5 + 500).otherwise(F.lit(7) + F.col("q") % 2)
    return _orders(spark, sf_dir).select(
        "o_orderkey", target.alias("target"), "p", "q", F.lit(1.0).alias("one"), (F.col("closed") * 40 + F.col("q")).alias("tells"), (F.col("q") < 20).cast("int").alias("low"),
        shifted.alias("shifted"), F.lit(None).cast("double").alias("nothing"),
    )


CLEANED = ("p", "q", "one", "tells", "low", "shifted", "nothing")


def clean_nunique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(c,) for c in constant_columns(_for_cleaning(spark, sf_dir), list(CLEANED))], "feature string")


def clean_diff_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _for_cleaning(spark, sf_dir)
    found = difference_stats(df.filter("target is not null"), ["p", "q", "tells", "low"], "target", df)
    return spark.createDataFrame([(c, round(d, 6), round(n, 6), int(p <= 0.05)) for c, (d, n, p) in found.items()], "feature string, diff double, norm double, significant int")


def clean_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = clean_data(_for_cleaning(spark, sf_dir), "o_orderkey", "target").columns
    return spark.createDataFrame([(c,) for c in CLEANED if c in kept], "feature string")


def _importances(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Importances of real and of shuffled targets, as order lines have it."""
    lines = _table(spark, sf_dir, "lineitem").withColumn("feature", F.concat(F.lit("f"), (F.col("l_partkey") % 23).cast("string")))
    actual = lines.filter("l_linenumber = 1").select("feature", (F.col("l_quantity") * (F.col("l_partkey") % 23 + 1)).cast("double").alias("importance_gain"))
    return actual, lines.filter("l_linenumber > 1").select("feature", (F.col("l_quantity") * 12).cast("double").alias("importance_gain"))


def ni_gain_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return null_importance_gain(*_importances(spark, sf_dir)).select("feature", F.round("score", 6).alias("score"))


def ni_corr_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return null_importance_share(*_importances(spark, sf_dir)).select("feature", F.round("score", 6).alias("score"))


def column_droplist(spark: SparkSession, sf_dir: str) -> DataFrame:
    dropped = under_threshold(null_importance_share(*_importances(spark, sf_dir)), 20)
    wide = spark.range(1).select(*[F.lit(i).alias(f"f{i}") for i in range(23)])
    left = drop_columns(wide, [*dropped, "not there"]).columns
    return spark.createDataFrame([(c,) for c in left], "feature string")


def top_importances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten features of the greatest mean importance."""
    mean = _importances(spark, sf_dir)[0].groupBy("feature").agg(F.avg("importance_gain").alias("importance"))
    return mean.orderBy(F.desc("importance"), "feature").limit(10).select("feature", F.round("importance", 6).alias("importance"))


def vocabulary_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderstatus"))
    return one_hot(_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", status.alias("status")))[0]


def finite_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.col("p").cast("double")
    value = F.when(F.col("q") == 0, F.lit(float("inf"))).when(F.col("q") == 1, F.lit(float("nan"))).when(F.col("q") > 1, a / F.col("q"))
    return _orders(spark, sf_dir).select(
        "o_orderkey", F.round(finite_or_zero(value), 6).alias("finite"), F.ceil(a / 7).cast("bigint").alias("up"), F.round(F.log1p(a), 6).alias("logged"), F.round(F.pow(a, F.lit(0.5)), 6).alias("root")
    )


OPERATOR_QUERIES = {
    f.__name__: f
    for f in (scan_union_train_test, feature_star_join, one_to_one_inner, column_difference, ranksum_z, clean_nunique, clean_diff_stats, clean_columns, ni_gain_score, ni_corr_score, column_droplist, top_importances, vocabulary_discovery, finite_values, rank_min, rank_mean, exact_auc, compare_classes, first_appearance_codes, dummy_columns, stratified_folds, blend_powers, average_ranks, stack_runs, row_statistics, ratios)
}

_RANKED = f"select *, rank() over (order by p) as lo, count(*) over (partition by p) as ties from {_ORDERS}"
_COMPARED = " union all ".join(
    f"""select cast({i} as int) as c, count(*) as n, sum(closed) as n1, round(sum(case when closed = 1 then lo + (ties - 1) / 2.0 end), 6) as rank_sum,
round(avg({x}) filter (where closed = 0), 6) as mean0, round(avg({x}) filter (where closed = 1), 6) as mean1,
round(median({x}) filter (where closed = 0), 6) as median0, round(median({x}) filter (where closed = 1), 6) as median1,
cast(min({x}) as double) as least, cast(max({x}) as double) as most
from (select *, rank() over (order by {x}) as lo, count(*) over (partition by {x}) as ties from {_ORDERS})"""
    for i, x in enumerate(("p", "q"))
)
_Z = "(sum(case when {f} = 1 then lo + (ties - 1) / 2.0 end) - sum({f}) * (count(*) + 1) / 2.0) / sqrt(cast(sum({f}) as double) * (count(*) - sum({f})) * (count(*) + 1) / 12)"
_CLEANING = f"""(select o_orderkey, t as target, cast(p as double) as p, cast(q as double) as q, 1.0 as one, cast(closed * 40 + q as double) as tells, case when q < 20 then 1.0 else 0.0 end as low,
cast(case when t is null then q * 5 + 500 else 7 + q % 2 end as double) as shifted, cast(null as double) as nothing
from (select *, case when o_orderkey % 4 != 0 then closed end as t from {_ORDERS}))"""


def _split_stats(x: str, flag: str, rows: str, whole: str) -> str:
    """feature, diff, norm and z of a column between rows of flag 0 and 1."""
    a, b = (("avg" if x == "low" else "median") + f"({x}) filter (where {flag} = {k})" for k in (0, 1))
    return f"""select '{x}' as feature, abs({a} - {b}) as diff, abs(abs({a} - {b}) / (select avg({x}) from {whole})) as norm, {_Z.format(f=flag)} as z
from (select *, rank() over (order by {x}) as lo, count(*) over (partition by {x}) as ties from {rows})"""


_TESTED = ("p", "q", "tells", "low")
_BY_TARGET = " union all ".join(_split_stats(x, "target", f"(select * from {_CLEANING} where target is not null)", _CLEANING) for x in (*_TESTED, "shifted"))
_BY_PART = " union all ".join(_split_stats(x, "part", f"(select *, case when target is null then 0 else 1 end as part from {_CLEANING})", _CLEANING) for x in (*_TESTED, "shifted"))
_ACTUAL = "(select 'f' || (l_partkey % 23) as feature, cast(l_quantity * (l_partkey % 23 + 1) as double) as g from lineitem where l_linenumber = 1)"
_NULL = "(select 'f' || (l_partkey % 23) as feature, cast(l_quantity * 12 as double) as g from lineitem where l_linenumber > 1)"
_SHARE = f"select feature, 100 * avg(case when n.g < a.g then 1.0 else 0.0 end) as score from {_NULL} n join (select feature, quantile_cont(g, 0.25) as g from {_ACTUAL} group by feature) a using (feature) group by feature"
OPERATOR_SQL = {
    "scan_union_train_test": "select c_custkey, case when c_custkey % 5 != 0 then cast(c_acctbal < 0 as double) end as target, c_mktsegment from customer",
    "feature_star_join": f"""with o as (select * from {_ORDERS} join (select o_orderkey, o_custkey as c_custkey from orders) using (o_orderkey))
select c_custkey, cast(n_orders as double) as n_orders, cast(p_sum as double) as p_sum, cast(q_max as double) as q_max from customer left join (select c_custkey, count(*) as n_orders, cast(sum(p) as bigint) as p_sum from o group by 1) using (c_custkey)
left join (select c_custkey, max(q) as q_max from o where closed = 1 group by 1) using (c_custkey)""",
    "one_to_one_inner": f"select o_orderkey, p, q from {_ORDERS} where p > 100 and q > 10",
    "column_difference": f"select o_orderkey, q, closed from {_ORDERS}",
    "ranksum_z": " union all ".join(
        f"select cast({i} as int) as c, round({_Z.format(f='closed')}, 6) as z, cast(abs({_Z.format(f='closed')}) >= 1.9599639845 as int) as significant from (select *, rank() over (order by {x}) as lo, count(*) over (partition by {x}) as ties from {_ORDERS})"
        for i, x in enumerate(("p", "q"))
    ),
    "clean_nunique": " union all ".join(f"select '{c}' as feature from {_CLEANING} having count(distinct {c}) <= 1" for c in CLEANED),
    "clean_diff_stats": f"select feature, round(diff, 6) as diff, round(norm, 6) as norm, cast(abs(z) >= 1.9599639845 as int) as significant from ({_BY_TARGET}) where feature != 'shifted'",
    "clean_columns": f"""select t.feature from ({_BY_TARGET}) t join ({_BY_PART}) s using (feature)
where not (abs(t.z) < 1.9599639845 and (t.diff = 0 or t.norm < 0.5)) and not (s.norm > 1 and t.norm = 0 and abs(s.z) > 1.9599639845)""",
    "ni_gain_score": f"select feature, round(ln(1e-10 + a.g / (1 + n.g)), 6) as score from (select feature, avg(g) as g from {_ACTUAL} group by feature) a join (select feature, quantile_cont(g, 0.75) as g from {_NULL} group by feature) n using (feature)",
    "ni_corr_score": f"select feature, round(score, 6) as score from ({_SHARE})",
    "column_droplist": f"select 'f' || i as feature from range(23) t(i) where 'f' || i not in (select feature from ({_SHARE}) where score < 20)",
    "top_importances": f"select feature, round(avg(g), 6) as importance from {_ACTUAL} group by feature order by avg(g) desc, feature limit 10",
    "vocabulary_discovery": "select o_orderkey, "
    + ", ".join(f"case when o_orderpriority = '{v}' then 1 else 0 end as \"o_orderpriority_{v}\"" for v in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"))
    + ", case when o_orderpriority is null then 1 else 0 end as o_orderpriority_nan, "
    + ", ".join(f"case when o_orderkey % 7 != 0 and o_orderstatus = '{v}' then 1 else 0 end as \"status_{v}\"" for v in "FOP")
    + ", case when o_orderkey % 7 = 0 then 1 else 0 end as status_nan from orders",
    "finite_values": f"select o_orderkey, round(case when q > 1 then cast(p as double) / q else 0.0 end, 6) as finite, cast(ceil(p / 7.0) as bigint) as up, round(ln(1 + cast(p as double)), 6) as logged, round(sqrt(cast(p as double)), 6) as root from {_ORDERS}",
    "rank_min": f"select o_orderkey, lo as rank_p from ({_RANKED})",
    "rank_mean": f"select o_orderkey, lo + (ties - 1) / 2.0 as rank_p from ({_RANKED})",
    "exact_auc": f"select round((sum(case when closed = 1 then lo + (ties - 1) / 2.0 end) - sum(closed) * (sum(closed) + 1) / 2.0) / (sum(closed) * (count(*) - sum(closed))), 9) as auc from ({_RANKED})",
    "compare_classes": _COMPARED,
    "first_appearance_codes": "select c_custkey, dense_rank() over (order by f) - 1 as c_mktsegment from (select c_custkey, min(c_custkey) over (partition by c_mktsegment) as f from customer)",
    "dummy_columns": "select o_orderkey, " + ", ".join(f"case when o_orderstatus = '{v}' then 1 else 0 end as \"o_orderstatus_{v}\"" for v in "FOP") + ", case when o_orderstatus is null then 1 else 0 end as o_orderstatus_nan from orders",
    "stratified_folds": f"select o_orderkey, cast((row_number() over (partition by closed order by (o_orderkey * {MULTIPLIER} + 47) % {MODULUS}, o_orderkey) - 1) % 5 as int) as fold from {_ORDERS}",
    "blend_powers": f"select o_orderkey, round(0.25 * power(p / 1000.0, 2) + 0.75 * power(q / 97.0, 2), 6) as prediction from {_ORDERS}",
    "average_ranks": f"""select o_orderkey, round((m - min(m) over ()) / (max(m) over () - min(m) over ()), 6) as prediction
from (select o_orderkey, (cast(rank() over (order by p) as double) * 0.25 + cast(rank() over (order by q) as double) * 0.75) / 2 as m from {_ORDERS})""",
    "stack_runs": f"select o_orderkey, cast(case when o_orderkey % 2 = 0 then p end as double) as \"a_PREDICTION\", cast(case when o_orderkey % 3 = 0 then q end as double) as \"b_PREDICTION\" from {_ORDERS}",
    "row_statistics": """select l_orderkey, l_linenumber, round(list_avg(x), 6) as rmean, round(case when len(x) > 1 then list_stddev_samp(x) end, 6) as rstd, round(list_median(x), 6) as rmedian,
round(list_sum(x), 6) as rsum, list_min(x) as rmin, list_max(x) as rmax, cast(4 - len(x) as double) as rnulls
from (select l_orderkey, l_linenumber, list_filter([cast(nullif(l_partkey % 7, 0) as double), nullif(l_suppkey % 5, 1), nullif(l_orderkey % 11, 2), l_linenumber], lambda v: v is not null) as x from lineitem)""",
    "ratios": f"select o_orderkey, round(cast(p as double) / nullif(q, 0), 6) as null_for_zero, round(coalesce(cast(p as double) / nullif(q, 0), 0), 6) as zero_for_zero from {_ORDERS}",
}

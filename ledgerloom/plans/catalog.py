"""Named queries over the driver tables, each with the SQL it must equal.

Every query reads whole tables. Those without SQL are checked by value in the tests.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import clean, dates, finance, shape
from ..operators.aggregate import group_by_aggregate
from ..operators.dedup import drop_duplicates
from ..operators.joins import (
    join_on_common_columns,
    join_report,
    join_tables,
    suggest_join_keys,
)
from ..operators.profile import currency_shares, hit_rates, profile
from ..operators.quality import detect_outliers, outlier_fences, validate_regex, validate_rules
from ..operators.union import consolidate_periods, union_identical
from ..session import work_path
from ..sources import readers, writers
from ..sources.preview import describe, preview, sample_records
from ..streaming import tables as streams
from .audit import log_table
from .recipe import run_recipe
from .suggest import proposals

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Tables:
    """Lazy access to the tables of one folder: ``t.orders``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))


def query(sql: str | None = None):
    def register(build):
        name = build.__name__
        QUERIES[name] = lambda spark, folder: build(Tables(spark, folder))
        if sql:
            SQL[name] = sql
        return build

    return register


def money(name: str, alias: str | None = None):
    """A sum of cents free of the noise that the order of additions leaves in a double."""
    return F.round(F.col(name), 2).alias(alias or name)


# Computed columns


@query(
    """SELECT l_orderkey, l_linenumber,
              round(l_extendedprice - l_quantity - l_tax, 4) AS net_profit FROM lineitem"""
)
def net_profit(t):
    out = finance.net_profit(
        t.lineitem, "l_extendedprice", "l_quantity", "l_tax", dest="net_profit"
    )
    return out.select("l_orderkey", "l_linenumber", F.round("net_profit", 4).alias("net_profit"))


@query(
    """SELECT l_orderkey, l_linenumber,
              round(CASE WHEN l_returnflag = 'R' THEN 0 ELSE l_extendedprice END - l_quantity, 4) AS net_profit FROM lineitem"""
)
def net_profit_of_text(t):
    """Revenue and costs as texts: one that is no number counts as 0."""
    revenue = F.when(F.col("l_returnflag") == "R", "n/a").otherwise(F.col("l_extendedprice").cast("string"))
    lines = t.lineitem.select("l_orderkey", "l_linenumber", revenue.alias("revenue"), F.concat(F.lit(" "), "l_quantity").alias("costs"))
    profit = finance.net_profit(lines, "revenue", "costs", dest="net_profit")
    return profit.select("l_orderkey", "l_linenumber", F.round("net_profit", 4).alias("net_profit"))


@query(
    """SELECT l_orderkey, l_linenumber, round(l_extendedprice - l_quantity, 4) AS gross_profit
       FROM lineitem"""
)
def gross_profit(t):
    out = finance.gross_profit(t.lineitem, "l_extendedprice", "l_quantity", "gross_profit")
    return out.select(
        "l_orderkey", "l_linenumber", F.round("gross_profit", 4).alias("gross_profit")
    )


@query(
    """SELECT l_orderkey, l_linenumber,
              round((l_extendedprice - l_quantity) / l_extendedprice * 100, 4) AS margin_pct
       FROM lineitem"""
)
def add_formula(t):
    out = shape.add_formula(
        t.lineitem,
        "margin_pct",
        "round((`l_extendedprice` - `l_quantity`) / `l_extendedprice` * 100, 4)",
    )
    return out.select("l_orderkey", "l_linenumber", "margin_pct")


@query(
    """SELECT l_orderkey, l_linenumber,
              CASE WHEN l_discount = 0 THEN NULL ELSE round(l_tax / l_discount, 4) END AS ratio
       FROM lineitem"""
)
def add_formula_zero_division(t):
    out = shape.add_formula(t.lineitem, "ratio", "round(l_tax / l_discount, 4)")
    return out.select("l_orderkey", "l_linenumber", "ratio")


@query("""SELECT o_orderkey, o_totalprice > 10000 AS high_value FROM orders""")
def flag_high_value(t):
    out = finance.flag_high_value(t.orders, "o_totalprice", dest="high_value")
    return out.select("o_orderkey", "high_value")


@query(
    """SELECT o_orderkey, greatest(o_orderkey, o_custkey, o_totalprice) > 250000 AS high_value
       FROM orders"""
)
def flag_high_value_any_cell(t):
    out = finance.flag_high_value(t.orders, None, 250000, dest="high_value")
    return out.select("o_orderkey", "high_value")


@query(
    """SELECT l_orderkey, l_linenumber, l_quantity - l_discount * 100 < 0 AS loss FROM lineitem"""
)
def flag_negative_profit(t):
    cost = t.lineitem.withColumn("cost", F.col("l_discount") * 100)
    out = finance.gross_profit(cost, "l_quantity", "cost", "profit")
    out = finance.flag_negative_profit(out, "profit", "loss")
    return out.select("l_orderkey", "l_linenumber", "loss")


@query("""SELECT o_orderkey, dayofweek(o_orderdate) IN (0, 6) AS weekend FROM orders""")
def flag_weekend(t):
    return dates.flag_weekend(t.orders, dest="weekend").select("o_orderkey", "weekend")


# Text


@query(
    """SELECT c_custkey, lower(trim('  ' || c_mktsegment || '  ')) AS seg FROM customer"""
)
def trim_lower(t):
    padded = t.customer.select(
        "c_custkey", F.concat(F.lit(" \t"), "c_mktsegment", F.lit(" \n")).alias("seg")
    )
    return clean.lowercase_text(clean.trim_whitespace(padded), ["seg"])


@query(
    r"""SELECT c_custkey, regexp_replace(c_name, '[^0-9A-Za-z\s.\-_/]', '', 'g') AS c_name
        FROM customer"""
)
def remove_symbols(t):
    return clean.remove_symbols(t.customer, ["c_name"]).select("c_custkey", "c_name")


@query(
    r"""SELECT doc_id,
               regexp_replace(text, '[^0-9A-Za-z\s\v\x1c-\x1f\x{85}\p{Z}.\-_/]', '', 'g') AS text
        FROM documents"""
)
def remove_symbols_documents(t):
    return clean.remove_symbols(t.documents, ["text"]).select("doc_id", "text")


@query(
    """SELECT event_id, CASE WHEN event_type = 'view' THEN 'seen' ELSE event_type END AS event_type
       FROM events"""
)
def replace_exact(t):
    out = clean.replace_values(t.events, ["event_type"], "view", "seen")
    return out.select("event_id", "event_type")


@query(
    """SELECT event_id, CASE WHEN event_type = 'view' THEN 'seen' ELSE event_type END AS event_type
       FROM events"""
)
def replace_exact_ignore_case(t):
    out = clean.replace_values(t.events, ["event_type"], "VIEW", "seen", case_sensitive=False)
    return out.select("event_id", "event_type")


@query(
    """SELECT l_orderkey, l_partkey, CASE WHEN l_linenumber = 7 THEN 0 ELSE l_linenumber END
              AS l_linenumber FROM lineitem"""
)
def replace_number(t):
    out = clean.replace_values(t.lineitem, ["l_linenumber"], 7, 0)
    return out.select("l_orderkey", "l_partkey", "l_linenumber")


@query(
    """SELECT c_custkey, regexp_replace(c_name, 'customer#0+', 'C', 'gi') AS c_name
       FROM customer"""
)
def replace_regex(t):
    out = clean.replace_values(
        t.customer, ["c_name"], "customer#0+", "C", regex=True, case_sensitive=False
    )
    return out.select("c_custkey", "c_name")


@query(
    r"""SELECT c_custkey, regexp_replace(c_name, '(\w+)#(\d+)', '\2 $\1', 'g') AS c_name
        FROM customer"""
)
def replace_regex_groups(t):
    out = clean.replace_values(t.customer, ["c_name"], r"(?P<a>\w+)#(\d+)", r"\2 $\g<a>", True)
    return out.select("c_custkey", "c_name")


@query(
    """SELECT p_partkey, concat_ws('-', p_brand, CASE WHEN p_size > 25 THEN p_type END) AS merged
       FROM part"""
)
def merge_columns(t):
    parts = t.part.withColumn("kind", F.when(F.col("p_size") > 25, F.col("p_type")))
    out = clean.merge_columns(parts, ["p_brand", "kind"], "merged", "-")
    return out.select("p_partkey", "merged")


@query(
    """SELECT o_orderkey, split_part(o_orderpriority, '-', 1) AS prio,
              CASE WHEN o_orderpriority LIKE '%-%' THEN split_part(o_orderpriority, '-', 2) END
              AS label FROM orders"""
)
def split_field(t):
    out = clean.split_field(t.orders, "o_orderpriority", ["prio", "label"], "-")
    return out.select("o_orderkey", "prio", "label")


@query(
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN -o_totalprice ELSE o_totalprice END
              AS amt FROM orders"""
)
def currency_to_float(t):
    amount = F.concat(F.lit("$"), F.format_number("o_totalprice", 2))
    text = F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("("), amount, F.lit(")")))
    shown = t.orders.select("o_orderkey", text.otherwise(amount).alias("amt"))
    return clean.currency_to_float(shown, ["amt"])


# Dates


@query(
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderdate END AS d
       FROM orders"""
)
def standardize_date(t):
    text = F.when(F.col("o_orderstatus") == "P", "n/a").otherwise(
        F.col("o_orderdate").cast("string")
    )
    return dates.standardize_date(t.orders.select("o_orderkey", text.alias("d")), ["d"])


@query("""SELECT o_orderkey, o_orderdate AS d FROM orders""")
def standardize_date_layouts(t):
    day, status = F.col("o_orderdate"), F.col("o_orderstatus")
    text = (
        F.when(status == "P", F.date_format(day, "M/d/yyyy"))
        .when(status == "F", F.date_format(day, "MMM d, yyyy"))
        .otherwise(F.date_format(day, "yyyyMMdd"))
    )
    return dates.standardize_date(t.orders.select("o_orderkey", text.alias("d")), ["d"])


@query("""SELECT o_orderkey, o_orderdate AS d, date_trunc('day', o_orderdate) AS m FROM orders""")
def standardize_date_day_first(t):
    """One column of days before months, one of months before days; each column's texts decide."""
    day = F.col("o_orderdate")
    texts = t.orders.select(
        "o_orderkey", F.date_format(day, "d/M/yyyy H:mm:ss").alias("d"), F.date_format(day, "M-d-yyyy").alias("m")
    )
    return dates.standardize_date(texts, ["d", "m"])


@query(
    """SELECT o_orderkey, date_trunc('day', o_orderdate) AS d FROM orders
       WHERE date_trunc('day', o_orderdate) BETWEEN TIMESTAMP '1996-02-01' AND TIMESTAMP '1996-05-04'"""
)
def filter_date_range_day_first(t):
    text = F.date_format("o_orderdate", "dd-MM-yyyy")
    return dates.filter_date_range(t.orders.select("o_orderkey", text.alias("d")), "d", "1996-02-01", "1996-05-04")


@query(
    """SELECT o_orderkey, o_orderdate FROM orders
       WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate <= TIMESTAMP '1996-12-31'"""
)
def filter_date_range(t):
    out = dates.filter_date_range(t.orders, "o_orderdate", "1996-01-01", "1996-12-31")
    return out.select("o_orderkey", "o_orderdate")


@query("""SELECT o_orderkey, o_orderdate FROM orders""")
def sort_by_date(t):
    return dates.sort_by_date(t.orders.select("o_orderkey", "o_orderdate"), "o_orderdate", "desc")


@query(
    """SELECT o_orderkey, o_orderdate FROM orders
       ORDER BY o_orderdate DESC NULLS LAST, o_orderkey LIMIT 100"""
)
def sort_top(t):
    recipe = [{"type": "sortByDate", "config": {"col": "o_orderdate", "order": "desc"}}]
    orders = t.orders.select("o_orderkey", "o_orderdate")
    return run_recipe(orders, recipe, order_by=["o_orderkey"]).preview(limit=100)


@query("""SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 5 OFFSET 5""")
def preview_page(t):
    return preview(t.orders.select("o_orderkey", "o_totalprice"), 5, 5, order_by=["o_orderkey"])


@query("""SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20""")
def sample_rows(t):
    """The first records of a sorted table, as the driver gets them."""
    orders = t.orders.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return t.spark.createDataFrame(sample_records(orders), orders.schema)


@query("""SELECT count(*) AS n_rows, 5 AS n_columns, 'c_custkey,c_name,c_nationkey,c_acctbal,c_mktsegment' AS names,
                 20 AS sampled FROM customer""")
def describe_table(t):
    """Columns, shape and sample size of a table, as its description states them."""
    found = describe(t.customer)
    row = (found["shape"][0], found["shape"][1], ",".join(found["columns"]), len(found["sample"]))
    return t.spark.createDataFrame([row], "n_rows bigint, n_columns int, names string, sampled int")


# Filters


@query(
    """SELECT o_orderkey, o_totalprice FROM orders
       WHERE o_totalprice > 100000 AND o_orderstatus = 'F'"""
)
def filter_expr(t):
    out = shape.filter_expr(t.orders, "`o_totalprice` > 100000 and `o_orderstatus` == 'F'")
    return out.select("o_orderkey", "o_totalprice")


@query(
    """SELECT event_id, event_type FROM events
       WHERE lower(trim(event_type)) IN ('click', 'purchase')"""
)
def filter_type(t):
    out = shape.filter_types(t.events, "event_type", [" click ", "PURCHASE"])
    return out.select("event_id", "event_type")


BLANKED = """SELECT event_id, CASE WHEN event_type = 'error' THEN '  '
             WHEN event_type = 'view' THEN NULL ELSE event_type END AS t FROM events"""


def _blanked(t):
    kind = F.col("event_type")
    text = F.when(kind == "error", "  ").when(kind != "view", kind)
    return t.events.select("event_id", text.alias("t"))


@query(f"""SELECT event_id FROM ({BLANKED}) WHERE nullif(trim(t), '') IS NOT NULL""")
def delete_blank_rows(t):
    return shape.delete_blank_rows(_blanked(t), ["t"]).select("event_id")


@query(f"""SELECT t FROM ({BLANKED}) WHERE t IS NOT NULL""")
def delete_empty_rows(t):
    return shape.delete_blank_rows(_blanked(t).select("t"))


# Joins


def _joined(t, how):
    customers = t.customer.select(F.col("c_custkey").alias("custkey"), "c_name")
    orders = t.orders.select(F.col("o_custkey").alias("custkey"), "o_orderkey")
    # Some customers without orders, and orders of unknown customers.
    orders = orders.withColumn(
        "custkey", F.when(F.col("custkey") % 7 == 0, -F.col("custkey")).otherwise(F.col("custkey"))
    )
    return join_tables(customers, orders, "custkey", how)


def _join_sql(kind):
    return f"""SELECT coalesce(c.c_custkey, o.k) AS custkey, c.c_name, o.o_orderkey
               FROM customer c {kind} JOIN
               (SELECT CASE WHEN o_custkey % 7 = 0 THEN -o_custkey ELSE o_custkey END AS k,
                       o_orderkey FROM orders) o
               ON c.c_custkey IS NOT DISTINCT FROM o.k"""


@query(_join_sql("LEFT"))
def join_left(t):
    return _joined(t, "left")


@query(_join_sql("INNER"))
def join_inner(t):
    return _joined(t, "inner")


@query(_join_sql("RIGHT"))
def join_right(t):
    return _joined(t, "right")


@query(_join_sql("FULL"))
def join_outer(t):
    return _joined(t, "outer")


@query(
    """SELECT a.k, count(*) AS n
       FROM (SELECT nullif(n_regionkey, 0) AS k FROM nation) a
       JOIN (SELECT nullif(r_regionkey, 0) AS k FROM region) b ON a.k IS NOT DISTINCT FROM b.k
       GROUP BY 1"""
)
def join_null_keys(t):
    a = t.nation.select(F.expr("nullif(n_regionkey, 0)").alias("k"))
    b = t.region.select(F.expr("nullif(r_regionkey, 0)").alias("k"))
    return join_tables(a, b, "k", "inner").groupBy("k").agg(F.count("*").alias("n"))


@query(
    """SELECT c.c_nationkey AS nationkey, c.c_name AS name, n.n_name AS name_s
       FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey"""
)
def join_suffixes(t):
    a = t.customer.select(F.col("c_nationkey").alias("nationkey"), F.col("c_name").alias("name"))
    b = t.nation.select(F.col("n_nationkey").alias("nationkey"), F.col("n_name").alias("name"))
    return join_tables(a, b, "nationkey", "inner", ["", "_s"])


@query(
    """SELECT coalesce(l.k, s.k) AS suppkey, n, s_name, nparts FROM
       (SELECT l_suppkey AS k, count(*) AS n FROM lineitem WHERE l_suppkey % 3 > 0 GROUP BY 1) l
       FULL JOIN (SELECT s_suppkey AS k, s_name FROM supplier) s ON l.k = s.k
       FULL JOIN (SELECT l_suppkey AS k, count(DISTINCT l_partkey) AS nparts FROM lineitem
                  GROUP BY 1) p ON coalesce(l.k, s.k) = p.k"""
)
def join_common_columns(t):
    key = F.col("l_suppkey").alias("suppkey")
    lines = t.lineitem
    a = lines.filter("l_suppkey % 3 > 0").groupBy(key).agg(F.count("*").alias("n"))
    b = t.supplier.select(F.col("s_suppkey").alias("suppkey"), "s_name")
    c = lines.groupBy(key).agg(F.count_distinct("l_partkey").alias("nparts"))
    return join_on_common_columns([a, b, c])


@query(
    """SELECT (SELECT count(*) FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey)
                AS joined_count,
              (SELECT count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders))
                AS left_unmatched,
              (SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer))
                AS right_unmatched"""
)
def join_simulate(t):
    customers = t.customer.withColumnRenamed("c_custkey", "custkey")
    orders = t.orders.withColumnRenamed("o_custkey", "custkey")
    report = join_report(customers, orders, "custkey", "left")
    return report.withColumn("joined_count", F.col("joined_count").cast("bigint"))


@query(
    """WITH a AS (SELECT CAST(c_nationkey AS VARCHAR) v FROM customer),
            b AS (SELECT CAST(s_nationkey AS VARCHAR) v FROM supplier),
            u AS (SELECT (SELECT count(DISTINCT v) * 1.0 / count(*) FROM a) ua,
                         (SELECT count(DISTINCT v) * 1.0 / count(*) FROM b) ub,
                         (SELECT count(*) FROM (SELECT v FROM a INTERSECT SELECT v FROM b)) i,
                         (SELECT count(*) FROM (SELECT v FROM a UNION SELECT v FROM b)) n,
                         (SELECT count(*) FROM (SELECT v FROM a EXCEPT SELECT v FROM b)) lo,
                         (SELECT count(*) FROM (SELECT v FROM b EXCEPT SELECT v FROM a)) ro)
       SELECT 'nationkey' AS col,
              round(0.5 * i / n + 0.25 * least(ua, ub) + 0.25 * (1 - abs(ua - ub)), 4) AS score,
              round(i * 1.0 / n, 4) AS overlap, lo AS left_only, ro AS right_only FROM u"""
)
def join_suggest(t):
    a = t.customer.withColumnRenamed("c_nationkey", "nationkey")
    b = t.supplier.withColumnRenamed("s_nationkey", "nationkey")
    return suggest_join_keys(a, b).select(
        F.col("column").alias("col"), "score", "overlap", "left_only", "right_only"
    )


# Aggregates


@query(
    """SELECT o_orderstatus,
              CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS o_totalprice_sum,
              max(o_totalprice) AS o_totalprice_max,
              count(DISTINCT o_custkey) AS o_custkey_nunique,
              round(median(o_totalprice), 4) AS o_totalprice_median,
              round(stddev_samp(o_totalprice), 4) AS o_totalprice_std
       FROM orders GROUP BY 1"""
)
def group_agg(t):
    aggs = {"o_totalprice": ["sum", "max", "median", "std"], "o_custkey": ["nunique"]}
    out = group_by_aggregate(t.orders, ["o_orderstatus"], aggs)
    return out.select(
        "o_orderstatus",
        money("o_totalprice_sum"),
        "o_totalprice_max",
        "o_custkey_nunique",
        F.round("o_totalprice_median", 4).alias("o_totalprice_median"),
        F.round("o_totalprice_std", 4).alias("o_totalprice_std"),
    )


@query(
    """SELECT l_returnflag, l_linestatus, round(avg(l_quantity), 4) AS l_quantity_mean,
              min(l_quantity) AS l_quantity_min, count(*) AS l_quantity_size,
              round(var_samp(l_extendedprice), 0) AS l_extendedprice_var,
              round(skewness(l_extendedprice), 4) AS l_extendedprice_skew,
              round(stddev_samp(l_tax) / sqrt(count(l_tax)), 6) AS l_tax_sem,
              bool_or(l_tax <> 0) AS l_tax_any, bool_and(l_tax <> 0) AS l_tax_all
       FROM lineitem GROUP BY 1, 2"""
)
def group_statistics(t):
    aggs = {
        "l_quantity": ["mean", "min", "size"],
        "l_extendedprice": ["var", "skew"],
        "l_tax": ["sem", "any", "all"],
    }
    out = group_by_aggregate(t.lineitem, ["l_returnflag", "l_linestatus"], aggs)
    digits = {
        "l_quantity_mean": 4,
        "l_extendedprice_var": 0,
        "l_extendedprice_skew": 4,
        "l_tax_sem": 6,
    }
    return out.withColumns({name: F.round(name, d) for name, d in digits.items()})


@query(
    """SELECT nullif(o_orderstatus, 'P') AS status,
              coalesce(sum(CASE WHEN o_orderstatus <> 'F' THEN o_custkey END), 0)::BIGINT AS total
       FROM orders GROUP BY 1"""
)
def group_null_keys(t):
    status = F.col("o_orderstatus")
    cut = t.orders.select(
        F.nullif(status, F.lit("P")).alias("status"),
        F.when(status != "F", F.col("o_custkey")).alias("total"),
    )
    return group_by_aggregate(cut, ["status"], {"total": "sum"})


@query(
    """SELECT o_custkey, arg_min(o_totalprice, o_orderkey) AS o_totalprice_first,
              arg_max(o_totalprice, o_orderkey) AS o_totalprice_last
       FROM orders GROUP BY 1"""
)
def group_first_last(t):
    aggs = {"o_totalprice": ["first", "last"]}
    return group_by_aggregate(t.orders, ["o_custkey"], aggs, order_by=["o_orderkey"])


@query(
    """SELECT l_suppkey, round(median(l_extendedprice), 4) AS l_extendedprice,
              round(median(l_quantity), 4) AS l_quantity FROM lineitem GROUP BY 1"""
)
def group_median(t):
    aggs = {"l_extendedprice": "median", "l_quantity": "median"}
    out = group_by_aggregate(t.lineitem, ["l_suppkey"], aggs)
    return out.withColumns({name: F.round(name, 4) for name in aggs})


def _pl_sql(unit):
    return f"""SELECT date_trunc('{unit}', l_shipdate)::TIMESTAMP AS period,
               CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue,
               CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS cogs,
               CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2)) - CAST(l_quantity AS DECIMAL(18,2)))
                    AS DOUBLE) AS net_profit
               FROM lineitem GROUP BY 1"""


def _pl(out):
    return out.select(
        F.col("Period").alias("period"),
        money("l_extendedprice", "revenue"),
        money("l_quantity", "cogs"),
        money("Net Profit", "net_profit"),
    )


@query(_pl_sql("month"))
def pl_by_month(t):
    return _pl(finance.pl_by_period(t.lineitem, "l_shipdate", "M", "l_extendedprice", "l_quantity"))


@query(_pl_sql("quarter"))
def pl_by_quarter(t):
    return _pl(finance.pl_by_period(t.lineitem, "l_shipdate", "Q", "l_extendedprice", "l_quantity"))


@query(_pl_sql("week"))
def pl_by_week(t):
    return _pl(finance.pl_by_period(t.lineitem, "l_shipdate", "W", "l_extendedprice", "l_quantity"))


@query(
    """SELECT date_trunc('month', l_shipdate)::TIMESTAMP AS period,
              CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue,
              CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS cogs,
              CAST(sum(CAST(l_tax AS DECIMAL(18,2))) AS DOUBLE) AS expenses FROM lineitem
       GROUP BY 1"""
)
def pl_summary(t):
    lines = t.lineitem.select(
        F.col("l_shipdate").alias("Ship Date"),
        F.col("l_extendedprice").alias("Sales"),
        F.col("l_quantity").alias("Cost"),
        F.col("l_tax").alias("Expenses"),
    )
    return finance.pl_summary(lines).select(
        F.col("Period").alias("period"),
        money("Revenue", "revenue"),
        money("COGS", "cogs"),
        money("Expenses", "expenses"),
    )


# Duplicates and unions


@query(
    """SELECT o_custkey, o_orderkey FROM orders
       QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1"""
)
def dedup_first(t):
    orders = t.orders.select("o_custkey", "o_orderkey")
    return drop_duplicates(orders, ["o_custkey"], "first", order_by=["o_orderkey"])


@query(
    """SELECT o_custkey, o_orderkey FROM orders
       QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1"""
)
def dedup_last(t):
    orders = t.orders.select("o_custkey", "o_orderkey")
    return drop_duplicates(orders, ["o_custkey"], "last", order_by=["o_orderkey"])


@query(
    """SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem
       QUALIFY count(*) OVER (PARTITION BY l_orderkey, l_linenumber) = 1"""
)
def dedup_none(t):
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey")
    return drop_duplicates(lines, ["l_orderkey", "l_linenumber"], keep=False)


@query("""SELECT DISTINCT l_returnflag, l_linestatus, l_tax FROM lineitem""")
def dedup_whole_rows(t):
    return drop_duplicates(t.lineitem.select("l_returnflag", "l_linestatus", "l_tax"))


@query("""SELECT DISTINCT text FROM documents""")
def dedup_documents(t):
    return drop_duplicates(t.documents.select("text"))


@query(
    """SELECT o_orderkey, o_orderdate, date_trunc('month', o_orderdate)::TIMESTAMP AS period,
              CASE WHEN o_orderstatus = 'F' THEN o_totalprice END AS total FROM orders"""
)
def consolidate(t):
    final = t.orders.filter("o_orderstatus = 'F'")
    rest = t.orders.filter("o_orderstatus <> 'F'").select("o_orderdate", "o_orderkey")
    final = final.select("o_orderkey", "o_orderdate", F.col("o_totalprice").alias("total"))
    return consolidate_periods([final, rest], "o_orderdate", period="period")


@query(
    """SELECT c_custkey AS key, c_name AS name FROM customer
       UNION ALL SELECT s_suppkey, s_name FROM supplier"""
)
def union_same_schema(t):
    sheets = {
        "other": t.nation,
        "customers": t.customer.selectExpr("c_custkey AS key", "c_name AS name"),
        "suppliers": t.supplier.selectExpr("s_suppkey AS ` Key`", "s_name AS NAME"),
    }
    return union_identical(sheets, merge_identical=True)


# Quality


@query(
    """SELECT o_orderkey, (o_totalprice < q1 - 0.2 * (q3 - q1))
              OR (o_totalprice > q3 + 0.2 * (q3 - q1)) AS outlier
       FROM orders, (SELECT quantile_cont(o_totalprice, 0.25) q1,
                            quantile_cont(o_totalprice, 0.75) q3 FROM orders)"""
)
def outliers(t):
    out = detect_outliers(t.orders, ["o_totalprice"], 0.2)
    return out.select("o_orderkey", F.col("Outlier_o_totalprice").alias("outlier"))


@query(
    """SELECT name, round(q1 - 1.5 * (q3 - q1), 6) AS low, round(q3 + 1.5 * (q3 - q1), 6) AS high
       FROM (SELECT 'l_extendedprice' AS name, quantile_cont(l_extendedprice, 0.25) q1,
                    quantile_cont(l_extendedprice, 0.75) q3 FROM lineitem
             UNION ALL SELECT 'l_quantity', quantile_cont(l_quantity, 0.25),
                    quantile_cont(l_quantity, 0.75) FROM lineitem)"""
)
def outlier_bounds(t):
    columns = ["l_extendedprice", "l_quantity"]
    names = F.create_map(*[F.lit(x) for i, n in enumerate(columns) for x in (f"n{i}", n)])
    return outlier_fences(t.lineitem, columns).select(
        names[F.col("name")].alias("name"),
        F.round("low", 6).alias("low"),
        F.round("high", 6).alias("high"),
    )


@query(
    """SELECT c_custkey, regexp_full_match(trim(c_name), 'Customer#[0-9]{8}[02468]') AS valid
       FROM customer"""
)
def validate_pattern(t):
    out = validate_regex(t.customer, "c_name", r"Customer#\d{8}[02468]", "valid")
    return out.select("c_custkey", "valid")


@query(
    """SELECT 'c_name' AS col, count(*) FILTER (ok) AS passed, count(*) FILTER (NOT ok) AS failed,
              (SELECT min(c_name) FROM customer
               WHERE NOT regexp_full_match(c_name, 'Customer#[0-9]{8}[02468]')) AS first_failing
       FROM (SELECT regexp_full_match(c_name, 'Customer#[0-9]{8}[02468]') AS ok FROM customer)
       UNION ALL
       SELECT 'c_mktsegment', count(*) FILTER (ok), count(*) FILTER (NOT ok),
              (SELECT min(c_mktsegment) FROM customer
               WHERE NOT regexp_full_match(c_mktsegment, '[A-Za-z0-9]{6,20}'))
       FROM (SELECT regexp_full_match(c_mktsegment, '[A-Za-z0-9]{6,20}') AS ok FROM customer)"""
)
def validate_several_rules(t):
    rules = [
        {"column": "c_name", "pattern": "Customer#[0-9]{8}[02468]"},
        {"column": "c_mktsegment", "preset": "id_generic"},
    ]
    return validate_rules(t.customer, rules).select(
        F.col("column").alias("col"),
        "passed",
        "failed",
        F.get("samples", F.lit(0)).alias("first_failing"),
    )


def _profile_sql():
    columns = {
        "o_orderkey": "number",
        "o_custkey": "number",
        "o_orderstatus": "text",
        "o_totalprice": "number",
        "o_orderdate": "date",
        "o_orderpriority": "text",
    }
    parts = []
    for name, kind in columns.items():
        number = (
            f"min({name})::DOUBLE, max({name})::DOUBLE, round(skewness({name}), 4)"
            if kind == "number"
            else "NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE"
        )
        day = (
            f"min({name}), max({name})" if kind == "date" else "NULL::TIMESTAMP, NULL::TIMESTAMP"
        )
        parts.append(
            f"""SELECT '{name}' AS col, count(*) - count({name}) AS nulls,
                count(DISTINCT {name}) AS uniques, {number}, {day} FROM orders"""
        )
    return (
        "SELECT * FROM ("
        + " UNION ALL ".join(parts)
        + ") AS p(col, nulls, uniques, vmin, vmax, skew, first_date, last_date)"
    )


@query(_profile_sql())
def profile_stats(t):
    return profile(t.orders).select(
        F.col("column").alias("col"),
        "nulls",
        "uniques",
        F.col("min").alias("vmin"),
        F.col("max").alias("vmax"),
        F.round("skew", 4).alias("skew"),
        "first_date",
        "last_date",
    )


@query(
    " UNION ALL ".join(
        f"""(SELECT '{name}' AS col, {name} AS value, count(*) AS n FROM customer
             GROUP BY 2 ORDER BY n DESC, value LIMIT 5)"""
        for name in ("c_name", "c_mktsegment")
    )
)
def profile_top(t):
    return (
        profile(t.customer.select("c_name", "c_mktsegment"))
        .select(F.col("column").alias("col"), F.inline("top"))
        .withColumnRenamed("count", "n")
    )


@query(
    """SELECT * FROM (
         SELECT 'text' AS "column", text AS value, count(*) AS n FROM documents GROUP BY text ORDER BY n DESC, value LIMIT 5)
       UNION ALL SELECT * FROM (
         SELECT 'first', text[1:100], count(*) FROM documents GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 5)
       UNION ALL SELECT * FROM (
         SELECT 'source', source, count(*) FROM documents GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 5)"""
)
def profile_top_documents(t):
    """The most frequent values of long texts, most of which occur as often as others."""
    table = t.documents.select("text", F.substring("text", 1, 100).alias("first"), "source")
    found = profile(table).select("column", F.inline("top"))
    return found.select("column", "value", F.col("count").alias("n"))


@query(
    """SELECT 'text' AS col, count(DISTINCT text) AS uniques,
              (SELECT max(n) FROM (SELECT count(*) AS n FROM documents GROUP BY text)) AS top_n,
              round(avg(CASE WHEN regexp_matches(text, '[$₹€£]|^\\(?-?\\d{1,3}(?:[ ,]\\d{3})+(?:\\.\\d+)?\\)?$')
                        THEN 1.0 ELSE 0.0 END), 4) AS currency_rate
       FROM documents"""
)
def profile_documents(t):
    return profile(t.documents.select("text")).select(
        F.col("column").alias("col"),
        "uniques",
        F.col("top")[0]["count"].alias("top_n"),
        F.round("currency_rate", 4).alias("currency_rate"),
    )


@query(
    r"""SELECT 'o_orderpriority' AS col,
               round(avg(CASE WHEN regexp_matches(o_orderpriority, '^[A-Za-z0-9\-]{6,20}$')
                         THEN 1.0 ELSE 0.0 END), 4) AS id_rate, 0.0::DOUBLE AS currency_rate
        FROM orders"""
)
def pattern_hit_rates(t):
    return hit_rates(t.orders, ["o_orderpriority"]).select(
        F.col("column").alias("col"),
        F.round("id_rate", 4).alias("id_rate"),
        F.round("currency_rate", 4).alias("currency_rate"),
    )


@query(
    """SELECT 'text' AS col, round(greatest(avg(contains(text, '$')::INT), avg(contains(text, '€')::INT),
              avg(contains(text, '£')::INT), avg(contains(text, '₹')::INT)), 4) AS share
       FROM documents WHERE text IS NOT NULL"""
)
def currency_symbol_shares(t):
    return currency_shares(t.documents.select("text")).select(
        F.col("column").alias("col"), F.round("share", 4).alias("share")
    )


# Documents, pages and conversations


@query("""SELECT doc_id, lower(text) AS text FROM documents""")
def lowercase_documents(t):
    return clean.lowercase_text(t.documents, ["text"]).select("doc_id", "text")


@query(
    """SELECT page_id, regexp_extract(url, '^([^/]*)/+([^/]*)/*(.*)$', 1) AS scheme,
              regexp_extract(url, '^([^/]*)/+([^/]*)/*(.*)$', 2) AS host,
              CASE WHEN regexp_matches(url, '^[^/]*/+[^/]*/') THEN
                   trim(regexp_extract(url, '^([^/]*)/+([^/]*)/*(.*)$', 3)) END AS rest
       FROM pages"""
)
def split_urls(t):
    out = clean.split_field(t.pages, "url", ["scheme", "host", "rest"], "/+", maxsplit=2)
    return out.select("page_id", "scheme", "host", "rest")


@query(
    """SELECT 'url' AS col, count(*) FILTER (ok) AS passed, count(*) FILTER (NOT ok) AS failed
       FROM (SELECT regexp_full_match(url, 'https://[a-z0-9.]+/[a-z]{2}/[0-9]+(\\?.*)?') AS ok
             FROM pages)"""
)
def validate_urls(t):
    rules = [{"column": "url", "pattern": r"https://[a-z0-9.]+/[a-z]{2}/[0-9]+(\?.*)?"}]
    return validate_rules(t.pages, rules).select(F.col("column").alias("col"), "passed", "failed")


@query(
    """SELECT conv_id, arg_min(text, turn) AS text_first, arg_max(text, turn) AS text_last,
              count(*) AS turn_size FROM conversations GROUP BY 1"""
)
def conversation_ends(t):
    aggs = {"text": ["first", "last"], "turn": ["size"]}
    return group_by_aggregate(t.conversations, ["conv_id"], aggs, order_by=["turn"])


@query("""SELECT conv_id, turn, role || ': ' || text AS line FROM conversations""")
def merge_conversation_lines(t):
    out = clean.merge_columns(t.conversations, ["role", "text"], "line", ": ")
    return out.select("conv_id", "turn", "line")


@query(
    """SELECT lang, quality, count(*) AS doc_id_size, sum(n_chars)::BIGINT AS n_chars_sum,
              max(n_chars) AS n_chars_max
       FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1, 2"""
)
def labelled_documents(t):
    recipe = [
        {"type": "joinWithFile", "config": {"key": "doc_id"}},
        {
            "type": "groupByAggregate",
            "config": {
                "by": ["lang", "quality"],
                "aggs": {"doc_id": ["size"], "n_chars": ["sum", "max"]},
            },
        },
    ]
    return run_recipe(t.documents, recipe, join_table=t.labels).df


# Recipes


FLAGSHIP = [
    {"type": "standardizeDate", "config": {"col": "l_shipdate"}},
    {"type": "filterDateRange", "config": {"col": "l_shipdate", "from": "1996-01-01"}},
    {
        "type": "calculateNetProfit",
        "config": {
            "revenue_col": "l_extendedprice",
            "cogs_col": "l_quantity",
            "output_col": "net_profit",
        },
    },
    {
        "type": "groupByAggregate",
        "config": {"by": ["l_returnflag"], "aggs": {"net_profit": ["size", "mean"]}},
    },
]


@query(
    """SELECT l_returnflag, count(*) AS n,
              round(avg(l_extendedprice - l_quantity), 4) AS net_profit_mean
       FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01' GROUP BY 1"""
)
def recipe_flagship(t):
    return run_recipe(t.lineitem, FLAGSHIP).df.select(
        "l_returnflag",
        F.col("net_profit_size").alias("n"),
        F.round("net_profit_mean", 4).alias("net_profit_mean"),
    )


@query(
    """SELECT o_custkey, o_orderkey, o_orderdate, n_name, CASE WHEN o_orderstatus = 'F'
              THEN 'final' ELSE lower(o_orderstatus) END AS "Type"
       FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
       WHERE o_orderstatus IN ('F', 'O')
       QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) = 1"""
)
def recipe_latest_order(t):
    """Newest order per customer: the sort only decides which copy the dedup step keeps."""
    nation = t.nation.withColumnRenamed("n_nationkey", "c_nationkey")
    customer = join_tables(t.customer, nation, "c_nationkey").withColumnRenamed(
        "c_custkey", "o_custkey"
    )
    recipe = [
        {"type": "sortByDate", "config": {"col": "o_orderdate", "order": "desc"}},
        {"type": "filterDebitCredit", "config": {"col": "o_orderstatus", "include": ["f", "o"]}},
        {"type": "dropDuplicates", "config": {"subset": ["o_custkey"], "keep": "first"}},
        {"type": "lowercaseText", "config": {"columns": ["Type"]}},
        {"type": "replaceValues", "config": {"columns": ["Type"], "to": "f", "value": "final"}},
        {"type": "joinWithFile", "config": {"key": "o_custkey"}},
    ]
    out = run_recipe(t.orders, recipe, join_table=customer, order_by=["o_orderkey"]).df
    return out.select("o_custkey", "o_orderkey", "o_orderdate", "n_name", "Type")


@query(
    """SELECT event_id, upper(event_type) AS kind FROM events WHERE value > 5"""
)
def recipe_skips_bad_steps(t):
    recipe = [
        {"type": "noSuchStep"},
        {"type": "lowercaseText", "config": {"columns": ["no such column"]}},
        {"type": "filterExpr", "config": {"expr": "value >"}},
        {"type": "filterExpr", "config": {"expr": "`value` > 5"}},
        {"type": "addColumnFormula", "config": {"dest": "kind", "expr": "upper(event_type)"}},
    ]
    return run_recipe(t.events, recipe).df.select("event_id", "kind")


@query(
    """SELECT 0 AS index, 'filterExpr' AS type, (SELECT count(*) FROM orders) AS rows_before,
              (SELECT count(*) FROM orders WHERE o_totalprice > 100000) AS rows_after,
              false AS failed
       UNION ALL
       SELECT 1, 'dropDuplicates', (SELECT count(*) FROM orders WHERE o_totalprice > 100000),
              (SELECT count(DISTINCT o_custkey) FROM orders WHERE o_totalprice > 100000), false
       UNION ALL SELECT 2, 'mergeColumns', NULL, NULL, true"""
)
def recipe_audit_log(t):
    recipe = [
        {"type": "filterExpr", "config": {"expr": "o_totalprice > 100000"}},
        {"type": "dropDuplicates", "config": {"subset": ["o_custkey"]}},
        {"type": "mergeColumns", "config": {"cols": ["missing"]}},
    ]
    result = run_recipe(t.orders, recipe, order_by=["o_orderkey"], audit="count")
    return log_table(t.spark, result.log).select(
        "index", "type", "rows_before", "rows_after", F.isnotnull("error").alias("failed")
    )


@query(
    r"""WITH s AS (SELECT 'ORD-' || lpad(l_orderkey::VARCHAR, 7, '0') AS o, '$' || format('{:,.2f}', l_extendedprice) AS r
                   FROM lineitem),
             q AS (SELECT round(avg(CASE WHEN regexp_matches(o, '^[A-Za-z0-9\-]{6,20}$') THEN 1.0 ELSE 0.0 END), 2) AS ids,
                          round(avg(CASE WHEN contains(r, '$') THEN 1.0 ELSE 0.0 END), 2) AS money FROM s)
        SELECT 'calculateNetProfit' AS type, '{}' AS config, money AS confidence FROM q WHERE money > 0.5
        UNION ALL SELECT 'standardizeDate', '{"col":"Ship Date"}', 0.95
        UNION ALL SELECT 'sortByDate', '{"col":"Ship Date"}', 0.8
        UNION ALL SELECT 'validateRegex', '{"column":"Order ID","pattern":"^[A-Za-z0-9\\\\-]{6,20}$"}', ids FROM q WHERE ids > 0.6
        UNION ALL SELECT 'currencyToFloat', '{"columns":["Revenue","Discount","Tax"]}', 0.9
        UNION ALL SELECT 'addColumnFormula', '{"dest":"Net Sales","expr":"`Revenue` - `Discount`"}', 0.85
        UNION ALL SELECT 'aggregatePLByPeriod',
          '{"date_col":"Ship Date","freq":"M","revenue_col":"Revenue","cogs_col":null,"expenses_col":null}', 0.9
        UNION ALL SELECT 'detectOutliers', '{"columns":["Quantity"],"k":1.5}', 0.7
        UNION ALL SELECT 'dropDuplicates', '{"subset":["Order ID"],"keep":"first"}', 0.8"""
)
def proposed_recipe(t):
    """Steps proposed from the pattern rates and names of order lines as sales data."""
    return proposals(_as_sales(t)).select("type", "config", "confidence")


def _as_sales(t):
    return t.lineitem.select(
        F.format_string("ORD-%07d", F.col("l_orderkey")).alias("Order ID"),
        F.col("l_shipdate").alias("Ship Date"),
        F.col("l_quantity").alias("Quantity"),
        F.concat(F.lit("$"), F.format_number("l_extendedprice", 2)).alias("Revenue"),
        F.col("l_discount").alias("Discount"),
        F.col("l_tax").alias("Tax"),
    )


# Files and streams


@query("""SELECT * FROM orders""")
def csv_round_trip(t):
    path = work_path(t.spark, "orders-csv")
    writers.write_csv(t.orders, path)
    return readers.read_csv(t.spark, path).select(
        *[F.col(f.name).cast(f.dataType) for f in t.orders.schema.fields]
    )


@query("""SELECT doc_id, text || chr(10) || '"' || lang || '"' AS text FROM documents""")
def csv_round_trip_documents(t):
    """Whole texts with line breaks and quotes."""
    path = work_path(t.spark, "documents-csv")
    text = F.concat("text", F.lit('\n"'), "lang", F.lit('"')).alias("text")
    docs = t.documents.select("doc_id", text)
    writers.write_csv(docs, path)
    return readers.read_csv(t.spark, path, schema=docs.schema)


@query("""SELECT event_id, ts, user_id, event_type, value, props FROM events""")
def json_round_trip(t):
    path = work_path(t.spark, "events-json")
    writers.write_json(t.events, path)
    return readers.read_json(t.spark, path).select(
        *[F.col(f.name).cast(f.dataType) for f in t.events.schema.fields]
    )


@query("""SELECT c_custkey, c_name, c_acctbal, CASE WHEN c_nationkey > 4 THEN c_nationkey END AS c_nationkey FROM customer""")
def json_columns(t):
    """Files of at most a thousand customers each, written as objects of columns and read back."""
    path, at = work_path(t.spark, "customer-columns"), F.col("c_custkey").cast("string")
    names = ("c_custkey", "c_name", "c_acctbal", "c_nationkey")
    cells = t.customer.withColumn("c_nationkey", F.when(F.col("c_nationkey") > 4, F.col("c_nationkey")))
    columns = [F.map_from_entries(F.collect_list(F.struct(at, n))).alias(n) for n in names]
    objects = cells.groupBy(F.floor(F.col("c_custkey") / 1000).alias("part")).agg(*columns)
    text = F.to_json(F.struct(*names), {"ignoreNullFields": "false"}).alias("value")
    objects.select("part", text).write.partitionBy("part").text(path)
    rows = readers.read_json(t.spark, path, layout="columns")
    return rows.withColumn("c_nationkey", F.col("c_nationkey").cast("int"))


@query("""SELECT o_orderstatus, o_orderkey FROM orders
          QUALIFY row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) = 1""")
def parquet_file_order(t):
    """First row per status in file order, from the scan's own row numbers."""
    orders = readers.read_parquet(t.spark, t.path("orders"), ordinal=True)
    return drop_duplicates(orders, ["o_orderstatus"]).select("o_orderstatus", "o_orderkey")


@query(
    """SELECT date_trunc('month', l_shipdate)::TIMESTAMP AS period,
              CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue
       FROM lineitem GROUP BY 1"""
)
def export_summary(t):
    return _exported_summary(t, "parquet")


@query(SQL["export_summary"])
def export_summary_csv(t):
    """The same from an export as CSV, of rows with a text that holds a line break."""
    return _exported_summary(t, "csv")


def _exported_summary(t, kind):
    lines = t.lineitem.selectExpr(
        "l_shipdate AS Date", "l_extendedprice AS Revenue", "l_quantity AS COGS",
        "concat(l_returnflag, '\\n', l_linestatus) AS Note",
    )
    recipe = [{"type": "calculateNetProfit"}]
    result = run_recipe(lines, recipe)
    paths = writers.export_bundle(result.df, work_path(t.spark, "export"), result.log, kind)
    summary = readers.read_table(t.spark, paths["pl_summary"], kind=kind)
    period = F.col("Period").cast("timestamp_ntz").alias("period")
    return summary.select(period, money("Revenue", "revenue"))


@query(_pl_sql("month"))
def stream_pl_by_month(t):
    stream = streams.read_stream(
        t.spark, t.folder, "parquet", t.lineitem.schema, pathGlobFilter="lineitem.parquet"
    )
    running = streams.stream_pl_by_period(stream, "l_shipdate", "M", "l_extendedprice", "l_quantity")
    path = work_path(t.spark, "stream-pl")
    streams.upsert_stream(running, path).awaitTermination()
    return _pl(t.spark.read.parquet(path))


@query(
    """SELECT event_id, lower(event_type) AS event_type, value * 2 AS doubled FROM events
       WHERE value > 1"""
)
def stream_recipe(t):
    stream = streams.read_stream(
        t.spark, t.folder, "parquet", t.events.schema, pathGlobFilter="events.parquet"
    )
    recipe = [
        {"type": "trimWhitespace"},
        {"type": "lowercaseText", "config": {"columns": ["event_type"]}},
        {"type": "filterExpr", "config": {"expr": "value > 1"}},
        {"type": "addColumnFormula", "config": {"dest": "doubled", "expr": "value * 2"}},
    ]
    path = work_path(t.spark, "stream-events")
    streams.write_stream(streams.stream_recipe(stream, recipe), path).awaitTermination()
    return t.spark.read.parquet(path).select("event_id", "event_type", "doubled")

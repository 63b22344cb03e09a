"""Stand-ins for the three churn tables, derived from the TPC-H-style test tables.

The churn CSVs are not available, so the test harness derives tables of the
same shape (and, where it makes sense, the same column names) from
``customer``, ``orders`` and ``lineitem``.  Every stand-in is written twice:
once as DataFrame code (what the library runs) and once as DuckDB SQL (what
the oracle runs); both must describe the same rows.

Stand-in mapping (fixed values, shared by both engines):

* churn flag: 1 when a customer's last order is before 2001-01-01, else 0.
* contract dates: first / last order date; ``date_modif_prod`` = last order
  with status 'P'; ``date_renewal`` = first order with priority '1-URGENT'
  (both NULL when no such order exists - natural missing values).
* customer measures: ``cons_12m`` = account balance (has negatives),
  ``imp_cons`` / ``margin_net_pow_ele`` / ``net_margin`` = mean / max / sum
  of order totals, ``cons_last_month`` = order total since 2000-01-01 (NULL
  when none), ``nb_prod_act`` = number of orders.
* categories: ``channel_sales`` = market segment, NULL for negative balance;
  ``activity_new`` = 'nation_<key>', NULL for balance above 9000;
  ``has_gas`` = 't' when more 'F' than 'O' orders, else 'f';
  ``campaign_disc_ele`` = all NULL.
* price history: one row per line item, ``id`` = ordering customer,
  ``price_date`` = ship date as 'yyyy-MM-dd' text, six measures built from
  price / discount / tax / quantity with NULLs on line 3 (p2_var) and
  line 4 (p2_fix) and negatives in p1_fix (tax - 0.02).
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from churnlab.session import materialize

CHURN_CUTOFF = "2001-01-01"
RECENT_FROM = "2000-01-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def _ts(s: str) -> Column:
    return F.lit(s).cast("timestamp_ntz")


def _day(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd")


def contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per ordering customer: churn flag, contract dates, order measures."""
    o = table(spark, sf_dir, "orders")
    d, st, tot = F.col("o_orderdate"), F.col("o_orderstatus"), F.col("o_totalprice")
    return o.groupBy(F.col("o_custkey").alias("id")).agg(
        F.when(F.max(d) < _ts(CHURN_CUTOFF), 1).otherwise(0).alias("churn"),
        _day(F.min(d)).alias("date_activ"),
        _day(F.max(d)).alias("date_end"),
        _day(F.max(F.when(st == "P", d))).alias("date_modif_prod"),
        _day(F.min(F.when(F.col("o_orderpriority") == "1-URGENT", d))).alias("date_renewal"),
        F.count(F.lit(1)).cast("int").alias("nb_prod_act"),
        F.sum(F.when(d >= _ts(RECENT_FROM), tot)).alias("cons_last_month"),
        F.avg(tot).alias("imp_cons"),
        F.max(tot).alias("margin_net_pow_ele"),
        F.sum(tot).alias("net_margin"),
        F.when(F.count_if(st == "F") > F.count_if(st == "O"), "t").otherwise("f").alias("has_gas"),
    )


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer table stand-in (customer_data analog); every customer, dates may be NULL."""
    c = table(spark, sf_dir, "customer")
    k = contract(spark, sf_dir).drop("churn")
    bal = F.col("c_acctbal")
    base = c.select(
        F.col("c_custkey").alias("id"),
        F.when(bal < 0, F.lit(None).cast("string")).otherwise(F.col("c_mktsegment")).alias("channel_sales"),
        F.when(bal > 9000, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("nation_"), F.col("c_nationkey").cast("string"))).alias("activity_new"),
        F.lit(None).cast("string").alias("campaign_disc_ele"),
        bal.alias("cons_12m"),
    )
    return base.join(k, "id", "left")


def churn_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Churn table stand-in: (id, churn)."""
    return contract(spark, sf_dir).select("id", "churn")


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price-history stand-in: one row per line item, keyed by the ordering customer."""
    li = table(spark, sf_dir, "lineitem")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    ln = F.col("l_linenumber")
    j = li.join(o, li.l_orderkey == o.o_orderkey)
    return j.select(
        F.col("o_custkey").alias("id"),
        _day(F.col("l_shipdate")).alias("price_date"),
        F.col("l_extendedprice").alias("price_p1_var"),
        F.when(ln == 3, F.lit(None).cast("double")).otherwise(F.col("l_discount")).alias("price_p2_var"),
        F.col("l_quantity").alias("price_p3_var"),
        (F.col("l_tax") - F.lit(0.02)).alias("price_p1_fix"),
        F.when(ln == 4, F.lit(None).cast("double")).otherwise(F.col("l_tax")).alias("price_p2_fix"),
        F.col("l_discount").alias("price_p3_fix"),
    )


def stored_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The price history stored, for operators that read it several times (medians, quartiles): joined once."""
    return materialize(prices(spark, sf_dir), "prices")


# --- The same stand-ins in DuckDB SQL (CTE bodies) -----------------------

SQL_CONTRACT = f"""
SELECT o_custkey AS id,
       CASE WHEN max(o_orderdate) < TIMESTAMP '{CHURN_CUTOFF}' THEN 1 ELSE 0 END AS churn,
       strftime(min(o_orderdate), '%Y-%m-%d') AS date_activ,
       strftime(max(o_orderdate), '%Y-%m-%d') AS date_end,
       strftime(max(CASE WHEN o_orderstatus = 'P' THEN o_orderdate END), '%Y-%m-%d') AS date_modif_prod,
       strftime(min(CASE WHEN o_orderpriority = '1-URGENT' THEN o_orderdate END), '%Y-%m-%d') AS date_renewal,
       CAST(count(*) AS INTEGER) AS nb_prod_act,
       sum(CASE WHEN o_orderdate >= TIMESTAMP '{RECENT_FROM}' THEN o_totalprice END) AS cons_last_month,
       avg(o_totalprice) AS imp_cons,
       max(o_totalprice) AS margin_net_pow_ele,
       sum(o_totalprice) AS net_margin,
       CASE WHEN count(*) FILTER (WHERE o_orderstatus = 'F') > count(*) FILTER (WHERE o_orderstatus = 'O')
            THEN 't' ELSE 'f' END AS has_gas
FROM orders GROUP BY o_custkey
"""

SQL_CUSTOMERS = """
SELECT c.c_custkey AS id,
       CASE WHEN c.c_acctbal < 0 THEN NULL ELSE c.c_mktsegment END AS channel_sales,
       CASE WHEN c.c_acctbal > 9000 THEN NULL ELSE 'nation_' || CAST(c.c_nationkey AS VARCHAR) END AS activity_new,
       CAST(NULL AS VARCHAR) AS campaign_disc_ele,
       c.c_acctbal AS cons_12m,
       k.date_activ, k.date_end, k.date_modif_prod, k.date_renewal, k.nb_prod_act,
       k.cons_last_month, k.imp_cons, k.margin_net_pow_ele, k.net_margin, k.has_gas
FROM customer c LEFT JOIN contract k ON c.c_custkey = k.id
"""

SQL_CHURN = "SELECT id, churn FROM contract"

SQL_PRICES = """
SELECT o.o_custkey AS id,
       strftime(l.l_shipdate, '%Y-%m-%d') AS price_date,
       l.l_extendedprice AS price_p1_var,
       CASE WHEN l.l_linenumber = 3 THEN NULL ELSE l.l_discount END AS price_p2_var,
       l.l_quantity AS price_p3_var,
       l.l_tax - 0.02 AS price_p1_fix,
       CASE WHEN l.l_linenumber = 4 THEN NULL ELSE l.l_tax END AS price_p2_fix,
       l.l_discount AS price_p3_fix
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
"""

SQL_CUST_CHURN = "SELECT c.*, f.churn FROM customers c JOIN churn f ON c.id = f.id"

SQL_SCORED = """
SELECT o_orderkey AS id, label, CAST(40 * label + (o_orderkey * 37) % 101 AS DOUBLE) / CAST(141 AS DOUBLE) AS score,
       CASE WHEN CAST(40 * label + (o_orderkey * 37) % 101 AS DOUBLE) / CAST(141 AS DOUBLE) >= 0.5 THEN 1 ELSE 0 END
       AS prediction
FROM (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS label FROM orders)
"""

_CTES = {
    "contract": (SQL_CONTRACT, ()),
    "customers": (SQL_CUSTOMERS, ("contract",)),
    "churn": (SQL_CHURN, ("contract",)),
    "cust_churn": (SQL_CUST_CHURN, ("customers", "churn")),
    "prices": (SQL_PRICES, ()),
    "scored": (SQL_SCORED, ()),
}


def with_ctes(sql: str, *names: str) -> str:
    """Prefix ``sql`` with the stand-in CTEs it names (dependencies included)."""
    order: list[str] = []

    def visit(n: str) -> None:
        for dep in _CTES[n][1]:
            visit(dep)
        if n not in order:
            order.append(n)

    for n in names:
        visit(n)
    if not order:
        return sql
    body = ",\n".join(f"{n} AS ({_CTES[n][0]})" for n in order)
    head = sql.lstrip()
    if head[:5].upper() == "WITH ":
        return f"WITH {body},\n{head[5:]}"
    return f"WITH {body}\n{sql}"


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classifier-output stand-in for the metric operators: (id, label, score, prediction).

    label = order status 'F'; score = (40 * label + pmod(37 * orderkey, 101)) / 141,
    an informative but imperfect score with many ties; prediction = score >= 0.5.
    """
    o = table(spark, sf_dir, "orders")
    label = F.when(F.col("o_orderstatus") == "F", 1).otherwise(0)
    base = o.select(F.col("o_orderkey").alias("id"), label.alias("label"))
    score = (F.lit(40) * F.col("label") + F.pmod(F.col("id") * 37, F.lit(101))).cast("double") / F.lit(141.0)
    return base.withColumn("score", score).withColumn("prediction", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def cust_churn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers joined to their churn flag (JO1 on the stand-ins)."""
    from churnlab.operators.joins import join_churn
    return join_churn(customers(spark, sf_dir), churn_flags(spark, sf_dir))

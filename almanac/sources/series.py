"""Time series derived from the benchmark tables (FIXTURES.md §2).

Each builder reads the whole table and lets Spark derive the series, so the work grows
with the table. The SQL text of the same derivation lives next to it for the DuckDB
oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from almanac.plans.ordered import join_on_keys


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# monthly global series from orders
def monthly_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return (o.groupBy(F.trunc(F.to_date("o_orderdate"), "month").alias("month"))
            .agg(F.sum("o_totalprice").alias("revenue"), F.count(F.lit(1)).alias("n"),
                 F.avg("o_totalprice").alias("avg_price")))


MONTHLY_ORDERS_SQL = """
SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month,
       SUM(o_totalprice) AS revenue, COUNT(*) AS n, AVG(o_totalprice) AS avg_price
FROM orders GROUP BY 1
"""


# monthly panel by order priority
def monthly_orders_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return (o.groupBy("o_orderpriority", F.trunc(F.to_date("o_orderdate"), "month").alias("month"))
            .agg(F.sum("o_totalprice").alias("revenue"), F.count(F.lit(1)).alias("n"),
                 F.avg("o_totalprice").alias("avg_price")))


MONTHLY_PANEL_SQL = """
SELECT o_orderpriority, CAST(date_trunc('month', o_orderdate) AS DATE) AS month,
       SUM(o_totalprice) AS revenue, COUNT(*) AS n, AVG(o_totalprice) AS avg_price
FROM orders GROUP BY 1, 2
"""


# quarterly and annual shipments
def shipments(spark: SparkSession, sf_dir: str, unit: str = "quarter") -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return (li.groupBy(F.trunc(F.to_date("l_shipdate"), unit).alias("d"))
            .agg(F.sum("l_quantity").alias("qty"), F.sum("l_extendedprice").alias("price")))


def shipments_sql(unit: str = "quarter") -> str:
    return f"""
SELECT CAST(date_trunc('{unit}', l_shipdate) AS DATE) AS d,
       SUM(l_quantity) AS qty, SUM(l_extendedprice) AS price
FROM lineitem GROUP BY 1
"""


# one column per priority, first k months of column k missing
PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


def staggered(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = monthly_orders_panel(spark, sf_dir)
    wide = p.groupBy("month").agg(*[
        F.max(F.when(F.col("o_orderpriority") == name, F.col("revenue"))).alias(f"p{k}")
        for k, name in enumerate(PRIORITIES, start=1)])
    # months since the first month of the data: one-row aggregate joined on a constant
    first = wide.agg(F.min("month").alias("__m0"))
    based = join_on_keys(wide, first, [], "inner")
    mi = F.months_between(F.col("month"), F.col("__m0")).cast("int")
    return based.select("month", *[F.when(mi >= k, F.col(f"p{k}")).alias(f"p{k}") for k in range(1, 6)])


STAGGERED_SQL = """
WITH p AS (""" + MONTHLY_PANEL_SQL + """),
w AS (
  SELECT month,
    MAX(CASE WHEN o_orderpriority = '1-URGENT' THEN revenue END) AS p1,
    MAX(CASE WHEN o_orderpriority = '2-HIGH' THEN revenue END) AS p2,
    MAX(CASE WHEN o_orderpriority = '3-MEDIUM' THEN revenue END) AS p3,
    MAX(CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN revenue END) AS p4,
    MAX(CASE WHEN o_orderpriority = '5-LOW' THEN revenue END) AS p5
  FROM p GROUP BY month),
m AS (SELECT MIN(month) AS m0 FROM w),
x AS (SELECT w.*, CAST(datediff('month', m.m0, w.month) AS INTEGER) AS mi FROM w, m)
SELECT month,
  CASE WHEN mi >= 1 THEN p1 END AS p1, CASE WHEN mi >= 2 THEN p2 END AS p2,
  CASE WHEN mi >= 3 THEN p3 END AS p3, CASE WHEN mi >= 4 THEN p4 END AS p4,
  CASE WHEN mi >= 5 THEN p5 END AS p5
FROM x
"""


# events with injected gaps
def events_with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", "ts", "user_id", "event_type",
                    F.when(F.col("event_id") % 7 == 0, F.lit(None)).otherwise(F.col("value")).alias("value"))


EVENTS_GAPS_SQL = """
SELECT event_id, ts, user_id, event_type,
       CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value
FROM events
"""


# wide numeric rows with planted columns
def lineitem_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    net = F.col("l_extendedprice") * (F.lit(1.0) - F.col("l_discount"))
    return li.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.to_date("l_shipdate").alias("ship_date"),
        "l_shipdate", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
        (F.col("l_quantity") * 2 + 1).alias("dup"), net.alias("net"), F.lit(1.0).alias("const"),
        (net * (F.lit(1.0) + F.col("l_tax"))).alias("target"),
    )


LINEITEM_WIDE_SQL = """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_shipdate AS DATE) AS ship_date, l_shipdate,
       l_quantity, l_extendedprice, l_discount, l_tax,
       l_quantity * 2 + 1 AS dup, l_extendedprice * (1.0 - l_discount) AS net, 1.0::DOUBLE AS const,
       l_extendedprice * (1.0 - l_discount) * (1.0 + l_tax) AS target
FROM lineitem
"""


# balances with negatives
def balances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment", "c_acctbal")

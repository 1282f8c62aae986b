"""Views of the given tables in the shape the operators expect.

Customers are the population. Orders are survey answers: each order is a
respondent with the traits of its customer, so customers with many orders are
over-represented, which is what weighting corrects. Events are polls: an event
is one poll of a source (user) on a party (event type).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import band

AGE_BREAKS = (0, 2500, 5000, 7500)
AGE_LABELS = ("18-25", "26-35", "36-45", "46-60", "60+")
PAST_LEVELS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
INTENT_LEVELS = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
PARTIES = ("click", "error", "purchase", "signup", "view")
STRATA = ("gender", "agegroup", "past")


# Column types are given, so that reading a table starts no job of its own.
TABLES = {
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
    "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE, "
    "l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, l_linestatus STRING, "
    "l_shipdate TIMESTAMP_NTZ",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
    "documents": "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT",
    "pages": "page_id BIGINT, url STRING, html STRING",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{folder}/{name}.parquet")


def people(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").select(
        F.col("c_custkey").alias("person"),
        F.col("c_nationkey").alias("nation"),
        F.expr("IF(c_nationkey < 13, 'Female', 'Male')").alias("gender"),
        band(F.col("c_acctbal"), AGE_BREAKS, AGE_LABELS).alias("agegroup"),
        F.col("c_acctbal").alias("balance"),
        F.col("c_mktsegment").alias("past"),
    )


def respondents(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").selectExpr(
        "o_orderkey AS id",
        "o_custkey AS person",
        "o_orderstatus AS status",
        "o_orderpriority AS intent",
        "IF(o_orderstatus = 'P', 0, 1) AS turnout",
        "o_totalprice AS w0",
        "year(o_orderdate) AS wave",
        "CAST(o_orderdate AS DATE) AS day",
    )
    return orders.join(people(spark, folder), "person")


def population(spark: SparkSession, folder: str, *keys: str) -> DataFrame:
    """People per stratum: (keys, n)."""
    return people(spark, folder).groupBy(*keys).agg(F.expr("count(*) AS n"))


def polls(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").selectExpr(
        "event_id",
        "concat('inst', user_id) AS institut",
        "CAST(ts AS DATE) AS datum",
        "event_type AS partei",
        "value / (value + 100) AS anteil",
        "CAST(500 + 10 * user_id AS DOUBLE) AS befragte",
    )


# The same views for DuckDB.
PEOPLE_SQL = """people AS (
  SELECT c_custkey AS person, c_nationkey AS nation,
         CASE WHEN c_nationkey < 13 THEN 'Female' ELSE 'Male' END AS gender,
         CASE WHEN c_acctbal < 0 THEN '18-25' WHEN c_acctbal < 2500 THEN '26-35'
              WHEN c_acctbal < 5000 THEN '36-45' WHEN c_acctbal < 7500 THEN '46-60'
              ELSE '60+' END AS agegroup,
         c_acctbal AS balance, c_mktsegment AS past
  FROM customer)"""
RESP_SQL = (
    PEOPLE_SQL
    + """, resp AS (
  SELECT o_orderkey AS id, p.person, o_orderstatus AS status, o_orderpriority AS intent,
         CASE WHEN o_orderstatus = 'P' THEN 0 ELSE 1 END AS turnout, o_totalprice AS w0,
         CAST(year(o_orderdate) AS INTEGER) AS wave, CAST(o_orderdate AS DATE) AS day,
         nation, gender, agegroup, balance, past
  FROM orders JOIN people p ON o_custkey = p.person)"""
)
POLLS_SQL = """polls AS (
  SELECT event_id, concat('inst', user_id) AS institut, CAST(ts AS DATE) AS datum,
         event_type AS partei, value / (value + 100) AS anteil,
         CAST(500 + 10 * user_id AS DOUBLE) AS befragte
  FROM events)"""

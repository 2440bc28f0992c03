"""The test tables and the `cases` view built from them, with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casekit.plans.roles import Roles
from casekit.sources.files import stage

CASE_ROLES = (
    "record_id", "consumer_id", "amount", "registration_date", "closing_date", "sla_deadline", "status",
    "category", "priority", "officer", "reopen_flag", "zone", "circle", "division", "latitude", "longitude",
)
ROLES = Roles({role: role for role in CASE_ROLES})

_staged: dict[tuple[str, str], DataFrame] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def build_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order: opened on the order date, closed by its last shipment."""
    lines = (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_orderkey").alias("record_id"))
        .agg(F.max("l_shipdate").alias("closing_date"), F.min("l_suppkey").alias("s_suppkey"))
    )
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("record_id"),
        F.col("o_custkey").alias("consumer_id"),
        F.col("o_totalprice").alias("amount"),
        F.col("o_orderdate").alias("registration_date"),
        F.expr(
            "CASE o_orderstatus WHEN 'F' THEN 'Closed' WHEN 'O' THEN 'Open' ELSE 'Re-opened' END"
        ).alias("status"),
        F.expr(
            "o_orderdate + make_dt_interval(90 * CAST(substring(o_orderpriority, 1, 1) AS INT))"
        ).alias("sla_deadline"),
        F.col("o_orderpriority").alias("category"),
        F.lower(F.expr("substring(o_orderpriority, 3)")).alias("priority"),
        F.when(F.col("o_orderkey") % 11 == 0, "yes").otherwise("no").alias("reopen_flag"),
        (F.col("o_custkey") % 181 - 90).cast("double").alias("latitude"),
        (F.col("o_orderkey") % 361 - 180).cast("double").alias("longitude"),
    )
    places = (
        table(spark, sf_dir, "nation")
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            F.col("n_nationkey").alias("c_nationkey"),
            F.col("n_name").alias("circle"),
            F.col("r_name").alias("zone"),
        )
    )
    customers = (
        table(spark, sf_dir, "customer")
        .join(places, "c_nationkey", "left")
        .select(F.col("c_custkey").alias("consumer_id"), F.col("c_mktsegment").alias("division"), "circle", "zone")
    )
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_name").alias("officer"))
    return (
        orders.join(lines, "record_id", "left")
        .join(customers, "consumer_id", "left")
        .join(suppliers, "s_suppkey", "left")
        .select(*CASE_ROLES)
    )


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view, written once per application so that each query is one pruned scan of it."""
    key = (spark.conf.get("spark.app.id", ""), sf_dir)
    if key not in _staged:
        _staged[key] = stage(build_cases(spark, sf_dir), "cases")
    return _staged[key]


CASES_SQL = """
cases AS (
  SELECT o.o_orderkey AS record_id, o.o_custkey AS consumer_id, o.o_totalprice AS amount,
         o.o_orderdate AS registration_date, l.closing_date,
         o.o_orderdate + to_days(90 * CAST(substr(o.o_orderpriority, 1, 1) AS INTEGER)) AS sla_deadline,
         CASE o.o_orderstatus WHEN 'F' THEN 'Closed' WHEN 'O' THEN 'Open' ELSE 'Re-opened' END AS status,
         o.o_orderpriority AS category, lower(substr(o.o_orderpriority, 3)) AS priority,
         s.s_name AS officer, CASE WHEN o.o_orderkey % 11 = 0 THEN 'yes' ELSE 'no' END AS reopen_flag,
         r.r_name AS zone, n.n_name AS circle, c.c_mktsegment AS division,
         CAST(o.o_custkey % 181 - 90 AS DOUBLE) AS latitude,
         CAST(o.o_orderkey % 361 - 180 AS DOUBLE) AS longitude
  FROM orders o
  LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS closing_date, min(l_suppkey) AS suppkey
             FROM lineitem GROUP BY l_orderkey) l ON l.l_orderkey = o.o_orderkey
  LEFT JOIN customer c ON c.c_custkey = o.o_custkey
  LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey
  LEFT JOIN region r ON r.r_regionkey = n.n_regionkey
  LEFT JOIN supplier s ON s.s_suppkey = l.suppkey
)"""

# Lifecycle columns used by many twins: flags, durations in days, age against the newest registration.
LIFE_SQL = CASES_SQL + """,
ref AS (SELECT max(registration_date) AS ref_date FROM cases),
life AS (
  SELECT c.*, lower(trim(status)) IN ('closed', 'resolved', 'completed') AS is_closed,
         lower(trim(status)) IN ('pending', 'open', 'assigned', 'in progress') AS is_pending,
         (lower(trim(status)) IN ('reopened', 're-opened', 'escalated')
          OR coalesce(lower(trim(reopen_flag)) IN ('1', 'true', 'yes', 'y', 'reopened', 're-opened'), false))
           AS is_reopened,
         CASE WHEN closing_date >= registration_date
              THEN (epoch_us(closing_date) - epoch_us(registration_date)) / 86400000000.0 END AS res_days,
         CASE WHEN ref_date >= registration_date
              THEN (epoch_us(ref_date) - epoch_us(registration_date)) / 86400000000.0 END AS age_days
  FROM cases c, ref
)"""


def with_cases(sql: str) -> str:
    return "WITH " + CASES_SQL.strip() + sql


def with_life(sql: str) -> str:
    return "WITH " + LIFE_SQL.strip() + sql

"""Checks: filters, group aggregates, top-N, distributions, hierarchies."""

from __future__ import annotations

from pyspark.sql import functions as F

from casekit.checks.tables import ROLES, cases, table, with_cases
from casekit.operators import aggregates, filters, search_index
from casekit.sources import files

FILTERS = [
    ("l_returnflag", "in", ["A", "R"]),
    ("l_linestatus", "eq", "O"),
    ("l_quantity", "between", (10.0, 40.0)),
    ("l_discount", "between", (0.02, None)),
    ("missing_column", "eq", 1),
    ("l_tax", "like", "x"),
]
STATE = {"date_range": ("1996-01-01", "1999-06-30"), "status": ["Open", "Closed"], "priority": ["high", "low"]}
DRILL = [("zone", "EUROPE"), ("circle", "")]
LEVELS = ["zone", "circle", "division"]


def agg_query(agg):
    return lambda s, d: aggregates.group_aggregate(table(s, d, "lineitem"), ["l_returnflag"], "l_extendedprice", agg)


def with_gaps(s, d):
    """Keys with missing values, which must not form a group."""
    return table(s, d, "lineitem").withColumn("flag", F.when(F.col("l_linenumber") != 3, F.col("l_returnflag")))


def outliers(method):
    def query(s, d):
        lines = table(s, d, "lineitem").select("l_orderkey", (F.col("l_extendedprice") * F.col("l_quantity")).alias("v"))
        kept = filters.outlier_filter(lines.withColumn("v", F.when(F.col("l_orderkey") % 9 != 0, F.col("v"))), "v", method)
        return kept.agg(
            F.count(F.lit(1)).alias("rows"), F.count("v").alias("filled"), F.round(F.max("v"), 2).alias("largest"),
            F.round(F.min("v"), 2).alias("smallest"), F.sum("l_orderkey").alias("key_sum"),
        )

    return query


def outlier_sql(limits: str) -> str:
    return f"""WITH t AS (SELECT l_orderkey, CASE WHEN l_orderkey % 9 <> 0 THEN l_extendedprice * l_quantity END AS v
        FROM lineitem), {limits}
      SELECT count(*) AS rows, count(v) AS filled, round(max(v), 2) AS largest, round(min(v), 2) AS smallest,
        CAST(sum(l_orderkey) AS BIGINT) AS key_sum FROM t, s WHERE v IS NULL OR v BETWEEN low AND high"""


def part_paths(s, d):
    return table(s, d, "part").withColumn("size_band", F.when(F.col("p_size") > 25, "large").otherwise("small"))


def search_indexed(s, d):
    index = search_index.build_search_index(table(s, d, "documents"), ["text", "source"], 1 << 10)
    return index.search("the.").select("doc_id", "source")


def clustered(s, d):
    """The cases in the order in which they are drilled into."""
    path = files.staging_path(s, "clustered")
    files.write_clustered(cases(s, d), path, ["zone", "division", "registration_date"], ["record_id"])
    return s.read.schema(cases(s, d).schema).parquet(path)


def drill_clustered(s, d):
    rows = clustered(s, d)
    return rows.where(filters.drill_condition(rows, [("zone", "ASIA"), ("division", "MACHINERY")], trimmed=True)).select(
        "record_id", "zone", "division"
    )


NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]

QUERIES = {
    "filtered_group_agg": lambda s, d: filters.filtered_group_aggregate(
        table(s, d, "lineitem"), ["l_shipdate"], "l_extendedprice", "sum", FILTERS
    ).select(F.date_format("l_shipdate", "yyyy-MM-dd").alias("day"), F.round("value", 2).alias("value")),
    "date_range_filter": lambda s, d: filters.date_range(table(s, d, "events"), "ts", "2024-01-05", "2024-01-09").select(
        "event_id", "ts", "event_type"
    ),
    "chart_date_range": lambda s, d: filters.chart_date_range(
        table(s, d, "events"), "ts", "2024-01-05", "2024-01-09 12:00:00"
    ).select("event_id", "ts", "event_type"),
    "multi_filter": lambda s, d: cases(s, d).where(
        filters.selection_condition("category", ["1-URGENT", "5-LOW"])
    ).select("record_id", "category"),
    "drill_filter": lambda s, d: cases(s, d).where(
        filters.drill_condition(cases(s, d), [("zone", "ASIA"), ("division", "MACHINERY"), ("nowhere", "x")])
    ).select("record_id", "zone", "division"),
    "drill_filter_clustered": drill_clustered,
    "apply_filters_clustered": lambda s, d: filters.apply_filters(clustered(s, d), ROLES, STATE, DRILL, trimmed=True).select(
        "record_id", "registration_date", "status", "priority", "zone"
    ),
    "apply_filters": lambda s, d: filters.apply_filters(cases(s, d), ROLES, STATE, DRILL).select(
        "record_id", "registration_date", "status", "priority", "zone"
    ),
    "filter_counts": lambda s, d: filters.filter_counts(cases(s, d), ROLES, STATE, DRILL),
    "filter_options": lambda s, d: filters.filter_options(cases(s, d), "officer", 40),
    "filter_options_all": lambda s, d: filters.filter_options(cases(s, d), "officer"),
    "search_options": lambda s, d: filters.search_options(cases(s, d), "officer", "#00000000", 500),
    "drill_topology": lambda s, d: filters.drill_topology(cases(s, d), LEVELS),
    "drill_children": lambda s, d: filters.drill_children(filters.drill_topology(cases(s, d), LEVELS), LEVELS, ["ASIA"]),
    "text_search": lambda s, d: filters.text_search(table(s, d, "documents"), "the.", ["text", "source"]).select("doc_id", "source"),
    "text_search_indexed": search_indexed,
    "outlier_filter_iqr": outliers("iqr"),
    "outlier_filter_z": outliers("zscore"),
    "outlier_filter_pct": outliers("percentile"),
    **{f"agg_{a}": agg_query(a) for a in ("count", "min", "max", "nunique")},
    **{
        f"agg_{a}": lambda s, d, a=a: agg_query(a)(s, d).withColumn("value", F.round("value", 2))
        for a in ("sum", "mean", "median")
    },
    "agg_null_keys": lambda s, d: aggregates.group_aggregate(with_gaps(s, d), ["flag", "l_linestatus"]),
    "agg_parquet_sum": lambda s, d: aggregates.group_aggregate(
        s.read.parquet(f"{d}/orders.parquet"), ["o_orderpriority", "o_orderstatus"], "o_totalprice", "sum"
    ).withColumn("value", F.round("value", 2)),
    "agg_multi_key": lambda s, d: aggregates.group_aggregate(
        with_gaps(s, d), ["flag", "l_linestatus", "l_linenumber"], "l_quantity", "mean"
    ).withColumn("value", F.round("value", 4)),
    "hierarchy_rollup": lambda s, d: aggregates.hierarchy_rollup(
        aggregates.clip_to_other(part_paths(s, d), ["p_type", "p_brand"], 5), ["p_type", "p_brand", "size_band"]
    ),
    "hierarchy_sum": lambda s, d: aggregates.hierarchy_rollup(
        cases(s, d), ["zone", "circle"], "amount", "sum"
    ).withColumn("value", F.round("value", 2)),
    "describe_numeric": lambda s, d: aggregates.describe(table(s, d, "lineitem"), "l_extendedprice"),
    "describe_by_group": lambda s, d: aggregates.describe(table(s, d, "lineitem"), "l_extendedprice", ["l_returnflag"]),
    "correlation_matrix": lambda s, d: aggregates.correlation_matrix(table(s, d, "lineitem"), NUMBERS),
    "crosstab": lambda s, d: aggregates.crosstab(with_gaps(s, d), "flag", "l_linenumber", x_values=[1, 2, 4, 5, 6, 7]),
    "crosstab_cells": lambda s, d: aggregates.crosstab(table(s, d, "lineitem"), "l_suppkey", "l_linenumber"),
    "crosstab_mean": lambda s, d: aggregates.crosstab(
        cases(s, d), "zone", "status", "amount", "mean", ["Closed", "Open", "Re-opened"]
    ).withColumn("value", F.round("value", 4)),
    "crosstab_wide": lambda s, d: aggregates.crosstab_wide(cases(s, d), "zone", "status", ["Closed", "Open", "Re-opened"]),
    "top_n": lambda s, d: aggregates.top_n(
        aggregates.group_aggregate(table(s, d, "lineitem"), ["l_suppkey"], "l_extendedprice", "sum"), "value", ["l_suppkey"], 15
    ).withColumn("value", F.round("value", 2)),
    "top_n_with_groups": lambda s, d: aggregates.top_n_with_groups(
        aggregates.group_aggregate(table(s, d, "lineitem"), ["l_suppkey", "l_returnflag"]), "l_suppkey", "value", 10
    ),
    "clip_other": lambda s, d: aggregates.clip_to_other(cases(s, d), ["officer", "circle"], 6)
    .groupBy("officer", "circle").agg(F.count(F.lit(1)).alias("rows")),
    "bounded_sample": lambda s, d: aggregates.bounded_sample(table(s, d, "orders"), "o_orderkey", 500),
}

_AGG_SQL = {
    "count": "count(*)", "sum": "round(sum(l_extendedprice), 2)", "mean": "round(avg(l_extendedprice), 2)",
    "median": "round(median(l_extendedprice), 2)", "min": "min(l_extendedprice)", "max": "max(l_extendedprice)",
    "nunique": "count(DISTINCT l_extendedprice)",
}
_DESCRIBE = """count(l_extendedprice) AS count, round(avg(l_extendedprice), 2) AS mean,
  round(stddev_samp(l_extendedprice), 2) AS std, round(min(l_extendedprice), 2) AS min,
  round(quantile_cont(l_extendedprice, 0.25), 2) AS p25, round(quantile_cont(l_extendedprice, 0.5), 2) AS p50,
  round(quantile_cont(l_extendedprice, 0.75), 2) AS p75, round(max(l_extendedprice), 2) AS max FROM lineitem"""
_GAPS = "(SELECT *, CASE WHEN l_linenumber <> 3 THEN l_returnflag END AS flag FROM lineitem)"

ORACLE = {
    "filtered_group_agg": """SELECT strftime(l_shipdate, '%Y-%m-%d') AS day, round(sum(l_extendedprice), 2) AS value
      FROM lineitem WHERE l_shipdate IS NOT NULL AND l_returnflag IN ('A', 'R') AND l_linestatus = 'O'
        AND l_quantity BETWEEN 10 AND 40 AND l_discount >= 0.02 GROUP BY l_shipdate""",
    "date_range_filter": """SELECT event_id, ts, event_type FROM events
      WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-10'""",
    "chart_date_range": """SELECT event_id, ts, event_type FROM events
      WHERE ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-09 12:00:00'""",
    "multi_filter": "SELECT o_orderkey AS record_id, o_orderpriority AS category FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW')",
    "drill_filter": with_cases("SELECT record_id, zone, division FROM cases WHERE zone = 'ASIA' AND division = 'MACHINERY'"),
    "apply_filters": with_cases("""SELECT record_id, registration_date, status, priority, zone FROM cases
      WHERE registration_date >= TIMESTAMP '1996-01-01' AND registration_date < TIMESTAMP '1999-07-01'
        AND status IN ('Open', 'Closed') AND priority IN ('high', 'low') AND zone = 'EUROPE'"""),
    "filter_counts": with_cases("""SELECT count(*) AS rows_before, count(*) FILTER (
        registration_date >= TIMESTAMP '1996-01-01' AND registration_date < TIMESTAMP '1999-07-01'
        AND status IN ('Open', 'Closed') AND priority IN ('high', 'low') AND zone = 'EUROPE') AS rows_after FROM cases"""),
    "filter_options": with_cases("""SELECT officer AS option FROM (SELECT trim(officer) AS officer, count(*) AS n FROM cases
      WHERE trim(officer) <> '' GROUP BY 1 ORDER BY n DESC, officer LIMIT 40)"""),
    "filter_options_all": with_cases("SELECT DISTINCT trim(officer) AS option FROM cases WHERE trim(officer) <> ''"),
    "crosstab_cells": "SELECT l_suppkey, l_linenumber, count(*) AS value FROM lineitem GROUP BY 1, 2",
    "bounded_sample": "SELECT * FROM orders ORDER BY md5('42:' || CAST(o_orderkey AS VARCHAR)), o_orderkey LIMIT 500",
    "search_options": with_cases("""SELECT DISTINCT trim(officer) AS option FROM cases
      WHERE contains(lower(officer), '#00000000') ORDER BY 1 LIMIT 500"""),
    "drill_topology": with_cases("""SELECT DISTINCT 1 AS level, zone, NULL AS circle, NULL AS division FROM cases WHERE zone IS NOT NULL
      UNION ALL SELECT DISTINCT 2, zone, circle, NULL FROM cases WHERE zone IS NOT NULL AND circle IS NOT NULL
      UNION ALL SELECT DISTINCT 3, zone, circle, division FROM cases
        WHERE zone IS NOT NULL AND circle IS NOT NULL AND division IS NOT NULL"""),
    "drill_children": with_cases("SELECT DISTINCT circle AS child FROM cases WHERE zone = 'ASIA'"),
    "text_search": "SELECT doc_id, source FROM documents WHERE contains(lower(text), 'the.') OR contains(lower(source), 'the.')",
    "outlier_filter_iqr": outlier_sql("""q AS (SELECT quantile_cont(v, 0.25) AS a, quantile_cont(v, 0.75) AS b FROM t),
      s AS (SELECT a - 1.5 * (b - a) AS low, b + 1.5 * (b - a) AS high FROM q)"""),
    "outlier_filter_z": outlier_sql("""s AS (SELECT avg(v) - 3 * stddev_samp(v) AS low, avg(v) + 3 * stddev_samp(v) AS high FROM t)"""),
    "outlier_filter_pct": outlier_sql("s AS (SELECT quantile_cont(v, 0.01) AS low, quantile_cont(v, 0.99) AS high FROM t)"),
    **{f"agg_{a}": f"SELECT l_returnflag, {e} AS value FROM lineitem GROUP BY 1" for a, e in _AGG_SQL.items()},
    "agg_null_keys": f"""SELECT flag, l_linestatus, count(*) AS value FROM {_GAPS}
      WHERE flag IS NOT NULL AND l_linestatus IS NOT NULL GROUP BY 1, 2""",
    "agg_parquet_sum": """SELECT o_orderpriority, o_orderstatus, round(sum(o_totalprice), 2) AS value FROM orders GROUP BY 1, 2""",
    "agg_multi_key": f"""SELECT flag, l_linestatus, l_linenumber, round(avg(l_quantity), 4) AS value FROM {_GAPS}
      WHERE flag IS NOT NULL GROUP BY 1, 2, 3""",
    "hierarchy_rollup": """WITH t AS (SELECT p_type, p_brand, CASE WHEN p_size > 25 THEN 'large' ELSE 'small' END AS size_band FROM part),
      a AS (SELECT p_type FROM t WHERE p_type IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, p_type LIMIT 5),
      b AS (SELECT p_brand FROM t WHERE p_brand IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, p_brand LIMIT 5),
      c AS (SELECT CASE WHEN p_type IN (SELECT p_type FROM a) THEN p_type ELSE '(Other)' END AS p_type,
        CASE WHEN p_brand IN (SELECT p_brand FROM b) THEN p_brand ELSE '(Other)' END AS p_brand, size_band FROM t)
      SELECT p_type, p_brand, size_band, count(*) AS value,
        CAST(3 - bit_count(grouping(p_type, p_brand, size_band)) AS INTEGER) AS level
      FROM c GROUP BY ROLLUP (p_type, p_brand, size_band)""",
    "hierarchy_sum": with_cases("""SELECT zone, circle, round(sum(amount), 2) AS value,
        CAST(2 - bit_count(grouping(zone, circle)) AS INTEGER) AS level
      FROM cases WHERE zone IS NOT NULL AND circle IS NOT NULL GROUP BY ROLLUP (zone, circle)"""),
    "describe_numeric": f"SELECT {_DESCRIBE}",
    "describe_by_group": f"SELECT l_returnflag, {_DESCRIBE} GROUP BY l_returnflag",
    "correlation_matrix": " UNION ALL ".join(
        f"SELECT '{a}' AS column_x, '{b}' AS column_y, round(corr({a}, {b}), 3) AS correlation FROM lineitem"
        for a in NUMBERS for b in NUMBERS
    ),
    "crosstab": f"""WITH c AS (SELECT flag, l_linenumber, count(*) AS n FROM {_GAPS} WHERE flag IS NOT NULL GROUP BY 1, 2),
      g AS (SELECT * FROM (SELECT DISTINCT flag FROM c), (SELECT DISTINCT l_linenumber FROM c))
      SELECT flag, l_linenumber, coalesce(n, 0) AS value FROM g LEFT JOIN c USING (flag, l_linenumber)""",
    "crosstab_mean": with_cases("""SELECT zone, status, round(avg(amount), 4) AS value FROM cases
      WHERE zone IS NOT NULL AND status IS NOT NULL GROUP BY 1, 2"""),
    "crosstab_wide": with_cases("""SELECT zone, count(*) FILTER (status = 'Closed') AS "Closed",
      count(*) FILTER (status = 'Open') AS "Open", count(*) FILTER (status = 'Re-opened') AS "Re-opened"
      FROM cases WHERE zone IS NOT NULL GROUP BY 1"""),
    "top_n": """SELECT l_suppkey, round(sum(l_extendedprice), 2) AS value FROM lineitem GROUP BY 1
      ORDER BY sum(l_extendedprice) DESC, l_suppkey LIMIT 15""",
    "top_n_with_groups": """WITH t AS (SELECT l_suppkey FROM lineitem GROUP BY 1 ORDER BY count(*) DESC, l_suppkey LIMIT 10)
      SELECT l_suppkey, l_returnflag, count(*) AS value FROM lineitem WHERE l_suppkey IN (SELECT l_suppkey FROM t) GROUP BY 1, 2""",
    "clip_other": with_cases(""", a AS (SELECT officer FROM cases WHERE officer IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, officer LIMIT 6),
      b AS (SELECT circle FROM cases WHERE circle IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, circle LIMIT 6)
      SELECT CASE WHEN officer IN (SELECT officer FROM a) THEN officer ELSE '(Other)' END AS officer,
        CASE WHEN circle IN (SELECT circle FROM b) THEN circle ELSE '(Other)' END AS circle, count(*) AS rows
      FROM cases GROUP BY 1, 2"""),
}

ORACLE |= {
    "drill_filter_clustered": ORACLE["drill_filter"],
    "apply_filters_clustered": ORACLE["apply_filters"],
    "text_search_indexed": ORACLE["text_search"],
}

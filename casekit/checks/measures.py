"""Checks: lifecycle, KPIs, breakdowns and the executive bundle."""

from __future__ import annotations

from pyspark.sql import functions as F

from casekit.checks.tables import ROLES, cases, with_cases, with_life
from casekit.functions.expressions import US_PER_DAY, attach_row
from casekit.operators import breakdowns, executive, kpis
from casekit.operators import lifecycle as L
from casekit.operators.cube import CaseCube
from casekit.sources.files import staging_path, write_parquet

NO_STATUS = ROLES.without("status")
NO_LIFECYCLE = ROLES.without("status", "closing_date")


def view(s, d):
    return ROLES.view(cases(s, d))


def lifecycle_flags(s, d):
    return L.with_flags(view(s, d), ROLES).select("record_id", "is_closed", "is_pending", "is_reopened")


def lifecycle_closing_only(s, d):
    flagged = L.with_flags(NO_STATUS.view(cases(s, d)), NO_STATUS)
    return flagged.select("record_id", "is_closed", "is_pending", "is_reopened")


def lifecycle_unmapped(s, d):
    flagged, method, quality = L.with_executive_flags(NO_LIFECYCLE.view(cases(s, d)), NO_LIFECYCLE)
    return flagged.agg(F.count_if("is_pending").alias("pending"), F.count_if("is_closed").alias("closed")).withColumns(
        {"method": F.lit(method), "quality": F.lit(quality)}
    )


def resolution_days(s, d):
    days = L.resolution_us(ROLES) / F.lit(US_PER_DAY)
    return view(s, d).select("record_id", F.round(days, 6).alias("resolution_days"))


def clipped_resolution(s, d):
    work = L.with_clipped_resolution(L.with_flags(view(s, d), ROLES), ROLES)
    return work.select("record_id", F.round(F.col("clipped_us") / US_PER_DAY, 4).alias("clipped_days"))


def pending_age(s, d):
    return kpis.pending_ages(view(s, d), ROLES).select(
        "record_id", F.round(F.col("age_us") / US_PER_DAY, 6).alias("age_days")
    )


def fenced_age(s, d):
    """Ages stretched by a power so that the fence bites."""
    aged = L.with_age(L.with_flags(view(s, d), ROLES), L.reference_date(view(s, d)))
    aged = aged.where("is_pending").withColumn("age_days", F.pow(F.col("age_us") / US_PER_DAY / 400, 4))
    fenced = attach_row(aged, L.age_quantiles(aged), "q")
    return fenced.select("record_id", F.round(L.fenced_age(F.col("age_days"), F.col("q")), 4).alias("fenced_days"))


def case_latency(s, d):
    work = L.with_latency(L.lifecycle_state(view(s, d), ROLES), ROLES, "hours")
    return work.select("record_id", "state", F.round("latency", 4).alias("latency_hours"))


def severity_weight(s, d):
    df = view(s, d)
    return df.select(
        "record_id", L.weight(df, "priority", 2.0).alias("severity"), L.weight(df, "amount", 1.0).alias("criticality")
    )


def kpi_counts(s, d):
    return kpis.count_measures(view(s, d), ROLES).select(
        "total_cases", "closed_cases", "pending_cases", "reopened_cases", "backlog"
    )


def kpi_rates(s, d):
    return kpis.count_measures(view(s, d), ROLES).select(
        "closure_rate", "pending_rate", "reopen_rate", "first_time_resolution_rate"
    )


def kpi_sla(s, d):
    return kpis.count_measures(view(s, d), ROLES).select("sla_compliance_rate", "sla_breach_rate")


def sla_breach(s, d):
    return breakdowns.sla_breach_detail(view(s, d), ROLES)


_cubes = {}


def cube(s, d):
    """Cells of the cases, which come in two deliveries: the second refresh reads the second one alone."""
    key = (s.conf.get("spark.app.id", ""), d)
    if key not in _cubes:
        source = staging_path(s, "deliveries")
        made = CaseCube(s, staging_path(s, "cube"), ROLES, ("zone", "circle", "division"))
        for part in ("record_id % 3 = 0", "record_id % 3 <> 0"):
            write_parquet(cases(s, d).where(part), source, mode="append")
            made.refresh(source)
        _cubes[key] = made
    return _cubes[key]


QUERIES = {
    "cube_counts": lambda s, d: cube(s, d).counts().select("total_cases", "closed_cases", "pending_cases", "reopened_cases", "backlog"),
    "cube_rates": lambda s, d: cube(s, d).counts().select(
        "closure_rate", "pending_rate", "reopen_rate", "first_time_resolution_rate"
    ),
    "cube_monthly_trend": lambda s, d: cube(s, d).monthly_trend(),
    "cube_hierarchy": lambda s, d: cube(s, d).hierarchy(["zone", "circle", "division"]),
    "lifecycle_flags": lifecycle_flags,
    "lifecycle_closing_only": lifecycle_closing_only,
    "lifecycle_unmapped": lifecycle_unmapped,
    "lifecycle_state": lambda s, d: L.lifecycle_state(view(s, d), ROLES).groupBy("state", "status").agg(
        F.count(F.lit(1)).alias("rows")
    ),
    "resolution_days": resolution_days,
    "clipped_resolution": clipped_resolution,
    "pending_age": pending_age,
    "fenced_age": fenced_age,
    "case_latency": case_latency,
    "severity_weight": severity_weight,
    "kpi_counts": kpi_counts,
    "kpi_rates": kpi_rates,
    "kpi_sla": kpi_sla,
    "kpi_resolution": lambda s, d: kpis.resolution_measures(view(s, d), ROLES),
    "kpi_pending_age": lambda s, d: kpis.age_measures(view(s, d), ROLES),
    "kpi_consumers": lambda s, d: kpis.consumer_measures(view(s, d), ROLES),
    "kpi_growth": lambda s, d: kpis.growth_measures(view(s, d)),
    "kpi_table": lambda s, d: kpis.kpi_table(view(s, d), ROLES),
    "kpi_table_without_status": lambda s, d: kpis.kpi_table(NO_STATUS.view(cases(s, d)), NO_STATUS),
    "officer_productivity": lambda s, d: breakdowns.officer_productivity(view(s, d), ROLES),
    "category_breakdown": lambda s, d: breakdowns.category_breakdown(view(s, d), ROLES),
    "category_breakdown_closing_only": lambda s, d: breakdowns.category_breakdown(NO_STATUS.view(cases(s, d)), NO_STATUS),
    "monthly_trend": lambda s, d: breakdowns.monthly_trend(view(s, d), ROLES),
    "hierarchy_risk": lambda s, d: breakdowns.hierarchy_risk(view(s, d), ROLES),
    "hierarchy_risk_circles": lambda s, d: breakdowns.hierarchy_risk(
        ROLES.without("zone").view(cases(s, d)), ROLES.without("zone")
    ),
    "top_repeat_consumers": lambda s, d: breakdowns.top_repeat_consumers(view(s, d), ROLES, 20),
    "top_repeat_consumers_all": lambda s, d: breakdowns.top_repeat_consumers(view(s, d), ROLES),
    "sla_breach_detail": sla_breach,
    "executive_kpis": lambda s, d: executive.executive_kpis(view(s, d), ROLES),
    "executive_deltas": lambda s, d: executive.executive_deltas(view(s, d), ROLES),
    "hierarchy_anomalies": lambda s, d: executive.hierarchy_anomalies(view(s, d), ROLES),
    "hierarchy_anomalies_officer": lambda s, d: executive.hierarchy_anomalies(view(s, d), ROLES, "officer"),
    "pareto_hotspots": lambda s, d: executive.pareto_hotspots(view(s, d), ROLES, longer_than=5, keep=3),
    "pareto_hotspots_all": lambda s, d: executive.pareto_hotspots(view(s, d), ROLES),
    "pareto_hierarchy": lambda s, d: executive.pareto_hierarchy(view(s, d), ROLES),
}

_P95 = "p95 AS (SELECT quantile_cont(res_days, 0.95) AS cap FROM life WHERE is_closed AND res_days IS NOT NULL)"
_FENCE = """aged AS (SELECT age_days, least(age_days, 3650) AS capped FROM life WHERE is_pending),
  fence AS (SELECT greatest(quantile_cont(capped, 0.75) + 3 * (quantile_cont(capped, 0.75) - quantile_cont(capped, 0.25)), 365) AS f FROM aged),
  age AS (SELECT avg(least(capped, f)) AS a, quantile_cont(age_days, 0.5) AS p50, quantile_cont(age_days, 0.95) AS p95 FROM aged, fence)"""
_CLIPPED_AVG = "round(avg(CASE WHEN is_closed AND res_days IS NOT NULL THEN least(res_days, cap) END), 1)"
_GROWTH = """periods AS (
    SELECT 'mom_growth' AS kpi, date_trunc('month', registration_date) AS p, count(*) AS n FROM cases GROUP BY 1, 2
    UNION ALL SELECT 'qoq_growth', date_trunc('quarter', registration_date), count(*) FROM cases GROUP BY 1, 2
    UNION ALL SELECT 'yoy_growth', date_trunc('year', registration_date), count(*) FROM cases GROUP BY 1, 2),
  numbered AS (SELECT *, row_number() OVER (PARTITION BY kpi ORDER BY p DESC) AS r FROM periods),
  growth AS (SELECT kpi, max(n) FILTER (r = 1) AS current_count, max(n) FILTER (r = 2) AS previous_count,
      round((max(n) FILTER (r = 1) - max(n) FILTER (r = 2)) * 100.0 / abs(max(n) FILTER (r = 2)), 2) AS pct_change
    FROM numbered GROUP BY kpi)"""
_COUNTS = """count(*) AS total_cases, count(*) FILTER (is_closed) AS closed_cases,
  count(*) FILTER (is_pending) AS pending_cases, count(*) FILTER (is_reopened) AS reopened_cases"""
_RATES = """round(count(*) FILTER (is_closed) * 100.0 / count(*), 2) AS closure_rate,
  round(count(*) FILTER (is_pending) * 100.0 / count(*), 2) AS pending_rate,
  round(count(*) FILTER (is_reopened) * 100.0 / count(*) FILTER (is_closed), 2) AS reopen_rate,
  round(count(*) FILTER (is_closed AND NOT is_reopened) * 100.0 / count(*) FILTER (is_closed), 2) AS first_time_resolution_rate"""
_SLA = """round(count(*) FILTER (is_closed AND closing_date <= sla_deadline) * 100.0
    / count(*) FILTER (is_closed AND closing_date IS NOT NULL), 2) AS sla_compliance_rate"""
_CONSUMERS = """consumers AS (SELECT count(*) AS unique_consumers, round(count(*) FILTER (n > 1) * 100.0 / count(*), 2)
    AS repeat_consumer_rate FROM (SELECT consumer_id, count(record_id) AS n FROM cases GROUP BY 1))"""
_LOW_BAND = "CASE WHEN {v} <= {a} THEN 'excellent' WHEN {v} <= {b} THEN 'good' WHEN {v} <= {c} THEN 'fair' ELSE 'critical' END"
_HIGH_BAND = "CASE WHEN {v} >= {a} THEN 'excellent' WHEN {v} >= {b} THEN 'good' WHEN {v} >= {c} THEN 'fair' ELSE 'critical' END"


def _kpi_rows() -> str:
    share = "round({v} * 100.0 / total_cases, 1)"
    band = {
        "pending_cases": f"CASE WHEN {share.format(v='pending_cases')} >= 60 THEN 'critical' WHEN {share.format(v='pending_cases')} >= 40 THEN 'warning' ELSE 'good' END",
        "reopened_cases": f"CASE WHEN {share.format(v='reopened_cases')} < 5 THEN 'good' WHEN {share.format(v='reopened_cases')} < 10 THEN 'fair' ELSE 'critical' END",
        "backlog": "CASE WHEN pending_cases < 100 THEN 'good' WHEN pending_cases < 500 THEN 'warning' ELSE 'critical' END",
        "closure_rate": _HIGH_BAND.format(v="closure_rate", a=80, b=60, c=40),
        "pending_rate": _LOW_BAND.format(v="pending_rate", a=20, b=40, c=60),
        "reopen_rate": _LOW_BAND.format(v="reopen_rate", a=5, b=10, c=20),
        "avg_resolution_time": _LOW_BAND.format(v="avg_resolution_time", a=72, b=168, c=360),
        "avg_pending_age": _LOW_BAND.format(v="avg_pending_age", a=7, b=15, c=30),
        "sla_compliance_rate": _HIGH_BAND.format(v="sla_compliance_rate", a=90, b=75, c=50),
        "sla_breach_rate": _LOW_BAND.format(v="sla_breach_rate", a=10, b=25, c=50),
        "first_time_resolution_rate": _HIGH_BAND.format(v="first_time_resolution_rate", a=90, b=75, c=60),
        "repeat_consumer_rate": _LOW_BAND.format(v="repeat_consumer_rate", a=95, b=85, c=70),
    }
    expr = {"backlog": "pending_cases"}
    rows = []
    for kpi, unit in kpis.UNITS.items():
        source = "growth_row" if kpi.endswith("_growth") else "one"
        rows.append(
            f"SELECT '{kpi}' AS kpi, CAST({expr.get(kpi, kpi)} AS DOUBLE) AS value, '{unit}' AS unit, "
            f"{band.get(kpi, repr('na'))} AS band, true AS is_eligible, '' AS missing_roles FROM {source}"
        )
    return " UNION ALL ".join(rows)


_KPI_TABLE = f""", {_P95}, {_FENCE}, {_GROWTH}, {_CONSUMERS},
  res AS (SELECT round(avg(least(res_days, cap)) * 24, 2) AS avg_resolution_time, round(median(res_days), 2) AS median_resolution_time,
    round(max(cap), 2) AS p95_resolution_time FROM life, p95 WHERE is_closed AND res_days IS NOT NULL),
  base AS (SELECT {_COUNTS}, {_RATES}, {_SLA} FROM life),
  one AS (SELECT *, round(100.0 - sla_compliance_rate, 2) AS sla_breach_rate, round(a, 2) AS avg_pending_age,
    round(p50, 2) AS median_pending_age, round(p95, 2) AS p95_pending_age FROM base, res, consumers, age),
  growth_row AS (SELECT max(pct_change) FILTER (kpi = 'mom_growth') AS mom_growth, max(pct_change) FILTER (kpi = 'qoq_growth')
    AS qoq_growth, max(pct_change) FILTER (kpi = 'yoy_growth') AS yoy_growth FROM growth)
  """ + _kpi_rows()


def _risk(level: str) -> str:
    return f""", units AS (SELECT trim({level}) AS unit, count(*) AS total_cases, count(*) FILTER (is_pending) AS pending,
        round(avg(age_days) FILTER (is_pending), 1) AS avg_pending_age, round(max(age_days) FILTER (is_pending), 1) AS max_pending_age
      FROM life WHERE {level} IS NOT NULL GROUP BY 1),
    scored AS (SELECT *, round(pending / CAST(total_cases AS DOUBLE) * (1 + least(coalesce(avg_pending_age, 0) / 30.0, 5.0)) * 100, 1)
      AS risk_score FROM units),
    cuts AS (SELECT quantile_cont(risk_score, 0.33) AS a, quantile_cont(risk_score, 0.66) AS b FROM scored)
    SELECT unit, '{level}' AS level, total_cases, pending, avg_pending_age, max_pending_age, risk_score,
      CASE WHEN risk_score <= a THEN 'Low' WHEN risk_score <= b THEN 'Medium' ELSE 'High' END AS risk_tier FROM scored, cuts"""


def _anomalies(unit: str) -> str:
    return f""", units AS (SELECT {unit} AS unit_name, count(*) AS pending_count, avg(age_days) AS avg_pending_age FROM life
        WHERE is_pending AND {unit} IS NOT NULL GROUP BY 1),
      scored AS (SELECT *, round(pending_count * avg_pending_age, 4) AS risk_score FROM units),
      med AS (SELECT median(risk_score) AS m FROM scored),
      mad AS (SELECT median(abs(risk_score - m)) AS d FROM scored, med),
      ranked AS (SELECT *, (rank() OVER (ORDER BY risk_score) + (count(*) OVER (PARTITION BY risk_score) - 1) / 2.0)
        * 100.0 / count(*) OVER () AS pct FROM scored)
      SELECT '{unit}' AS unit_type, unit_name, pending_count, round(avg_pending_age, 4) AS avg_pending_age, risk_score,
        CASE WHEN d = 0 THEN 0.0 ELSE round(0.6745 * (risk_score - m) / d, 4) END AS z_score,
        CASE WHEN pct >= 90 THEN 'CRITICAL' WHEN pct >= 75 THEN 'HIGH' WHEN pct >= 50 THEN 'MEDIUM' ELSE 'LOW' END AS severity
      FROM ranked, med, mad"""


def _pareto_level(depth: int, path: list[str]) -> str:
    column, above = path[depth], path[:depth]
    keys = ", ".join(path[: depth + 1])
    part = f"PARTITION BY {', '.join(above)}" if above else ""
    semi = f" AND ({', '.join(above)}) IN (SELECT ({', '.join(above)}) FROM v{depth - 1})" if above else ""
    label = " || ' › ' || ".join(path[: depth + 1])
    return f"""n{depth} AS (SELECT {keys}, count(*) AS pending_volume FROM life WHERE is_pending AND {column} IS NOT NULL{semi} GROUP BY ALL),
      c{depth} AS (SELECT *, round(pending_volume * 100.0 / sum(pending_volume) OVER ({part}), 4) AS backlog_contribution_pct,
        round(sum(pending_volume) OVER ({part} ORDER BY pending_volume DESC, {column} ROWS UNBOUNDED PRECEDING) * 100.0
          / sum(pending_volume) OVER ({part}), 4) AS cumulative_pct FROM n{depth}),
      r{depth} AS (SELECT {depth + 1} AS depth, '{column}' AS level, {label} AS path, *, coalesce(lag(cumulative_pct)
        OVER ({part} ORDER BY pending_volume DESC, {column}), 0) < 80 AS is_vital_few FROM c{depth}),
      v{depth} AS (SELECT {keys} FROM r{depth} WHERE is_vital_few)"""


_PATH = ["zone", "circle", "division"]
_PARETO_TREE = ", " + ", ".join(_pareto_level(i, _PATH) for i in range(3)) + " " + " UNION ALL ".join(
    f"""SELECT depth, level, path, {c} AS name, pending_volume, backlog_contribution_pct, cumulative_pct, is_vital_few FROM r{i}"""
    for i, c in enumerate(_PATH)
)

def _closing_only_rows() -> str:
    """The KPI table when no status is mapped: only closing-date, consumer and growth KPIs remain."""
    values = {
        "total_cases": ("one", "na"), "closed_cases": ("one", "na"),
        "avg_resolution_time": ("one", _LOW_BAND.format(v="avg_resolution_time", a=72, b=168, c=360)),
        "median_resolution_time": ("one", "na"), "p95_resolution_time": ("one", "na"),
        "sla_compliance_rate": ("one", _HIGH_BAND.format(v="sla_compliance_rate", a=90, b=75, c=50)),
        "sla_breach_rate": ("one", _LOW_BAND.format(v="100.0 - sla_compliance_rate", a=10, b=25, c=50)),
        "unique_consumers": ("one", "na"),
        "repeat_consumer_rate": ("one", _LOW_BAND.format(v="repeat_consumer_rate", a=95, b=85, c=70)),
        "mom_growth": ("growth_row", "na"), "qoq_growth": ("growth_row", "na"), "yoy_growth": ("growth_row", "na"),
        "first_time_resolution_rate": ("one", _HIGH_BAND.format(v="first_time_resolution_rate", a=90, b=75, c=60)),
    }
    rows = []
    for kpi, unit in kpis.UNITS.items():
        if kpi not in values:
            rows.append(f"SELECT '{kpi}' AS kpi, CAST(NULL AS DOUBLE) AS value, '{unit}' AS unit, 'na' AS band, false AS is_eligible, 'status' AS missing_roles")
            continue
        source, band = values[kpi]
        expr = "round(100.0 - sla_compliance_rate, 2)" if kpi == "sla_breach_rate" else kpi
        rows.append(
            f"SELECT '{kpi}' AS kpi, CAST({expr} AS DOUBLE) AS value, '{unit}' AS unit, {band if band != 'na' else repr('na')} AS band, "
            f"true AS is_eligible, '' AS missing_roles FROM {source}"
        )
    return " UNION ALL ".join(rows)


_CLOSING_ONLY = f""", p95 AS (SELECT quantile_cont(res_days, 0.95) AS cap FROM life WHERE res_days IS NOT NULL), {_GROWTH}, {_CONSUMERS},
  res AS (SELECT round(avg(least(res_days, cap)) * 24, 2) AS avg_resolution_time, round(median(res_days), 2) AS median_resolution_time,
    round(max(cap), 2) AS p95_resolution_time FROM life, p95 WHERE res_days IS NOT NULL),
  base AS (SELECT count(*) AS total_cases, count(closing_date) AS closed_cases,
    round(count(*) FILTER (closing_date <= sla_deadline) * 100.0 / count(closing_date), 2) AS sla_compliance_rate,
    round(count(*) FILTER (closing_date IS NOT NULL AND reopen_flag <> 'yes') * 100.0 / count(closing_date), 2) AS first_time_resolution_rate
    FROM life),
  one AS (SELECT * FROM base, res, consumers),
  growth_row AS (SELECT max(pct_change) FILTER (kpi = 'mom_growth') AS mom_growth, max(pct_change) FILTER (kpi = 'qoq_growth')
    AS qoq_growth, max(pct_change) FILTER (kpi = 'yoy_growth') AS yoy_growth FROM growth)
  """ + _closing_only_rows()

ORACLE = {
    "kpi_table_without_status": with_life(_CLOSING_ONLY),
    "lifecycle_flags": with_life("SELECT record_id, is_closed, is_pending, is_reopened FROM life"),
    "lifecycle_closing_only": with_cases("""SELECT record_id, closing_date IS NOT NULL AS is_closed,
      closing_date IS NULL AS is_pending, reopen_flag = 'yes' AS is_reopened FROM cases"""),
    "lifecycle_unmapped": """SELECT count(*) AS pending, CAST(0 AS BIGINT) AS closed, 'fallback' AS method,
      'ESTIMATED' AS quality FROM orders""",
    "lifecycle_state": with_cases("""SELECT CASE status WHEN 'Closed' THEN 'Closed' WHEN 'Open' THEN 'Active' END AS state,
      status, count(*) AS rows FROM cases GROUP BY ALL"""),
    "resolution_days": with_life("SELECT record_id, round(res_days, 6) AS resolution_days FROM life"),
    "clipped_resolution": with_life(f""", {_P95} SELECT record_id,
      CASE WHEN res_days IS NOT NULL THEN round(least(res_days, cap), 4) END AS clipped_days FROM life, p95"""),
    "pending_age": with_life("SELECT record_id, round(age_days, 6) AS age_days FROM life WHERE is_pending"),
    "fenced_age": with_life(""", aged AS (SELECT record_id, least(pow(age_days / 400, 4), 3650) AS a FROM life WHERE is_pending),
      f AS (SELECT greatest(quantile_cont(a, 0.75) + 3 * (quantile_cont(a, 0.75) - quantile_cont(a, 0.25)), 365) AS fence FROM aged)
      SELECT record_id, round(least(a, fence), 4) AS fenced_days FROM aged, f"""),
    "case_latency": with_life("""SELECT record_id, CASE status WHEN 'Closed' THEN 'Closed' WHEN 'Open' THEN 'Active' END AS state,
      round(CASE WHEN status = 'Closed' AND closing_date IS NOT NULL THEN res_days WHEN status IN ('Closed', 'Open') THEN age_days END
        * 24, 4) AS latency_hours FROM life"""),
    "severity_weight": with_cases("""SELECT record_id, CASE priority WHEN 'high' THEN 3.0 WHEN 'medium' THEN 2.0
      WHEN 'low' THEN 1.0 ELSE 2.0 END AS severity, amount AS criticality FROM cases"""),
    "kpi_counts": with_life(f"SELECT {_COUNTS}, count(*) FILTER (is_pending) AS backlog FROM life"),
    "kpi_rates": with_life(f"SELECT {_RATES} FROM life"),
    "kpi_sla": with_life(f"SELECT sla_compliance_rate, round(100.0 - sla_compliance_rate, 2) AS sla_breach_rate FROM (SELECT {_SLA} FROM life)"),
    "kpi_resolution": with_life(f""", {_P95} SELECT round(avg(least(res_days, cap)) * 24, 2) AS avg_resolution_time,
      round(median(res_days), 2) AS median_resolution_time, round(max(cap), 2) AS p95_resolution_time
      FROM life, p95 WHERE is_closed AND res_days IS NOT NULL"""),
    "kpi_pending_age": with_life(f""", {_FENCE} SELECT round(a, 2) AS avg_pending_age, round(p50, 2) AS median_pending_age,
      round(p95, 2) AS p95_pending_age FROM age"""),
    "kpi_consumers": with_cases(f", {_CONSUMERS} SELECT * FROM consumers"),
    "kpi_growth": with_cases(f""", {_GROWTH} SELECT *, CASE WHEN pct_change IS NULL THEN 'none' WHEN pct_change > 0.5 THEN 'up'
      WHEN pct_change < -0.5 THEN 'down' ELSE 'neutral' END AS direction FROM growth"""),
    "kpi_table": with_life(_KPI_TABLE),
    "officer_productivity": with_life(f""", {_P95} SELECT trim(officer) AS officer, count(*) AS total_cases,
      count(*) FILTER (is_closed) AS closed, count(*) FILTER (is_pending) AS pending, count(*) FILTER (is_reopened) AS reopened,
      round(count(*) FILTER (is_closed) * 100.0 / count(*), 1) AS closure_rate, {_CLIPPED_AVG} AS avg_resolution_days,
      count(*) FILTER (is_pending) AS pending_load FROM life, p95 WHERE officer IS NOT NULL GROUP BY 1"""),
    "category_breakdown": with_life(f""", {_P95} SELECT trim(category) AS category, count(*) AS total,
      count(*) FILTER (is_closed) AS closed, count(*) - count(*) FILTER (is_closed) AS pending,
      round(count(*) FILTER (is_closed) * 100.0 / count(*), 1) AS closure_rate, {_CLIPPED_AVG} AS avg_resolution_days
      FROM life, p95 WHERE category IS NOT NULL GROUP BY 1"""),
    "category_breakdown_closing_only": with_life(""", p95 AS (SELECT quantile_cont(res_days, 0.95) AS cap FROM life)
      SELECT category, count(*) AS total, count(closing_date) AS closed, count(*) - count(closing_date) AS pending,
      round(count(closing_date) * 100.0 / count(*), 1) AS closure_rate,
      round(avg(CASE WHEN res_days IS NOT NULL THEN least(res_days, cap) END), 1) AS avg_resolution_days
      FROM life, p95 GROUP BY 1"""),
    "monthly_trend": with_life("""SELECT strftime(date_trunc('month', registration_date), '%Y-%m') AS period,
      CAST(any_value(year(registration_date)) AS INTEGER) AS year, CAST(any_value(month(registration_date)) AS INTEGER) AS month,
      count(*) AS total, count(*) FILTER (is_closed) AS closed, count(*) - count(*) FILTER (is_closed) AS pending,
      round(count(*) FILTER (is_closed) * 100.0 / count(*), 1) AS closure_rate FROM life GROUP BY 1"""),
    "hierarchy_risk": with_life(_risk("zone")),
    "hierarchy_risk_circles": with_life(_risk("circle")),
    "top_repeat_consumers_all": with_cases("""SELECT consumer_id, count(record_id) AS case_count FROM cases GROUP BY 1
      HAVING count(record_id) > 1"""),
    "pareto_hotspots_all": with_life(""", p AS (SELECT category, division AS administrative_unit, count(*) AS pending_volume FROM life
        WHERE is_pending AND category IS NOT NULL AND division IS NOT NULL GROUP BY 1, 2),
      c AS (SELECT *, row_number() OVER w AS position, sum(pending_volume) OVER w * 100.0 / sum(pending_volume) OVER () AS cum,
        sum(pending_volume) OVER () AS total FROM p
        WINDOW w AS (ORDER BY pending_volume DESC, category, administrative_unit ROWS UNBOUNDED PRECEDING)),
      k AS (SELECT min(position) AS vital FROM c WHERE cum >= 80)
      SELECT CAST(position AS INTEGER) AS position, category, administrative_unit, pending_volume,
        round(pending_volume * 100.0 / total, 4) AS backlog_contribution_pct, CAST(0 AS BIGINT) AS omitted_count FROM c, k
      WHERE position <= vital"""),
    "top_repeat_consumers": with_cases("""SELECT consumer_id, count(record_id) AS case_count FROM cases GROUP BY 1
      HAVING count(record_id) > 1 ORDER BY 2 DESC, 1 LIMIT 20"""),
    "sla_breach_detail": with_life("""SELECT * EXCLUDE (is_closed, is_pending, is_reopened, res_days, age_days, ref_date)
      FROM (SELECT *, NULL AS ref_date, round((epoch_us(closing_date) - epoch_us(sla_deadline)) / 86400000000.0, 1) AS breach_days FROM life)
      WHERE is_closed AND closing_date > sla_deadline"""),
    "executive_kpis": with_life(f""", {_P95}, {_FENCE}
      SELECT (SELECT sla_compliance_rate FROM (SELECT {_SLA} FROM life)) AS sla_compliance,
        (SELECT round(avg(least(res_days, cap)) * 24, 2) FROM life, p95 WHERE is_closed AND res_days IS NOT NULL) AS mttr_hours,
        count(*) AS total_volume, count(*) FILTER (is_pending) AS pending_count,
        round((SELECT a FROM age), 4) AS avg_pending_age_days,
        round(count(*) FILTER (is_pending) * (SELECT a FROM age), 4) AS business_risk_score,
        strftime(min(registration_date), '%Y-%m-%d') AS date_from, strftime(max(registration_date), '%Y-%m-%d') AS date_to,
        'status' AS lifecycle_method, 'MEASURED' AS calculation_quality FROM life"""),
    "executive_deltas": with_life(""", o AS (SELECT *, CASE WHEN row_number() OVER (ORDER BY registration_date, record_id)
          <= (SELECT count(*) // 2 FROM life) THEN 1 ELSE 2 END AS half FROM life),
      caps AS (SELECT half, quantile_cont(res_days, 0.95) AS cap FROM o WHERE is_closed AND res_days IS NOT NULL GROUP BY 1),
      h AS (SELECT half, count(*) AS volume, round(avg(CASE WHEN is_closed AND res_days IS NOT NULL THEN least(res_days, cap) END) * 24, 2) AS mttr,
        round(count(*) FILTER (is_closed AND closing_date <= sla_deadline) * 100.0 / count(*) FILTER (is_closed AND closing_date IS NOT NULL), 2) AS sla
        FROM o JOIN caps USING (half) GROUP BY 1)
      SELECT a.volume AS volume_1, b.volume AS volume_2, a.mttr AS mttr_1, b.mttr AS mttr_2, a.sla AS sla_1, b.sla AS sla_2,
        round(b.sla - a.sla, 4) AS sla_pop_delta, round(b.mttr - a.mttr, 4) AS mttr_pop_delta
      FROM h a, h b WHERE a.half = 1 AND b.half = 2"""),
    "hierarchy_anomalies": with_life(_anomalies("division")),
    "hierarchy_anomalies_officer": with_life(_anomalies("officer")),
    "pareto_hotspots": with_life(""", p AS (SELECT category, division AS administrative_unit, count(*) AS pending_volume FROM life
        WHERE is_pending AND category IS NOT NULL AND division IS NOT NULL GROUP BY 1, 2),
      c AS (SELECT *, row_number() OVER w AS position, sum(pending_volume) OVER w * 100.0 / sum(pending_volume) OVER () AS cum,
        sum(pending_volume) OVER () AS total FROM p
        WINDOW w AS (ORDER BY pending_volume DESC, category, administrative_unit ROWS UNBOUNDED PRECEDING)),
      k AS (SELECT min(position) AS vital FROM c WHERE cum >= 80)
      SELECT CAST(position AS INTEGER) AS position, category, administrative_unit, pending_volume,
        round(pending_volume * 100.0 / total, 4) AS backlog_contribution_pct,
        CASE WHEN vital > 5 THEN vital - 3 ELSE 0 END AS omitted_count FROM c, k
      WHERE position <= CASE WHEN vital > 5 THEN 3 ELSE vital END"""),
    "pareto_hierarchy": with_life(_PARETO_TREE),
}

ORACLE |= {
    "cube_counts": ORACLE["kpi_counts"],
    "cube_rates": ORACLE["kpi_rates"],
    "cube_monthly_trend": ORACLE["monthly_trend"],
    "cube_hierarchy": with_cases("""SELECT zone, circle, division, CAST(count(*) AS BIGINT) AS value,
        CAST(3 - bit_count(grouping(zone, circle, division)) AS INTEGER) AS level
      FROM cases WHERE zone IS NOT NULL AND circle IS NOT NULL AND division IS NOT NULL GROUP BY ROLLUP (zone, circle, division)"""),
}

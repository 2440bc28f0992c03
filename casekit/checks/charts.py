"""Checks: chart datasets, matrices, positions and insight statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from casekit.checks.tables import ROLES, cases, table, with_cases, with_life
from casekit.operators import aggregates, datasets, geo, insights, matrices


def view(s, d):
    return ROLES.view(cases(s, d))


def rounded(df, *columns, digits=2):
    return df.withColumns({c: F.round(c, digits) for c in columns})


def cell_rate(s, d):
    """Wide zone × status table of mean amounts."""
    wide = cases(s, d).groupBy("zone").pivot("status", ["Closed", "Open", "Re-opened"]).agg(F.round(F.avg("amount"), 2))
    return wide.where("zone IS NOT NULL").toDF("zone", "closed", "open", "reopened")


NO_GPS = ROLES.without("latitude", "longitude")


def circle_lookup(s, d):
    """A made key table: one position per officer, some of them missing."""
    sup = table(s, d, "supplier").where("s_suppkey % 3 <> 0")
    return sup.select(
        F.concat(F.lit(" "), F.col("s_name")).alias("key"),
        (F.col("s_suppkey") % 170 - 85).cast("double").alias("lat"),
        (F.col("s_nationkey") * 7 - 80).cast("double").alias("lon"),
    )


def centroids(s, d):
    """Boundary positions from JSON text, as such lookups are delivered."""
    names = table(s, d, "nation").where("n_nationkey % 5 <> 2").agg(
        F.to_json(
            F.map_from_entries(
                F.collect_list(
                    F.struct(
                        F.col("n_name"),
                        F.array((F.col("n_nationkey") * 3 - 30).cast("double"), (F.col("n_nationkey") * 5).cast("double")),
                    )
                )
            )
        ).alias("doc")
    )
    return geo.lookup_from_json(names, "doc")


CIRCLE_ROLES = ROLES.without("latitude", "longitude", "division")
KEY_ROLES = type(ROLES)({**{r: c for r, c in ROLES.columns.items() if r not in ("latitude", "longitude")}, "feeder": "officer"})


def resolved(df):
    return df.select("record_id", "resolved_latitude", "resolved_longitude", "geo_status")


QUERIES = {
    "chart_bar": lambda s, d: rounded(datasets.bar(table(s, d, "lineitem"), "l_suppkey", "l_quantity", "sum", 12, "asc"), "value"),
    "chart_bar_horizontal": lambda s, d: datasets.bar_horizontal(table(s, d, "lineitem"), "l_partkey", most=100),
    "chart_bar_horizontal_all": lambda s, d: datasets.bar_horizontal(table(s, d, "lineitem"), "l_partkey"),
    "chart_bar_facet": lambda s, d: datasets.bar(cases(s, d), "category", group="status", facet="zone"),
    "chart_line_text": lambda s, d: datasets.period_series(cases(s, d), "category", value="amount", agg="max", group="status"),
    "chart_box_outliers": lambda s, d: datasets.box(table(s, d, "lineitem"), "l_extendedprice", ["l_returnflag"], "percentile"),
    "chart_treemap_other": lambda s, d: datasets.hierarchy(cases(s, d), ["zone", "circle"], n=3),
    "chart_bar_grouped": lambda s, d: rounded(
        datasets.bar_grouped(cases(s, d), "circle", "status", "amount", "mean", 8), "value"
    ),
    "stacked_share": lambda s, d: datasets.bar_grouped(cases(s, d), "zone", "status", n=4, normalize=True),
    "chart_pareto": lambda s, d: datasets.pareto(cases(s, d), "circle", n=20),
    "chart_pareto_all": lambda s, d: datasets.pareto(table(s, d, "lineitem"), "l_partkey"),
    "chart_pareto_sum": lambda s, d: rounded(datasets.pareto(cases(s, d), "officer", "amount", "sum", 12, 50.0), "value"),
    "chart_line": lambda s, d: rounded(
        datasets.period_series(cases(s, d), "registration_date", "M", "amount", "sum", "status"), "value"
    ),
    "chart_line_weekly": lambda s, d: datasets.period_series(table(s, d, "events"), "ts", "W"),
    "chart_area": lambda s, d: datasets.area_shares(cases(s, d), "registration_date", "status", "Q"),
    "chart_scatter_agg": lambda s, d: rounded(
        datasets.scatter(table(s, d, "lineitem"), "l_suppkey", "l_quantity", "l_extendedprice"), "x", "y"
    ),
    "chart_scatter_sample": lambda s, d: datasets.scatter_sample(cases(s, d), "amount", "latitude", 500, "record_id"),
    "chart_bubble": lambda s, d: rounded(
        datasets.bubble(table(s, d, "lineitem"), "l_suppkey", "l_quantity", "l_extendedprice", "l_tax", "max"), "x", "y", "size"
    ),
    "chart_share": lambda s, d: datasets.share(cases(s, d), "circle", n=10),
    "chart_share_all": lambda s, d: datasets.share(table(s, d, "lineitem"), "l_suppkey"),
    "chart_histogram": lambda s, d: datasets.histogram(cases(s, d), "amount", 16, "iqr", 0.1),
    "sparkline": lambda s, d: datasets.sparkline(cases(s, d), "registration_date"),
    "sparkline_mean": lambda s, d: rounded(datasets.sparkline(cases(s, d), "registration_date", "Q", "amount"), "value"),
    "calendar_heatmap": lambda s, d: datasets.calendar_heatmap(cases(s, d), "registration_date", least_dates=7),
    "calendar_heatmap_year": lambda s, d: datasets.calendar_heatmap(cases(s, d), "registration_date", year=1998),
    "flow_links": lambda s, d: datasets.flow_links(cases(s, d), ["category", "officer", "status"], 4, 3),
    "peak_hour": lambda s, d: datasets.peak_hour(table(s, d, "events"), "ts", "event_type"),
    "peak_hour_total": lambda s, d: datasets.peak_hour(table(s, d, "events"), "ts"),
    "rolling_average_monthly": lambda s, d: datasets.rolling_average(cases(s, d), "registration_date"),
    "rolling_average_daily_grouped": lambda s, d: datasets.rolling_average(
        table(s, d, "events").withColumn("ts", F.expr("CASE WHEN event_id % 7 <> 3 OR day(ts) % 3 = 0 THEN ts END")),
        "ts", "D", 7, group="event_type",
    ),
    "rolling_average_quarterly_mean": lambda s, d: rounded(
        datasets.rolling_average(cases(s, d), "registration_date", "Q", value="amount", agg="mean"), "value", "rolling_average", digits=4
    ),
    "growth_mom": lambda s, d: datasets.growth(cases(s, d), "registration_date", "circle", n=15),
    "growth_yoy": lambda s, d: datasets.growth(cases(s, d), "registration_date", "zone", "YoY", 3),
    "growth_rolling": lambda s, d: datasets.growth(cases(s, d), "registration_date", "circle", "rolling", 5),
    "pending_age_distribution": lambda s, d: datasets.pending_age_distribution(view(s, d), ROLES),
    "pending_age_distribution_grouped": lambda s, d: datasets.pending_age_distribution(
        view(s, d), ROLES, "zone", "weeks", "percentile"
    ),
    "reopen_analysis": lambda s, d: matrices.reopen_analysis(view(s, d), ROLES, "circle", 3, 15),
    "risk_matrix": lambda s, d: rounded(
        matrices.risk_matrix(view(s, d), ROLES, "category", min_group_size=2), "mean_latency", "median_latency", "avg_severity_weight",
        "reopen_rate", "risk_score", digits=3,
    ),
    "risk_matrix_enterprise": lambda s, d: rounded(
        matrices.risk_matrix(
            cases(s, d).withColumn("business_criticality", F.col("latitude")),
            type(ROLES)({**ROLES.columns, "business_criticality": "business_criticality"}), "zone", min_group_size=2,
        ),
        "mean_latency", "median_latency", "avg_severity_weight", "avg_criticality_weight", "reopen_rate", "risk_score", digits=3,
    ),
    "risk_quadrants": lambda s, d: matrices.risk_quadrants(view(s, d), ROLES, "circle", min_group_size=2).select(
        "circle", "volume", F.round("median_latency", 3).alias("median_latency"),
        F.round("x_threshold", 3).alias("x_threshold"), F.round("y_threshold", 3).alias("y_threshold"), "quadrant",
    ),
    "risk_quadrants_sla": lambda s, d: matrices.risk_quadrants(view(s, d), ROLES, "zone", "sla", min_group_size=2).select(
        "zone", F.round("x_threshold", 3).alias("x_threshold"), F.round("y_threshold", 3).alias("y_threshold"), "quadrant",
    ),
    "performance_matrix": lambda s, d: matrices.performance_matrix(view(s, d), ROLES, n=20),
    "geo_resolve": lambda s, d: resolved(geo.resolve_positions(view(s, d), ROLES)),
    "geo_resolve_lookup": lambda s, d: resolved(
        geo.resolve_positions(KEY_ROLES.view(cases(s, d)), KEY_ROLES, keys=circle_lookup(s, d))
    ),
    "geo_resolve_key_role": lambda s, d: resolved(
        geo.resolve_positions(NO_GPS.view(cases(s, d)), NO_GPS, keys=circle_lookup(s, d), key_role="officer")
    ),
    "geo_resolve_boundary": lambda s, d: resolved(
        geo.resolve_positions(CIRCLE_ROLES.view(cases(s, d)), CIRCLE_ROLES, boundaries=centroids(s, d))
    ),
    "geo_concentration": lambda s, d: geo.concentration(CIRCLE_ROLES.view(cases(s, d)), CIRCLE_ROLES, centroids(s, d)),
    "insight_peak_trough": lambda s, d: insights.peak_trough(datasets.bar(cases(s, d), "circle"), "circle", "value"),
    "insight_anomaly": lambda s, d: insights.anomaly(
        aggregates.group_aggregate(table(s, d, "events"), ["user_id"], "value", "sum"), "value"
    ),
    "insight_concentration": lambda s, d: insights.concentration(datasets.bar(cases(s, d), "category"), ["category"], "value"),
    "insight_concentration_path": lambda s, d: insights.concentration(
        aggregates.group_aggregate(cases(s, d), ["zone", "circle"]), ["zone", "circle"], "value"
    ),
    "insight_flow": lambda s, d: insights.concentration(
        datasets.flow_links(cases(s, d), ["category", "status"], 15), ["source", "target"], "flow", flow=True
    ),
    "insight_trend": lambda s, d: insights.trend(datasets.period_series(cases(s, d), "registration_date"), "period", "value"),
    "insight_peak_hour": lambda s, d: insights.trend(datasets.peak_hour(table(s, d, "events"), "ts"), "hour_label", "value"),
    "insight_spread": lambda s, d: insights.spread(aggregates.describe(table(s, d, "lineitem"), "l_extendedprice", ["l_returnflag"])),
    "insight_matrix": lambda s, d: insights.matrix_extremes(cell_rate(s, d), "zone", ["closed", "open", "reopened"]),
    "insight_pareto": lambda s, d: insights.pareto_summary(datasets.pareto(cases(s, d), "circle", n=20), "circle"),
    "insight_risk": lambda s, d: rounded(
        insights.risk_ranking(matrices.risk_matrix(view(s, d), ROLES, "category", min_group_size=2), "category"), "peak_value", "trough_value"
    ),
    "insight_reopen": lambda s, d: insights.reopen_level(matrices.reopen_analysis(view(s, d), ROLES, "circle", 3, 15), "circle"),
    "insight_geo": lambda s, d: insights.geo_coverage(geo.resolve_positions(view(s, d), ROLES)),
}

_OPEN = "lower(trim(status)) IN ('pending', 'open', 'active', 'in progress', 'inprogress')"
_DONE = "lower(trim(status)) IN ('closed', 'completed', 'resolved', 'finished')"
_CHART_REOPEN = "(lower(trim(status)) IN ('reopened', 're-opened', 'escalated') OR reopen_flag = 'yes')"
_LATENCY = f"CASE WHEN {_DONE} AND closing_date IS NOT NULL THEN res_days WHEN {_DONE} OR {_OPEN} THEN age_days END"
_DESCRIBE = """count(v) AS count, round(avg(v), 2) AS mean, round(stddev_samp(v), 2) AS std, round(min(v), 2) AS min,
  round(quantile_cont(v, 0.25), 2) AS p25, round(quantile_cont(v, 0.5), 2) AS p50, round(quantile_cont(v, 0.75), 2) AS p75,
  round(max(v), 2) AS max"""
_SEVERITY = "CASE priority WHEN 'high' THEN 3.0 WHEN 'medium' THEN 2.0 WHEN 'low' THEN 1.0 ELSE 2.0 END"


def _anomaly(table_name: str) -> str:
    """CTE `odd(is_anomaly)` over column v of a table."""
    return f"""st AS (SELECT count(v) AS n, avg(v) AS m, stddev_pop(v) AS s, quantile_cont(v, 0.25) AS a, quantile_cont(v, 0.75) AS b FROM {table_name}),
      odd AS (SELECT coalesce(max(n) >= 4 AND (bool_or(s > 0 AND abs(v - m) / s > 2.5)
        OR bool_or(b > a AND (v < a - 1.5 * (b - a) OR v > b + 1.5 * (b - a)))), false) AS is_anomaly FROM {table_name}, st)"""


_EXTREMES = """(SELECT label FROM x ORDER BY v DESC, label LIMIT 1) AS peak_label, (SELECT max(v) FROM x) AS peak_value,
  (SELECT label FROM x ORDER BY v, label LIMIT 1) AS trough_label, (SELECT min(v) FROM x) AS trough_value"""


def _concentration(rows: str, flow: bool = False) -> str:
    severity = (
        "CASE WHEN share >= 40 THEN 'warning' ELSE 'info' END" if flow
        else "CASE WHEN share >= 40 THEN 'critical' WHEN share >= 25 THEN 'warning' ELSE 'info' END"
    )
    return with_cases(f""", x AS ({rows}), {_anomaly('x')}, sh AS (SELECT max(v) * 100.0 / sum(v) AS share FROM x)
      SELECT {_EXTREMES}, round(share, 4) AS share_pct, {severity} AS severity, is_anomaly FROM sh, odd""")


def _trend(prefix: str) -> str:
    return f"""{prefix}, y AS (SELECT v, row_number() OVER (ORDER BY label) - 1 AS i FROM x), {_anomaly('x')},
      f AS (SELECT regr_slope(v, i) AS slope, regr_slope(v, i) / abs(avg(v)) * 100.0 AS rel FROM y)
      SELECT {_EXTREMES}, round(slope, 4) AS slope, round(rel, 4) AS relative_slope_pct,
        CASE WHEN rel > 5 THEN 'up' WHEN rel < -5 THEN 'down' ELSE 'stable' END AS direction,
        CASE WHEN rel > 5 THEN 'warning' WHEN rel < -5 THEN 'positive' ELSE 'info' END AS severity, is_anomaly FROM f, odd"""


def _rolling(source: str, date: str, unit: str, step: str, back: int, value: str, group: str | None = None, digits: int = 4) -> str:
    g = f"{group}, " if group else ""
    groups = f", (SELECT DISTINCT {group} FROM c)" if group else ""
    part = f"PARTITION BY {group} " if group else ""
    return f"""c AS (SELECT {g}date_trunc('{unit}', {date}) AS p, {value} AS v FROM {source} GROUP BY ALL),
      spine AS (SELECT * FROM (SELECT unnest(generate_series((SELECT min(p) FROM c), (SELECT max(p) FROM c), INTERVAL {step})) AS p){groups}),
      f AS (SELECT {g}p, coalesce(v, 0) AS v FROM spine LEFT JOIN c USING ({g}p))
      SELECT {g}strftime(p, '%Y-%m-%d') AS period, CAST(round(v, {digits}) AS DOUBLE) AS value,
        round(avg(v) OVER ({part}ORDER BY p ROWS BETWEEN {back} PRECEDING AND CURRENT ROW), {digits}) AS rolling_average FROM f"""


def _growth(category: str, unit: str, n: int, base: str) -> str:
    return with_cases(f""", h AS (SELECT {category} FROM cases WHERE {category} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, {category} LIMIT {n}),
      c AS (SELECT {category}, date_trunc('{unit}', registration_date) AS p, count(*) AS v FROM cases
        WHERE {category} IN (SELECT {category} FROM h) GROUP BY 1, 2),
      f AS (SELECT {category}, p, coalesce(v, 0) AS v FROM (SELECT * FROM (SELECT DISTINCT {category} FROM c), (SELECT DISTINCT p FROM c))
        LEFT JOIN c USING ({category}, p)),
      b AS (SELECT *, {base} AS base, row_number() OVER w AS r FROM f WINDOW w AS (PARTITION BY {category} ORDER BY p))
      SELECT {category}, strftime(p, '%Y-%m-%d') AS period, CAST(v AS DOUBLE) AS value,
        CASE WHEN base <> 0 THEN round((v - base) * 100.0 / base, 4) END AS growth_pct FROM b WHERE r > 1""")


def _calendar(year: str) -> str:
    return f"""WITH c AS (SELECT CAST(o_orderdate AS DATE) AS d, count(*) AS v FROM orders GROUP BY 1),
      y AS (SELECT {year} AS y FROM c),
      s AS (SELECT CAST(unnest(generate_series(make_date((SELECT y FROM y), 1, 1), make_date((SELECT y FROM y), 12, 31), INTERVAL 1 DAY)) AS DATE) AS d)
      SELECT strftime(d, '%Y-%m-%d') AS day, CAST(month(d) AS INTEGER) AS month, CAST(isodow(d) - 1 AS INTEGER) AS weekday,
        CAST(CASE WHEN month(d) = 1 AND week(d) > 50 THEN 1 WHEN month(d) = 12 AND week(d) = 1 THEN 53 ELSE week(d) END AS INTEGER) AS week,
        CAST(coalesce(v, 0) AS DOUBLE) AS value FROM s LEFT JOIN c USING (d)"""


def _peak(group: str | None) -> str:
    g = f"{group}, " if group else ""
    cross = f", (SELECT DISTINCT {group} FROM c)" if group else ""
    return f"""WITH c AS (SELECT {g}hour(ts) AS h, count(*) AS v FROM events GROUP BY ALL),
      s AS (SELECT * FROM (SELECT unnest(range(24)) AS h){cross}),
      f AS (SELECT {g}h, coalesce(v, 0) AS v FROM s LEFT JOIN c USING ({g}h)),
      p AS (SELECT h AS ph FROM f GROUP BY 1 ORDER BY sum(v) DESC, h LIMIT 1)
      SELECT {g}lpad(CAST(h AS VARCHAR), 2, '0') || ':00' AS hour_label, CAST(v AS DOUBLE) AS value, h = ph AS is_peak FROM f, p"""


def _risk_matrix(group: str, model: str, source: str, extra: str = "") -> str:
    score = {
        "advanced": "volume * mean_latency * avg_severity_weight",
        "enterprise": "volume * mean_latency * avg_severity_weight * avg_criticality_weight * (1 + reopen_rate / 100.0)",
    }[model]
    criticality = "avg(greatest(latitude, 0.0)) AS avg_criticality_weight, " if model == "enterprise" else ""
    out = "round(avg_criticality_weight, 3) AS avg_criticality_weight, " if model == "enterprise" else ""
    return f""", w AS (SELECT *, {_LATENCY} AS latency FROM life),
      g AS (SELECT {group}, count(*) AS volume, coalesce(avg(latency), 0) AS mean_latency, coalesce(median(latency), 0) AS median_latency,
        avg({_SEVERITY}) AS avg_severity_weight, {criticality}
        count(*) FILTER ({_CHART_REOPEN}) * 100.0 / count(*) AS reopen_rate FROM w WHERE {group} IS NOT NULL GROUP BY 1 HAVING count(*) >= 2),
      r AS (SELECT *, {score} AS risk_score, '{model}' AS risk_model FROM g)
      SELECT {group}, volume, round(mean_latency, 3) AS mean_latency, round(median_latency, 3) AS median_latency,
        round(avg_severity_weight, 3) AS avg_severity_weight, {out}round(reopen_rate, 3) AS reopen_rate,
        round(risk_score, 3) AS risk_score, risk_model FROM r"""


def _scaled(metric: str) -> str:
    return f"""CASE WHEN count({metric}) OVER () < 2 OR min({metric}) OVER () = max({metric}) OVER () THEN 50.0
      ELSE round(coalesce(({metric} - min({metric}) OVER ()) * 1.0 / (max({metric}) OVER () - min({metric}) OVER ()) * 100.0, 0), 2) END AS {metric}_scaled"""


_CENTROID = "(SELECT n_name AS k, CAST(n_nationkey * 3 - 30 AS DOUBLE) AS lat, CAST(n_nationkey * 5 AS DOUBLE) AS lon FROM nation WHERE n_nationkey % 5 <> 2)"
_GEO_OK = "lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180 AND NOT (lat = 0 AND lon = 0)"

ORACLE = {
    "chart_bar": """SELECT l_suppkey, round(sum(l_quantity), 2) AS value FROM lineitem GROUP BY 1 ORDER BY sum(l_quantity), l_suppkey LIMIT 12""",
    "chart_bar_horizontal": "SELECT l_partkey, count(*) AS value FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 100",
    "chart_bar_horizontal_all": "SELECT l_partkey, count(*) AS value FROM lineitem GROUP BY 1",
    "chart_bar_facet": with_cases("""SELECT category, status, zone, count(*) AS value FROM cases
      WHERE zone IS NOT NULL GROUP BY 1, 2, 3"""),
    "chart_line_text": with_cases("""SELECT category AS period, status, max(amount) AS value FROM cases GROUP BY 1, 2"""),
    "chart_box_outliers": f"""WITH q AS (SELECT quantile_cont(l_extendedprice, 0.01) AS a, quantile_cont(l_extendedprice, 0.99) AS b FROM lineitem),
      k AS (SELECT l_returnflag, l_extendedprice AS v FROM lineitem, q WHERE l_extendedprice BETWEEN a AND b)
      SELECT l_returnflag, {_DESCRIBE} FROM k GROUP BY 1""",
    "chart_treemap_other": with_cases(""", a AS (SELECT zone FROM cases WHERE zone IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, zone LIMIT 3),
      b AS (SELECT circle FROM cases WHERE circle IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, circle LIMIT 3),
      k AS (SELECT CASE WHEN zone IN (SELECT zone FROM a) THEN zone ELSE '(Other)' END AS zone,
        CASE WHEN circle IN (SELECT circle FROM b) THEN circle ELSE '(Other)' END AS circle FROM cases)
      SELECT zone, circle, count(*) AS value, 2 AS level FROM k GROUP BY 1, 2
      UNION ALL SELECT zone, NULL, count(*), 1 FROM k GROUP BY 1 UNION ALL SELECT NULL, NULL, count(*), 0 FROM k"""),
    "chart_pareto_all": """WITH t AS (SELECT l_partkey, count(*) AS value FROM lineitem GROUP BY 1),
      c AS (SELECT *, CAST((20000 * sum(value) OVER (ORDER BY value DESC, l_partkey ROWS UNBOUNDED PRECEDING) + (sum(value) OVER ())) // (2 * (sum(value) OVER ())) AS DOUBLE) / 100 AS cumulative_pct FROM t)
      SELECT *, CASE WHEN coalesce(lag(cumulative_pct) OVER (ORDER BY value DESC, l_partkey), 0) < 80 THEN 'Vital Few' ELSE 'Trivial Many' END AS pareto_class FROM c""",
    "chart_share_all": """SELECT l_suppkey, count(*) AS value, CAST((20000 * count(*) + (sum(count(*)) OVER ())) // (2 * (sum(count(*)) OVER ())) AS DOUBLE) / 100 AS share_pct
      FROM lineitem GROUP BY 1""",
    "chart_scatter_sample": with_cases("""SELECT record_id, amount AS x, latitude AS y FROM cases WHERE amount IS NOT NULL AND latitude IS NOT NULL
      ORDER BY md5('42:' || CAST(record_id AS VARCHAR)), record_id LIMIT 500"""),
    "chart_bar_grouped": with_cases(""", a AS (SELECT circle, status, avg(amount) AS v FROM cases WHERE circle IS NOT NULL GROUP BY 1, 2),
      t AS (SELECT circle FROM a GROUP BY 1 ORDER BY sum(v) DESC, circle LIMIT 8)
      SELECT circle, status, round(v, 2) AS value FROM a WHERE circle IN (SELECT circle FROM t)"""),
    "stacked_share": with_cases(""", a AS (SELECT zone, status, count(*) AS value FROM cases WHERE zone IS NOT NULL GROUP BY 1, 2),
      t AS (SELECT zone FROM a GROUP BY 1 ORDER BY sum(value) DESC, zone LIMIT 4)
      SELECT zone, status, value, CAST((20000 * value + (sum(value) OVER (PARTITION BY zone))) // (2 * (sum(value) OVER (PARTITION BY zone))) AS DOUBLE) / 100 AS share_pct
      FROM a WHERE zone IN (SELECT zone FROM t)"""),
    "chart_pareto": with_cases(""", t AS (SELECT circle, count(*) AS value FROM cases WHERE circle IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20),
      c AS (SELECT *, CAST((20000 * sum(value) OVER (ORDER BY value DESC, circle ROWS UNBOUNDED PRECEDING) + (sum(value) OVER ())) // (2 * (sum(value) OVER ())) AS DOUBLE) / 100 AS cumulative_pct FROM t)
      SELECT *, CASE WHEN coalesce(lag(cumulative_pct) OVER (ORDER BY value DESC, circle), 0) < 80 THEN 'Vital Few' ELSE 'Trivial Many' END AS pareto_class FROM c"""),
    "chart_pareto_sum": with_cases(""", t AS (SELECT officer, sum(amount) AS v FROM cases WHERE officer IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 12),
      c AS (SELECT *, round(sum(v) OVER (ORDER BY v DESC, officer ROWS UNBOUNDED PRECEDING) * 100.0 / sum(v) OVER (), 2) AS cumulative_pct FROM t)
      SELECT officer, round(v, 2) AS value, cumulative_pct,
        CASE WHEN coalesce(lag(cumulative_pct) OVER (ORDER BY v DESC, officer), 0) < 50 THEN 'Vital Few' ELSE 'Trivial Many' END AS pareto_class FROM c"""),
    "chart_line": with_cases("""SELECT strftime(date_trunc('month', registration_date), '%Y-%m-%d') AS period, status,
      round(sum(amount), 2) AS value FROM cases GROUP BY 1, 2"""),
    "chart_line_weekly": "SELECT strftime(date_trunc('week', ts), '%Y-%m-%d') AS period, count(*) AS value FROM events GROUP BY 1",
    "chart_area": with_cases(""", a AS (SELECT strftime(date_trunc('quarter', registration_date), '%Y-%m-%d') AS period, status, count(*) AS value
      FROM cases GROUP BY 1, 2) SELECT *, CAST((20000 * value + (sum(value) OVER (PARTITION BY period))) // (2 * (sum(value) OVER (PARTITION BY period))) AS DOUBLE) / 100 AS share_pct FROM a"""),
    "chart_scatter_agg": "SELECT l_suppkey, round(avg(l_quantity), 2) AS x, round(avg(l_extendedprice), 2) AS y FROM lineitem GROUP BY 1",
    "chart_bubble": """SELECT l_suppkey, max(l_quantity) AS x, max(l_extendedprice) AS y, round(sum(l_tax), 2) AS size FROM lineitem GROUP BY 1""",
    "chart_share": with_cases(""", t AS (SELECT circle, count(*) AS value FROM cases WHERE circle IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10)
      SELECT *, CAST((20000 * value + (sum(value) OVER ())) // (2 * (sum(value) OVER ())) AS DOUBLE) / 100 AS share_pct FROM t"""),
    "chart_histogram": """WITH q AS (SELECT quantile_cont(o_totalprice, 0.25) AS a, quantile_cont(o_totalprice, 0.75) AS b FROM orders),
      k AS (SELECT o_totalprice AS v FROM orders, q WHERE o_totalprice BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a)),
      l AS (SELECT min(v) AS low, (max(v) - min(v)) / 16 AS width FROM k),
      c AS (SELECT least(CAST(floor((v - low) / width) AS BIGINT), 15) AS bin, count(*) AS n FROM k, l GROUP BY 1)
      SELECT s.bin, round(low + s.bin * width, 6) AS lower, round(low + (s.bin + 1) * width, 6) AS upper, coalesce(n, 0) AS count
      FROM (SELECT unnest(range(16)) AS bin) s LEFT JOIN c USING (bin), l""",
    "sparkline": """WITH t AS (SELECT strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS period, count(*) AS value FROM orders GROUP BY 1)
      SELECT *, CASE WHEN (SELECT arg_max(value, period) FROM t) > (SELECT arg_min(value, period) FROM t) THEN 'up'
        WHEN (SELECT arg_max(value, period) FROM t) < (SELECT arg_min(value, period) FROM t) THEN 'down' ELSE 'neutral' END AS direction FROM t""",
    "sparkline_mean": """WITH t AS (SELECT strftime(date_trunc('quarter', o_orderdate), '%Y-%m-%d') AS period, avg(o_totalprice) AS v FROM orders GROUP BY 1)
      SELECT period, round(v, 2) AS value, CASE WHEN (SELECT arg_max(v, period) FROM t) > (SELECT arg_min(v, period) FROM t) THEN 'up'
        WHEN (SELECT arg_max(v, period) FROM t) < (SELECT arg_min(v, period) FROM t) THEN 'down' ELSE 'neutral' END AS direction FROM t""",
    "calendar_heatmap": _calendar("year(max(d))"),
    "calendar_heatmap_year": _calendar("any_value(1998)"),
    "flow_links": with_cases(""", a AS (SELECT category FROM cases WHERE category IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, category LIMIT 4),
      b AS (SELECT officer FROM cases WHERE officer IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, officer LIMIT 4),
      k AS (SELECT CASE WHEN category IN (SELECT category FROM a) THEN category ELSE '(Other)' END AS category,
        CASE WHEN officer IN (SELECT officer FROM b) THEN officer ELSE '(Other)' END AS officer, status FROM cases)
      SELECT * FROM (SELECT 1 AS step, 'category' AS source_level, category AS source, 'officer' AS target_level, officer AS target, count(*) AS flow
        FROM k GROUP BY ALL UNION ALL SELECT 2, 'officer', officer, 'status', status, count(*) FROM k GROUP BY ALL) WHERE flow >= 3"""),
    "peak_hour": _peak("event_type"),
    "peak_hour_total": _peak(None),
    "rolling_average_monthly": "WITH " + _rolling("orders", "o_orderdate", "month", "1 MONTH", 2, "count(*)"),
    "rolling_average_daily_grouped": "WITH e AS (SELECT * FROM (SELECT * REPLACE (CASE WHEN event_id % 7 <> 3 OR day(ts) % 3 = 0 THEN ts END AS ts) FROM events) WHERE ts IS NOT NULL), "
    + _rolling("e", "ts", "day", "1 DAY", 6, "count(*)", "event_type"),
    "rolling_average_quarterly_mean": "WITH " + _rolling("orders", "o_orderdate", "quarter", "3 MONTH", 1, "avg(o_totalprice)"),
    "growth_mom": _growth("circle", "month", 15, "lag(v) OVER w"),
    "growth_yoy": _growth("zone", "year", 3, "lag(v) OVER w"),
    "growth_rolling": _growth("circle", "month", 5, "avg(v) OVER (PARTITION BY circle ORDER BY p ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)"),
    "pending_age_distribution": with_cases(f""", r AS (SELECT max(registration_date) AS m FROM cases WHERE {_OPEN}),
      a AS (SELECT (epoch_us(m) - epoch_us(registration_date)) / 86400000000.0 AS v FROM cases, r WHERE {_OPEN})
      SELECT {_DESCRIBE} FROM a"""),
    "pending_age_distribution_grouped": with_cases(f""", r AS (SELECT max(registration_date) AS m FROM cases WHERE {_OPEN}),
      a AS (SELECT zone, (epoch_us(m) - epoch_us(registration_date)) / 604800000000.0 AS v FROM cases, r WHERE {_OPEN}),
      q AS (SELECT quantile_cont(v, 0.01) AS lo, quantile_cont(v, 0.99) AS hi FROM a)
      SELECT zone, {_DESCRIBE} FROM a, q WHERE v BETWEEN lo AND hi AND zone IS NOT NULL GROUP BY 1"""),
    "reopen_analysis": with_cases(f"""SELECT circle, count(*) AS total_cases, count(*) FILTER ({_CHART_REOPEN}) AS reopened_cases,
      round(count(*) FILTER ({_CHART_REOPEN}) * 100.0 / count(*), 2) AS reopen_rate,
      (SELECT round(count(*) FILTER ({_CHART_REOPEN}) * 100.0 / count(*), 2) FROM cases) AS overall_rate
      FROM cases WHERE circle IS NOT NULL GROUP BY 1 HAVING count(*) >= 3 ORDER BY reopen_rate DESC, circle LIMIT 15"""),
    "risk_matrix": with_life(_risk_matrix("category", "advanced", "life")),
    "risk_matrix_enterprise": with_life(_risk_matrix("zone", "enterprise", "life")),
    "risk_quadrants": with_life(f""", w AS (SELECT *, {_LATENCY} AS latency FROM life),
      g AS (SELECT circle, count(*) AS volume, coalesce(median(latency), 0) AS med FROM w WHERE circle IS NOT NULL GROUP BY 1 HAVING count(*) >= 2),
      t AS (SELECT median(volume) AS x, median(med) AS y FROM g)
      SELECT circle, volume, round(med, 3) AS median_latency, round(x, 3) AS x_threshold, round(y, 3) AS y_threshold,
        CASE WHEN volume > x THEN 'High Volume' ELSE 'Low Volume' END || ' / ' || CASE WHEN med > y THEN 'High Latency' ELSE 'Low Latency' END AS quadrant
      FROM g, t"""),
    "risk_quadrants_sla": with_life(f""", w AS (SELECT *, {_LATENCY} AS latency FROM life),
      g AS (SELECT zone, count(*) AS volume, coalesce(median(latency), 0) AS med FROM w WHERE zone IS NOT NULL GROUP BY 1 HAVING count(*) >= 2),
      t AS (SELECT (SELECT median(volume) FROM g) AS x, avg((epoch_us(sla_deadline) - epoch_us(registration_date)) / 86400000000.0) AS y FROM life)
      SELECT zone, round(x, 3) AS x_threshold, round(y, 3) AS y_threshold,
        CASE WHEN volume > x THEN 'High Volume' ELSE 'Low Volume' END || ' / ' || CASE WHEN med > y THEN 'High Latency' ELSE 'Low Latency' END AS quadrant
      FROM g, t"""),
    "performance_matrix": with_life(f""", w AS (SELECT *, {_LATENCY} AS latency FROM life),
      g AS (SELECT officer, count(*) AS total_cases, count(*) FILTER ({_DONE}) AS resolved_count, count(*) FILTER ({_OPEN}) AS backlog,
        count(*) FILTER ({_OPEN}) AS workload, round(count(*) FILTER ({_DONE}) * 100.0 / count(*), 2) AS throughput_pct,
        round(avg(latency) FILTER ({_DONE}), 2) AS avg_resolution, round(median(latency) FILTER ({_DONE}), 2) AS median_resolution,
        round(count(*) FILTER ({_DONE} AND closing_date <= sla_deadline) * 100.0 / nullif(count(*) FILTER ({_DONE} AND closing_date IS NOT NULL), 0), 2)
          AS sla_compliance_pct,
        round(count(*) FILTER (reopen_flag = 'yes') * 100.0 / count(*), 2) AS reopen_rate_pct
      FROM w WHERE officer IS NOT NULL GROUP BY 1 ORDER BY total_cases DESC, officer LIMIT 20)
      SELECT *, {', '.join(_scaled(m) for m in matrices.PERFORMANCE_METRICS)} FROM g"""),
    "geo_resolve": with_cases(f""", p AS (SELECT record_id, latitude AS lat, longitude AS lon FROM cases)
      SELECT record_id, CASE WHEN {_GEO_OK} THEN lat END AS resolved_latitude, CASE WHEN {_GEO_OK} THEN lon END AS resolved_longitude,
        CASE WHEN {_GEO_OK} THEN 'Resolved (Exact GPS)' ELSE 'Dropped' END AS geo_status FROM p"""),
    "geo_resolve_lookup": with_cases(f""", p AS (SELECT record_id, CAST(s_suppkey % 170 - 85 AS DOUBLE) AS lat, CAST(s_nationkey * 7 - 80 AS DOUBLE) AS lon
        FROM cases LEFT JOIN (SELECT * FROM supplier WHERE s_suppkey % 3 <> 0) ON s_name = officer)
      SELECT record_id, CASE WHEN {_GEO_OK} THEN lat END AS resolved_latitude, CASE WHEN {_GEO_OK} THEN lon END AS resolved_longitude,
        CASE WHEN {_GEO_OK} THEN 'Resolved (Key Lookup)' ELSE 'Dropped' END AS geo_status FROM p"""),
    "geo_resolve_boundary": with_cases(f""", p AS (SELECT record_id, lat, lon FROM cases LEFT JOIN {_CENTROID} ON k = circle)
      SELECT record_id, CASE WHEN {_GEO_OK} THEN lat END AS resolved_latitude, CASE WHEN {_GEO_OK} THEN lon END AS resolved_longitude,
        CASE WHEN {_GEO_OK} THEN 'Resolved (Boundary Centroid)' ELSE 'Dropped' END AS geo_status FROM p"""),
    "geo_concentration": with_cases(f""", g AS (SELECT circle AS boundary, any_value(lat) AS lat, any_value(lon) AS lon, count(*) AS case_count
        FROM cases JOIN {_CENTROID} ON k = circle WHERE {_GEO_OK} GROUP BY 1)
      SELECT *, round(6.0 + 24.0 * case_count / max(case_count) OVER (), 4) AS radius, round(avg(lat) OVER (), 4) AS center_lat,
        round(avg(lon) OVER (), 4) AS center_lon FROM g"""),
    "insight_peak_trough": with_cases(f", x AS (SELECT circle AS label, CAST(count(*) AS DOUBLE) AS v FROM cases WHERE circle IS NOT NULL GROUP BY 1) SELECT {_EXTREMES}"),
    "insight_anomaly": f"""WITH x AS (SELECT sum(value) AS v FROM events WHERE user_id IS NOT NULL GROUP BY user_id), {_anomaly('x')}
      SELECT (SELECT count(v) FROM x) AS points, is_anomaly FROM odd""",
    "insight_concentration": _concentration("SELECT category AS label, CAST(count(*) AS DOUBLE) AS v FROM cases GROUP BY 1"),
    "insight_concentration_path": _concentration(
        "SELECT zone || ' › ' || circle AS label, CAST(count(*) AS DOUBLE) AS v FROM cases WHERE zone IS NOT NULL AND circle IS NOT NULL GROUP BY 1"
    ),
    "insight_flow": _concentration("SELECT category || ' → ' || status AS label, CAST(count(*) AS DOUBLE) AS v FROM cases GROUP BY 1", True),
    "insight_trend": _trend("WITH x AS (SELECT strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS label, CAST(count(*) AS DOUBLE) AS v FROM orders GROUP BY 1)"),
    "insight_peak_hour": _trend("""WITH x AS (SELECT lpad(CAST(h AS VARCHAR), 2, '0') || ':00' AS label, CAST(coalesce(n, 0) AS DOUBLE) AS v
      FROM (SELECT unnest(range(24)) AS h) LEFT JOIN (SELECT hour(ts) AS h, count(*) AS n FROM events GROUP BY 1) USING (h))"""),
    "insight_spread": """WITH g AS (SELECT l_returnflag, count(*) AS n, round(avg(l_extendedprice), 2) AS m, round(stddev_samp(l_extendedprice), 2) AS s,
        min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem GROUP BY 1),
      a AS (SELECT sum(m * n) / sum(n) AS mean, avg(s) AS std, min(lo) AS lo, max(hi) AS hi FROM g)
      SELECT round(mean, 4) AS mean, round(std, 4) AS std, lo AS min, hi AS max, round(std / mean * 100.0, 4) AS spread_pct,
        CASE WHEN std / mean * 100 >= 75 THEN 'warning' WHEN std / mean * 100 >= 35 THEN 'info' ELSE 'positive' END AS severity,
        greatest(abs(hi - mean), abs(mean - lo)) / std > 2.5 AS is_anomaly FROM a""",
    "insight_matrix": with_cases(f""", x AS (SELECT zone || ' × ' || CASE status WHEN 'Closed' THEN 'closed' WHEN 'Open' THEN 'open' ELSE 'reopened' END AS label,
        round(avg(amount), 2) AS v FROM cases WHERE zone IS NOT NULL GROUP BY 1), {_anomaly('x')}
      SELECT {_EXTREMES}, (SELECT round(avg(v), 4) FROM x) AS mean_value, is_anomaly, CASE WHEN is_anomaly THEN 'warning' ELSE 'info' END AS severity FROM odd"""),
    "insight_pareto": with_cases(f""", x AS (SELECT circle AS label, CAST(count(*) AS DOUBLE) AS v FROM cases WHERE circle IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20),
      c AS (SELECT *, round(sum(v) OVER (ORDER BY v DESC, label ROWS UNBOUNDED PRECEDING) * 100.0 / sum(v) OVER (), 2) AS cum FROM x),
      p AS (SELECT *, coalesce(lag(cum) OVER (ORDER BY v DESC, label), 0) < 80 AS vital FROM c), {_anomaly('x')},
      s AS (SELECT count(*) FILTER (vital) AS vital_few, count(*) AS categories FROM p)
      SELECT {_EXTREMES}, vital_few, categories, round(vital_few * 100.0 / categories, 4) AS vital_pct,
        vital_few > 0 AND vital_few * 100.0 / categories <= 40 AS is_concentrated,
        CASE WHEN vital_few > 0 AND vital_few * 100.0 / categories <= 40 THEN 'warning' ELSE 'info' END AS severity, is_anomaly FROM s, odd"""),
    "insight_risk": with_life(f""", w AS (SELECT *, {_LATENCY} AS latency FROM life),
      x AS (SELECT category AS label, count(*) * coalesce(avg(latency), 0) * avg({_SEVERITY}) AS v FROM w GROUP BY 1), {_anomaly('x')}
      SELECT (SELECT label FROM x ORDER BY v DESC, label LIMIT 1) AS peak_label, (SELECT round(max(v), 2) FROM x) AS peak_value,
        (SELECT label FROM x ORDER BY v, label LIMIT 1) AS trough_label, (SELECT round(min(v), 2) FROM x) AS trough_value,
        is_anomaly, CASE WHEN is_anomaly THEN 'critical' ELSE 'info' END AS severity FROM odd"""),
    "insight_reopen": with_cases(f""", x AS (SELECT circle AS label, round(count(*) FILTER ({_CHART_REOPEN}) * 100.0 / count(*), 2) AS v FROM cases
        WHERE circle IS NOT NULL GROUP BY 1 HAVING count(*) >= 3 ORDER BY v DESC, label LIMIT 15), {_anomaly('x')}
      SELECT {_EXTREMES}, CASE WHEN (SELECT max(v) FROM x) >= 20 THEN 'critical' WHEN (SELECT max(v) FROM x) >= 10 THEN 'warning' ELSE 'positive' END AS severity,
        is_anomaly FROM odd"""),
    "insight_geo": with_cases(f""", p AS (SELECT latitude AS lat, longitude AS lon FROM cases),
      c AS (SELECT count(*) AS total, count(*) FILTER ({_GEO_OK}) AS resolved FROM p)
      SELECT total, resolved, round(resolved * 100.0 / total, 4) AS coverage_pct, CASE WHEN resolved * 100.0 / total >= 90 THEN 'positive'
        WHEN resolved * 100.0 / total >= 50 THEN 'info' ELSE 'warning' END AS severity, resolved * 100.0 / total < 50 AS is_anomaly FROM c"""),
}
ORACLE["geo_resolve_key_role"] = ORACLE["geo_resolve_lookup"]

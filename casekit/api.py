"""One object over a case table: filters, KPIs, breakdowns, charts and insights as DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame

from casekit.operators import aggregates, breakdowns, datasets, executive, filters, geo, insights, kpis, matrices
from casekit.plans import roles as R
from casekit.plans.roles import Roles, eligibility_report, ineligible

# Chart name → builder over a role view. Keyword arguments go to the builder.
CHARTS: dict[str, Callable[..., DataFrame]] = {
    "bar": datasets.bar,
    "bar_horizontal": datasets.bar_horizontal,
    "bar_grouped": datasets.bar_grouped,
    "bar_stacked": datasets.bar_grouped,
    "line": datasets.period_series,
    "area": datasets.area_shares,
    "scatter": datasets.scatter,
    "scatter_sample": datasets.scatter_sample,
    "bubble": datasets.bubble,
    "pie": datasets.share,
    "donut": datasets.share,
    "histogram": datasets.histogram,
    "box": datasets.box,
    "sparkline": datasets.sparkline,
    "treemap": datasets.hierarchy,
    "sunburst": datasets.hierarchy,
    "heatmap": aggregates.crosstab,
    "correlation": aggregates.correlation_matrix,
    "calendar_heatmap": datasets.calendar_heatmap,
    "pareto": datasets.pareto,
    "sankey": datasets.flow_links,
    "peak_hour": datasets.peak_hour,
    "rolling_average": datasets.rolling_average,
    "growth_heatmap": datasets.growth,
}
# The same for charts that also look at the role binding.
ROLE_CHARTS: dict[str, Callable[..., DataFrame]] = {
    "pending_age_distribution": datasets.pending_age_distribution,
    "reopen_analysis": matrices.reopen_analysis,
    "risk_matrix": matrices.risk_matrix,
    "risk_quadrants": matrices.risk_quadrants,
    "performance_matrix": matrices.performance_matrix,
    "geo": geo.resolve_positions,
    "geo_concentration": geo.concentration,
}
# Other names under which charts are asked for.
ALIASES = {
    "peak_complaint_hour": "peak_hour",
    "rolling_average_trend": "rolling_average",
    "officer_performance_matrix": "performance_matrix",
    "reopened_complaint_analysis": "reopen_analysis",
    "geographical_concentration_map": "geo_concentration",
}
# Roles that a chart cannot do without, beside those named in its parameters.
CHART_ROLES = {"pending_age_distribution": (R.REGISTRATION_DATE,)}
# Parameters that name a role.
COLUMN_PARAMETERS = ("x", "y", "group", "value", "date", "category", "size", "facet", "key")
COLUMN_LISTS = ("path", "levels", "keys", "columns")


class CaseTable:
    """A case table and its role binding.

    Results are DataFrames. Some methods run small jobs while they build them, and write what several steps start
    from to the staging folder: `executive`, `breakdowns` and `kpis` do, and the charts with outlier limits,
    tiers, running shares or gaps that are filled.
    """

    def __init__(self, df: DataFrame, roles: Roles, reference_date: str | None = None):
        self.roles = roles
        self.reference_date = reference_date
        self.view = roles.view(df)

    def _over(self, view: DataFrame) -> CaseTable:
        other = object.__new__(CaseTable)
        other.roles, other.reference_date, other.view = self.roles, self.reference_date, view
        return other

    def filtered(self, state: Mapping[str, Any], drill_path: Sequence[tuple[str, str]] = ()) -> CaseTable:
        return self._over(filters.apply_filters(self.view, self.roles, state, drill_path))

    def between(self, start: str | None, end: str | None, role: str = R.REGISTRATION_DATE) -> CaseTable:
        """Chart date range with the bounds exactly as given."""
        return self._over(filters.chart_date_range(self.view, role, start, end)) if self.roles.has(role) else self

    def eligibility(self) -> DataFrame:
        return eligibility_report(self.view.sparkSession, self.roles)

    def kpis(self) -> DataFrame:
        return kpis.kpi_table(self.view, self.roles, self.reference_date)

    def breakdowns(self, top_consumers: int = 0) -> dict[str, DataFrame]:
        v, r = self.view, self.roles
        return {
            "officer_productivity": breakdowns.officer_productivity(v, r),
            "category_breakdown": breakdowns.category_breakdown(v, r),
            "monthly_trend": breakdowns.monthly_trend(v, r),
            "hierarchy_risk": breakdowns.hierarchy_risk(v, r, self.reference_date),
            "top_repeat_consumers": breakdowns.top_repeat_consumers(v, r, top_consumers),
            "sla_breach_detail": breakdowns.sla_breach_detail(v, r),
        }

    def executive(self) -> dict[str, DataFrame]:
        """Headline numbers, deltas, anomalies and both Pareto views; needs a registration date."""
        if not self.roles.has(R.REGISTRATION_DATE):
            return {"executive_kpis": ineligible(self.view.sparkSession, "executive", [R.REGISTRATION_DATE])}
        v, r = self.view, self.roles
        out = {"executive_kpis": executive.executive_kpis(v, r)}
        if not r.missing([R.CLOSING_DATE, R.SLA_DEADLINE]):
            out["executive_deltas"] = executive.executive_deltas(v, r)
        unit = executive.lowest_unit(executive.dated(v), r)
        if unit:
            out["hierarchy_anomalies"] = executive.hierarchy_anomalies(v, r, unit)
            out["pareto_hierarchy"] = executive.pareto_hierarchy(v, r)
            if r.has(R.CATEGORY):
                out["pareto_hotspots"] = executive.pareto_hotspots(v, r, unit)
        return out

    def chart(self, kind: str, date_range: tuple[str | None, str | None] | None = None, **params: Any) -> DataFrame:
        """A chart's dataset. A chart, role or key that there is not, or that is not mapped, gives an ineligible row."""
        kind = ALIASES.get(kind, kind)
        if kind not in ROLE_CHARTS and kind not in CHARTS:
            return ineligible(self.view.sparkSession, kind, ["a known chart"])
        source = self.between(*date_range) if date_range else self
        wanted = [params[p] for p in COLUMN_PARAMETERS if isinstance(params.get(p), str)]
        wanted += [c for p in COLUMN_LISTS if isinstance(params.get(p), (list, tuple)) for c in params[p]]
        wanted += CHART_ROLES.get(kind, ())
        missing = [c for c in dict.fromkeys(wanted) if c not in source.view.columns]
        missing = missing or R.groupable(source.view, *dict.fromkeys(wanted))
        if missing:
            return ineligible(self.view.sparkSession, kind, missing)
        if kind in ROLE_CHARTS:
            return ROLE_CHARTS[kind](source.view, self.roles, **params)
        return CHARTS[kind](source.view, **params)


# Insight per kind of chart dataset.
INSIGHTS: dict[str, Callable[..., DataFrame]] = {
    "categorical": insights.concentration,
    "hierarchy": insights.concentration,
    "flow": insights.concentration,
    "time_series": insights.trend,
    "peak_hour": insights.trend,
    "distribution": insights.spread,
    "matrix": insights.matrix_extremes,
    "pareto": insights.pareto_summary,
    "risk": insights.risk_ranking,
    "reopen": insights.reopen_level,
    "geo": insights.geo_coverage,
}

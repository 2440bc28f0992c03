"""Reopen analysis, risk matrix and performance matrix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casekit.functions.expressions import US_PER_UNIT, attach_row, in_tokens, rate, us_between
from casekit.functions.order_stats import Quantile, quantiles_of
from casekit.operators import lifecycle as L
from casekit.operators.lifecycle import CHART_WORDS
from casekit.plans import roles as R
from casekit.plans.roles import Roles, ineligible
from casekit.sources.files import settle


def reopen_analysis(view: DataFrame, roles: Roles, group: str, min_group_size: int = 1, n: int = 0,
                    order: str = "desc") -> DataFrame:
    """Reopen rate per group against the overall rate; groups that are too small are left out."""
    work = view.withColumn("reopened", L.reopened(roles, CHART_WORDS))
    overall = work.agg(rate(F.count_if("reopened"), F.count(F.lit(1)))).scalar()
    groups = (
        work.where(F.col(group).isNotNull())
        .groupBy(group)
        .agg(
            F.count(F.lit(1)).alias("total_cases"),
            F.count_if("reopened").alias("reopened_cases"),
            rate(F.count_if("reopened"), F.count(F.lit(1))).alias("reopen_rate"),
        )
        .where(F.col("total_cases") >= max(min_group_size, 1))
    )
    first = F.asc("reopen_rate") if order == "asc" else F.desc("reopen_rate")
    ordered = groups.orderBy(first, group)
    return (ordered.limit(n) if n > 0 else ordered).withColumn("overall_rate", overall)


def risk_matrix(view: DataFrame, roles: Roles, group: str, unit: str = "days", min_group_size: int = 1,
                model: str | None = None, analysis_date: str | None = None) -> DataFrame:
    """Volume, latency, weights, reopen rate and risk score per group."""
    model = L.risk_model(roles, model)
    states = L.lifecycle_state(view, roles)
    work = L.with_latency(states, roles, unit, analysis_date) if model != "minimum" else states.withColumn(
        "latency", F.lit(None).cast("double")
    )
    work = work.where(F.col(group).isNotNull()).withColumn("reopened", L.reopened(roles, CHART_WORDS))
    measures = {
        "volume": F.count(F.lit(1)),
        "mean_latency": F.coalesce(F.avg("latency"), F.lit(0.0)),
        "reopen_rate": F.coalesce(F.count_if("reopened") * 100.0 / F.count(F.lit(1)), F.lit(0.0)),
    }
    severity = F.lit(1.0)
    criticality = F.lit(1.0)
    if roles.has(R.PRIORITY):
        measures["avg_severity_weight"] = F.avg(L.weight(view, R.PRIORITY, 2.0))
        severity = F.col("avg_severity_weight")
    if roles.has(R.BUSINESS_CRITICALITY):
        measures["avg_criticality_weight"] = F.avg(L.weight(view, R.BUSINESS_CRITICALITY, 1.0))
        criticality = F.col("avg_criticality_weight")
    groups = work.groupBy(group).agg(*[m.alias(k) for k, m in measures.items()])
    groups = groups.where(F.col("volume") >= max(min_group_size, 1))
    middle = quantiles_of(work, "latency", [Quantile("median_latency", 0.5)], [group]).select(group, "median_latency")
    groups = groups.join(middle, group, "left").fillna(0.0, ["median_latency"])
    score = {
        "minimum": F.col("volume").cast("double"),
        "standard": F.col("volume") * F.col("mean_latency"),
        "advanced": F.col("volume") * F.col("mean_latency") * severity,
        "enterprise": F.col("volume") * F.col("mean_latency") * severity * criticality
        * (1.0 + F.col("reopen_rate") / 100.0),
    }[model]
    scored = groups.withColumns({"risk_score": score, "risk_model": F.lit(model)})
    # When nothing scores, volume takes the place of the score.
    best = scored.agg(F.max("risk_score")).scalar()
    return scored.withColumn("risk_score", F.when(best <= 0, F.col("volume").cast("double")).otherwise(F.col("risk_score")))


def risk_quadrants(view: DataFrame, roles: Roles, group: str, thresholds: str = "median", percentile: float = 75.0,
                   x_threshold: float | None = None, y_threshold: float | None = None, **kwargs) -> DataFrame:
    """The risk matrix with each group's quadrant.

    Thresholds: median, mean, percentile, static (the given numbers, else median) or sla (mean allowed span).
    """
    matrix = risk_matrix(view, roles, group, **kwargs)
    by_sla = thresholds == "sla" and not roles.missing([R.SLA_DEADLINE, R.REGISTRATION_DATE])
    method = thresholds if thresholds in ("mean", "percentile") else "median"
    prob = min(max(percentile, 0.0), 100.0) / 100.0 if method == "percentile" else 0.5

    matrix = settle(matrix, "groups")

    def cut(column: str, fixed: float | None) -> Column:
        if fixed is not None:
            return F.lit(float(fixed))
        if method == "mean":
            return matrix.agg(F.avg(column).cast("double")).scalar()
        return quantiles_of(matrix, column, [Quantile("q", prob)]).select("q").scalar()

    cuts = view.sparkSession.range(1).select(
        cut("volume", x_threshold).alias("x_threshold"),
        cut("median_latency", None if by_sla else y_threshold).alias("y_threshold"),
    )
    if by_sla:
        allowed = us_between(R.REGISTRATION_DATE, R.SLA_DEADLINE) / F.lit(US_PER_UNIT[kwargs.get("unit", "days")])
        mean_allowed = L.lifecycle_state(view, roles).agg(F.avg(allowed)).scalar()
        cuts = cuts.withColumn("y_threshold", F.coalesce(mean_allowed, F.col("y_threshold")))
    placed = attach_row(matrix, cuts, "__c").withColumns(
        {"x_threshold": F.col("__c.x_threshold"), "y_threshold": F.col("__c.y_threshold")}
    ).drop("__c")
    volume = F.when(F.col("volume") > F.col("x_threshold"), "High Volume").otherwise("Low Volume")
    latency = F.when(F.col("median_latency") > F.col("y_threshold"), "High Latency").otherwise("Low Latency")
    return placed.withColumn("quadrant", F.concat_ws(" / ", volume, latency))


PERFORMANCE_METRICS = (
    "resolved_count", "backlog", "workload", "throughput_pct", "avg_resolution", "median_resolution",
    "sla_compliance_pct", "reopen_rate_pct",
)


def performance_matrix(view: DataFrame, roles: Roles, group: str = R.OFFICER, unit: str = "days", n: int = 0,
                       sort_by: str = "total_cases") -> DataFrame:
    """Per group: load, throughput, resolution, SLA and reopen rates, and each scaled to 0-100 over the shown rows."""
    if group not in view.columns:
        return ineligible(view.sparkSession, "performance_matrix", [group])
    work = L.with_latency(L.lifecycle_state(view, roles), roles, unit).where(F.col(group).isNotNull())
    resolved, active = F.col("state") == "Closed", F.col("state") == "Active"
    total = F.count(F.lit(1))
    measures = {
        "total_cases": total,
        "resolved_count": F.count_if(resolved),
        "backlog": F.count_if(active),
        "workload": F.count_if(active),
        "throughput_pct": F.coalesce(rate(F.count_if(resolved), total), F.lit(0.0)),
        "avg_resolution": F.round(F.avg(F.when(resolved, F.col("latency"))), 2),
    }
    if not roles.missing([R.SLA_DEADLINE, R.CLOSING_DATE]):
        both = resolved & F.col(R.SLA_DEADLINE).isNotNull() & F.col(R.CLOSING_DATE).isNotNull()
        measures["sla_compliance_pct"] = rate(
            F.count_if(both & (F.col(R.CLOSING_DATE) <= F.col(R.SLA_DEADLINE))), F.count_if(both)
        )
    if roles.has(R.REOPEN_FLAG):
        flag = in_tokens(R.REOPEN_FLAG, CHART_WORDS.reopen_flag)
        measures["reopen_rate_pct"] = F.coalesce(rate(F.count_if(flag), total), F.lit(0.0))
    groups = work.groupBy(group).agg(*[m.alias(k) for k, m in measures.items()])
    closed = work.where("state = 'Closed'")
    middle = quantiles_of(closed, "latency", [Quantile("m", 0.5)], [group]).select(
        group, F.round("m", 2).alias("median_resolution")
    )
    ordered = groups.join(middle, group, "left").orderBy(F.col(sort_by).desc_nulls_last(), group)
    shown = ordered.limit(n) if n > 0 else ordered
    shown = settle(shown, "groups")
    metrics = [m for m in PERFORMANCE_METRICS if m in shown.columns]
    ends = shown.agg(*[f(m).alias(f"{f.__name__}_{m}") for m in metrics for f in (F.min, F.max, F.count)])
    shown = attach_row(shown, ends, "__ends")
    scaled = {}
    for m in metrics:
        low, high = F.col(f"__ends.min_{m}"), F.col(f"__ends.max_{m}")
        flat = (F.col(f"__ends.count_{m}") < 2) | (low == high)
        # A constant metric sits in the middle; a missing value counts as 0.
        scaled[f"{m}_scaled"] = F.when(flat, 50.0).otherwise(
            F.round(F.coalesce((F.col(m) - low) / (high - low) * 100.0, F.lit(0.0)), 2)
        )
    return shown.withColumns(scaled).drop("__ends")

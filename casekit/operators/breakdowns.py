"""Breakdown tables per officer, category, month, place and consumer, and SLA breaches."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casekit.functions.expressions import US_PER_DAY, attach_row, month_label, period_start, rate, text, us_between
from casekit.functions.order_stats import Quantile, are_few, quantiles_of
from casekit.operators import lifecycle as L
from casekit.plans import roles as R
from casekit.plans.roles import Roles, ineligible, missing_for
from casekit.sources.files import settle


def needs_roles(metric: str):
    """Answers with an ineligible row when the roles of `metric` are not mapped."""

    def decorate(build):
        @wraps(build)
        def checked(view: DataFrame, roles: Roles, *args, **kwargs) -> DataFrame:
            missing = missing_for(metric, roles)
            return ineligible(view.sparkSession, metric, missing) if missing else build(view, roles, *args, **kwargs)

        return checked

    return decorate


def _avg_closed_days() -> Column:
    return F.round(F.avg(F.when(F.col("is_closed"), F.col("clipped_us"))) / US_PER_DAY, 1)


@needs_roles("officer_productivity")
def officer_productivity(view: DataFrame, roles: Roles) -> DataFrame:
    work = L.with_clipped_resolution(L.with_flags(view, roles), roles).withColumn("officer", text(R.OFFICER))
    closed, total = F.count_if("is_closed"), F.count(F.lit(1))
    return (
        work.where("officer IS NOT NULL")
        .groupBy("officer")
        .agg(
            total.alias("total_cases"),
            closed.alias("closed"),
            F.count_if("is_pending").alias("pending"),
            F.count_if("is_reopened").alias("reopened"),
            rate(closed, total, 1).alias("closure_rate"),
            _avg_closed_days().alias("avg_resolution_days"),
            F.count_if("is_pending").alias("pending_load"),
        )
        .orderBy(F.desc("closure_rate"), "officer")
    )


@needs_roles("category_breakdown")
def category_breakdown(view: DataFrame, roles: Roles) -> DataFrame:
    work = L.with_clipped_resolution(L.with_flags(view, roles), roles).withColumn("category", text(R.CATEGORY))
    closed, total = F.count_if("is_closed"), F.count(F.lit(1))
    return (
        work.where("category IS NOT NULL")
        .groupBy("category")
        .agg(
            total.alias("total"),
            closed.alias("closed"),
            (total - closed).alias("pending"),
            rate(closed, total, 1).alias("closure_rate"),
            _avg_closed_days().alias("avg_resolution_days"),
        )
        .orderBy(F.desc("total"), "category")
    )


@needs_roles("monthly_trend")
def monthly_trend(view: DataFrame, roles: Roles) -> DataFrame:
    closed_words = L.in_tokens(R.STATUS, L.KPI_WORDS.closed) if roles.has(R.STATUS) else F.lit(False)
    closed, total = F.count_if(closed_words), F.count(F.lit(1))
    months = (
        view.where(F.col(R.REGISTRATION_DATE).isNotNull())
        .groupBy(period_start(R.REGISTRATION_DATE, "M").alias("m"))
        .agg(total.alias("total"), closed.alias("closed"), (total - closed).alias("pending"),
             rate(closed, total, 1).alias("closure_rate"))
    )
    return months.orderBy("m").select(
        month_label("m").alias("period"), F.year("m").alias("year"), F.month("m").alias("month"),
        "total", "closed", "pending", "closure_rate",
    )


@needs_roles("hierarchy_risk")
def hierarchy_risk(view: DataFrame, roles: Roles, reference_date: str | None = None) -> DataFrame:
    """Risk per unit of the first mapped administrative level, with tiers at 33 % and 66 %."""
    level = roles.mapped(R.ADMIN_HIERARCHY)[0]
    work = L.with_flags(view, roles).withColumn("unit", text(level)).where("unit IS NOT NULL")
    if roles.has(R.REGISTRATION_DATE):
        work = L.with_age(work, L.reference_date(view, reference_date))
        days = F.col("age_us") / US_PER_DAY
    else:
        days = F.lit(None).cast("double")
    pending_days = F.when(F.col("is_pending"), days)
    total, pending = F.count(F.lit(1)), F.count_if("is_pending")
    units = work.groupBy("unit").agg(
        total.alias("total_cases"),
        pending.alias("pending"),
        F.round(F.avg(pending_days), 1).alias("avg_pending_age"),
        F.round(F.max(pending_days), 1).alias("max_pending_age"),
    )
    age_factor = F.least(F.coalesce(F.col("avg_pending_age"), F.lit(0.0)) / 30.0, F.lit(5.0))
    scored = units.withColumn(
        "risk_score", F.round(F.col("pending") / F.col("total_cases") * (1 + age_factor) * 100, 1)
    )
    scored = settle(scored, "units")
    cuts = quantiles_of(scored, "risk_score", [Quantile("low", 0.33), Quantile("high", 0.66)], few=are_few(scored))
    score = F.col("risk_score")
    tier = F.when(score <= F.col("cuts.low"), "Low").when(score <= F.col("cuts.high"), "Medium").otherwise("High")
    return (
        attach_row(scored, cuts, "cuts")
        .withColumn("risk_tier", tier)
        .withColumn("level", F.lit(level))
        .select("unit", "level", "total_cases", "pending", "avg_pending_age", "max_pending_age", "risk_score", "risk_tier")
        .orderBy(F.desc("risk_score"), "unit")
    )


@needs_roles("top_repeat_consumers")
def top_repeat_consumers(view: DataFrame, roles: Roles, n: int = 0) -> DataFrame:
    """Consumers with more than one record, most records first; with N, the first N."""
    counted = F.count(R.RECORD_ID) if roles.has(R.RECORD_ID) else F.count(F.lit(1))
    ordered = (
        view.where(F.col(R.CONSUMER_ID).isNotNull())
        .groupBy(R.CONSUMER_ID)
        .agg(counted.alias("case_count"))
        .where("case_count > 1")
        .orderBy(F.desc("case_count"), R.CONSUMER_ID)
    )
    return ordered.limit(n) if n > 0 else ordered


@needs_roles("sla_breach_detail")
def sla_breach_detail(view: DataFrame, roles: Roles) -> DataFrame:
    """Closed rows past their deadline, the longest breach first."""
    closed, _, _ = L.closed_pending(roles)
    late = view.where(closed & (F.col(R.CLOSING_DATE) > F.col(R.SLA_DEADLINE)))
    days = F.round(us_between(R.SLA_DEADLINE, R.CLOSING_DATE) / F.lit(US_PER_DAY), 1)
    order = [F.desc("breach_days")] + ([F.col(R.RECORD_ID).asc()] if roles.has(R.RECORD_ID) else [])
    return late.withColumn("breach_days", days).orderBy(*order)

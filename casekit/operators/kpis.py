"""Scalar KPIs. Counts and rates share one aggregate; durations come from value counts."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casekit.functions.expressions import (
    US_PER_DAY, US_PER_HOUR, attach_row, banded, capped, pct_change, period_start, rate,
)
from casekit.functions.order_stats import Quantile, quantiles, value_counts
from casekit.operators import lifecycle as L
from casekit.operators.summary import Summary, summarize
from casekit.plans import roles as R
from casekit.plans.roles import Roles, missing_for

# KPI → unit, in report order.
UNITS = {
    "total_cases": "cases", "closed_cases": "cases", "pending_cases": "cases", "reopened_cases": "cases",
    "closure_rate": "%", "pending_rate": "%", "reopen_rate": "%", "backlog": "cases",
    "avg_resolution_time": "hrs", "median_resolution_time": "days", "p95_resolution_time": "days",
    "avg_pending_age": "days", "median_pending_age": "days", "p95_pending_age": "days",
    "sla_compliance_rate": "%", "sla_breach_rate": "%", "unique_consumers": "consumers",
    "repeat_consumer_rate": "%", "first_time_resolution_rate": "%",
    "mom_growth": "%", "qoq_growth": "%", "yoy_growth": "%",
}
GROWTH_GRAINS = {"mom_growth": "M", "qoq_growth": "Q", "yoy_growth": "Y"}


def _ids(roles: Roles) -> Column:
    return F.count(R.RECORD_ID) if roles.has(R.RECORD_ID) else F.count(F.lit(1))


def conditions(roles: Roles) -> dict[str, Column]:
    """What counts and rates are made of, as conditions on a row of the role view."""
    closed, _, _ = L.closed_pending(roles)
    sla = not roles.missing([R.CLOSING_DATE, R.SLA_DEADLINE])
    dated = closed & F.col(R.CLOSING_DATE).isNotNull() & F.col(R.SLA_DEADLINE).isNotNull() if sla else F.lit(False)
    return {
        "known": F.col(R.RECORD_ID).isNotNull() if roles.has(R.RECORD_ID) else F.lit(True),
        "closed": closed,
        "pending": L.in_tokens(R.STATUS, L.KPI_WORDS.pending) if roles.has(R.STATUS) else F.lit(False),
        "reopened": L.reopened(roles),
        "status_closed": L.in_tokens(R.STATUS, L.KPI_WORDS.closed) if roles.has(R.STATUS) else F.lit(False),
        "due": dated,
        "met": dated & (F.col(R.CLOSING_DATE) <= F.col(R.SLA_DEADLINE)) if sla else F.lit(False),
    }


def count_formulas(roles: Roles, count: Callable[[Column], Column], of: Mapping[str, Column]) -> list[Column]:
    """Counts and rates from a way to count rows with a condition."""
    rows = count(F.lit(True))
    first_time = rate(count(of["closed"] & ~of["reopened"]), F.when(count(of["closed"]) > 0, count(of["closed"])))
    measures = {
        "total_cases": count(of["known"]),
        "row_count": rows,
        "closed_cases": count(of["closed"]),
        "pending_cases": count(of["pending"]),
        "reopened_cases": count(of["reopened"]),
        "closure_rate": F.coalesce(rate(count(of["status_closed"]), F.nullif(rows, F.lit(0))), F.lit(0.0)),
        "pending_rate": F.coalesce(rate(count(of["pending"]), F.nullif(rows, F.lit(0))), F.lit(0.0)),
        "reopen_rate": F.coalesce(rate(count(of["reopened"]), count(of["status_closed"])), F.lit(0.0)),
        "backlog": count(of["pending"]),
        "first_time_resolution_rate": first_time,
    }
    if not roles.missing([R.CLOSING_DATE, R.SLA_DEADLINE]):
        measures["sla_compliance_rate"] = rate(count(of["met"]), count(of["due"]))
        measures["sla_breach_rate"] = F.round(100.0 - rate(count(of["met"]), count(of["due"])), 2)
    return [m.alias(name) for name, m in measures.items()]


def count_measures(view: DataFrame, roles: Roles) -> DataFrame:
    """One row of counts and rates from a single scan of the role view."""
    flags = view.select(*[F.coalesce(c, F.lit(False)).alias(name) for name, c in conditions(roles).items()])
    return flags.agg(*count_formulas(roles, F.count_if, {name: F.col(name) for name in flags.columns}))


def counts_of(flags: DataFrame, roles: Roles) -> DataFrame:
    """The same from rows that stand for `n` rows each."""

    def count(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0))

    return flags.agg(*count_formulas(roles, count, {name: F.col(name) for name in conditions(roles)}))


def resolution_measures(view: DataFrame, roles: Roles) -> DataFrame:
    """Clipped mean in hours, median and 95th percentile in days over closed rows, one scan."""
    spans = L.with_flags(view, roles).withColumn("resolution_us", L.resolution_us(roles)).where("is_closed")
    counts = value_counts(spans, "resolution_us")
    q = quantiles(counts, [Quantile("p50", 0.5), Quantile("p95", 0.95)])
    clipped = attach_row(counts, q, "q").withColumn("v", capped(F.col("__value").cast("double"), F.col("q.p95")))
    return clipped.agg(
        F.round(F.try_divide(F.sum(F.col("v") * F.col("__n")), F.sum("__n")) / US_PER_HOUR, 2).alias("avg_resolution_time"),
        F.round(F.max("q.p50") / US_PER_DAY, 2).alias("median_resolution_time"),
        F.round(F.max("q.p95") / US_PER_DAY, 2).alias("p95_resolution_time"),
    )


def rounded_durations(total: Summary) -> dict[str, Column]:
    """Mean resolution in hours, all else in days."""
    spans, ages = total.durations["resolution"], total.durations["pending"]
    wanted = {
        "avg_resolution_time": (spans.mean, US_PER_HOUR), "median_resolution_time": (spans.p50, US_PER_DAY),
        "p95_resolution_time": (spans.p95, US_PER_DAY), "avg_pending_age": (ages.mean, US_PER_DAY),
        "median_pending_age": (ages.p50, US_PER_DAY), "p95_pending_age": (ages.p95, US_PER_DAY),
    }
    return {name: F.round(F.lit(value).cast("double") / unit, 2) for name, (value, unit) in wanted.items()}


def pending_ages(view: DataFrame, roles: Roles, reference_date: str | None = None) -> DataFrame:
    """Pending rows with their age in microseconds against the reference date."""
    ref = L.reference_date(view, reference_date)
    strict = L.in_tokens(R.STATUS, L.KPI_WORDS.pending) if roles.has(R.STATUS) else F.lit(False)
    return L.with_age(view.where(strict), ref)


def age_measures(view: DataFrame, roles: Roles, reference_date: str | None = None) -> DataFrame:
    """Fenced mean, median and 95th percentile of pending ages in days."""
    counts = value_counts(pending_ages(view, roles, reference_date), "age_us")
    return fenced_age_summary(counts).select(
        F.round("avg_age", 2).alias("avg_pending_age"),
        F.round("p50", 2).alias("median_pending_age"),
        F.round("p95", 2).alias("p95_pending_age"),
    )


def fenced_age_summary(counts: DataFrame) -> DataFrame:
    """One row `(avg_age, p50, p95)` in days from counts of ages in microseconds."""
    ceiling = L.AGE_CEILING_DAYS * US_PER_DAY
    q = quantiles(counts, [Quantile("q25", 0.25, ceiling), Quantile("q75", 0.75, ceiling),
                           Quantile("p50", 0.5), Quantile("p95", 0.95)])
    q25, q75 = F.col("q.q25"), F.col("q.q75")
    fence = F.greatest(q75 + L.AGE_FENCE_IQR * (q75 - q25), F.lit(L.AGE_FENCE_FLOOR_DAYS * US_PER_DAY))
    age = capped(F.least(F.col("__value").cast("double"), F.lit(ceiling)), fence)
    return attach_row(counts, q, "q").withColumn("v", age).agg(
        (F.try_divide(F.sum(F.col("v") * F.col("__n")), F.sum("__n")) / US_PER_DAY).alias("avg_age"),
        (F.max("q.p50") / US_PER_DAY).alias("p50"),
        (F.max("q.p95") / US_PER_DAY).alias("p95"),
    )


def consumer_measures(view: DataFrame, roles: Roles, approximate: bool = False) -> DataFrame:
    """Distinct consumers and the share with more than one record.

    `approximate` estimates the distinct count alone without the shuffle on consumers.
    """
    if approximate:
        return view.agg(F.approx_count_distinct(R.CONSUMER_ID, 0.01).alias("unique_consumers"))
    return repeat_measures(view.where(F.col(R.CONSUMER_ID).isNotNull()).groupBy(R.CONSUMER_ID).agg(_ids(roles).alias("n")))


def repeat_measures(per: DataFrame) -> DataFrame:
    """Distinct consumers and the share with more than one record, from records per consumer."""
    return per.agg(
        F.count(F.lit(1)).alias("unique_consumers"),
        F.coalesce(rate(F.count_if(F.col("n") > 1), F.count(F.lit(1))), F.lit(0.0)).alias("repeat_consumer_rate"),
    )


def growth_measures(view: DataFrame) -> DataFrame:
    """Last observed month, quarter and year against the one before, each from monthly counts."""
    return growth_of(
        view.where(F.col(R.REGISTRATION_DATE).isNotNull())
        .groupBy(period_start(R.REGISTRATION_DATE, "M").alias("month"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def growth_of(months: DataFrame) -> DataFrame:
    """As `growth_measures`, from rows per month."""
    grains = F.array(
        *[
            F.struct(F.lit(name).alias("kpi"), period_start("month", grain).alias("period"))
            for name, grain in GROWTH_GRAINS.items()
        ]
    )
    periods = (
        months.select(F.explode(grains).alias("g"), "n")
        .groupBy("g.kpi", "g.period")
        .agg(F.sum("n").alias("n"))
    )
    latest = Window.partitionBy("kpi").orderBy(F.desc("period"))
    last_two = periods.withColumn("r", F.row_number().over(latest)).where("r <= 2")
    current = F.max(F.when(F.col("r") == 1, F.col("n")))
    previous = F.max(F.when(F.col("r") == 2, F.col("n")))
    change = last_two.groupBy("kpi").agg(current.alias("current_count"), previous.alias("previous_count"))
    pct = pct_change(F.col("current_count"), F.col("previous_count"))
    return change.withColumn("pct_change", pct).withColumn("direction", trend_direction(F.col("pct_change")))


def trend_direction(pct: Column) -> Column:
    return (
        F.when(pct.isNull(), "none").when(pct > 0.5, "up").when(pct < -0.5, "down").otherwise("neutral")
    )


def band_of(kpi: str, value: Column, rows: Column) -> Column:
    """Benchmark label of a KPI; `rows` is the table's row count."""
    share = F.coalesce(rate(value, rows, 1), F.lit(0.0))
    if kpi == "pending_cases":
        label = F.when(share >= 60, "critical").when(share >= 40, "warning").otherwise("good")
    elif kpi == "reopened_cases":
        label = F.when(share < 5, "good").when(share < 10, "fair").otherwise("critical")
    elif kpi == "backlog":
        label = F.when(value < 100, "good").when(value < 500, "warning").otherwise("critical")
    elif kpi in THRESHOLDS:
        return banded(value, *THRESHOLDS[kpi])
    else:
        return F.lit("na")
    return F.when(value.isNull(), "na").otherwise(label)


# KPI → excellent, good and fair limits, and whether more is better.
THRESHOLDS = {
    "closure_rate": (80.0, 60.0, 40.0, True),
    "pending_rate": (20.0, 40.0, 60.0, False),
    "reopen_rate": (5.0, 10.0, 20.0, False),
    "avg_resolution_time": (72.0, 168.0, 360.0, False),
    "avg_pending_age": (7.0, 15.0, 30.0, False),
    "sla_compliance_rate": (90.0, 75.0, 50.0, True),
    "sla_breach_rate": (10.0, 25.0, 50.0, False),
    "first_time_resolution_rate": (90.0, 75.0, 60.0, True),
    "repeat_consumer_rate": (95.0, 85.0, 70.0, False),
}


def kpi_table(view: DataFrame, roles: Roles, reference_date: str | None = None) -> DataFrame:
    """All KPIs in long form. KPIs whose roles are not mapped stay as ineligible rows.

    The view is scanned twice while the plan is built; see `casekit.operators.summary`.
    """
    eligible = [k for k in UNITS if not missing_for(k, roles)]
    own = conditions(roles)
    total = summarize(view, roles, own, own["closed"], own["pending"], reference_date, "unique_consumers" in eligible)
    flags = total.flags
    row = counts_of(flags, roles)

    row = row.withColumns(rounded_durations(total))
    if "unique_consumers" in eligible:
        repeat = rate(F.lit(total.returning), F.nullif(F.lit(total.consumers), F.lit(0)))
        row = row.withColumns({"unique_consumers": F.lit(total.consumers), "repeat_consumer_rate": F.coalesce(repeat, F.lit(0.0))})
    if "mom_growth" in eligible:
        month = F.make_date(F.floor(F.col("month") / 12).cast("int"), (F.col("month") % 12 + 1).cast("int"), F.lit(1))
        growth = growth_of(flags.where("month IS NOT NULL").groupBy(month.alias("month")).agg(F.sum("n").alias("n")))
        # Three rows at most: one per grain.
        wide = growth.agg(*[F.max(F.when(F.col("kpi") == k, F.col("pct_change"))).alias(k) for k in GROWTH_GRAINS])
        row = row.join(F.broadcast(wide))  # one row each
    rows = []
    for i, (kpi, unit) in enumerate(UNITS.items()):
        missing = missing_for(kpi, roles)
        value = F.col(kpi).cast("double") if kpi in eligible and kpi in row.columns else F.lit(None).cast("double")
        # An empty table has eligible KPIs without values.
        value = F.when(F.col("row_count") > 0, value)
        rows.append(
            F.struct(
                F.lit(kpi).alias("kpi"), value.alias("value"), F.lit(unit).alias("unit"),
                band_of(kpi, value, F.col("row_count")).alias("band"),
                F.lit(not missing).alias("is_eligible"), F.lit(", ".join(missing)).alias("missing_roles"),
            )
        )
    return row.select(F.explode(F.array(*rows)).alias("k")).select("k.*")

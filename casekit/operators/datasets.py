"""Chart datasets: the aggregated table behind each chart, without the drawing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casekit.functions.expressions import attach_row, numeric, period_start, share_pct
from casekit.operators import lifecycle as L
from casekit.functions.order_stats import running_sums
from casekit.operators.aggregates import (
    bounded_sample, clip_to_other, describe, group_aggregate, group_measures, hierarchy_rollup, share_of_group, top_n,
    top_n_with_groups,
)
from casekit.operators.filters import outlier_filter
from casekit.plans.roles import Roles
from casekit.sources.files import settle

DAY = "yyyy-MM-dd"
# Trailing window per grain.
DEFAULT_WINDOWS = {"D": 30, "W": 4, "M": 3, "Q": 2, "Y": 2}
STEPS = {"D": "INTERVAL 1 DAY", "W": "INTERVAL 7 DAY", "M": "INTERVAL 1 MONTH", "Q": "INTERVAL 3 MONTH",
         "Y": "INTERVAL 1 YEAR"}
GROWTH_GRAINS = {"mom": "M", "qoq": "Q", "yoy": "Y"}


def bar(df: DataFrame, x: str, value: str | None = None, agg: str = "count", n: int = 0, order: str = "desc",
        group: str | None = None, facet: str | None = None) -> DataFrame:
    """Sorted bars, the first N of them when N is given; a facet splits them further."""
    keys = list(dict.fromkeys(c for c in (x, group, facet) if c))
    return top_n(group_aggregate(df, keys, value, agg), "value", keys, n, order)


def bar_horizontal(df: DataFrame, x: str, value: str | None = None, agg: str = "count", n: int = 0,
                   order: str = "desc", group: str | None = None, most: int = 0) -> DataFrame:
    """As `bar`; with `most`, at most that many of the bars asked for, in their order."""
    keys = [x, group] if group and group != x else [x]
    return top_n(bar(df, x, value, agg, n, order, group), "value", keys, most, order)


def bar_grouped(df: DataFrame, x: str, group: str, value: str | None = None, agg: str = "count", n: int = 0,
                normalize: bool = False, facet: str | None = None) -> DataFrame:
    """All groups of the N largest bars (0: of all), optionally with each group's share of its bar."""
    keys = [x, group, *([facet] if facet else [])]
    kept = top_n_with_groups(group_aggregate(df, keys, value, agg), x, "value", n)
    return share_of_group(kept, [x, *([facet] if facet else [])], "value") if normalize else kept


def pareto(df: DataFrame, x: str, value: str | None = None, agg: str = "count", n: int = 0,
           threshold: float = 80.0) -> DataFrame:
    """Bars, the N largest of them when N is given, with the running share of what is shown and the vital-few class.

    Bars are summed up in ordered ranges, so all categories of a table need no single task. Writing the bars
    out first is a job that runs while the plan is built.
    """
    shown = settle(top_n(group_aggregate(df, [x], value, agg), "value", [x], n), "bars")
    ranked = running_sums(shown, "value", x).where("total <> 0")
    whole = isinstance(shown.schema["value"].dataType, T.IntegralType)
    share = share_pct(F.col("upto"), F.col("total"), whole)
    before = share_pct(F.col("upto") - F.coalesce("value", F.lit(0)), F.col("total"), whole)
    label = F.when(before < threshold, "Vital Few").otherwise("Trivial Many")
    return ranked.select(x, "value", share.alias("cumulative_pct"), label.alias("pareto_class"))


def period_series(df: DataFrame, date: str, grain: str = "M", value: str | None = None, agg: str = "count",
                  group: str | None = None, facet: str | None = None) -> DataFrame:
    """Line data: one aggregate per period (its first day), group and facet.

    A column that holds no dates is its own scale: its values stand for the periods.
    """
    others = [c for c in (group, facet) if c]
    if isinstance(df.schema[date].dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        period = F.date_format(period_start(date, grain), DAY)
    else:
        period = F.col(date)
    bucketed = df.where(F.col(date).isNotNull()).withColumn("period", period)
    return group_aggregate(bucketed, ["period", *others], value, agg)


def area_shares(df: DataFrame, date: str, group: str, grain: str = "M", value: str | None = None,
                agg: str = "count") -> DataFrame:
    """Stacked area data: each group's share of its period."""
    return share_of_group(period_series(df, date, grain, value, agg, group), "period", "value")


def scatter(df: DataFrame, group: str, x: str, y: str, agg: str = "mean") -> DataFrame:
    """One aggregated point per group; points without both coordinates are left out."""
    points = group_measures(df, [group], {"x": (x, agg), "y": (y, agg)})
    return points.where("x IS NOT NULL AND y IS NOT NULL")


def scatter_sample(df: DataFrame, x: str, y: str, rows: int, key: str, group: str | None = None) -> DataFrame:
    """Single points: a repeatable sample of so many rows that have both coordinates."""
    points = df.select(key, *([group] if group else []), numeric(df, x).alias("x"), numeric(df, y).alias("y"))
    return bounded_sample(points.where("x IS NOT NULL AND y IS NOT NULL"), key, rows)


def box(df: DataFrame, value: str, keys: Sequence[str] = (), outliers: str | None = None) -> DataFrame:
    """Quartiles, extremes and moments, whole or per group, with values outside the outlier limits left out."""
    numbers = df.select(*keys, numeric(df, value).alias("__number")).where("__number IS NOT NULL")
    return describe(outlier_filter(numbers, "__number", outliers), "__number", keys)


def hierarchy(df: DataFrame, path: Sequence[str], value: str | None = None, agg: str = "count", n: int = 0) -> DataFrame:
    """Treemap and sunburst data; with N, all but the N most frequent names of a level become (Other)."""
    return hierarchy_rollup(clip_to_other(df, path, n), path, value, agg)


def bubble(df: DataFrame, group: str, x: str, y: str, size: str | None = None, agg: str = "mean") -> DataFrame:
    """As scatter, with the sum of a size column or the row count as bubble size."""
    weight = (size, "sum") if size else (None, "count")
    points = group_measures(df, [group], {"x": (x, agg), "y": (y, agg), "size": weight})
    return points.where("x IS NOT NULL AND y IS NOT NULL")


def share(df: DataFrame, x: str, value: str | None = None, agg: str = "count", n: int = 0) -> DataFrame:
    """Pie data: the slices, the N largest when N is given, and their share of what is shown."""
    shown = top_n(group_aggregate(df, [x], value, agg), "value", [x], n)
    total = F.col("__sum.total")
    whole = attach_row(shown, shown.agg(F.sum("value").alias("total")), "__sum").where(total != 0)
    exact = isinstance(shown.schema["value"].dataType, T.IntegralType)
    return whole.select(x, "value", share_pct(F.col("value"), total, exact).alias("share_pct"))


def histogram(df: DataFrame, value: str, bins: int = 20, outliers: str | None = None,
              least_numeric: float = 0.0) -> DataFrame:
    """Equal-width bin counts with empty bins; nothing when a smaller share of rows than `least_numeric` are numbers."""
    numbers = df.select(numeric(df, value).alias("v"))
    usable = numbers.agg(F.avg(F.col("v").isNotNull().cast("double"))).scalar() >= least_numeric
    kept = outlier_filter(numbers.where("v IS NOT NULL"), "v", outliers)
    limits = kept.agg(F.min("v").alias("low"), F.max("v").alias("high"))
    low = F.col("l.low")
    width = (F.col("l.high") - low) / bins
    index = F.coalesce(F.floor(F.try_divide(F.col("v") - low, width)), F.lit(0))
    binned = attach_row(kept, limits, "l").withColumn("bin", F.least(index, F.lit(bins - 1)))
    counts = binned.groupBy("bin").agg(F.count(F.lit(1)).alias("count"))
    spine = df.sparkSession.range(bins).select(F.col("id").alias("bin"))
    return (
        attach_row(spine.where(usable), limits, "l")
        .join(counts, "bin", "left")
        .select(
            "bin",
            F.round(low + F.col("bin") * width, 6).alias("lower"),
            F.round(low + (F.col("bin") + 1) * width, 6).alias("upper"),
            F.coalesce("count", F.lit(0)).alias("count"),
        )
    )


def sparkline(df: DataFrame, date: str, grain: str = "M", value: str | None = None) -> DataFrame:
    """Count or mean per period with the overall direction, last period against first."""
    points = period_series(df, date, grain, value, "mean" if value else "count").where("value IS NOT NULL")
    ends = points.agg(F.max_by("value", "period").alias("last"), F.min_by("value", "period").alias("first"))
    last, first = F.col("ends.last"), F.col("ends.first")
    direction = F.when(last > first, "up").when(last < first, "down").otherwise("neutral")
    return attach_row(points, ends, "ends").withColumn("direction", direction).drop("ends").orderBy("period")


def calendar_heatmap(df: DataFrame, date: str, value: str | None = None, agg: str = "count",
                     year: int | None = None, least_dates: int = 1) -> DataFrame:
    """Every day of the target year (the newest by default) with its value, weekday and calendar column.

    Nothing when fewer than `least_dates` rows have a date.
    """
    daily = settle(group_aggregate(df.withColumn("day", F.col(date).cast("date")), ["day"], value, agg), "daily")
    filled = df.agg(F.count(date)).scalar()
    target = F.lit(year) if year else F.year(F.max("day"))
    days = daily.agg(target.alias("y")).select(
        F.explode(F.sequence(F.make_date("y", F.lit(1), F.lit(1)), F.make_date("y", F.lit(12), F.lit(31)))).alias("day")
    )
    week = F.weekofyear("day")
    column = (
        F.when((F.month("day") == 1) & (week > 50), 1).when((F.month("day") == 12) & (week == 1), 53).otherwise(week)
    )
    return (
        days.where(filled >= least_dates)
        .join(daily, "day", "left")
        .select(
            F.date_format("day", DAY).alias("day"), F.month("day").alias("month"), F.weekday("day").alias("weekday"),
            column.alias("week"), F.coalesce(F.col("value").cast("double"), F.lit(0.0)).alias("value"),
        )
    )


def flow_links(df: DataFrame, levels: Sequence[str], n: int = 0, min_flow: float = 1, value: str | None = None,
               agg: str = "count") -> DataFrame:
    """Flows between consecutive levels; all level pairs come from one scan and one shuffle."""
    columns = [*levels, *([value] if value else [])]
    clipped = clip_to_other(df.select(*columns), levels, n)
    pairs = F.explode(
        F.array(
            *[
                F.struct(F.lit(i + 1).alias("step"), F.lit(a).alias("source_level"), F.trim(a).alias("source"),
                         F.lit(b).alias("target_level"), F.trim(b).alias("target"))
                for i, (a, b) in enumerate(zip(levels, levels[1:]))
            ]
        )
    )
    links = clipped.select(pairs.alias("p"), *([value] if value else [])).select("p.*", *([value] if value else []))
    keys = ["step", "source_level", "source", "target_level", "target"]
    return group_aggregate(links, keys, value, agg, "flow").where(F.col("flow") >= min_flow)


def peak_hour(df: DataFrame, date: str, group: str | None = None, value: str | None = None,
              agg: str = "count", outliers: str | None = None) -> DataFrame:
    """All 24 hours per group with absent ones 0, and the hour with the largest total marked."""
    kept = df.where(F.col(date).isNotNull())
    if value and outliers:
        kept = outlier_filter(kept, value, outliers)
    hourly = kept.withColumn("hour", F.hour(date))
    keys = ["hour", group] if group else ["hour"]
    found = settle(group_aggregate(hourly, keys, value, agg), "hourly")
    hours = F.explode(F.sequence(F.lit(0), F.lit(23)))
    spine = found.select(group).distinct().select(group, hours.alias("hour")) if group else (
        df.sparkSession.range(24).select(F.col("id").cast("int").alias("hour"))
    )
    full = spine.join(found, keys, "left").withColumn("value", F.coalesce(F.col("value").cast("double"), F.lit(0.0)))
    totals = full.groupBy("hour").agg(F.sum("value").alias("t"))
    peak = totals.agg(F.min_by("hour", F.struct((-F.col("t")).alias("t"), "hour"))).scalar()
    labelled = full.withColumns(
        {"hour_label": F.concat(F.lpad(F.col("hour").cast("string"), 2, "0"), F.lit(":00")),
         "is_peak": F.col("hour") == peak}
    )
    return labelled.select("hour_label", *([group] if group else []), "value", "is_peak")


def rolling_average(df: DataFrame, date: str, grain: str = "M", window: int | None = None, value: str | None = None,
                    agg: str = "count", group: str | None = None) -> DataFrame:
    """Every period from first to last, absent ones 0, with a trailing mean over the window."""
    width = max(window or DEFAULT_WINDOWS[grain], 1)
    bucketed = df.where(F.col(date).isNotNull()).withColumn(
        "period", period_start(date, grain)
    )
    keys = ["period", group] if group else ["period"]
    found = settle(group_aggregate(bucketed, keys, value, agg), "periods")
    # The span covers all dated rows, also those whose group is missing.
    spanned = bucketed if group else found
    ends = spanned.agg(F.min("period").alias("a"), F.max("period").alias("b"))
    periods = F.sequence("a", "b", F.expr(STEPS[grain])).alias("periods")
    if group:
        # One array of calendar periods for all groups.
        every = ends.select(periods).scalar()
        spine = found.select(group).distinct().withColumn("period", F.explode(every))
    else:
        spine = ends.select(F.explode(periods).alias("period"))
    full = spine.join(found, keys, "left").withColumn("value", F.coalesce(F.col("value").cast("double"), F.lit(0.0)))
    trailing = Window.partitionBy(*([group] if group else [])).orderBy("period").rowsBetween(-(width - 1), 0)
    return full.select(
        F.date_format("period", DAY).alias("period"), *([group] if group else []), "value",
        F.round(F.avg("value").over(trailing), 4).alias("rolling_average"),
    )


def growth(df: DataFrame, date: str, category: str, method: str = "mom", n: int = 0, window: int = 3,
           value: str | None = None, agg: str = "count") -> DataFrame:
    """Growth per category and observed period against the previous one, or against a rolling baseline.

    Growth from 0 is missing, and the first period has none.
    """
    method = method.strip().lower().replace(" ", "").replace("-", "")
    rolling = method in ("rolling", "rollinggrowth")
    if not rolling and method not in GROWTH_GRAINS:
        raise ValueError(f"unknown growth method {method}")
    grain = "M" if rolling else GROWTH_GRAINS[method]
    # One aggregate of the table serves the ranking, the observed periods and the values.
    # Undated rows count for the ranking only; they stand under a day no case can have.
    undated = F.lit("0001-01-01").cast("date")
    start = F.coalesce(period_start(date, grain), undated)
    found = settle(
        group_measures(
            df.withColumn("period", start), [category, "period"], {"__rows": (None, "count"), "value": (value, agg)}
        ),
        "cells",
    )
    if n > 0:
        counts = found.groupBy(category).agg(F.sum("__rows").alias("__rows"))
        head = top_n(counts, "__rows", [category], n).select(category)
        found = found.join(F.broadcast(head), category, "left_semi")
    found = found.where(F.col("period") > undated).drop("__rows")
    observed = found.agg(F.array_sort(F.collect_set("period"))).scalar()
    spine = found.select(category).distinct().withColumn("period", F.explode(observed))
    full = spine.join(found, [category, "period"], "left").withColumn(
        "value", F.coalesce(F.col("value").cast("double"), F.lit(0.0))
    )
    by_period = Window.partitionBy(category).orderBy("period")
    base = F.avg("value").over(by_period.rowsBetween(-window, -1)) if rolling else F.lag("value").over(by_period)
    rows = full.withColumns({"base": base, "position": F.row_number().over(by_period)}).where("position > 1")
    change = F.when(F.col("base") != 0, (F.col("value") - F.col("base")) / F.col("base") * 100.0)
    return rows.select(
        category, F.date_format("period", DAY).alias("period"), "value", F.round(change, 4).alias("growth_pct")
    )


def pending_age_distribution(view: DataFrame, roles: Roles, group: str | None = None, unit: str = "days",
                             outliers: str | None = None, analysis_date: str | None = None) -> DataFrame:
    """Distribution of the ages of active rows, whole or per group.

    The reference date is the newest registration among the active rows.
    """
    active = L.lifecycle_state(view, roles).where("state = 'Active'")
    aged = L.with_latency(active, roles, unit, analysis_date).where("latency IS NOT NULL")
    return describe(outlier_filter(aged, "latency", outliers), "latency", [group] if group else [])

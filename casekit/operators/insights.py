"""Statistics behind chart insights, each a one-row table of numbers and a severity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casekit.functions.expressions import attach_row, finite
from casekit.functions.order_stats import Quantile, are_few, quantiles_of, row_numbers
from casekit.operators.geo import DROPPED
from casekit.sources.files import settle

# Limits of the insight rules.
Z_LIMIT = 2.5
IQR_FACTOR = 1.5
MIN_POINTS = 4
SHARE_CRITICAL = 40.0
SHARE_WARNING = 25.0
TREND_PCT = 5.0
SPREAD_WARNING = 75.0
SPREAD_INFO = 35.0
PARETO_PCT = 40.0
REOPEN_CRITICAL = 20.0
REOPEN_WARNING = 10.0
COVERAGE_GOOD = 90.0
COVERAGE_FAIR = 50.0


def _values(df: DataFrame, label: Column | str, value: str) -> DataFrame:
    name = F.col(label) if isinstance(label, str) else label
    return df.select(name.cast("string").alias("label"), finite(value).alias("v")).where("v IS NOT NULL")


def _extremes() -> list[Column]:
    """Largest and smallest value with their labels; equal values go to the first label."""
    low = F.min_by("label", F.struct("v", "label"))
    high = F.min_by("label", F.struct((-F.col("v")).alias("v"), "label"))
    return [
        high.alias("peak_label"), F.max("v").alias("peak_value"),
        low.alias("trough_label"), F.min("v").alias("trough_value"),
    ]


def peak_trough(df: DataFrame, label: str, value: str) -> DataFrame:
    return _values(df, label, value).agg(*_extremes())


def is_anomalous(values: DataFrame, few: bool = False) -> Column:
    """Scalar: any of at least four values lies beyond 2.5 deviations or 1.5 quartile ranges.

    Only the extreme values can be the farthest out, so the rule needs no second pass.
    """
    stats = values.agg(
        F.count("v").alias("n"), F.avg("v").alias("m"), F.stddev_pop("v").alias("s"),
        F.min("v").alias("low"), F.max("v").alias("high"),
    )
    row = attach_row(stats, quantiles_of(values, "v", [Quantile("a", 0.25), Quantile("b", 0.75)], few=few), "q")
    c = F.col
    far = F.greatest(c("high") - c("m"), c("m") - c("low"))
    by_z = (c("s") > 0) & (F.try_divide(far, c("s")) > Z_LIMIT)
    spread = c("q.b") - c("q.a")
    by_iqr = (spread > 0) & (
        (c("low") < c("q.a") - IQR_FACTOR * spread) | (c("high") > c("q.b") + IQR_FACTOR * spread)
    )
    return row.select(F.coalesce((c("n") >= MIN_POINTS) & (by_z | by_iqr), F.lit(False))).scalar()


def anomaly(df: DataFrame, value: str) -> DataFrame:
    values = df.select(finite(value).alias("v")).where("v IS NOT NULL")
    return values.agg(F.count("v").alias("points")).withColumn("is_anomaly", is_anomalous(values))


def _share_severity(share: Column, flow: bool) -> Column:
    if flow:
        return F.when(share >= SHARE_CRITICAL, "warning").otherwise("info")
    return F.when(share >= SHARE_CRITICAL, "critical").when(share >= SHARE_WARNING, "warning").otherwise("info")


def concentration(df: DataFrame, labels: Sequence[str], value: str, flow: bool = False) -> DataFrame:
    """Share of the largest category, hierarchy path or flow in the total."""
    joined = F.concat_ws(" → " if flow else " › ", *[F.col(c).cast("string") for c in labels])
    values = _values(df, joined, value)
    if len(labels) == 1:
        values = values.groupBy("label").agg(F.sum("v").alias("v"))
    row = values.agg(*_extremes(), F.sum("v").alias("total"))
    share = F.when(F.col("total") > 0, F.col("peak_value") / F.col("total") * 100.0).otherwise(0.0)
    return row.select(
        "peak_label", "peak_value", "trough_label", "trough_value",
        F.round(share, 4).alias("share_pct"), _share_severity(share, flow).alias("severity"),
    ).withColumn("is_anomaly", is_anomalous(values))


def trend(df: DataFrame, period: str, value: str) -> DataFrame:
    """Least-squares slope per period relative to the mean. Periods are numbered in ordered ranges."""
    series = settle(_values(df, period, value), "series")
    row = row_numbers(series, F.col("label").asc(), out="x").agg(
        *_extremes(), F.regr_slope("v", "x").alias("slope"), F.avg("v").alias("mean"), F.count("v").alias("n")
    )
    slope = F.coalesce(F.when(F.col("n") >= 2, F.col("slope")), F.lit(0.0))
    relative = F.coalesce(F.try_divide(slope, F.abs("mean")) * 100.0, F.lit(0.0))
    severity = F.when(relative > TREND_PCT, "warning").when(relative < -TREND_PCT, "positive").otherwise("info")
    direction = F.when(relative > TREND_PCT, "up").when(relative < -TREND_PCT, "down").otherwise("stable")
    return row.select(
        "peak_label", "peak_value", "trough_label", "trough_value", F.round(slope, 4).alias("slope"),
        F.round(relative, 4).alias("relative_slope_pct"), direction.alias("direction"), severity.alias("severity"),
    ).withColumn("is_anomaly", is_anomalous(series, are_few(series)))


def spread(described: DataFrame) -> DataFrame:
    """Deviation relative to the mean over a table of described groups, weighted by their counts."""
    row = described.agg(
        F.coalesce(
            F.try_divide(F.sum(F.col("mean") * F.col("count")), F.sum("count")), F.avg("mean")
        ).alias("mean"),
        F.avg("std").alias("std"), F.min("min").alias("min"), F.max("max").alias("max"),
    )
    c = F.col
    far = F.greatest(F.abs(c("max") - c("mean")), F.abs(c("mean") - c("min")))
    odd = F.coalesce((c("std") > 0) & (F.try_divide(far, c("std")) > Z_LIMIT), F.lit(False))
    pct = F.coalesce(F.try_divide(c("std"), c("mean")) * 100.0, F.lit(0.0))
    severity = F.when(pct >= SPREAD_WARNING, "warning").when(pct >= SPREAD_INFO, "info").otherwise("positive")
    return row.select(
        F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"), "min", "max",
        F.round(pct, 4).alias("spread_pct"), severity.alias("severity"), odd.alias("is_anomaly"),
    )


def matrix_extremes(df: DataFrame, label: str, metrics: Sequence[str]) -> DataFrame:
    """Largest and smallest cell of a wide table and whether any cell stands out."""
    cells = df.unpivot([label], list(metrics), "metric", "cell") if metrics else df
    values = _values(cells, F.concat_ws(" × ", F.col(label).cast("string"), "metric"), "cell")
    row = values.agg(*_extremes(), F.round(F.avg("v"), 4).alias("mean_value"))
    marked = row.withColumn("is_anomaly", is_anomalous(values))
    return marked.withColumn("severity", F.when(F.col("is_anomaly"), "warning").otherwise("info"))


def pareto_summary(pareto: DataFrame, label: str) -> DataFrame:
    """Whether few of the shown categories make up most of the total."""
    row = _pareto_values(pareto, label).agg(
        *_extremes(), F.count_if("vital").alias("vital_few"), F.count(F.lit(1)).alias("categories")
    )
    pct = F.col("vital_few") * 100.0 / F.col("categories")
    concentrated = (F.col("vital_few") > 0) & (pct <= PARETO_PCT)
    return row.withColumns(
        {
            "vital_pct": F.round(pct, 4),
            "is_concentrated": concentrated,
            "severity": F.when(concentrated, "warning").otherwise("info"),
            "is_anomaly": is_anomalous(_pareto_values(pareto, label)),
        }
    )


def _pareto_values(pareto: DataFrame, label: str) -> DataFrame:
    return pareto.select(
        F.col(label).cast("string").alias("label"), finite("value").alias("v"),
        (F.col("pareto_class") == "Vital Few").alias("vital"),
    ).where("v IS NOT NULL")


def risk_ranking(matrix: DataFrame, label: str, score: str = "risk_score") -> DataFrame:
    """Highest and lowest risk; critical when any group stands out."""
    values = _values(matrix, label, score)
    marked = values.agg(*_extremes()).withColumn("is_anomaly", is_anomalous(values))
    return marked.withColumn("severity", F.when(F.col("is_anomaly"), "critical").otherwise("info"))


def reopen_level(analysis: DataFrame, label: str) -> DataFrame:
    values = _values(analysis, label, "reopen_rate")
    level = (
        F.when(F.col("peak_value") >= REOPEN_CRITICAL, "critical")
        .when(F.col("peak_value") >= REOPEN_WARNING, "warning")
        .otherwise("positive")
    )
    return values.agg(*_extremes()).withColumns({"severity": level, "is_anomaly": is_anomalous(values)})


def geo_coverage(positions: DataFrame) -> DataFrame:
    """Share of rows that got a position."""
    row = positions.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("geo_status") != DROPPED).alias("resolved")
    )
    pct = F.coalesce(F.try_divide(F.col("resolved") * 100.0, F.col("total")), F.lit(0.0))
    severity = F.when(pct >= COVERAGE_GOOD, "positive").when(pct >= COVERAGE_FAIR, "info").otherwise("warning")
    return row.withColumns(
        {"coverage_pct": F.round(pct, 4), "severity": severity, "is_anomaly": pct < COVERAGE_FAIR}
    )

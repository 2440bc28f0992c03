"""Predicates, filter state, drill-down, search and outlier masks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casekit.functions.expressions import all_of, any_of, as_timestamp, text
from casekit.functions.order_stats import Quantile, quantiles_of
from casekit.operators.aggregates import group_aggregate
from casekit.plans import roles as R
from casekit.plans.roles import Roles

# Texts that are not a place on a drill path.
BLANK_PLACES = ("", "nan", "none", "nat")


def predicates(df: DataFrame, filters: Sequence[tuple[str, str, Any]]) -> list[Column]:
    """`(column, eq | in | between, value)` triples as conditions; malformed ones are skipped."""
    out: list[Column] = []
    for column, op, value in filters:
        if column not in df.columns:
            continue
        c = F.col(f"`{column}`")
        op = str(op).strip().lower()
        if op == "eq" and value is not None:
            out.append(c == F.lit(value))
        elif op == "in":
            values = [v for v in (value or []) if v is not None]
            if values:
                out.append(c.isin(*values))
        elif op == "between" and isinstance(value, (list, tuple)) and len(value) == 2:
            low, high = value
            if low is not None:
                out.append(c >= F.lit(low))
            if high is not None:
                out.append(c <= F.lit(high))
    return out


def where_all(df: DataFrame, conditions: Sequence[Column]) -> DataFrame:
    return df.where(all_of(conditions)) if conditions else df


def filtered_group_aggregate(
    df: DataFrame,
    keys: Sequence[str],
    value: str | None,
    agg: str,
    filters: Sequence[tuple[str, str, Any]],
    out: str = "value",
) -> DataFrame:
    return group_aggregate(where_all(df, predicates(df, filters)), keys, value, agg, out)


def _timestamp(df: DataFrame, column: str) -> Column:
    return as_timestamp(F.col(f"`{column}`"), df.schema[column].dataType)


def date_range_condition(df: DataFrame, column: str, start: str | None, end: str | None) -> Column | None:
    """Days from `start` to `end`, the whole end day included; open where a bound is missing."""
    ts = _timestamp(df, column)
    parts = []
    if start is not None:
        parts.append(ts >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        parts.append(ts < F.lit(end).cast("timestamp_ntz") + F.expr("INTERVAL 1 DAY"))
    return all_of(parts) if parts else None


def date_range(df: DataFrame, column: str, start: str | None, end: str | None) -> DataFrame:
    condition = date_range_condition(df, column, start, end)
    return df if condition is None else df.where(condition)


def chart_date_range(df: DataFrame, column: str, start: str | None, end: str | None) -> DataFrame:
    """`start <= value <= end` with the bounds exactly as given."""
    ts = _timestamp(df, column)
    parts = []
    if start is not None:
        parts.append(ts >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        parts.append(ts <= F.lit(end).cast("timestamp_ntz"))
    return where_all(df, parts)


def selection_condition(column: str, values: Sequence[str], trimmed: bool = False) -> Column:
    """Multi-select on trimmed text."""
    return (F.col(f"`{column}`") if trimmed else text(column)).isin(*values)


def drill_condition(df: DataFrame, path: Sequence[tuple[str, str]], trimmed: bool = False) -> Column | None:
    """Every level of the path equals its value; unknown levels and empty values are skipped.

    With `trimmed` the levels are texts without outer spaces already, and the comparison reaches the scan.
    """
    steps = [
        (F.col(f"`{level}`") if trimmed else text(level)) == F.lit(value)
        for level, value in path if level in df.columns and value
    ]
    return all_of(steps) if steps else None


def filter_condition(
    view: DataFrame,
    roles: Roles,
    filters: Mapping[str, Any],
    drill_path: Sequence[tuple[str, str]] = (),
    trimmed: bool = False,
) -> Column:
    """The whole filter state, date range, selections and drill path, as one condition.

    It is null where a part is. `trimmed` says that the filtered texts have no outer spaces, as `write_clustered`
    leaves them; all parts then reach the scan.
    """
    parts: list[Column] = []
    if filters.get("date_range") and roles.has(R.REGISTRATION_DATE):
        condition = date_range_condition(view, R.REGISTRATION_DATE, *filters["date_range"])
        if condition is not None:
            parts.append(condition)
    for role in roles.mapped(R.FILTER_ROLES):
        if filters.get(role):
            parts.append(selection_condition(role, filters[role], trimmed))
    drill = drill_condition(view, [(level, value) for level, value in drill_path if level in R.DRILL_HIERARCHY], trimmed)
    if drill is not None:
        parts.append(drill)
    return all_of(parts) if parts else F.lit(True)


def apply_filters(
    view: DataFrame, roles: Roles, filters: Mapping[str, Any], drill_path: Sequence[tuple[str, str]] = (),
    trimmed: bool = False,
) -> DataFrame:
    return view.where(filter_condition(view, roles, filters, drill_path, trimmed))


def filter_counts(
    view: DataFrame, roles: Roles, filters: Mapping[str, Any], drill_path: Sequence[tuple[str, str]] = ()
) -> DataFrame:
    """Rows before and after the filter state, from one scan."""
    condition = filter_condition(view, roles, filters, drill_path)
    return view.agg(F.count(F.lit(1)).alias("rows_before"), F.count_if(condition).alias("rows_after"))


def filter_options(df: DataFrame, column: str, limit: int = 0) -> DataFrame:
    """Choices for a column: trimmed, non-blank, in alphabetical order; with a limit the most frequent ones."""
    value = text(column)
    counts = df.select(value.alias("option")).where("option <> ''").groupBy("option").agg(F.count(F.lit(1)).alias("n"))
    kept = counts.orderBy(F.desc("n"), "option").limit(limit) if limit > 0 else counts
    return kept.orderBy("option").select("option")


def search_options(df: DataFrame, column: str, needle: str, limit: int = 0) -> DataFrame:
    """Choices of a many-valued column that contain the needle, in alphabetical order; with a limit the first ones."""
    value = text(column)
    hits = df.select(value.alias("option")).where(F.contains(F.lower("option"), F.lit(needle.strip().lower())))
    ordered = hits.distinct().orderBy("option")
    return ordered.limit(limit) if limit > 0 else ordered


def drill_topology(df: DataFrame, levels: Sequence[str]) -> DataFrame:
    """Every distinct path prefix: a row per node with its `level` (1-based); blank places end a path."""
    places = [text(c).alias(c) for c in levels]
    paths = df.select(*places).distinct()
    open_so_far = F.lit(True)
    prefixes = []
    for depth in range(1, len(levels) + 1):
        here = F.col(levels[depth - 1])
        open_so_far = open_so_far & here.isNotNull() & ~F.lower(here).isin(*BLANK_PLACES)
        node = [F.col(c).alias(c) if i < depth else F.lit(None).cast("string").alias(c) for i, c in enumerate(levels)]
        prefixes.append(F.struct(F.lit(depth).alias("level"), open_so_far.alias("is_open"), *node))
    nodes = paths.select(F.explode(F.array(*prefixes)).alias("node")).select("node.*")
    return nodes.where("is_open").drop("is_open").distinct()


def drill_children(topology: DataFrame, levels: Sequence[str], chosen: Sequence[str]) -> DataFrame:
    """Names one level below the chosen path, sorted."""
    at = topology.where(F.col("level") == len(chosen) + 1)
    at = where_all(at, [F.col(level) == value for level, value in zip(levels, chosen)])
    return at.select(F.col(levels[len(chosen)]).alias("child")).distinct().orderBy("child")


def text_search(df: DataFrame, needle: str, columns: Sequence[str]) -> DataFrame:
    """Rows where any column contains the needle, ignoring case; the needle is not a pattern."""
    wanted = F.lit(needle.lower())
    hit = any_of(F.contains(F.lower(F.col(f"`{c}`").cast("string")), wanted) for c in columns)
    return df.where(F.coalesce(hit, F.lit(False)))


def outlier_limits(df: DataFrame, value: str, method: str) -> DataFrame:
    """One row `(low, high)` between which values are kept; null limits keep everything."""
    method = method.strip().lower()
    if method in ("zscore", "z_score", "z"):
        stats = df.agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.stddev_samp(value).alias("s"))
        usable = (F.col("n") >= 4) & (F.col("s") > 0)
        return stats.select(
            F.when(usable, F.col("m") - 3 * F.col("s")).alias("low"),
            F.when(usable, F.col("m") + 3 * F.col("s")).alias("high"),
        )
    low_p, high_p = (0.25, 0.75) if method == "iqr" else (0.01, 0.99)
    q = quantiles_of(df, value, [Quantile("a", low_p), Quantile("b", high_p)])
    if method == "iqr":
        spread = F.col("b") - F.col("a")
        usable = (F.col("n") >= 4) & (spread > 0)
        return q.select(
            F.when(usable, F.col("a") - 1.5 * spread).alias("low"),
            F.when(usable, F.col("b") + 1.5 * spread).alias("high"),
        )
    usable = F.col("n") >= 4
    return q.select(F.when(usable, F.col("a")).alias("low"), F.when(usable, F.col("b")).alias("high"))


def outlier_filter(df: DataFrame, value: str, method: str | None) -> DataFrame:
    """Keeps values inside the limits of the method (iqr, zscore, percentile) and missing values.

    The two limits are fetched first, so that they reach the scan as plain numbers and later
    steps do not carry the plan that found them.
    """
    known = ("iqr", "zscore", "z_score", "z", "percentile", "percentile_clip")
    if not method or method.strip().lower() not in known:
        return df
    low, high = outlier_limits(df, value, method).first()
    if low is None or high is None:
        return df
    return df.where(F.col(value).isNull() | F.col(value).between(low, high))

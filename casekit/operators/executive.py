"""Executive bundle: headline numbers, period deltas, unit anomalies and Pareto concentrations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casekit.functions.expressions import US_PER_DAY, US_PER_HOUR, attach_row, capped, rate, us_between
from casekit.functions.order_stats import (
    Quantile, are_few, at_ranks, average_rank_share, quantiles, quantiles_of, row_numbers, running_sums,
    value_counts,
)
from casekit.operators import lifecycle as L
from casekit.operators.kpis import conditions, counts_of, rounded_durations
from casekit.operators.summary import summarize
from casekit.plans import roles as R
from casekit.plans.roles import Roles, ineligible
from casekit.sources.files import settle

# Robust score factor and Pareto target.
MODIFIED_Z_FACTOR = 0.6745
PARETO_TARGET_PCT = 80


def dated(view: DataFrame) -> DataFrame:
    return view.where(F.col(R.REGISTRATION_DATE).isNotNull())


def lowest_unit(view: DataFrame, roles: Roles) -> str | None:
    """Most detailed mapped place level that holds any value, else officer or category.

    One single-row aggregate; only asked when there is more than one candidate.
    """
    candidates = [*reversed(roles.mapped(R.PLACE_HIERARCHY)), *reversed(roles.mapped(R.FLAT_FALLBACK))]
    filled = _filled(view, candidates)
    return next((c for c in candidates if c in filled), None)


def _filled(view: DataFrame, columns: list[str]) -> set[str]:
    if not columns:
        return set()
    row = view.agg(*[F.max(F.col(c).isNotNull()).alias(c) for c in columns]).first()
    return {c for c in columns if row[c]}


def executive_kpis(view: DataFrame, roles: Roles) -> DataFrame:
    """One row of headline numbers. Business risk is pending count times fenced mean age.

    Ages are against the newest registration in the table. The view is scanned twice while the plan is built.
    """
    closed, pending, method = L.closed_pending(roles)
    quality = "MEASURED"
    if method == "unresolved":
        pending, method, quality = F.lit(True), "fallback", "ESTIMATED"
    rows = dated(view)
    own = conditions(roles)
    total = summarize(rows, roles, own | {"open": pending}, own["closed"], pending)
    epoch = F.lit("1970-01-01").cast("timestamp_ntz")

    def day(us: float | None) -> Column:
        return F.date_format(F.timestamp_add("MICROSECOND", F.lit(us).cast("bigint"), epoch), "yyyy-MM-dd")

    opened = F.coalesce(F.sum(F.when(F.col("open"), F.col("n"))), F.lit(0))
    base = total.flags.agg(opened.alias("pending_count")).withColumns({"date_from": day(total.first), "date_to": day(total.newest)})
    has_span = not roles.missing([R.CLOSING_DATE])
    mttr = rounded_durations(total)["avg_resolution_time"] if has_span else F.lit(None).cast("double")
    age = (total.durations["pending"].mean or 0.0) / US_PER_DAY
    has_sla = not roles.missing([R.CLOSING_DATE, R.SLA_DEADLINE])
    sla = F.col("__c.sla_compliance_rate") if has_sla else F.lit(None).cast("double")
    row = attach_row(base, counts_of(total.flags, roles), "__c")
    return row.withColumn("__age", F.lit(age)).select(
        F.round(F.coalesce(sla, F.lit(0.0)), 4).alias("sla_compliance"),
        F.round(F.coalesce(mttr, F.lit(0.0)), 4).alias("mttr_hours"),
        F.col("__c.total_cases").alias("total_volume"),
        "pending_count",
        F.round("__age", 4).alias("avg_pending_age_days"),
        F.round(F.col("pending_count") * F.col("__age"), 4).alias("business_risk_score"),
        "date_from",
        "date_to",
        F.lit(method).alias("lifecycle_method"),
        F.lit(quality).alias("calculation_quality"),
    )


def _id_number(view: DataFrame, roles: Roles) -> Column:
    """Numeric record id, or a hash of a textual one, to settle equal timestamps."""
    if not roles.has(R.RECORD_ID):
        return F.xxhash64(*view.columns)
    is_integer = isinstance(view.schema[R.RECORD_ID].dataType, T.IntegralType)
    return F.col(R.RECORD_ID).cast("bigint") if is_integer else F.xxhash64(R.RECORD_ID)


def split_halves(view: DataFrame, roles: Roles) -> DataFrame:
    """Adds `half`: 1 for the first floor(n/2) rows by registration date and record id, else 2.

    The boundary is found as an order statistic of the dates, then of the ids on the boundary
    date, so the table is never sorted and no date, however common, is gathered in one task.
    Both are fetched as one row each: the second search then only scans the boundary date.
    """
    epoch = F.lit("1970-01-01").cast("timestamp_ntz")
    rows = dated(view).withColumns(
        {"__us": us_between(epoch, F.col(R.REGISTRATION_DATE)), "__id": _id_number(view, roles)}
    )
    total, cut = at_ranks(value_counts(rows, "__us"), {"cut": "floor(__total / 2)"}).first()
    if total is None:
        return rows.withColumn("half", F.lit(1)).drop("__us", "__id")
    boundary = F.timestamp_add("MICROSECOND", F.lit(cut["value"]), epoch)
    ties = rows.where(F.col(R.REGISTRATION_DATE) == boundary)
    left = total // 2 - cut["before"]
    id_cut = at_ranks(value_counts(ties, "__id"), {"cut": str(left)}).first()["cut"]["value"]
    first = (F.col(R.REGISTRATION_DATE) < boundary) | (
        (F.col(R.REGISTRATION_DATE) == boundary) & (F.col("__id") < id_cut)
    )
    return rows.withColumn("half", F.when(first, 1).otherwise(2)).drop("__us", "__id")


def executive_deltas(view: DataFrame, roles: Roles) -> DataFrame:
    """Second half less first half: volume, clipped resolution hours, SLA compliance."""
    halves = L.with_flags(split_halves(view, roles), roles).withColumn("resolution_us", L.resolution_us(roles))
    counts = value_counts(halves.where("is_closed"), "resolution_us", ["half"])
    caps = quantiles(counts, [Quantile("p95", 0.95)], ["half"])
    # Two rows at most.
    clipped = counts.join(F.broadcast(caps), "half").withColumn("v", capped(F.col("__value").cast("double"), F.col("p95")))
    mttr = clipped.groupBy("half").agg(
        F.round(F.sum(F.col("v") * F.col("__n")) / F.sum("__n") / US_PER_HOUR, 2).alias("mttr")
    )
    mttr_by_half = mttr.agg(*[F.max(F.when(F.col("half") == h, F.col("mttr"))).alias(f"h{h}") for h in (1, 2)])
    both = F.col("is_closed") & F.col(R.CLOSING_DATE).isNotNull() & F.col(R.SLA_DEADLINE).isNotNull()
    met = both & (F.col(R.CLOSING_DATE) <= F.col(R.SLA_DEADLINE))
    record = F.col(R.RECORD_ID) if roles.has(R.RECORD_ID) else F.lit(1)
    parts = []
    for h in (1, 2):
        here = F.col("half") == h
        parts += [
            F.count(F.when(here, record)).alias(f"volume_{h}"),
            F.coalesce(rate(F.count_if(here & met), F.count_if(here & both)), F.lit(0.0)).alias(f"sla_{h}"),
        ]
    row = attach_row(halves.agg(*parts), mttr_by_half, "__m").withColumns(
        {f"mttr_{h}": F.coalesce(F.col("__m")[f"h{h}"], F.lit(0.0)) for h in (1, 2)}
    )
    return row.select(
        "volume_1", "volume_2", "mttr_1", "mttr_2", "sla_1", "sla_2",
        F.round(F.col("sla_2") - F.col("sla_1"), 4).alias("sla_pop_delta"),
        F.round(F.col("mttr_2") - F.col("mttr_1"), 4).alias("mttr_pop_delta"),
    )


def with_modified_z(df: DataFrame, value: str, out: str = "z_score", few: bool = False) -> DataFrame:
    """Adds the robust z-score of a column; 0 for all rows when the median deviation is 0."""
    middle = attach_row(df, quantiles_of(df, value, [Quantile("m", 0.5)], few=few), "__mid").withColumn("__m", F.col("__mid.m"))
    off = F.col(value) - F.col("__m")
    mad = quantiles_of(middle.withColumn("__off", F.abs(off)), "__off", [Quantile("d", 0.5)], few=few)
    z = F.try_divide(F.lit(MODIFIED_Z_FACTOR) * off, F.col("__mad.d"))
    scored = attach_row(middle, mad, "__mad").withColumn(out, F.round(F.coalesce(z, F.lit(0.0)), 4))
    return scored.drop("__mid", "__m", "__mad")


def hierarchy_anomalies(view: DataFrame, roles: Roles, unit: str | None = None) -> DataFrame:
    """Pending load times mean age per lowest unit, with robust z-score and severity by rank."""
    work, _, _ = L.with_executive_flags(dated(view), roles)
    unit = unit or lowest_unit(dated(view), roles)
    if not unit:
        return ineligible(view.sparkSession, "hierarchy_anomalies", ["a filled place, officer or category"])
    newest = L.newest_registration(work).scalar()
    units = (
        L.with_age(work.where(F.col("is_pending") & F.col(unit).isNotNull()), newest)
        .groupBy(F.col(unit).cast("string").alias("unit_name"))
        .agg(
            F.count(F.lit(1)).alias("pending_count"),
            F.coalesce(F.avg("age_us") / US_PER_DAY, F.lit(0.0)).alias("avg_pending_age"),
        )
        .withColumn("risk_score", F.round(F.col("pending_count") * F.col("avg_pending_age"), 4))
    )
    units = settle(units, "units")
    few = are_few(units)
    ranked = average_rank_share(with_modified_z(units, "risk_score", few=few), "risk_score", few)
    pct = F.col("rank_share") * 100.0
    severity = (
        F.when(pct >= 90, "CRITICAL").when(pct >= 75, "HIGH").when(pct >= 50, "MEDIUM").otherwise("LOW")
    )
    return ranked.select(
        F.lit(unit).alias("unit_type"), "unit_name", "pending_count",
        F.round("avg_pending_age", 4).alias("avg_pending_age"), "risk_score", "z_score",
        severity.alias("severity"),
    ).orderBy(F.desc("risk_score"), "unit_name")


def pareto_hotspots(view: DataFrame, roles: Roles, unit: str | None = None, longer_than: int | None = None,
                    keep: int = 0) -> DataFrame:
    """Category × unit pairs that make up 80 % of the backlog, with their position.

    Only if asked to, a list longer than `longer_than` is cut to its first `keep`; `omitted_count` says how many
    are then missing. Where the list ends follows from a table of distinct volumes, which is at most about the square
    root of twice the backlog long; pairs are numbered over ordered ranges.
    """
    work, _, _ = L.with_executive_flags(dated(view), roles)
    unit = unit or lowest_unit(dated(view), roles)
    if not unit or not roles.has(R.CATEGORY):
        return ineligible(view.sparkSession, "pareto_hotspots", ["category and a filled place or officer"])
    keyed = work.where(F.col("is_pending") & F.col(R.CATEGORY).isNotNull() & F.col(unit).isNotNull())
    pairs = keyed.groupBy(
        F.col(R.CATEGORY).cast("string").alias("category"), F.col(unit).cast("string").alias("administrative_unit")
    ).agg(F.count(F.lit(1)).alias("pending_volume"))
    pairs = settle(pairs, "pairs")
    volumes = pairs.groupBy("pending_volume").agg(F.count(F.lit(1)).alias("pairs"))
    mass = F.col("pending_volume") * F.col("pairs")
    upto = Window.orderBy(F.desc("pending_volume")).rowsBetween(Window.unboundedPreceding, 0)
    running = volumes.withColumns(
        {"mass": mass, "mass_upto": F.sum(mass).over(upto), "pairs_upto": F.sum("pairs").over(upto)}
    )
    total = F.max("mass_upto").over(Window.partitionBy())
    missing = F.ceil((total * PARETO_TARGET_PCT / 100 - (F.col("mass_upto") - F.col("mass"))) / F.col("pending_volume"))
    reached = running.withColumns({"total": total, "vital": F.col("pairs_upto") - F.col("pairs") + missing}).where(
        F.col("mass_upto") * 100 >= F.col("total") * PARETO_TARGET_PCT
    )
    cut = reached.agg(F.min_by("vital", "mass_upto").alias("vital"), F.max("total").alias("total"))
    vital = F.col("cut.vital")
    shown = vital if longer_than is None else F.when(vital > longer_than, keep).otherwise(vital)
    # All pairs in order: numbered over ranges, so that no volume, however common, is one task's.
    order = F.desc("pending_volume"), F.asc("category"), F.asc("administrative_unit")
    placed = row_numbers(pairs, *order, out="position").withColumn("position", (F.col("position") + 1).cast("int"))
    return (
        attach_row(placed, cut, "cut")
        .where(F.col("position") <= shown)
        .select(
            "position", "category", "administrative_unit", "pending_volume",
            F.round(F.col("pending_volume") / F.col("cut.total") * 100.0, 4).alias("backlog_contribution_pct"),
            (vital - shown).cast("bigint").alias("omitted_count"),
        )
    )


PARETO_SCHEMA = (
    "depth int, level string, path string, name string, pending_volume bigint, backlog_contribution_pct double,"
    " cumulative_pct double, is_vital_few boolean"
)


def pareto_hierarchy(view: DataFrame, roles: Roles) -> DataFrame:
    """Pareto tree down the places as flat rows; only vital branches are opened. Nothing pending: no rows.

    The rows are reduced once to counts per full path; the at most seven levels work on those.
    """
    work, _, _ = L.with_executive_flags(dated(view), roles)
    pending = work.where("is_pending")
    places = roles.mapped(R.PLACE_HIERARCHY)
    filled = _filled(pending, places or roles.mapped(R.FLAT_FALLBACK))
    path = [c for c in places if c in filled] or [c for c in roles.mapped(R.FLAT_FALLBACK) if c in filled][:1]
    if not path:
        return view.sparkSession.createDataFrame([], PARETO_SCHEMA)
    counts = pending.groupBy(*[F.col(c).cast("string").alias(c) for c in path]).agg(F.count(F.lit(1)).alias("n"))
    counts = settle(counts, "paths")
    levels: list[DataFrame] = []
    parents: DataFrame | None = None
    for depth, column in enumerate(path):
        above = path[:depth]
        inside = counts.where(F.col(column).isNotNull())
        if parents is not None:
            inside = inside.join(parents, above, "left_semi")
        nodes = inside.groupBy(*above, column).agg(F.sum("n").alias("pending_volume"))
        summed = running_sums(settle(nodes, "nodes"), "pending_volume", column, above)
        share = F.round(F.col("pending_volume") / F.col("total") * 100.0, 4)
        reached = F.round(F.col("upto") / F.col("total") * 100.0, 4)
        reached_before = F.round((F.col("upto") - F.col("pending_volume")) / F.col("total") * 100.0, 4)
        nodes = summed.withColumns(
            {
                "backlog_contribution_pct": share, "cumulative_pct": reached,
                "is_vital_few": reached_before < PARETO_TARGET_PCT,
            }
        )
        parents = nodes.where("is_vital_few").select(*above, column)
        levels.append(
            nodes.select(
                F.lit(depth + 1).alias("depth"), F.lit(column).alias("level"),
                F.concat_ws(" › ", *above, column).alias("path"), F.col(column).alias("name"),
                "pending_volume", "backlog_contribution_pct", "cumulative_pct", "is_vital_few",
            )
        )
    return reduce(DataFrame.unionByName, levels)

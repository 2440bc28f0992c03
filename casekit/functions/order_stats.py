"""Exact order statistics that stay spread over the cluster.

A built-in exact percentile keeps every distinct value of a group in one task. Here a histogram finds the few
values that matter: the rows are counted in order-preserving buckets by size, whose number is bounded by the
number format; only buckets that hold a wanted rank are counted again, in even parts of their own range; and only
the values in such parts are sorted. Counts are summed before each shuffle, so what is shuffled are buckets, and
at the end the values of a few narrow parts. One far outlier, or one group on another scale, falls in a bucket of
its own and leaves the others as fine as they were. A hot value costs one row per task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casekit.functions.expressions import col, finite
from casekit.sources.files import settle

BUCKETS_PER_OCTAVE = 64
EXPONENT_SHIFT = 1075
PARTS = 16_384
# A written table of at most so many rows is put in order by one task, without ranges or refinement.
FEW_ROWS = 10_000

# Bucket numbers never decrease as the value grows, and neither do the parts of a bucket.
_DOUBLE = "cast(__value AS double)"
BUCKET = (
    f"coalesce(cast(signum({_DOUBLE}) AS bigint) * floor((log2(abs({_DOUBLE})) + {EXPONENT_SHIFT})"
    f" * {BUCKETS_PER_OCTAVE}), 0L)"
)
PART = f"coalesce(floor(try_divide({_DOUBLE} - __low, __high - __low) * {PARTS}), 0L)"


class Quantile(NamedTuple):
    """A wanted quantile; `cap` clips the order statistics before interpolation."""

    name: str
    prob: float
    cap: float | None = None


def _partition(*columns: str) -> str:
    return "PARTITION BY " + ", ".join(f"`{c}`" for c in columns) if columns else ""


def value_counts(df: DataFrame, value: Column | str, keys: Sequence[str] = ()) -> DataFrame:
    """`(keys, __value, __n)` for finite values, one row each; rows with a missing key are dropped."""
    present = "__value IS NOT NULL AND NOT isnan(cast(__value AS double)) AND abs(cast(__value AS double)) <> double('inf')"
    for k in keys:
        present += f" AND `{k}` IS NOT NULL"
    return df.select(*keys, col(value).alias("__value")).where(present).withColumn("__n", F.expr("1L"))


def _upto(keys: Sequence[str], order: str) -> str:
    """Rows up to this one in the order of a column."""
    return f"sum(__n) OVER ({_partition(*keys)} ORDER BY {order} ROWS UNBOUNDED PRECEDING)"


def at_ranks(counts: DataFrame, ranks: Mapping[str, str], keys: Sequence[str] = ()) -> DataFrame:
    """Value and rows before it at zero-based ranks, given as SQL over the row count `__total`.

    One row per group: `keys`, `total`, and per name a struct `(value, before)`.
    """
    # 1: buckets by size, each with its own ends.
    sized = counts.withColumn("__bucket", F.expr(BUCKET))
    ends = [F.expr(f"min({_DOUBLE}) AS __low"), F.expr(f"max({_DOUBLE}) AS __high")]
    totals = sized.groupBy(*keys, "__bucket").agg(F.expr("sum(__n) AS __n"), *ends)
    return refined(sized, wanted_buckets(totals, ranks, keys), ranks, keys)


def _slots(ranks: Mapping[str, str]) -> dict[str, str]:
    return {name: f"__rank_{i}" for i, name in enumerate(ranks)}


def _holds(slot: str, start: str, rows: str) -> str:
    return f"({slot} >= {start} AND {slot} < {start} + {rows})"


def struct_at(ranks: Mapping[str, str], before: str, rows: str) -> list[Column]:
    """Per rank an aggregate `(value, before)` of the row that holds it."""
    found = "struct(__value AS value, __before AS before)"
    return [F.expr(f"max(CASE WHEN {_holds(s, before, rows)} THEN {found} END) AS `{name}`") for name, s in _slots(ranks).items()]


def wanted_buckets(totals: DataFrame, ranks: Mapping[str, str], keys: Sequence[str] = ()) -> DataFrame:
    """The buckets of `(keys, __bucket, __n, __low, __high)` that hold a wanted rank, with the rows below and the ranks."""
    placed = totals.selectExpr(
        "*", f"{_upto(keys, '__bucket')} - __n AS __below", f"sum(__n) OVER ({_partition(*keys)}) AS __total"
    ).selectExpr("*", *[f"cast({rank} AS bigint) AS {slot}" for slot, rank in zip(_slots(ranks).values(), ranks.values())])
    return placed.where(" OR ".join(_holds(s, "__below", "__n") for s in _slots(ranks).values()))


def refined(sized: DataFrame, first: DataFrame, ranks: Mapping[str, str], keys: Sequence[str] = ()) -> DataFrame:
    """As `at_ranks`, from rows with their `__bucket` and the wanted buckets; rows of other buckets play no part."""
    wanted = list(_slots(ranks).values())
    # 2: even parts of the buckets that hold a rank. Without keys there are at most as many as ranks.
    first = first.drop("__n")
    first = first if keys else F.broadcast(first)
    parted = sized.join(first, [*keys, "__bucket"]).withColumn("__part", F.expr(PART)).drop("__low", "__high")
    in_bucket = [*keys, "__bucket"]
    kept = [F.max(c).alias(c) for c in ("__below", "__total", *wanted)]
    narrow = parted.groupBy(*in_bucket, "__part").agg(F.expr("sum(__n) AS __n"), *kept).selectExpr(
        *[f"`{c}`" for c in in_bucket], "__part", "__n", "__total", *wanted,
        f"__below + {_upto(in_bucket, '__part')} - __n AS __start",
    )
    second = narrow.where(" OR ".join(_holds(s, "__start", "__n") for s in wanted)).select(*in_bucket, "__part", "__start")
    # 3: the values of the parts that hold a rank.
    second = second if keys else F.broadcast(second)
    in_part = [*in_bucket, "__part"]
    near = parted.join(second, in_part).groupBy(*in_part, "__value").agg(
        F.expr("sum(__n) AS __n"), *[F.max(c).alias(c) for c in ("__start", "__total", *wanted)]
    ).selectExpr("*", f"__start + {_upto(in_part, '__value')} - __n AS __before")
    hits = " OR ".join(_holds(s, "__before", "__n") for s in wanted)
    return near.where(hits).groupBy(*keys).agg(F.expr("max(__total) AS total"), *struct_at(ranks, "__before", "__n"))


def quantiles(counts: DataFrame, wanted: Sequence[Quantile], keys: Sequence[str] = ()) -> DataFrame:
    """Linearly interpolated quantiles: `keys`, `n`, and one double per wanted name."""

    return interpolated(at_ranks(counts, quantile_ranks(wanted), keys), wanted, keys)


def _position(q: Quantile, total: str) -> str:
    return f"(({total} - 1) * {float(q.prob)!r}D)"


def quantile_ranks(wanted: Sequence[Quantile]) -> dict[str, str]:
    """The two ranks around each quantile."""
    ranks: dict[str, str] = {}
    for i, q in enumerate(wanted):
        ranks[f"lo_{i}"] = f"floor({_position(q, '__total')})"
        ranks[f"hi_{i}"] = f"ceil({_position(q, '__total')})"
    return ranks


def interpolated(found: DataFrame, wanted: Sequence[Quantile], keys: Sequence[str] = ()) -> DataFrame:
    """Quantiles from the order statistics at `quantile_ranks`."""

    def order_stat(slot: str, q: Quantile) -> str:
        value = f"cast({slot}.value AS double)"
        return value if q.cap is None else f"CASE WHEN {slot} IS NOT NULL THEN least({value}, {float(q.cap)!r}D) END"

    out = []
    for i, q in enumerate(wanted):
        pos = _position(q, "total")
        low, high = order_stat(f"lo_{i}", q), order_stat(f"hi_{i}", q)
        out.append(f"{low} + ({high} - {low}) * ({pos} - floor({pos})) AS `{q.name}`")
    return found.selectExpr(*[f"`{k}`" for k in keys], "total AS n", *out)


def are_few(written: DataFrame) -> bool:
    """Whether a written table has at most `FEW_ROWS` rows: a job that stops at that number."""
    return written.limit(FEW_ROWS + 1).count() <= FEW_ROWS


def _few_quantiles(counts: DataFrame, wanted: Sequence[Quantile], keys: Sequence[str]) -> DataFrame:
    """As `quantiles`, from one sorted array a group."""
    sorted_values = F.array_sort(F.collect_list(F.expr(_DOUBLE))).alias("__sorted")
    lists = counts.groupBy(*keys).agg(sorted_values).withColumn("n", F.size("__sorted").cast("bigint")).where("n > 0")

    def order_stat(place: str, q: Quantile) -> str:
        value = f"__sorted[cast({place} AS int)]"
        return value if q.cap is None else f"least({value}, {float(q.cap)!r}D)"

    out = []
    for q in wanted:
        pos = f"((n - 1) * {float(q.prob)!r}D)"
        low, high = order_stat(f"floor({pos})", q), order_stat(f"ceil({pos})", q)
        out.append(f"{low} + ({high} - {low}) * ({pos} - floor({pos})) AS `{q.name}`")
    return lists.selectExpr(*[f"`{k}`" for k in keys], "n", *out)


def quantiles_of(
    df: DataFrame, value: Column | str, wanted: Sequence[Quantile], keys: Sequence[str] = (), few: bool = False
) -> DataFrame:
    """Quantiles of a column. `few` says that the table is known to have few rows (see `are_few`)."""
    counts = value_counts(df, value, keys)
    return _few_quantiles(counts, wanted, keys) if few else quantiles(counts, wanted, keys)


def in_ranges(df: DataFrame, *order: Column) -> DataFrame:
    """The rows written in ordered ranges of even size, with the number of the range as `__range`.

    Ties are split by the later columns of the order. Writing is a job that runs while the plan is built.
    """
    return settle(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "ranges")


def row_numbers(df: DataFrame, *order: Column, out: str) -> DataFrame:
    """Adds the number of each row of a written table in an order, from 0.

    With few rows one window does it; else a row's number is that in its range after those of lower ranges.
    """
    if are_few(df):
        return df.withColumn(out, (F.row_number().over(Window.orderBy(*order)) - 1).cast("bigint"))
    ranged = in_ranges(df, *order)
    sizes = ranged.groupBy("__range").agg(F.count(F.lit(1)).alias("__rows"))
    below = F.sum("__rows").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__rows")
    inside = F.row_number().over(Window.partitionBy("__range").orderBy(*order)) - 1
    numbered = ranged.join(sizes.select("__range", below.alias("__below")), "__range").withColumn(out, F.col("__below") + inside)
    return numbered.drop("__range", "__below")


def running_sums(df: DataFrame, value: str, tie: str, keys: Sequence[str] = ()) -> DataFrame:
    """Adds `upto`, the sum of the value down to a row of a written table, largest first, and `total`, both per key.

    With few rows one window does it; else ranges are summed on their own; only their sums, one row per range and key, are summed up in order.
    """
    order = [F.col(value).desc_nulls_last(), F.col(tie).asc()]
    if are_few(df):
        whole = Window.partitionBy(*keys)
        running = whole.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumns(
            {"upto": F.coalesce(F.sum(value).over(running), F.lit(0)), "total": F.coalesce(F.sum(value).over(whole), F.lit(0))}
        )
    ranged = in_ranges(df, *[F.col(k) for k in keys], *order)
    sums = ranged.groupBy(*keys, "__range").agg(F.coalesce(F.sum(value), F.lit(0)).alias("__sum"))
    by_range = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, 0)
    starts = sums.withColumns(
        {"__above": F.sum("__sum").over(by_range) - F.col("__sum"), "total": F.sum("__sum").over(Window.partitionBy(*keys))}
    ).drop("__sum")
    inside = Window.partitionBy(*keys, "__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = ranged.join(starts, [*keys, "__range"])
    upto = F.col("__above") + F.coalesce(F.sum(value).over(inside), F.lit(0))
    return joined.withColumn("upto", upto).drop("__above", "__range")


def average_rank_share(df: DataFrame, value: str, few: bool = False) -> DataFrame:
    """Adds `rank_share`: average rank of the value (ties share it) over the row count, to the rows that have one.

    With few rows two windows do it. Else distinct values are ranked by running counts; the join back on the value leaves a hot value to Spark's
    splitting of skewed joins.
    """
    if few:
        ties, rows = Window.partitionBy(value), F.count(F.lit(1)).over(Window.partitionBy())
        first = F.rank().over(Window.orderBy(value))
        share = (first - 1 + (F.count(F.lit(1)).over(ties) + 1) / 2) / rows
        return df.where(finite(value).isNotNull()).withColumn("rank_share", share)
    counts = value_counts(df, value).groupBy("__value").agg(F.expr("sum(__n) AS __n"))
    ranged = in_ranges(counts, F.col("__value").asc())
    sums = ranged.groupBy("__range").agg(F.sum("__n").alias("__rows"))
    by_range = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, 0)
    starts = sums.select(
        "__range", (F.sum("__rows").over(by_range) - F.col("__rows")).alias("__below"),
        F.sum("__rows").over(Window.partitionBy()).alias("__total"),
    )
    before = f"__below + {_upto(['__range'], '__value')} - __n"
    ranked = ranged.join(starts, "__range").selectExpr(
        f"__value AS `{value}`", f"({before} + (__n + 1) / 2) / __total AS rank_share"
    )
    return df.join(ranked, value)

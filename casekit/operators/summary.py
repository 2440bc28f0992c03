"""A dashboard's figures from two scans of the case table.

The first scan makes one small table `(measure, bucket) → n, low, high, sum`:

* `flags`: rows by month of registration and by a mask of their conditions, from which every count, rate and growth
  follows;
* `registration`: the newest one;
* `resolution`: spans of closed rows, in buckets by size;
* `pending`: registrations of pending rows, newest first, in buckets of a day. An age is the reference date less the
  registration, so ages need no reference date while scanning, and it can be the newest registration itself.

That table has at most a row per month and mask, 64 per doubling of a span, and one per day, so it comes to the driver. It
tells which buckets hold a wanted order statistic, or a limit at which values are cut. The second scan counts the values
of those buckets, and consumers by whether they come again. Medians, percentiles and means of cut values are then exact:
whole buckets by their sums, the others by their values. Where those buckets have many rows, their values stay a written
table and the order statistics are refined there.
"""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casekit.functions.expressions import US_PER_DAY, any_of, us_between
from casekit.functions.order_stats import BUCKET, Quantile, quantile_ranks, refined
from casekit.operators import lifecycle as L
from casekit.plans import roles as R
from casekit.plans.roles import Roles
from casekit.sources.files import settle

CEILING_US = L.AGE_CEILING_DAYS * US_PER_DAY
FLOOR_US = L.AGE_FENCE_FLOOR_DAYS * US_PER_DAY
WANTED = {"q25": 0.25, "q75": 0.75, "p50": 0.5, "p95": 0.95}  # of both measures
DURATIONS = ("resolution", "pending")
CONSUMER = "consumer"
NO_MONTH = -1_000_000
# Buckets with at most so many rows in all are brought to the driver as counts of values.
HERE_ROWS = 100_000


class Bucket(NamedTuple):
    number: int
    n: int
    low: float
    high: float
    sum: float
    below: int


class Duration(NamedTuple):
    """Microseconds; the mean is of spans cut at their 95th percentile, or of ages cut at the fence."""

    p50: float | None
    p95: float | None
    mean: float | None


@dataclass(frozen=True)
class Summary:
    """Rows by month and conditions, the first and the newest registration, both durations, and consumers."""

    flags: DataFrame
    first: float | None
    newest: float | None
    durations: Mapping[str, Duration]
    consumers: int
    returning: int


def _ranks(total: int) -> dict[str, tuple[int, int, float]]:
    """Per quantile the ranks around it, and how far it lies between them."""
    places = {name: (total - 1) * p for name, p in WANTED.items()}
    return {name: (math.floor(at), math.ceil(at), at - math.floor(at)) for name, at in places.items()}


def _fence(upper: float, lower: float) -> float:
    return min(max(upper + L.AGE_FENCE_IQR * (upper - lower), FLOOR_US), CEILING_US)


def _holding(buckets: list[Bucket], rank: int) -> Bucket:
    return next(b for b in buckets if b.below <= rank < b.below + b.n)


def _needed(measure: str, buckets: list[Bucket], shift: float) -> set[int]:
    """Numbers of the buckets whose values decide: those at wanted ranks, and those that the fence may lie in."""
    if not buckets:
        return set()
    ranks = _ranks(sum(b.n for b in buckets))
    needed = {_holding(buckets, r).number for low, high, _ in ranks.values() for r in (low, high)}
    if measure == "pending":
        ends = {q: (_holding(buckets, ranks[q][0]).low, _holding(buckets, ranks[q][1]).high) for q in ("q25", "q75")}
        (low25, high25), (low75, high75) = ((min(v + shift, CEILING_US) for v in ends[q]) for q in ("q25", "q75"))
        start, end = _fence(low75, high25), _fence(high75, low25)
        needed |= {b.number for b in buckets if b.low + shift < end and b.high + shift > start}
    return needed


def _duration(measure: str, buckets: list[Bucket], needed: set[int], shift: float, at_rank: Mapping[int, float],
              cut_sum) -> Duration:
    """From the buckets, the values at wanted ranks, and the sum of the needed buckets' values cut at a limit."""
    total = sum(b.n for b in buckets)
    if not total:
        return Duration(None, None, None)
    found = {}
    for name, (low, high, part) in _ranks(total).items():
        a, b = (at_rank[r] + shift for r in (low, high))
        if measure == "pending" and name in ("q25", "q75"):
            a, b = min(a, CEILING_US), min(b, CEILING_US)
        found[name] = a + (b - a) * part
    cap = _fence(found["q75"], found["q25"]) if measure == "pending" else found["p95"]
    whole = sum((b.sum + b.n * shift) if b.high + shift <= cap else b.n * cap for b in buckets if b.number not in needed)
    return Duration(found["p50"], found["p95"], (whole + cut_sum(cap)) / total)


def _microseconds(date: str) -> Column:
    return us_between(F.lit("1970-01-01").cast("timestamp_ntz"), F.col(date))


def summarize(view: DataFrame, roles: Roles, conditions: Mapping[str, Column], closed: Column, pending: Column,
              reference_date: str | None = None, consumers: bool = False) -> Summary:
    """Scans the role view twice, at once. `conditions` are the counted ones, at most 20; `consumers` asks for consumers."""
    dated = roles.has(R.REGISTRATION_DATE)
    day = F.col(R.REGISTRATION_DATE).cast("date") if dated else F.lit(None).cast("date")
    month = F.coalesce(F.year(day) * 12 + F.month(day) - 1, F.lit(NO_MONTH)).cast("bigint")
    mask = sum((F.when(F.coalesce(c, F.lit(False)), 1 << i).otherwise(0) for i, c in enumerate(conditions.values())), F.lit(0))
    registered = _microseconds(R.REGISTRATION_DATE) if dated else F.lit(None).cast("bigint")
    newest = F.lit(reference_date).cast("timestamp_ntz") if reference_date is not None else None

    def cell(measure: str, value: Column, bucket: Column, text: Column | None = None) -> Column:
        return F.struct(
            F.lit(measure).alias("measure"), bucket.cast("bigint").alias("__bucket"), value.cast("bigint").alias("__value"),
            (F.lit(None).cast("string") if text is None else text).alias("text"),
        )

    # No age is below zero: with a given reference date, later registrations have none.
    in_time = pending & (F.col(R.REGISTRATION_DATE) <= newest) if newest is not None else pending
    spans = F.when(closed, L.resolution_us(roles))
    ages = F.when(in_time, -registered) if dated else F.lit(None).cast("bigint")
    measured = [
        cell("resolution", spans, F.expr(BUCKET.replace("__value", "__span"))),
        cell("pending", ages, F.floor(F.col("__age") / US_PER_DAY)),
    ]
    counted = [cell("flags", mask, month * (1 << len(conditions)) + mask), cell("registration", registered, F.lit(0))]
    rows = view.withColumns({"__span": spans, "__age": ages})
    cells = rows.select(F.explode(F.array(*measured, *counted)).alias("c")).select("c.*").where("__bucket IS NOT NULL AND __value IS NOT NULL")
    table = cells.groupBy("measure", "__bucket").agg(
        F.count(F.lit(1)).alias("n"), F.min("__value").cast("double").alias("low"), F.max("__value").cast("double").alias("high"),
        F.sum(F.col("__value").cast("decimal(38,0)")).cast("double").alias("sum"),
    ).collect()
    spark = view.sparkSession
    by_measure: dict[str, list[Bucket]] = {m: [] for m in ("flags", "registration", *DURATIONS)}
    for r in sorted(table, key=lambda r: r["__bucket"]):
        own = by_measure[r["measure"]]
        own.append(Bucket(r["__bucket"], r["n"], r["low"], r["high"], r["sum"], own[-1].below + own[-1].n if own else 0))
    registered_in = by_measure["registration"]
    ref = registered_in[0].high if registered_in else 0.0
    if newest is not None:
        ref = float(spark.range(1).select(us_between(F.lit("1970-01-01").cast("timestamp_ntz"), newest)).first()[0])
    shift = {"resolution": 0.0, "pending": ref}
    needed = {m: _needed(m, by_measure[m], shift[m]) for m in DURATIONS}

    near_cells = [*measured]
    if consumers:
        id_known = F.col(R.RECORD_ID).isNotNull() if roles.has(R.RECORD_ID) else F.lit(True)
        near_cells.append(cell(CONSUMER, id_known.cast("int"), F.lit(0), F.col(R.CONSUMER_ID).cast("string")))
    values = rows.select(F.explode(F.array(*near_cells)).alias("c")).select("c.*")
    is_consumer = F.col("measure") == CONSUMER
    in_bucket = [(F.col("measure") == m) & F.col("__bucket").isin(list(b)) & F.col("__value").isNotNull() for m, b in needed.items() if b]
    values = values.where(any_of([F.lit(False), *in_bucket]) | (is_consumer & F.col("text").isNotNull()))
    counted = values.groupBy("measure", "__bucket", F.when(~is_consumer, F.col("__value")).alias("__value"), "text").agg(
        F.sum(F.when(is_consumer, F.col("__value")).otherwise(1)).alias("__n")
    )
    # A consumer counts once, as 0, 1 or 2 for more rows.
    counted = counted.groupBy("measure", "__bucket", F.when(is_consumer, F.least("__n", F.lit(2))).otherwise(F.col("__value")).alias("__value")).agg(
        F.sum(F.when(is_consumer, 1).otherwise(F.col("__n"))).alias("__n")
    )
    many = sum(b.n for m in DURATIONS for b in by_measure[m] if b.number in needed[m]) > HERE_ROWS
    if many:
        counted = settle(counted, "near")
    here = (counted.where(is_consumer) if many else counted).collect()
    durations = {
        m: _far_duration(m, by_measure[m], needed[m], shift[m], counted) if many
        else _near_duration(m, by_measure[m], needed[m], shift[m], [r for r in here if r["measure"] == m])
        for m in DURATIONS
    }
    per = {r["__value"]: r["__n"] for r in here if r["measure"] == CONSUMER}
    flags = []
    for b in by_measure["flags"]:
        month, bits = b.number >> len(conditions), b.number & ((1 << len(conditions)) - 1)
        flags.append((None if month == NO_MONTH else month, b.n, *(bool(bits >> i & 1) for i in range(len(conditions)))))
    schema = "month int, n long" + "".join(f", {name} boolean" for name in conditions)
    return Summary(
        spark.createDataFrame(flags, schema), registered_in[0].low if registered_in else None,
        registered_in[0].high if registered_in else None, durations, sum(per.values()), per.get(2, 0),
    )


def _near_duration(measure: str, buckets: list[Bucket], needed: set[int], shift: float, rows: list) -> Duration:
    """With the values of the needed buckets at hand."""
    values: dict[int, list[tuple[int, int]]] = {}
    for r in rows:
        values.setdefault(r["__bucket"], []).append((r["__value"], r["__n"]))
    at_rank: dict[int, float] = {}
    wanted = sorted({r for low, high, _ in _ranks(max(1, sum(b.n for b in buckets))).values() for r in (low, high)})
    for b in buckets:
        before = b.below
        for value, n in sorted(values.get(b.number, ())):
            at_rank |= {r: float(value) for r in wanted if before <= r < before + n}
            before += n

    def cut_sum(cap: float) -> float:
        return sum(min(value + shift, cap) * n for own in values.values() for value, n in own)

    return _duration(measure, buckets, needed, shift, at_rank, cut_sum)


def _far_duration(measure: str, buckets: list[Bucket], needed: set[int], shift: float, written: DataFrame) -> Duration:
    """With the values of the needed buckets in a written table: ranks are refined there, and sums taken there."""
    total = sum(b.n for b in buckets)
    if not total:
        return Duration(None, None, None)
    ranks = quantile_ranks([Quantile(name, p) for name, p in WANTED.items()])
    places = [r for low, high, _ in _ranks(total).values() for r in (low, high)]
    first = [
        (b.number, b.n, b.low, b.high, b.below, total, *places) for b in buckets if any(b.below <= r < b.below + b.n for r in places)
    ]
    schema = "__bucket long, __n long, __low double, __high double, __below long, __total long" + "".join(f", __rank_{i} long" for i in range(len(places)))
    rows = written.where(F.col("measure") == measure).select("__bucket", "__value", "__n")
    found = refined(rows, written.sparkSession.createDataFrame(first, schema), ranks).first()
    at_rank = {r: float(found[name]["value"]) for r, name in zip(places, ranks)}

    def cut_sum(cap: float) -> float:
        cut = F.least((F.col("__value") + shift).cast("double"), F.lit(cap)) * F.col("__n")
        return rows.agg(F.coalesce(F.sum(cut), F.lit(0.0))).first()[0]

    return _duration(measure, buckets, needed, shift, at_rank, cut_sum)

"""Per-row lifecycle: closed, pending and reopened flags, durations, ages and weights."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casekit.functions.expressions import US_PER_UNIT, capped, finite, in_tokens, key_text, us_between
from casekit.functions.order_stats import Quantile, quantiles_of
from casekit.plans import roles as R
from casekit.plans.roles import Roles


@dataclass(frozen=True)
class Vocabulary:
    closed: Sequence[str]
    pending: Sequence[str]
    reopened: Sequence[str]
    reopen_flag: Sequence[str]
    excluded: Sequence[str] = ()


# Status words counted by the KPIs.
KPI_WORDS = Vocabulary(
    closed=("closed", "resolved", "completed"),
    pending=("pending", "open", "assigned", "in progress"),
    reopened=("reopened", "re-opened", "escalated"),
    reopen_flag=("1", "true", "yes", "y", "reopened", "re-opened"),
)
# Status words of the chart datasets.
CHART_WORDS = Vocabulary(
    closed=("closed", "completed", "resolved", "finished"),
    pending=("pending", "open", "active", "in progress", "inprogress"),
    reopened=("reopened", "re-opened", "escalated"),
    reopen_flag=("1", "true", "yes", "y", "reopened", "re-opened", "escalated"),
    excluded=("cancelled", "canceled", "rejected"),
)
# Status word → canonical status.
CANONICAL_STATUS = {
    "closed": "CLOSED", "resolved": "CLOSED", "completed": "CLOSED", "done": "CLOSED",
    "pending": "PENDING", "open": "PENDING", "in progress": "PENDING", "under process": "PENDING", "wip": "PENDING",
    "reopened": "REOPENED", "re-opened": "REOPENED", "repeat": "REOPENED", "escalated": "REOPENED",
}
# Severity word → weight.
SEVERITY_WEIGHTS = {
    "critical": 4.0, "high": 3.0, "severe": 3.0, "major": 3.0, "medium": 2.0,
    "moderate": 2.0, "normal": 2.0, "low": 1.0, "minor": 1.0, "trivial": 0.5,
}
# Limits of the pending-age fence in days, and its quartile multiplier.
AGE_CEILING_DAYS = 3650.0
AGE_FENCE_FLOOR_DAYS = 365.0
AGE_FENCE_IQR = 3.0


def _literal_map(entries: Mapping[str, object]) -> Column:
    return F.create_map(*[F.lit(x) for pair in entries.items() for x in pair])


def closed_pending(roles: Roles, words: Vocabulary = KPI_WORDS) -> tuple[Column, Column, str]:
    """Closed and pending conditions: by status, else by presence of a closing date."""
    if roles.has(R.STATUS):
        return in_tokens(R.STATUS, words.closed), in_tokens(R.STATUS, words.pending), "status"
    if roles.has(R.CLOSING_DATE):
        return F.col(R.CLOSING_DATE).isNotNull(), F.col(R.CLOSING_DATE).isNull(), "dates"
    return F.lit(False), F.lit(False), "unresolved"


def reopened(roles: Roles, words: Vocabulary = KPI_WORDS) -> Column:
    found = F.lit(False)
    if roles.has(R.STATUS):
        found = found | in_tokens(R.STATUS, words.reopened)
    if roles.has(R.REOPEN_FLAG):
        found = found | in_tokens(R.REOPEN_FLAG, words.reopen_flag)
    return found


def with_flags(view: DataFrame, roles: Roles, words: Vocabulary = KPI_WORDS) -> DataFrame:
    closed, pending, _ = closed_pending(roles, words)
    return view.withColumns({"is_closed": closed, "is_pending": pending, "is_reopened": reopened(roles, words)})


def with_executive_flags(view: DataFrame, roles: Roles) -> tuple[DataFrame, str, str]:
    """Flags for the executive bundle: with neither status nor closing date all rows count as pending."""
    closed, pending, method = closed_pending(roles)
    quality = "MEASURED"
    if method == "unresolved":
        pending, method, quality = F.lit(True), "fallback", "ESTIMATED"
    return view.withColumns({"is_closed": closed, "is_pending": pending}), method, quality


def resolution_us(roles: Roles) -> Column:
    """Microseconds from registration to closing; negative spans are missing."""
    if roles.missing([R.REGISTRATION_DATE, R.CLOSING_DATE]):
        return F.lit(None).cast("bigint")
    span = us_between(R.REGISTRATION_DATE, R.CLOSING_DATE)
    return F.when(span >= 0, span)


def newest_registration(view: DataFrame) -> DataFrame:
    return view.agg(F.max(R.REGISTRATION_DATE).alias("ref_date"))


def reference_date(view: DataFrame, given: str | None = None) -> Column:
    """The given date, or the newest registration of all rows as a scalar subquery."""
    if given is not None:
        return F.lit(given).cast("timestamp_ntz")
    return newest_registration(view).scalar()


def with_age(view: DataFrame, ref: Column) -> DataFrame:
    """Adds `age_us`, microseconds from registration to the reference date; negative ages are missing."""
    span = us_between(R.REGISTRATION_DATE, "__ref")
    return view.withColumn("__ref", ref).withColumn("age_us", F.when(span >= 0, span)).drop("__ref")


def age_quantiles(view: DataFrame, extra: Sequence[Quantile] = ()) -> DataFrame:
    """Quartiles of the ceiling-capped ages of pending rows (`q25`, `q75`) plus any extra ones, in days."""
    pending = view.where("is_pending AND age_days IS NOT NULL")
    wanted = [Quantile("q25", 0.25, AGE_CEILING_DAYS), Quantile("q75", 0.75, AGE_CEILING_DAYS), *extra]
    return quantiles_of(pending, "age_days", wanted)


def age_fence(q: Column) -> Column:
    """Upper age limit from a `(q25, q75)` struct."""
    q25, q75 = q["q25"], q["q75"]
    return F.greatest(q75 + AGE_FENCE_IQR * (q75 - q25), F.lit(AGE_FENCE_FLOOR_DAYS))


def fenced_age(age: Column, q: Column) -> Column:
    return capped(capped(age, F.lit(AGE_CEILING_DAYS)), age_fence(q))


def resolution_cap(view: DataFrame) -> Column:
    """Scalar: 95th percentile of `resolution_us` over closed rows."""
    closed = view.where("is_closed AND resolution_us IS NOT NULL")
    return quantiles_of(closed, "resolution_us", [Quantile("p95", 0.95)]).select("p95").scalar()


def with_clipped_resolution(view: DataFrame, roles: Roles) -> DataFrame:
    """Adds `resolution_us` and `clipped_us`, the span cut at the closed rows' 95th percentile."""
    spans = view.withColumn("resolution_us", resolution_us(roles))
    return spans.withColumn("clipped_us", capped(F.col("resolution_us").cast("double"), resolution_cap(spans)))


def lifecycle_state(view: DataFrame, roles: Roles) -> DataFrame:
    """Chart lifecycle: `state` is Active, Closed or null; excluded rows are dropped."""
    if roles.has(R.STATUS):
        status = key_text(R.STATUS)
        state = F.when(status.isin(*CHART_WORDS.closed), "Closed").when(status.isin(*CHART_WORDS.pending), "Active")
        kept = view.where(~in_tokens(R.STATUS, CHART_WORDS.excluded))
        return kept.withColumn("state", state)
    if roles.has(R.CLOSING_DATE):
        return view.withColumn("state", F.when(F.col(R.CLOSING_DATE).isNotNull(), "Closed").otherwise("Active"))
    return view.withColumn("state", F.lit(None).cast("string"))


def with_latency(
    states: DataFrame, roles: Roles, unit: str = "days", analysis_date: str | None = None
) -> DataFrame:
    """Adds `latency`: closed rows to their closing date, active rows to the reference date."""
    ref = F.col("__ref")
    closing = F.coalesce(F.col(R.CLOSING_DATE), ref) if roles.has(R.CLOSING_DATE) else ref
    end = F.when(F.col("state") == "Closed", closing).when(F.col("state") == "Active", ref)
    span = F.col("__span")
    return (
        states.withColumn("__ref", reference_date(states, analysis_date))
        .withColumn("__span", us_between(F.col(R.REGISTRATION_DATE), end))
        .withColumn("latency", F.when(span >= 0, span / F.lit(US_PER_UNIT[unit])))
        .drop("__ref", "__span")
    )


def weight(df: DataFrame, column: str, default: float = 1.0) -> Column:
    """Numeric columns as they are (missing → default, never negative), words by the severity table."""
    if isinstance(df.schema[column].dataType, T.NumericType):
        return F.greatest(F.coalesce(finite(column), F.lit(float(default))), F.lit(0.0))
    return F.coalesce(_literal_map(SEVERITY_WEIGHTS)[key_text(column)], F.lit(float(default)))


def canonical_status(column: Column | str, words: Mapping[str, str] = CANONICAL_STATUS) -> Column:
    """Known words in canonical form, unknown ones trimmed, missing ones left missing."""
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(_literal_map(words)[key_text(c)], F.trim(c))


def risk_model(roles: Roles, requested: str | None = None) -> str:
    """Richest risk model whose inputs are mapped, or the requested one if it is possible."""
    latency = roles.has(R.REGISTRATION_DATE) and (roles.has(R.STATUS) or roles.has(R.CLOSING_DATE))
    severity = latency and roles.has(R.PRIORITY)
    reopen = roles.has(R.REOPEN_FLAG) or roles.has(R.STATUS)
    possible = {
        "enterprise": severity and roles.has(R.BUSINESS_CRITICALITY) and reopen,
        "advanced": severity,
        "standard": latency,
        "minimum": True,
    }
    if requested and possible.get(requested.strip().lower()):
        return requested.strip().lower()
    return next(model for model, ok in possible.items() if ok)

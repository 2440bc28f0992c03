"""Business roles, their binding to columns, and which metrics a binding supports.

Everything here happens at plan time on a handful of names; no data is touched.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casekit.functions.expressions import as_timestamp

# Role names.
RECORD_ID = "record_id"
REGISTRATION_DATE = "registration_date"
CLOSING_DATE = "closing_date"
STATUS = "status"
CATEGORY = "category"
SUBCATEGORY = "subcategory"
OFFICER = "officer"
CONSUMER_ID = "consumer_id"
ZONE = "zone"
CIRCLE = "circle"
DIVISION = "division"
SUBDIVISION = "subdivision"
SUBSTATION = "substation"
FEEDER = "feeder"
TRANSFORMER = "transformer"
AMOUNT = "amount"
TARGET_AMOUNT = "target_amount"
COLLECTED_AMOUNT = "collected_amount"
UNITS_CONSUMED = "units_consumed"
SLA_DEADLINE = "sla_deadline"
REOPEN_FLAG = "reopen_flag"
PRIORITY = "priority"
LATITUDE = "latitude"
LONGITUDE = "longitude"
BUSINESS_CRITICALITY = "business_criticality"

# Order of the place hierarchy, largest first.
PLACE_HIERARCHY = (ZONE, CIRCLE, DIVISION, SUBDIVISION, SUBSTATION, FEEDER, TRANSFORMER)
DRILL_HIERARCHY = (*PLACE_HIERARCHY, CONSUMER_ID)
ADMIN_HIERARCHY = PLACE_HIERARCHY[:5]
FLAT_FALLBACK = (OFFICER, CATEGORY)
FILTER_ROLES = (STATUS, CATEGORY, SUBCATEGORY, OFFICER, PRIORITY)

DATE_ROLES = (REGISTRATION_DATE, CLOSING_DATE, SLA_DEADLINE)
NUMBER_ROLES = (AMOUNT, TARGET_AMOUNT, COLLECTED_AMOUNT, UNITS_CONSUMED)

NESTED_TYPES = (T.StructType, T.ArrayType, T.MapType, T.VariantType)

# Roles each metric needs.
REQUIRED_ROLES: dict[str, tuple[str, ...]] = {
    "total_cases": (RECORD_ID,),
    "closed_cases": (RECORD_ID, STATUS),
    "pending_cases": (RECORD_ID, STATUS),
    "reopened_cases": (RECORD_ID, STATUS),
    "closure_rate": (RECORD_ID, STATUS),
    "pending_rate": (RECORD_ID, STATUS),
    "reopen_rate": (RECORD_ID, STATUS),
    "backlog": (RECORD_ID, STATUS),
    "avg_resolution_time": (REGISTRATION_DATE, CLOSING_DATE, STATUS),
    "median_resolution_time": (REGISTRATION_DATE, CLOSING_DATE, STATUS),
    "p95_resolution_time": (REGISTRATION_DATE, CLOSING_DATE, STATUS),
    "avg_pending_age": (REGISTRATION_DATE, STATUS),
    "median_pending_age": (REGISTRATION_DATE, STATUS),
    "p95_pending_age": (REGISTRATION_DATE, STATUS),
    "sla_compliance_rate": (STATUS, CLOSING_DATE, SLA_DEADLINE),
    "sla_breach_rate": (STATUS, CLOSING_DATE, SLA_DEADLINE),
    "unique_consumers": (CONSUMER_ID,),
    "repeat_consumer_rate": (CONSUMER_ID, RECORD_ID),
    "first_time_resolution_rate": (RECORD_ID, STATUS),
    "mom_growth": (RECORD_ID, REGISTRATION_DATE),
    "qoq_growth": (RECORD_ID, REGISTRATION_DATE),
    "yoy_growth": (RECORD_ID, REGISTRATION_DATE),
    "officer_productivity": (OFFICER, RECORD_ID, STATUS),
    "category_breakdown": (CATEGORY, RECORD_ID, STATUS),
    "monthly_trend": (RECORD_ID, REGISTRATION_DATE),
    "hierarchy_risk": (RECORD_ID, STATUS),
    "top_repeat_consumers": (CONSUMER_ID, RECORD_ID),
    "sla_breach_detail": (STATUS, CLOSING_DATE, SLA_DEADLINE),
}
# Status or closing date is enough.
EITHER_LIFECYCLE = {"officer_productivity", "category_breakdown", "hierarchy_risk"}
# Closing date is needed, status is optional.
CLOSING_ANCHORED = {
    "closed_cases",
    "avg_resolution_time",
    "median_resolution_time",
    "p95_resolution_time",
    "sla_compliance_rate",
    "sla_breach_rate",
    "sla_breach_detail",
    "first_time_resolution_rate",
}


@dataclass(frozen=True)
class Roles:
    """Role → column name. Roles left out are simply not mapped."""

    columns: Mapping[str, str]
    unconfirmed: frozenset[str] = field(default_factory=frozenset)

    def has(self, role: str) -> bool:
        return self.columns.get(role) is not None and role not in self.unconfirmed

    def resolve(self, role: str) -> str | None:
        return self.columns[role] if self.has(role) else None

    def missing(self, wanted: Iterable[str]) -> list[str]:
        return [role for role in wanted if not self.has(role)]

    def mapped(self, wanted: Iterable[str]) -> list[str]:
        return [role for role in wanted if self.has(role)]

    def without(self, *dropped: str) -> Roles:
        kept = {role: col for role, col in self.columns.items() if role not in dropped}
        return Roles(kept, self.unconfirmed)

    def view(self, df: DataFrame) -> DataFrame:
        """Project the mapped columns under their role names; dates become naive timestamps."""
        types = {f.name: f.dataType for f in df.schema.fields}
        picked = []
        for role, column in self.columns.items():
            if not self.has(role) or column not in types:
                continue
            value = F.col(f"`{column}`")
            if role in DATE_ROLES:
                value = as_timestamp(value, types[column])
            picked.append(value.alias(role))
        return df.select(*picked)


def identity_roles(df: DataFrame) -> Roles:
    """Binding for a table whose columns already carry role names."""
    return Roles({c: c for c in df.columns})


def missing_for(metric: str, roles: Roles) -> list[str]:
    """Roles that keep `metric` from being computed; an empty list means eligible."""
    required = REQUIRED_ROLES[metric]
    if metric in EITHER_LIFECYCLE:
        missing = roles.missing(r for r in required if r != STATUS)
        if not roles.has(STATUS) and not roles.has(CLOSING_DATE):
            missing += [STATUS, CLOSING_DATE]
        if metric == "hierarchy_risk" and not missing and not roles.mapped(ADMIN_HIERARCHY):
            missing = list(ADMIN_HIERARCHY)
        return missing
    if metric in CLOSING_ANCHORED:
        needed = [r for r in required if r != STATUS]
        if CLOSING_DATE not in needed:
            needed.append(CLOSING_DATE)
        return roles.missing(needed)
    return roles.missing(required)


def eligibility_rows(roles: Roles, metrics: Iterable[str] = REQUIRED_ROLES) -> list[tuple]:
    rows = []
    for metric in metrics:
        missing = missing_for(metric, roles)
        rows.append((metric, not missing, missing))
    return rows


ELIGIBILITY_SCHEMA = "metric string, is_eligible boolean, missing_roles array<string>"


def eligibility_report(spark: SparkSession, roles: Roles) -> DataFrame:
    return spark.createDataFrame(eligibility_rows(roles), ELIGIBILITY_SCHEMA)


def ineligible(spark: SparkSession, what: str, missing: Iterable[str]) -> DataFrame:
    """The one-row answer for a request whose roles are not mapped."""
    return spark.createDataFrame([(what, False, list(missing))], ELIGIBILITY_SCHEMA)


def groupable(df: DataFrame, *columns: str) -> list[str]:
    """Columns that are absent or nested and so cannot be grouped or aggregated."""
    types = {f.name: f.dataType for f in df.schema.fields}
    return [c for c in columns if c not in types or isinstance(types[c], NESTED_TYPES)]

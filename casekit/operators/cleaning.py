"""Non-destructive cleaning in a fixed order, with flags and a report.

All steps are lazy projections. Only the choice of columns to convert looks at data, in two
small actions: the profile (one row per column) and one row of parse rates.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casekit.functions.expressions import (
    SERIAL_DATE_MAX, SERIAL_DATE_MIN, attach_row, collapse_spaces, date_from_serial, date_from_text, null_if_placeholder,
    number_from_text, numeric,
)
from casekit.functions.order_stats import Quantile, quantiles, value_counts
from casekit.operators.lifecycle import canonical_status
from casekit.operators.profiling import infer_types
from casekit.plans import roles as R
from casekit.plans.roles import Roles
from casekit.sources.files import settle

MIN_CONFIDENCE = 0.75
NUMERIC_ACCEPT = 0.85
DATE_ACCEPT = 0.80
SERIAL_ACCEPT = 0.9
FENCE_IQR = 3.0
MIN_FENCE_VALUES = 10
# A digest is 8 bytes: up to this many are broadcast.
BROADCAST_DIGESTS = 2_000_000
NUMERIC_TYPES = ("numeric", "currency", "percentage")


def _map_columns(df: DataFrame, kinds: type | tuple, change) -> DataFrame:
    hits = {f.name: change(F.col(f"`{f.name}`")) for f in df.schema.fields if isinstance(f.dataType, kinds)}
    return df.withColumns(hits) if hits else df


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def strip_timezones(df: DataFrame) -> DataFrame:
    return _map_columns(df, T.TimestampType, lambda c: c.cast("timestamp_ntz"))


def decimals_to_double(df: DataFrame) -> DataFrame:
    return _map_columns(df, T.DecimalType, lambda c: c.cast("double"))


def empty_to_text(df: DataFrame, empty: Sequence[str] = ()) -> DataFrame:
    """Untyped columns, and the listed ones known to hold nothing, become text columns."""
    df = _map_columns(df, T.NullType, lambda c: c.cast("string"))
    return df.withColumns({c: F.lit(None).cast("string") for c in empty}) if empty else df


def trim_whitespace(df: DataFrame) -> DataFrame:
    return _map_columns(df, T.StringType, collapse_spaces)


def nullify_placeholders(df: DataFrame) -> DataFrame:
    return _map_columns(df, T.StringType, null_if_placeholder)


def convert_numbers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: number_from_text(F.col(f"`{c}`")) for c in columns}) if columns else df


def standardize_dates(df: DataFrame, text: Sequence[str] = (), serial: Sequence[str] = ()) -> DataFrame:
    changes = {c: date_from_text(F.col(f"`{c}`")) for c in text}
    changes |= {c: date_from_serial(F.col(f"`{c}`")) for c in serial}
    return df.withColumns(changes) if changes else df


def business_key_duplicates(df: DataFrame, key: str) -> DataFrame:
    """Keys held by several rows that do not all have an identical twin, with their row counts."""
    columns = [f"`{c}`" for c in df.columns]
    rows = df.where(F.col(f"`{key}`").isNotNull()).groupBy(*columns).agg(F.count(F.lit(1)).alias("__n"))
    keys = rows.groupBy(f"`{key}`").agg(F.sum("__n").alias("occurrences"), F.min("__n").alias("__fewest"))
    return keys.where("occurrences > 1 AND __fewest = 1").drop("__fewest")


def outlier_fences(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Numeric columns with values beyond 3 quartile ranges: fences and counts; nothing is removed.

    Fences and counts both come from the value counts of all columns, so the table is read once.
    """
    cells = F.array(
        *[F.struct(F.lit(c).alias("column"), numeric(df, c).alias("value")) for c in columns]
    )
    counts = value_counts(df.select(F.explode(cells).alias("c")).select("c.*"), "value", ["column"])
    q = quantiles(counts, [Quantile("q1", 0.25), Quantile("q3", 0.75)], ["column"])
    spread = F.col("q3") - F.col("q1")
    fences = q.where((F.col("n") >= MIN_FENCE_VALUES) & (spread != 0)).select(
        "column",
        (F.col("q1") - FENCE_IQR * spread).alias("lower"),
        (F.col("q3") + FENCE_IQR * spread).alias("upper"),
    )
    # One row per listed column, so the fences are small whatever the table's size.
    beyond = counts.join(F.broadcast(fences), "column").where("__value < lower OR __value > upper")
    return beyond.groupBy("column").agg(
        F.sum("__n").alias("outlier_count"),
        F.round(F.max("lower"), 4).alias("lower_fence"),
        F.round(F.max("upper"), 4).alias("upper_fence"),
    )


def drop_empty_rows(df: DataFrame) -> DataFrame:
    return df.na.drop(how="all")


def row_digest(df: DataFrame) -> Column:
    """64 bits that equal rows share; a null differs from a value that would leave the hash as it was."""
    parts = []
    for f in df.schema.fields:
        parts.append(F.col(f"`{f.name}`"))
        if f.nullable:
            parts.append(F.col(f"`{f.name}`").isNull())
    return F.xxhash64(*parts)


def repeated_digests(df: DataFrame) -> DataFrame:
    """Digests that more than one row has; only digests are shuffled."""
    return df.select(row_digest(df).alias("__digest")).groupBy("__digest").count().where("count > 1").select("__digest")


def drop_duplicate_rows(df: DataFrame) -> DataFrame:
    """Distinct rows; a table without repeated rows is not shuffled.

    Digests are counted first, in a job at once. Rows whose digest nobody shares stay where they are; the others are
    compared whole, so rows that merely share a digest both stay. With more shared digests than may be broadcast, all
    rows are compared. Nulls equal nulls, -0.0 equals 0.0, NaN equals NaN. The table is read up to three times, so
    stage it first if it is costly to make. Columns that cannot be compared (maps) raise Spark's error.
    """
    if not df.columns:
        return df.dropDuplicates()
    shared = settle(repeated_digests(df), "digests")
    found = shared.count()
    if found == 0:
        return df
    if found > BROADCAST_DIGESTS:
        return df.dropDuplicates()
    marked = df.withColumn("__digest", row_digest(df))
    alone = marked.join(F.broadcast(shared), "__digest", "left_anti").drop("__digest")
    return alone.unionByName(marked.join(F.broadcast(shared), "__digest", "left_semi").drop("__digest").dropDuplicates())


def distinct_rows(df: DataFrame) -> DataFrame:
    """Distinct rows with the number of times each occurs (`__copies`)."""
    return df.groupBy(*[f"`{c}`" for c in df.columns]).agg(F.count(F.lit(1)).alias("__copies"))


def _is_filled(rows: DataFrame) -> Column:
    filled = F.coalesce(*[F.col(f"`{c}`").cast("string") for c in rows.columns if c != "__copies"]).isNotNull()
    # Tied to the count so that it is tested on the few distinct rows, not moved down to every
    # row, where it would repeat the whole cleaning of the cells.
    return F.when(F.col("__copies") > 0, filled)


def canonicalize_status(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, canonical_status(column))


@dataclass
class Conversions:
    """Columns chosen for conversion."""

    empty: list[str] = field(default_factory=list)
    numbers: list[str] = field(default_factory=list)
    text_dates: list[str] = field(default_factory=list)
    serial_dates: list[str] = field(default_factory=list)


def choose_conversions(df: DataFrame, profile: Sequence[Row]) -> Conversions:
    """Columns whose profile and parse rate are good enough; `df` has placeholders already removed."""
    types = {f.name: f.dataType for f in df.schema.fields}
    sure = [p for p in profile if p["confidence"] >= MIN_CONFIDENCE and p["column"] in types]
    chosen = Conversions(
        empty=[p["column"] for p in profile
               if p["distinct_count"] == 0 and isinstance(types.get(p["column"]), T.StringType)]
    )
    rates: dict[str, tuple[str, Column]] = {}
    for p in sure:
        name = p["column"]
        c, filled = F.col(f"`{name}`"), F.col(f"`{name}`").isNotNull()
        is_text = isinstance(types[name], T.StringType)
        if p["inferred_type"] in NUMERIC_TYPES and is_text:
            rates[name] = ("numbers", F.avg(F.when(filled, number_from_text(c).isNotNull().cast("double"))))
        elif p["inferred_type"] == "datetime" and is_text:
            rates[name] = ("text_dates", F.avg(F.when(filled, date_from_text(c).isNotNull().cast("double"))))
        elif p["inferred_type"] == "datetime" and isinstance(types[name], T.NumericType):
            in_range = c.between(SERIAL_DATE_MIN, SERIAL_DATE_MAX)
            rates[name] = ("serial_dates", F.avg(F.when(filled, in_range.cast("double"))))
    if not rates:
        return chosen
    measured = df.agg(*[m.alias(f"m{i}") for i, (_, m) in enumerate(rates.values())]).first()
    for i, (name, (kind, _)) in enumerate(rates.items()):
        value = measured[f"m{i}"]
        if value is None:
            continue
        if kind == "serial_dates" and value > SERIAL_ACCEPT:
            chosen.serial_dates.append(name)
        elif kind == "numbers" and value >= NUMERIC_ACCEPT:
            chosen.numbers.append(name)
        elif kind == "text_dates" and value >= DATE_ACCEPT:
            chosen.text_dates.append(name)
    return chosen


@dataclass
class Cleaned:
    cleaned: DataFrame
    analytics: DataFrame
    report: DataFrame
    losses: DataFrame
    duplicates: DataFrame | None
    outliers: DataFrame | None
    conversions: Conversions


def clean_table(df: DataFrame, roles: Roles, profile: DataFrame | None = None) -> Cleaned:
    """The whole cleaning sequence. Row removal comes last, after the flags."""
    profile_rows = (profile if profile is not None else infer_types(df)).collect()
    typed = decimals_to_double(empty_to_text(strip_timezones(df)))
    trimmed = trim_whitespace(typed)
    filled = nullify_placeholders(trimmed)
    chosen = choose_conversions(filled, profile_rows)
    work = standardize_dates(convert_numbers(filled, chosen.numbers), chosen.text_dates, chosen.serial_dates)

    key = roles.resolve(R.RECORD_ID)
    duplicates = business_key_duplicates(work, key) if key in work.columns else None
    bound = {column for role, column in roles.columns.items() if roles.has(role)}
    fenced = [
        p["column"] for p in profile_rows
        if p["inferred_type"] in ("numeric", "currency") and p["confidence"] >= MIN_CONFIDENCE
        and p["column"] in bound and p["column"] in work.columns
    ]
    outliers = outlier_fences(work, fenced) if fenced else None

    rows = distinct_rows(work)
    cleaned = rows.where(_is_filled(rows)).drop("__copies")
    status = roles.resolve(R.STATUS)
    analytics = canonicalize_status(cleaned, status) if status in cleaned.columns else cleaned
    report = cleaning_report(typed, rows, df, chosen, duplicates, outliers)
    return Cleaned(cleaned, analytics, report, conversion_losses(filled, chosen), duplicates, outliers, chosen)


def conversion_losses(filled: DataFrame, chosen: Conversions) -> DataFrame:
    """Per converted column its filled cells and those that conversion leaves empty, from one scan."""
    readings = {c: number_from_text(F.col(f"`{c}`")) for c in chosen.numbers}
    readings |= {c: date_from_text(F.col(f"`{c}`")) for c in chosen.text_dates}
    readings |= {c: date_from_serial(F.col(f"`{c}`")) for c in chosen.serial_dates}
    if not readings:
        return filled.sparkSession.createDataFrame([], "column string, filled bigint, lost bigint")
    measures, rows = [], []
    for i, (c, reading) in enumerate(readings.items()):
        measures.append(F.count(F.col(f"`{c}`")).alias(f"filled_{i}"))
        measures.append(F.count_if(F.col(f"`{c}`").isNotNull() & reading.isNull()).alias(f"lost_{i}"))
        rows.append(F.struct(F.lit(c).alias("column"), F.col(f"filled_{i}").alias("filled"), F.col(f"lost_{i}").alias("lost")))
    return filled.agg(*measures).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def cleaning_report(
    typed: DataFrame,
    rows: DataFrame,
    raw: DataFrame,
    chosen: Conversions,
    duplicates: DataFrame | None,
    outliers: DataFrame | None,
) -> DataFrame:
    """One row per cleaning step with what it touched.

    Cell counts come from one scan, row counts from the distinct rows the cleaning makes anyway.
    """
    texts = text_columns(typed)

    def cell_sum(condition) -> Column:
        per_column = [F.count_if(F.coalesce(condition(F.col(f"`{c}`")), F.lit(False))) for c in texts]
        return sum(per_column[1:], per_column[0]) if per_column else F.lit(0).cast("bigint")

    trimmed_cells = cell_sum(lambda c: collapse_spaces(c) != c)
    nulled_cells = cell_sum(lambda c: c.isNotNull() & null_if_placeholder(collapse_spaces(c)).isNull())
    counts = typed.agg(trimmed_cells.alias("trimmed"), nulled_cells.alias("nulled"))
    filled = _is_filled(rows)
    removed = rows.agg(
        F.coalesce(F.sum(F.when(~filled, F.col("__copies"))), F.lit(0)).alias("empty"),
        F.coalesce(F.sum(F.when(filled, F.col("__copies") - 1)), F.lit(0)).alias("repeated"),
    )
    row = attach_row(counts, removed, "removed").withColumns(
        {
            "key_groups": duplicates.agg(F.count(F.lit(1))).scalar() if duplicates is not None else F.lit(0),
            "outlier_columns": outliers.agg(F.count(F.lit(1))).scalar() if outliers is not None else F.lit(0),
        }
    )
    zoned = sum(isinstance(f.dataType, T.TimestampType) for f in raw.schema.fields)
    decimals = sum(isinstance(f.dataType, T.DecimalType) for f in raw.schema.fields)
    untyped = sum(isinstance(f.dataType, T.NullType) for f in raw.schema.fields) + len(chosen.empty)
    steps: Mapping[str, Column] = {
        "timezone_columns_normalized": F.lit(zoned),
        "null_type_columns_coerced": F.lit(untyped),
        "decimal_columns_coerced": F.lit(decimals),
        "values_whitespace_trimmed": F.col("trimmed"),
        "values_null_normalized": F.col("nulled"),
        "columns_dtype_converted": F.lit(len(chosen.numbers)),
        "date_columns_standardized": F.lit(len(chosen.text_dates) + len(chosen.serial_dates)),
        "business_key_duplicate_groups": F.col("key_groups"),
        "outlier_columns_flagged": F.col("outlier_columns"),
        "rows_removed_fully_empty": F.col("removed.empty"),
        "rows_removed_exact_duplicates": F.col("removed.repeated"),
    }
    details = {
        "columns_dtype_converted": ", ".join(sorted(chosen.numbers)),
        "date_columns_standardized": ", ".join(sorted(chosen.text_dates + chosen.serial_dates)),
    }
    lines = [
        F.struct(F.lit(i + 1).alias("step_order"), F.lit(name).alias("step"),
                 value.cast("bigint").alias("affected"), F.lit(details.get(name, "")).alias("columns"))
        for i, (name, value) in enumerate(steps.items())
    ]
    return row.select(F.explode(F.array(*lines)).alias("r")).select("r.*")

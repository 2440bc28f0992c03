"""Column profiles, type inference, quality scores and alerts, fuzzy value matching.

Types come from one scan of conditional counts and sketches; exact distinct counts and samples from
`(column, value) → count`, one shuffle cut down by partial aggregation.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casekit.functions.expressions import (
    CURRENCY_MARKS, FALSE_TOKENS, NUMBER_TEXT, SERIAL_DATE_MAX, SERIAL_DATE_MIN, TRUE_TOKENS,
    as_timestamp, date_from_text, finite, key_text,
)
from casekit.plans import roles as R
from casekit.plans.roles import NESTED_TYPES, Roles
from casekit.sources.files import settle

# Header parts that hint at an identifier.
ID_HINTS = ("id", "no", "number", "code", "ref")
# Texts that look like percentages, and currency signs.
PERCENT_TEXT = r"^\s*-?\d+(\.\d+)?\s*%\s*$"
CURRENCY_SIGN = r"[₹$€£]"
DATE_DELIMITER = r"[-/.\s]"
REVIEW_BELOW = 0.75
SAMPLE_SIZE = 8
PARSE_FAILURE_WARN = 0.15
# Lower bounds of the readiness bands.
READINESS_BANDS = ((90, "Excellent"), (75, "Good"), (55, "Fair"), (35, "Poor"), (0, "Critical"))


def flat_columns(df: DataFrame) -> list[T.StructField]:
    return [f for f in df.schema.fields if not isinstance(f.dataType, NESTED_TYPES)]


def _kind(dtype: T.DataType) -> str:
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "datetime"
    if isinstance(dtype, T.NumericType):
        return "numeric"
    return "boolean" if isinstance(dtype, T.BooleanType) else "text"


def _cell_text(field: T.StructField) -> Column:
    c = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
        c = F.when(~F.isnan(c), c)
    return c.cast("string")


def cell_counts(df: DataFrame) -> DataFrame:
    """`(column, kind, value) → n` for every flat column, missing values included."""
    cells = F.array(
        *[
            F.struct(
                F.lit(i).alias("position"), F.lit(f.name).alias("column"), F.lit(_kind(f.dataType)).alias("kind"),
                _cell_text(f).alias("value"),
            )
            for i, f in enumerate(flat_columns(df))
        ]
    )
    return (
        df.select(F.explode(cells).alias("cell"))
        .groupBy("cell.position", "cell.column", "cell.kind", "cell.value")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def column_profile(df: DataFrame, approximate: bool = False) -> DataFrame:
    """Nulls, null share and distinct values per column.

    `approximate` trades exact distinct counts for a single pass without a shuffle of values.
    """
    if approximate:
        return _approximate_profile(df)
    return cell_counts(df).groupBy("position", "column").agg(*_basic_counts()).select(
        "column", "null_count", _null_pct(), "distinct_count"
    )


def _basic_counts() -> list[Column]:
    present = F.col("value").isNotNull()
    return [
        F.sum("n").alias("total"),
        F.coalesce(F.sum(F.when(~present, F.col("n"))), F.lit(0)).alias("null_count"),
        F.count("value").alias("distinct_count"),
    ]


def _null_pct() -> Column:
    return F.round(F.col("null_count") * 100.0 / F.col("total"), 2).alias("null_pct")


def _approximate_profile(df: DataFrame) -> DataFrame:
    fields = flat_columns(df)
    measures = [F.count(F.lit(1)).alias("total")]
    for i, f in enumerate(fields):
        measures.append(F.count_if(_cell_text(f).isNull()).alias(f"nulls_{i}"))
        measures.append(F.approx_count_distinct(F.col(f"`{f.name}`"), 0.01).alias(f"distinct_{i}"))
    rows = F.array(
        *[
            F.struct(
                F.lit(f.name).alias("column"), F.col(f"nulls_{i}").alias("null_count"),
                F.col(f"distinct_{i}").alias("distinct_count"), F.col("total"),
            )
            for i, f in enumerate(fields)
        ]
    )
    out = df.agg(*measures).select(F.explode(rows).alias("r")).select("r.*")
    return out.select("column", "null_count", _null_pct(), "distinct_count")


def column_samples(df: DataFrame, size: int = SAMPLE_SIZE) -> DataFrame:
    """A repeatable sample of distinct values per column: those with the smallest digests."""
    order = Window.partitionBy("column").orderBy(F.md5("value"), "value")
    picked = cell_counts(df).where("value IS NOT NULL").withColumn("r", F.row_number().over(order)).where(F.col("r") <= size)
    return picked.groupBy("column").agg(F.array_join(F.array_sort(F.collect_list("value")), "|").alias("sample_values"))


def _exact_distinct(df: DataFrame, fields: Sequence[T.StructField]) -> DataFrame:
    """`(position, distinct)` of the given columns: values are shuffled as two 64-bit hashes, not as text."""
    cells = F.array(
        *[
            F.struct(F.lit(i).alias("position"), F.xxhash64(_cell_text(f)).alias("a"), F.xxhash64(_cell_text(f), F.lit(1)).alias("b"),
                     _cell_text(f).isNotNull().alias("filled"))
            for i, f in enumerate(fields)
        ]
    )
    values = df.select(F.explode(cells).alias("c")).select("c.*").where("filled").select("position", "a", "b").distinct()
    return values.groupBy("position").agg(F.count(F.lit(1)).alias("exact"))


def type_statistics(df: DataFrame) -> DataFrame:
    """Per column: rows, nulls, distinct values by sketch, and shares of filled cells with each pattern.

    One scan of conditional sums; no cell leaves its row. Patterns are only tried on columns that can have them.
    """
    fields = flat_columns(df)
    booleans = [*TRUE_TOKENS, *FALSE_TOKENS]
    measures, rows = [F.count(F.lit(1)).alias("total")], []
    for i, f in enumerate(fields):
        value, kind = _cell_text(f), _kind(f.dataType)
        trimmed, lowered = F.trim(value), F.lower(F.trim(value))
        tests = {"booleans": lowered.isin(*booleans)}
        if kind == "numeric":
            tests["serial"] = F.col(f"`{f.name}`").cast("double").between(SERIAL_DATE_MIN, SERIAL_DATE_MAX)
        if kind == "text":
            tests |= {
                "digits": value.rlike(r"^\d+$"),
                "delimited": value.rlike(DATE_DELIMITER),
                "dates": date_from_text(value).isNotNull(),
                "percent": trimmed.endswith("%") & trimmed.rlike(PERCENT_TEXT),
                "numbers": F.translate(trimmed, "₹$€£, \t\n\x0b\f\r", "").rlike(NUMBER_TEXT),
                "currency": value.rlike(CURRENCY_SIGN),
            }
        measures.append(F.count(value).alias(f"filled_{i}"))
        measures.append(F.approx_count_distinct(value, 0.02).alias(f"distinct_{i}"))
        bit = F.call_function("shiftleft", F.lit(1), F.array_position(F.lit(booleans), lowered).cast("int"))
        measures.append(F.coalesce(F.bit_count(F.bit_or(F.when(tests["booleans"], bit))), F.lit(0)).alias(f"words_{i}"))
        measures += [F.count_if(test).alias(f"{name}_{i}") for name, test in tests.items()]
        shares = [
            (F.try_divide(F.col(f"{name}_{i}").cast("double"), F.col(f"filled_{i}")) if name in tests else F.lit(0.0)).alias(name)
            for name in ("booleans", "serial", "digits", "delimited", "dates", "percent", "numbers", "currency")
        ]
        rows.append(
            F.struct(
                F.lit(i).alias("position"), F.lit(f.name).alias("column"), F.lit(kind).alias("kind"), F.col("total"),
                (F.col("total") - F.col(f"filled_{i}")).alias("null_count"),
                F.least(F.col(f"distinct_{i}"), F.col(f"filled_{i}")).alias("distinct_count"),
                F.col(f"words_{i}").alias("boolean_words"), *shares,
            )
        )
    return df.agg(*measures).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def infer_types(df: DataFrame, exact: bool = False) -> DataFrame:
    """One row per column: inferred type, confidence, counts and whether a person should look.

    Detectors run in the order identifier, date, boolean, number, category; free text is last. Distinct values are
    counted by a sketch in the one scan that everything else takes; a column whose sketch lies so near one of the
    limits that it could err is counted exactly, which is a job that runs while the plan is built. `exact` counts
    all columns exactly.
    """
    fields = flat_columns(df)
    stats = type_statistics(df)
    if exact:
        near = list(range(len(fields)))
    else:
        stats = settle(stats, "types")
        unique = F.try_divide(F.col("distinct_count"), F.col("total") - F.col("null_count"))
        doubt = (unique > 0.85) | unique.between(0.27, 0.33) | F.col("distinct_count").between(40, 60)
        near = [r["position"] for r in stats.where(doubt).select("position").collect()]
    if near:
        counted = _exact_distinct(df, [fields[i] for i in near])
        counted = counted.select(F.element_at(F.array(*map(F.lit, near)), F.col("position") + 1).alias("position"), "exact")
        stats = stats.join(counted, "position", "left")
        sure = F.when(F.col("position").isin(near), F.coalesce("exact", F.lit(0))).otherwise(F.col("distinct_count"))
        stats = stats.withColumn("distinct_count", sure)
    c = F.col
    filled = c("total") > c("null_count")
    unique = c("distinct_count") / (c("total") - c("null_count"))
    hinted = F.lower("column").rlike("|".join(ID_HINTS))
    is_numeric, is_date = c("kind") == "numeric", c("kind") == "datetime"
    serial_date = is_numeric & (c("serial") > 0.9)
    bare_digits = (c("digits") > 0.5) & (c("delimited") < 0.5)
    text_date = ~bare_digits & (c("dates") > 0.85)
    boolean = (c("booleans") == 1.0) & (c("boolean_words") <= 2)
    percent = ~is_numeric & (c("percent") > 0.85)
    numeric_text = ~is_numeric & (c("numbers") > 0.85)
    category = (c("distinct_count") <= 50) & (unique < 0.3)

    def case(kind: str, confidence: Column | float) -> Column:
        return F.struct(F.lit(kind).alias("type"), F.round(F.lit(confidence) if isinstance(confidence, float)
                                                           else confidence, 3).cast("double").alias("confidence"))

    refined = F.when(c("currency") > 0.5, "currency").when(c("percent") > 0.5, "percentage").otherwise("numeric")

    def numeric_case(confidence: Column | float) -> Column:
        score = F.lit(confidence) if isinstance(confidence, float) else confidence
        return F.struct(refined.alias("type"), F.round(score, 3).cast("double").alias("confidence"))

    verdict = (
        F.when(~filled, case("text", 0.4))
        .when((unique > 0.95) & hinted, case("id", 0.95))
        .when(unique > 0.99, case("id", 0.7))
        .when(is_date, case("datetime", 0.99))
        .when(serial_date, case("datetime", 0.8))
        .when(text_date, case("datetime", F.least(F.lit(0.95), 0.6 + c("dates") * 0.4)))
        .when(boolean, case("boolean", 0.9))
        .when(is_numeric, numeric_case(0.97))
        .when(percent, numeric_case(0.9))
        .when(numeric_text, numeric_case(F.least(F.lit(0.95), 0.55 + c("numbers") * 0.4)))
        .when(category, case("categorical", 0.85))
        .otherwise(case("text", 0.4))
    )
    return stats.withColumn("v", verdict).select(
        "column",
        F.col("v.type").alias("inferred_type"),
        F.col("v.confidence").alias("confidence"),
        "null_count",
        _null_pct(),
        "distinct_count",
        (F.col("v.confidence") < REVIEW_BELOW).alias("needs_review"),
    )


def type_override(df: DataFrame, column: str, target: str) -> DataFrame:
    """Recasts one column to a chosen type; what cannot be read becomes null."""
    dtype = df.schema[column].dataType
    c = F.col(f"`{column}`")
    if target == "datetime":
        new = as_timestamp(c, dtype if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType))
                           else T.StringType())
    elif target in ("numeric", "currency"):
        bare = F.trim(F.regexp_replace(c.cast("string"), CURRENCY_MARKS, ""))
        new = F.when(bare.rlike(NUMBER_TEXT), bare.try_cast("double"))
    elif target == "percentage":
        bare = F.trim(F.regexp_replace(c.cast("string"), r"%\s*$", ""))
        new = F.when(bare.rlike(NUMBER_TEXT), bare.try_cast("double"))
    elif target == "boolean":
        new = F.when(key_text(c).isin(*TRUE_TOKENS), True).when(key_text(c).isin(*FALSE_TOKENS), False)
    elif target in ("text", "id") and isinstance(dtype, (T.DoubleType, T.FloatType)):
        whole = finite(c) == F.floor(finite(c))
        filled = c.isNotNull() & ~F.isnan(c)
        ratio = df.agg(F.avg(F.when(filled, F.coalesce(whole, F.lit(False)).cast("double")))).scalar()
        as_int = F.when(whole, c.cast("decimal(38,0)").cast("string")).otherwise(c.cast("string"))
        new = F.when(ratio >= 0.99, as_int).otherwise(c.cast("string"))
    elif target in ("categorical", "text", "id"):
        new = c.cast("string")
    else:
        raise ValueError(f"unknown target type {target}")
    return df.withColumn(column, new)


def role_parse_failures(df: DataFrame, roles: Roles) -> DataFrame:
    """Share of filled cells that cannot be read as the number or date their role needs."""
    checks = []
    for role in roles.mapped((*R.NUMBER_ROLES, *R.DATE_ROLES)):
        column = roles.resolve(role)
        if column not in df.columns:
            continue
        c = F.col(f"`{column}`")
        if role in R.NUMBER_ROLES:
            bare = F.regexp_replace(c.cast("string"), r"[₹$€£¥,\s%]", "")
            good = F.when(bare.rlike(NUMBER_TEXT), bare.try_cast("double")).isNotNull()
        else:
            good = as_timestamp(c, df.schema[column].dataType).isNotNull()
        checks.append((role, column, F.avg(F.when(c.isNotNull(), (~good).cast("double")))))
    if not checks:
        return df.sparkSession.createDataFrame([], "role string, column string, failure_rate double, warns boolean")
    row = df.agg(*[m.alias(f"f{i}") for i, (_, _, m) in enumerate(checks)])
    rows = F.array(
        *[
            F.struct(F.lit(role).alias("role"), F.lit(column).alias("column"),
                     F.round(F.col(f"f{i}"), 6).alias("failure_rate"))
            for i, (role, column, _) in enumerate(checks)
        ]
    )
    out = row.select(F.explode(rows).alias("r")).select("r.*").where("failure_rate IS NOT NULL")
    return out.withColumn("warns", F.col("failure_rate") > PARSE_FAILURE_WARN)


def _missing_cells(df: DataFrame) -> Column:
    missing = [_cell_text(f).isNull().cast("bigint") for f in flat_columns(df)]
    return sum(missing[1:], missing[0])


def quality_banner(df: DataFrame) -> DataFrame:
    """Rows, missing cells, completeness and exact duplicate rows.

    Rows are equal if all their columns are, nested ones too. They are compared by a 256-bit digest of their JSON
    text, so what is shuffled is one digest and one number per row.
    """
    names = flat_columns(df)
    plain = [F.col(f"`{f.name}`").alias(f"c{i}") for i, f in enumerate(df.schema.fields)]
    digest = F.sha2(F.to_json(F.struct(*plain), {"ignoreNullFields": "false"}), 256)
    rows = df.select(digest.alias("__row"), _missing_cells(df).alias("__missing")).groupBy("__row").agg(
        F.count(F.lit(1)).alias("__n"), F.sum("__missing").alias("__missing")
    )
    totals = rows.agg(
        F.coalesce(F.sum("__n"), F.lit(0)).alias("row_count"),
        F.coalesce(F.sum("__missing"), F.lit(0)).alias("missing_cells"),
        F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).alias("duplicate_rows"),
    )
    cells = F.greatest(F.col("row_count") * len(names), F.lit(1))
    complete = F.greatest(F.lit(0.0), 100.0 - F.col("missing_cells") * 100.0 / cells)
    return totals.select("row_count", "missing_cells", F.round(complete, 1).alias("completeness_pct"), "duplicate_rows")


def data_quality_score(df: DataFrame, profile: DataFrame) -> DataFrame:
    """100 less weighted shares of missing cells, duplicate rows and columns to review."""
    review = profile.agg(F.avg(F.col("needs_review").cast("double"))).scalar()
    banner = quality_banner(df)
    cells = F.col("row_count") * len(flat_columns(df))
    missing = F.try_divide(F.col("missing_cells").cast("double"), cells)
    duplicate = F.try_divide(F.col("duplicate_rows").cast("double"), F.col("row_count"))
    score = 100.0 - (missing * 45.0 + duplicate * 25.0 + F.coalesce(review, F.lit(0.0)) * 30.0)
    bounded = F.greatest(F.lit(0.0), F.least(F.lit(100.0), score))
    return banner.select(
        F.when(F.col("row_count") == 0, 0).otherwise(F.bround(bounded, 0).cast("int")).alias("quality_score"),
        F.round(missing, 6).alias("missing_ratio"),
        F.round(duplicate, 6).alias("duplicate_ratio"),
        F.round(review, 6).alias("review_ratio"),
    )


def readiness_score(profile: DataFrame, roles: Roles) -> DataFrame:
    """Weighted readiness of schema, role binding and data, with its band."""
    confirmed = [role for role in roles.columns if roles.has(role)]
    mapping = 100.0 * len(confirmed) / max(len(roles.columns), 1) if roles.columns else 0.0
    needed = (R.RECORD_ID, R.REGISTRATION_DATE, R.STATUS)
    required = 100.0 * len(roles.mapped(needed)) / len(needed)
    hierarchy = 100.0 if roles.mapped(R.PLACE_HIERARCHY[:4]) else 0.0
    dated = 100.0 if roles.has(R.REGISTRATION_DATE) else 0.0
    fixed = mapping * 0.25 + required * 0.20 + hierarchy * 0.075 + dated * 0.075
    row = profile.agg(
        F.count(F.lit(1)).alias("columns"),
        F.avg((~F.col("needs_review")).cast("double")).alias("reviewed"),
        F.avg("null_pct").alias("null_pct"),
    )
    quality = F.greatest(F.lit(0.0), 100.0 - F.col("null_pct"))
    total = F.col("reviewed") * 100.0 * 0.20 + quality * 0.20 + F.lit(fixed)
    score = F.coalesce(F.bround(F.greatest(F.lit(0.0), F.least(F.lit(100.0), total)), 0).cast("int"), F.lit(0))
    band = F.lit(None).cast("string")
    for low, label in reversed(READINESS_BANDS):
        band = F.when(F.col("readiness_score") >= low, label).otherwise(band)
    return row.select(
        score.alias("readiness_score"),
        F.round(F.col("reviewed") * 100.0, 4).alias("schema_pct"),
        F.lit(mapping).alias("role_pct"),
        F.round(quality, 4).alias("data_pct"),
        F.lit(required).alias("required_pct"),
    ).withColumn("band", band)


def quality_alerts(
    profile: DataFrame, roles: Roles, duplicate_groups: DataFrame, outlier_columns: DataFrame
) -> DataFrame:
    """Alert rows (severity, category, measure) from the profile and the cleaning flags."""
    review = profile.agg(F.count_if("needs_review").cast("bigint")).scalar()
    dup = duplicate_groups.agg(F.count(F.lit(1))).scalar()
    out = outlier_columns.agg(F.count(F.lit(1))).scalar()
    missing_core = len(roles.missing((R.RECORD_ID, R.REGISTRATION_DATE, R.STATUS)))
    unconfirmed = len([r for r in roles.columns if not roles.has(r)])
    row = readiness_score(profile, roles).select("band").withColumns(
        {"review": review, "dup": dup, "outliers": out}
    )
    weak = F.col("band").isin("Critical", "Poor")

    def alert(when: Column, severity: Column | str, category: str, measure: Column) -> Column:
        level = F.lit(severity) if isinstance(severity, str) else severity
        return F.when(
            when,
            F.struct(level.alias("severity"), F.lit(category).alias("category"),
                     measure.cast("bigint").alias("affected")),
        )

    alerts = F.array_compact(
        F.array(
            alert(weak, F.when(F.col("band") == "Critical", "critical").otherwise("warning"),
                  "Analytics Readiness", F.lit(1)),
            alert(F.col("review") > 0, "warning", "Type Inference Review", F.col("review")),
            alert(F.lit(missing_core > 0), "warning", "Missing Role Mappings", F.lit(missing_core)),
            alert(F.lit(missing_core == 0 and unconfirmed > 0), "info", "Missing Role Mappings", F.lit(unconfirmed)),
            alert(F.col("dup") > 0, "warning", "Business Key Duplicates", F.col("dup")),
            alert(F.col("outliers") > 0, "info", "Outlier Columns", F.col("outliers")),
        )
    )
    quiet = F.array(F.struct(F.lit("info").alias("severity"), F.lit("System").alias("category"),
                             F.lit(0).cast("bigint").alias("affected")))
    return row.select(F.explode(F.when(F.size(alerts) > 0, alerts).otherwise(quiet)).alias("a")).select("a.*")


def match_text(c: Column) -> Column:
    """Lower-case words with single spaces; underscores, dashes and dots part words as spaces do."""
    return F.trim(F.lower(F.regexp_replace(c, r"[\s_.-]+", " ")))


def fuzzy_matches(
    df: DataFrame, column: str, vocabulary: Sequence[str], min_score: float = 70.0, top: int = 3
) -> DataFrame:
    """Best vocabulary entries for each distinct value of a column, with the number of rows it holds.

    Meant for a short list of known words: it is one array in the plan, and each distinct value is scored
    against all of it in its own row, so nothing is joined. The column's values may be as many as they like.
    """
    values = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(
        F.count(F.lit(1)).alias("row_count")
    )
    mine = F.col("norm")
    entries = F.transform(
        F.array(*[F.lit(v) for v in vocabulary]),
        lambda v: F.struct(v.alias("match"), match_text(v).alias("norm")),
    )

    def scored(entry: Column) -> Column:
        other = entry["norm"]
        base = (1 - F.levenshtein(mine, other) / F.greatest(F.length(mine), F.length(other))) * 100.0
        inside = F.contains(mine, other) | F.contains(other, mine)
        score = F.when(mine == other, 100.0).when(inside, F.greatest(base, F.lit(85.0))).otherwise(base)
        return F.struct((-F.round(score, 1)).alias("order"), entry["match"].alias("match"))

    candidates = F.filter(F.transform(entries, scored), lambda s: -s["order"] >= min_score)
    best = F.slice(F.array_sort(candidates), 1, top)
    return (
        values.withColumn("norm", match_text(F.col("value")))
        .where("norm <> ''")
        .select("value", "row_count", F.posexplode(best).alias("pos", "hit"))
        .select("value", "row_count", (F.col("pos") + 1).alias("rank"), F.col("hit.match").alias("match"),
                (-F.col("hit.order")).alias("score"))
    )

"""Checks: sources, profiling and cleaning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casekit.checks.tables import ROLES, cases, table, with_cases
from casekit.functions.expressions import date_from_text, is_ambiguous_date
from casekit.operators import cleaning, fuzzy, profiling
from casekit.plans.roles import Roles
from casekit.sources import files

# ---- derived dirty tables -------------------------------------------------------------


def dirty_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders written the way people type them: symbols, padding, placeholders, mixed dates."""
    o = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    whole = F.floor("o_totalprice").cast("bigint")
    amount = (
        F.when(key % 5 == 0, F.concat(F.lit("₹"), F.format_number(whole, 0)))
        .when(key % 5 == 1, whole.cast("string"))
        .when(key % 5 == 2, F.concat(F.lit("$ "), whole.cast("string"), F.lit(".0")))
        .when(key % 5 == 3, F.concat(F.lit("  "), whole.cast("string"), F.lit(" ")))
        .otherwise(F.when(key % 10 == 4, "N/A").otherwise(whole.cast("string")))
    )
    date = (
        F.when(key % 17 == 0, "--")
        .when(key % 4 == 0, F.date_format("o_orderdate", "yyyy-MM-dd"))
        .when(key % 4 == 1, F.upper(F.date_format("o_orderdate", "dd_MMM_yyyy")))
        .when(key % 4 == 2, F.date_format("o_orderdate", "M/d/yyyy"))
        .otherwise(F.date_format("o_orderdate", "d-M-yyyy"))
    )
    status = F.element_at(
        F.array(*[F.lit(s) for s in (" Closed", "RESOLVED ", "done", "wip", "Weird   State", "NULL", "Repeat")]),
        (key % 7 + 1).cast("int"),
    )
    return o.select(
        F.concat(F.lit("  ORD  "), key.cast("string"), F.lit(" ")).alias("ticket_id"),
        amount.alias("amount_text"),
        date.alias("opened_text"),
        status.alias("status_text"),
        F.datediff(F.col("o_orderdate"), F.lit("1899-12-30").cast("date")).cast("double").alias("opened_serial"),
        F.col("o_custkey").alias("customer"),
    )


DIRTY_KEY = "o_orderkey"
# What the dirty cells mean, from the clean columns they were written from.
TRUE_AMOUNT = "CASE WHEN o_orderkey % 10 = 4 THEN NULL ELSE floor(o_totalprice) END"
TRUE_DATE = "CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE CAST(o_orderdate AS TIMESTAMP) END"
TRUE_STATUS = """CASE o_orderkey % 7 WHEN 0 THEN 'Closed' WHEN 1 THEN 'RESOLVED' WHEN 2 THEN 'done' WHEN 3 THEN 'wip'
  WHEN 4 THEN 'Weird State' WHEN 5 THEN NULL ELSE 'Repeat' END"""
TRUE_TICKET = "'ORD ' || CAST(o_orderkey AS VARCHAR)"


def csv_roundtrip(spark, sf_dir):
    path = files.staging_path(spark, "csv")
    customers = table(spark, sf_dir, "customer")
    files.write_csv(customers, path)
    return files.scan_csv(spark, path, customers.schema)


def csv_union(spark, sf_dir):
    """Two exports with different columns, united by name."""
    customers = table(spark, sf_dir, "customer")
    suppliers = table(spark, sf_dir, "supplier")
    a, b = files.staging_path(spark, "csv-a"), files.staging_path(spark, "csv-b")
    files.write_csv(customers.select(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")), a)
    files.write_csv(suppliers.select(F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation")), b)
    return files.scan_csv(spark, [a, b])


def csv_bad_rows(spark, sf_dir):
    """Numbers that do not parse make a row bad; the rest is read and bad rows are counted."""
    path = files.staging_path(spark, "csv-bad")
    orders = table(spark, sf_dir, "orders")
    price = F.when(F.col("o_orderkey") % 10 == 0, "oops").otherwise(F.col("o_totalprice").cast("string"))
    files.write_csv(orders.select("o_orderkey", price.alias("price")), path)
    schema = "o_orderkey bigint, price double"
    kept = files.scan_csv(spark, path, schema, drop_bad_rows=True).agg(F.count("price").alias("good_rows"), F.count("o_orderkey").alias("read_rows"))
    marked = files.scan_csv(spark, path, schema, keep_bad_rows=True)
    return kept.withColumn("bad_rows", files.bad_rows(marked).scalar())


def _exported(df: DataFrame, path: str, **options: str) -> None:
    """Files with a header as another program exports them, each task its own."""
    df.write.options(header=True, escape='"', **options).csv(path)


def csv_mixed_headers(spark, sf_dir):
    """One pattern over files whose headers differ in order, separator and columns."""
    path = files.staging_path(spark, "csv-mixed")
    orders = table(spark, sf_dir, "orders")
    key, who, status = F.col("o_orderkey").alias("key"), F.col("o_custkey").alias("who"), F.col("o_orderstatus").alias("status")
    _exported(orders.where("o_orderkey % 3 = 0").select(key, who), f"{path}/a")
    _exported(orders.where("o_orderkey % 3 = 1").select(who, key, status), f"{path}/b", sep=";")
    _exported(orders.where("o_orderkey % 3 = 2").select(key, who), f"{path}/c")
    return files.scan_csv(spark, f"{path}/*/*.csv", sep=None)


def _quoted(spark, sf_dir):
    path = files.staging_path(spark, "csv-quoted")
    between = F.when(F.col("o_orderkey") % 2 == 0, "\n").otherwise(",")
    note = F.concat(F.lit('say "'), F.col("o_orderstatus"), F.lit('" now'), between, F.lit("then"))
    _exported(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), note.alias("note")), path)
    return files.scan_csv(spark, f"{path}/*.csv", "key bigint, note string", multi_line=True)


def csv_quoted(spark, sf_dir):
    """Line breaks, separators and doubled quotes within quotes, with the rows counted in three ways."""
    read = _quoted(spark, sf_dir)
    return read.withColumns({"rows": F.lit(read.count()), "keys": F.lit(read.select("key").where("key IS NOT NULL").count())})


def csv_latin1(spark, sf_dir):
    """Files in a one-byte encoding beside others in UTF-8."""
    path = files.staging_path(spark, "csv-latin")
    name = F.concat(F.lit("Zoë Müßig "), F.col("c_custkey").cast("string")).alias("name")
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), name)
    _exported(rows.where("key % 2 = 0"), f"{path}/a", encoding="ISO-8859-1")
    _exported(rows.where("key % 2 = 1"), f"{path}/b")
    return files.scan_csv(spark, f"{path}/*/*.csv", "key bigint, name string", encoding=None)


def clean_dates_mixed(spark, sf_dir):
    """The shapes people and programs write, all in one column; what stands for the day in each is the order date."""
    day = F.col("o_orderdate")
    shapes = [
        F.date_format(day, "dd/MM/yyyy"), F.concat(F.date_format(day, "M/d/yyyy"), F.lit(" 10:30")), F.date_format(day, "yyyy/MM/dd"),
        F.date_format(day, "d MMM yyyy"), F.concat(F.upper(F.date_format(day, "dd-MMM-yyyy")), F.lit(" 11:00")),
        F.date_format(day, "MMMM d, yyyy"), F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("T03:04:05Z")),
        F.date_format(day, "yyyyMMdd"), F.date_format(day, "M/d/yy"), F.concat(F.date_format(day, "M/d/yyyy"), F.lit(" 1:05 PM")),
    ]
    written = F.element_at(F.array(*shapes), (F.col("o_orderkey") % 10 + 1).cast("int"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", written.alias("written"))
    return rows.select("o_orderkey", date_from_text("written").alias("opened"), is_ambiguous_date("written").alias("is_ambiguous"))


def parquet_sink_roundtrip(spark, sf_dir):
    return files.stage(table(spark, sf_dir, "orders"), "sink")


def csv_export(spark, sf_dir):
    path = files.staging_path(spark, "export")
    view = cases(spark, sf_dir).where("status = 'Open'").select("record_id", "category", "zone")
    files.write_csv(view, path)
    return files.scan_csv(spark, path, view.schema)


def sanitize_headers(spark, sf_dir):
    """Headers that clash once cleaned, and in capitals only."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_tax")
    return files.sanitize_headers(lines.toDF("Order Key #", " Order/Key # ", "order_key_2", "2nd", "ID", "id"))


def _mixed(spark, sf_dir):
    key = F.col("o_orderkey")
    text = (
        F.when(key % 6 == 0, F.concat(key.cast("string"), F.lit(".0")))
        .when(key % 6 == 1, F.lit(" Unknown "))
        .when(key % 6 == 2, F.lit("?"))
        .when(key % 6 == 3, F.concat(F.lit("  "), F.col("o_orderpriority"), F.lit(" ")))
        .when(key % 6 == 4, F.concat(key.cast("string"), F.lit(".50")))
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", text.alias("mixed"))


PROFILED = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
_PROFILE_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS null_count, "
    f"round((count(*) - count({c})) * 100.0 / count(*), 2) AS null_pct, count(DISTINCT {c}) AS distinct_count FROM orders"
    for c in PROFILED
)
_CASE_PROFILE = ("closing_date", "officer", "status", "reopen_flag", "latitude")
_CASE_PROFILE_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS null_count, "
    f"CAST(round((count(*) - count({c})) * 100.0 / count(*), 2) AS DOUBLE) AS null_pct, "
    f"count(DISTINCT {c}) AS distinct_count FROM cases"
    for c in _CASE_PROFILE
)

DIRTY_ROLES = Roles(
    {"record_id": "ticket_id", "amount": "amount_text", "registration_date": "opened_text", "status": "status_text"}
)


def type_override_cast(spark, sf_dir):
    df = dirty_orders(spark, sf_dir)
    df = profiling.type_override(df, "amount_text", "currency")
    df = profiling.type_override(df, "opened_text", "datetime")
    df = profiling.type_override(df, "opened_serial", "id")
    flag = df.withColumn("is_even", F.when(F.col("customer") % 3 == 0, "Yes").when(F.col("customer") % 3 == 1, "f").otherwise("maybe"))
    return profiling.type_override(flag, "is_even", "boolean").select(
        F.trim(F.regexp_replace("ticket_id", r"\s+", " ")).alias("ticket_id"), "amount_text", "opened_text",
        "opened_serial", "is_even",
    )


def _failing(spark, sf_dir):
    """A numeric and a date role with unreadable cells."""
    df = dirty_orders(spark, sf_dir)
    return df.withColumn("due", F.when(F.col("customer") % 4 == 0, "soon").otherwise(F.col("opened_text")))


FAILING_ROLES = Roles({"amount": "amount_text", "sla_deadline": "due", "registration_date": "opened_text"})


ALERT_ROLES = DIRTY_ROLES.without("status")


def alerts(spark, sf_dir):
    """No status is mapped; twins of some tickets differ in their amount."""
    df = dirty_orders(spark, sf_dir)
    twins = df.where("customer % 9 = 0").withColumn("amount_text", F.lit("1"))
    done = cleaning.clean_table(df.unionByName(twins), ALERT_ROLES)
    return profiling.quality_alerts(profiling.infer_types(df), ALERT_ROLES, done.duplicates, done.outliers)


VOCABULARY = ("economy", "standard type", "promo", "medium burnished", "large", "small ring", "blue gadget")


def keyed_lines(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").withColumn(
        "line_key", F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    )


def repeated_lines(spark, sf_dir):
    """Lines reduced to few columns, so that whole rows repeat, with some rows emptied."""
    keep = F.col("l_partkey") % 50 != 0
    return table(spark, sf_dir, "lineitem").select(
        F.when(keep, F.col("l_returnflag")).alias("flag"), F.when(keep, F.col("l_linestatus")).alias("line_status"),
        F.when(keep, F.col("l_quantity")).alias("quantity"), F.when(keep, F.col("l_linenumber")).alias("line_number"),
    )


_REPEATED_SQL = """SELECT CASE WHEN l_partkey % 50 <> 0 THEN l_returnflag END AS flag,
  CASE WHEN l_partkey % 50 <> 0 THEN l_linestatus END AS line_status,
  CASE WHEN l_partkey % 50 <> 0 THEN l_quantity END AS quantity,
  CASE WHEN l_partkey % 50 <> 0 THEN l_linenumber END AS line_number FROM lineitem"""


def clean_timezone(spark, sf_dir):
    zoned = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    return cleaning.strip_timezones(zoned)


def clean_decimal(spark, sf_dir):
    exact = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").cast("decimal(14,2)").alias("price"))
    return cleaning.decimals_to_double(exact)


def clean_null_type(spark, sf_dir):
    return cleaning.empty_to_text(table(spark, sf_dir, "orders").withColumn("note", F.lit(None)))


def clean_whitespace(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return cleaning.trim_whitespace(docs).select(
        "doc_id", F.md5("text").alias("text_md5"), F.length("text").cast("bigint").alias("text_length")
    )


def clean_null_tokens(spark, sf_dir):
    dirty = dirty_orders(spark, sf_dir)
    return cleaning.nullify_placeholders(cleaning.trim_whitespace(dirty)).agg(
        F.count(F.lit(1)).alias("rows"), F.count("amount_text").alias("amounts"),
        F.count("opened_text").alias("dates"), F.count("status_text").alias("statuses"),
    )


def clean_numeric(spark, sf_dir):
    df = cleaning.convert_numbers(dirty_orders(spark, sf_dir), ["amount_text"])
    return df.select(F.trim("ticket_id").alias("ticket_id"), "amount_text")


def clean_dates(spark, sf_dir):
    df = cleaning.standardize_dates(dirty_orders(spark, sf_dir), ["opened_text"], ["opened_serial"])
    return df.select(F.trim("ticket_id").alias("ticket_id"), "opened_text", "opened_serial")


def canonical(spark, sf_dir):
    df = cleaning.canonicalize_status(cleaning.trim_whitespace(dirty_orders(spark, sf_dir)), "status_text")
    return df.groupBy("status_text").agg(F.count(F.lit(1)).alias("rows"))


def column_profile_approx(spark, sf_dir):
    """Whether the sketch's distinct counts are within five hundredths of the exact ones."""
    orders = table(spark, sf_dir, "orders")
    exact = profiling.column_profile(orders).select("column", F.col("distinct_count").alias("exact"))
    near = F.abs(F.col("distinct_count") - F.col("exact")) <= 0.05 * F.col("exact")
    return profiling.column_profile(orders, approximate=True).join(exact, "column").select(
        "column", "null_count", "null_pct", near.alias("is_close")
    )


def cleaning_losses(spark, sf_dir):
    return cleaning.clean_table(dirty_orders(spark, sf_dir), DIRTY_ROLES).losses


def clean_table(spark, sf_dir):
    done = cleaning.clean_table(dirty_orders(spark, sf_dir), DIRTY_ROLES)
    return done.analytics


QUERIES = {
    "scan_parquet": lambda s, d: files.scan_parquet(s, f"{d}/lineitem.parquet"),
    "csv_roundtrip": csv_roundtrip,
    "csv_union_by_name": csv_union,
    "csv_bad_rows": csv_bad_rows,
    "csv_export": csv_export,
    "csv_mixed_headers": csv_mixed_headers,
    "csv_quoted": csv_quoted,
    "csv_latin1": csv_latin1,
    "clean_dates_mixed": clean_dates_mixed,
    "parquet_sink_roundtrip": parquet_sink_roundtrip,
    "sanitize_headers": sanitize_headers,
    "sanitize_mixed_text": lambda s, d: files.sanitize_cells(_mixed(s, d)),
    "preview_rows": lambda s, d: files.preview(table(s, d, "orders"), ["o_orderkey"], 200),
    "column_profile": lambda s, d: profiling.column_profile(table(s, d, "orders")),
    "column_profile_nulls": lambda s, d: profiling.column_profile(cases(s, d).select(*_CASE_PROFILE)),
    "column_profile_approx": column_profile_approx,
    "column_samples": lambda s, d: profiling.column_samples(table(s, d, "part").select("p_name", "p_brand", "p_type")),
    "infer_types": lambda s, d: profiling.infer_types(dirty_orders(s, d), exact=True),
    "infer_types_clean": lambda s, d: profiling.infer_types(table(s, d, "lineitem"), exact=True),
    "infer_types_one_scan": lambda s, d: profiling.infer_types(dirty_orders(s, d)).drop("distinct_count"),
    "type_override_cast": type_override_cast,
    "role_parse_failure": lambda s, d: profiling.role_parse_failures(_failing(s, d), FAILING_ROLES),
    "quality_banner": lambda s, d: profiling.quality_banner(repeated_lines(s, d)),
    "data_quality_score": lambda s, d: profiling.data_quality_score(
        repeated_lines(s, d), profiling.infer_types(repeated_lines(s, d))
    ),
    "readiness_score": lambda s, d: profiling.readiness_score(profiling.infer_types(cases(s, d)), ROLES),
    "readiness_score_dirty": lambda s, d: profiling.readiness_score(profiling.infer_types(dirty_orders(s, d)), DIRTY_ROLES),
    "quality_alerts": alerts,
    "fuzzy_value_join": lambda s, d: fuzzy.fuzzy_join(table(s, d, "pages"), "url", table(s, d, "pages"), "url", 90.0),
    "fuzzy_value_match": lambda s, d: profiling.fuzzy_matches(table(s, d, "part"), "p_name", VOCABULARY),
    "clean_timezone": clean_timezone,
    "clean_decimal": clean_decimal,
    "clean_null_type": clean_null_type,
    "clean_whitespace": clean_whitespace,
    "clean_null_tokens": clean_null_tokens,
    "clean_numeric": clean_numeric,
    "clean_dates": clean_dates,
    "business_key_duplicates": lambda s, d: cleaning.business_key_duplicates(keyed_lines(s, d), "line_key"),
    "iqr_outliers": lambda s, d: cleaning.outlier_fences(
        table(s, d, "lineitem").withColumn("skewed", F.pow("l_quantity", F.lit(6)) / 1000000),
        ["l_quantity", "l_extendedprice", "l_discount", "skewed"],
    ),
    "drop_empty_rows": lambda s, d: cleaning.drop_empty_rows(repeated_lines(s, d)),
    "drop_duplicate_rows": lambda s, d: cleaning.drop_duplicate_rows(repeated_lines(s, d)),
    "canonical_status": canonical,
    "clean_table": clean_table,
    "cleaning_losses": cleaning_losses,
    "cleaning_report": lambda s, d: cleaning.clean_table(dirty_orders(s, d), DIRTY_ROLES).report,
}

# The dirty table itself, for distinct counts, and what type inference should make of it.
_DIRTY_SQL = """dirty AS (SELECT o_orderkey AS k, '  ORD  ' || CAST(o_orderkey AS VARCHAR) || ' ' AS ticket_id,
    CASE WHEN o_orderkey % 5 = 0 THEN '₹' || format('{:,}', CAST(floor(o_totalprice) AS BIGINT))
      WHEN o_orderkey % 5 = 2 THEN '$ ' || CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) || '.0'
      WHEN o_orderkey % 5 = 3 THEN '  ' || CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) || ' '
      WHEN o_orderkey % 10 = 4 THEN 'N/A' ELSE CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) END AS amount_text,
    CASE WHEN o_orderkey % 17 = 0 THEN '--' WHEN o_orderkey % 4 = 0 THEN strftime(o_orderdate, '%Y-%m-%d')
      WHEN o_orderkey % 4 = 1 THEN upper(strftime(o_orderdate, '%d_%b_%Y'))
      WHEN o_orderkey % 4 = 2 THEN strftime(o_orderdate, '%-m/%-d/%Y') ELSE strftime(o_orderdate, '%-d-%-m-%Y') END AS opened_text,
    o_orderkey % 7 AS status_text, date_diff('day', DATE '1899-12-30', CAST(o_orderdate AS DATE)) AS opened_serial,
    o_custkey AS customer FROM orders)"""


def _dirty_row(column: str, kind: str, confidence: str, hinted: bool = False) -> str:
    unique = f"count(DISTINCT {column}) / CAST(count({column}) AS DOUBLE)"
    if hinted:
        kind, confidence = f"CASE WHEN {unique} > 0.95 THEN 'id' ELSE {kind} END", f"CASE WHEN {unique} > 0.95 THEN 0.95 ELSE {confidence} END"
    else:
        kind, confidence = f"CASE WHEN {unique} > 0.99 THEN 'id' ELSE {kind} END", f"CASE WHEN {unique} > 0.99 THEN 0.7 ELSE {confidence} END"
    return f"""SELECT '{column}' AS "column", {kind} AS inferred_type, CAST({confidence} AS DOUBLE) AS confidence,
      CAST(0 AS BIGINT) AS null_count, 0.0 AS null_pct, count(DISTINCT {column}) AS distinct_count,
      {confidence} < 0.75 AS needs_review FROM dirty"""


_DIRTY_TYPES = " UNION ALL ".join(
    [
        _dirty_row("ticket_id", "'text'", "0.4", hinted=True),
        _dirty_row("amount_text", "'numeric'", "round(least(0.95, 0.55 + 0.4 * avg(CASE WHEN k % 10 = 4 THEN 0.0 ELSE 1 END)), 3)"),
        _dirty_row("opened_text", "'datetime'", "round(least(0.95, 0.6 + 0.4 * avg(CASE WHEN k % 17 = 0 THEN 0.0 ELSE 1 END)), 3)"),
        _dirty_row("status_text", "'categorical'", "0.85"),
        _dirty_row("opened_serial", "'datetime'", "0.8"),
        _dirty_row("customer", "CASE WHEN avg(CASE WHEN customer BETWEEN 25569 AND 73050 THEN 1.0 ELSE 0 END) > 0.9 THEN 'datetime' ELSE 'numeric' END",
                   "CASE WHEN avg(CASE WHEN customer BETWEEN 25569 AND 73050 THEN 1.0 ELSE 0 END) > 0.9 THEN 0.8 ELSE 0.97 END"),
    ]
)


def _line_row(column: str) -> str:
    hinted = any(h in column for h in profiling.ID_HINTS)
    unique = f"count(DISTINCT {column}) / CAST(count({column}) AS DOUBLE)"
    if column == "l_shipdate":
        rest = [("true", "datetime", 0.99)]
    elif column in ("l_returnflag", "l_linestatus"):
        rest = [("true", "categorical", 0.85)]
    else:
        rest = [(f"avg(CASE WHEN {column} BETWEEN 25569 AND 73050 THEN 1.0 ELSE 0 END) > 0.9", "datetime", 0.8), ("true", "numeric", 0.97)]
    cases = [(f"{unique} > 0.95 AND {str(hinted).lower()}", "id", 0.95), (f"{unique} > 0.99", "id", 0.7), *rest]
    kind = "CASE " + " ".join(f"WHEN {c} THEN '{k}'" for c, k, _ in cases) + " END"
    confidence = "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, _, v in cases) + " END"
    return f"""SELECT '{column}' AS "column", {kind} AS inferred_type, CAST({confidence} AS DOUBLE) AS confidence,
      count(*) - count({column}) AS null_count, 0.0 AS null_pct, count(DISTINCT {column}) AS distinct_count,
      {confidence} < 0.75 AS needs_review FROM lineitem"""


LINE_COLUMNS = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
                "l_returnflag", "l_linestatus", "l_shipdate")
_READY = "WHEN score >= 90 THEN 'Excellent' WHEN score >= 75 THEN 'Good' WHEN score >= 55 THEN 'Fair' WHEN score >= 35 THEN 'Poor' ELSE 'Critical'"

_FUZZY_VOCAB_SQL = " UNION ALL ".join(f"SELECT '{v}' AS match" for v in VOCABULARY)
_SKEWED = "(SELECT *, pow(l_quantity, 6) / 1000000 AS skewed FROM lineitem)"
_OUTLIER_SQL = " UNION ALL ".join(
    f"""SELECT * FROM (WITH q AS (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM {_SKEWED})
    SELECT '{c}' AS "column", count(*) AS outlier_count, round(any_value(q1 - 3 * (q3 - q1)), 4) AS lower_fence,
           round(any_value(q3 + 3 * (q3 - q1)), 4) AS upper_fence
    FROM {_SKEWED}, q WHERE {c} < q1 - 3 * (q3 - q1) OR {c} > q3 + 3 * (q3 - q1)) WHERE outlier_count > 0"""
    for c in ("l_quantity", "l_extendedprice", "l_discount", "skewed")
)

ORACLE = {
    "scan_parquet": "SELECT * FROM lineitem",
    "csv_roundtrip": "SELECT * FROM customer",
    "csv_union_by_name": """SELECT c_name AS name, c_mktsegment AS segment, CAST(NULL AS VARCHAR) AS nation FROM customer
      UNION ALL SELECT s_name, NULL, CAST(s_nationkey AS VARCHAR) FROM supplier""",
    "csv_bad_rows": """SELECT count(*) FILTER (o_orderkey % 10 <> 0) AS good_rows,
      count(*) FILTER (o_orderkey % 10 <> 0) AS read_rows, count(*) FILTER (o_orderkey % 10 = 0) AS bad_rows FROM orders""",
    "csv_export": with_cases("SELECT record_id, category, zone FROM cases WHERE status = 'Open'"),
    "parquet_sink_roundtrip": "SELECT * FROM orders",
    "sanitize_headers": '''SELECT l_orderkey AS "Order_Key", l_partkey AS "Order_Key_3", l_suppkey AS "order_key_2",
      l_linenumber AS "_2nd", l_quantity AS "ID", l_tax AS "id_2" FROM lineitem''',
    "sanitize_mixed_text": """SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN CAST(o_orderkey AS VARCHAR)
      WHEN 3 THEN o_orderpriority WHEN 4 THEN CAST(o_orderkey AS VARCHAR) || '.50' END AS mixed FROM orders""",
    "preview_rows": "SELECT * FROM orders ORDER BY o_orderkey LIMIT 200",
    "column_profile": _PROFILE_SQL,
    "column_profile_nulls": with_cases(_CASE_PROFILE_SQL),
    "column_samples": " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", string_agg(v, '|' ORDER BY v) AS sample_values FROM
        (SELECT DISTINCT {c} AS v FROM part WHERE {c} IS NOT NULL ORDER BY md5({c}), {c} LIMIT 8)"""
        for c in ("p_name", "p_brand", "p_type")
    ),
    "infer_types": f"WITH {_DIRTY_SQL} {_DIRTY_TYPES}",
    "infer_types_clean": " UNION ALL ".join(_line_row(c) for c in LINE_COLUMNS),
    "readiness_score_dirty": f"""WITH {_DIRTY_SQL}, types AS ({_DIRTY_TYPES}),
      r AS (SELECT avg(CASE WHEN needs_review THEN 0.0 ELSE 1 END) AS reviewed FROM types),
      s AS (SELECT reviewed, CAST(round_even(reviewed * 20 + 20 + 25 + 20 + 7.5, 0) AS INTEGER) AS score FROM r)
      SELECT score AS readiness_score, round(reviewed * 100, 4) AS schema_pct, 100.0 AS role_pct, 100.0 AS data_pct,
        100.0 AS required_pct, CASE {_READY} END AS band FROM s""",
    "quality_alerts": f"""WITH {_DIRTY_SQL}, types AS ({_DIRTY_TYPES}),
      r AS (SELECT count(*) FILTER (needs_review) AS review FROM types),
      d AS (SELECT count(*) AS n FROM dirty WHERE customer % 9 = 0 AND amount_text IS DISTINCT FROM '1')
      SELECT 'warning' AS severity, 'Type Inference Review' AS category, review AS affected FROM r WHERE review > 0
      UNION ALL SELECT 'warning', 'Missing Role Mappings', CAST(1 AS BIGINT)
      UNION ALL SELECT 'warning', 'Business Key Duplicates', n FROM d WHERE n > 0""",
    "type_override_cast": f"""SELECT {TRUE_TICKET} AS ticket_id, {TRUE_AMOUNT} AS amount_text, {TRUE_DATE} AS opened_text,
      CAST(date_diff('day', DATE '1899-12-30', CAST(o_orderdate AS DATE)) AS VARCHAR) AS opened_serial,
      CASE o_custkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS is_even FROM orders""",
    "role_parse_failure": """WITH f AS (SELECT avg(CASE WHEN o_orderkey % 10 = 4 THEN 1.0 ELSE 0 END) AS a,
        avg(CASE WHEN o_custkey % 4 = 0 OR o_orderkey % 17 = 0 THEN 1.0 ELSE 0 END) AS s,
        avg(CASE WHEN o_orderkey % 17 = 0 THEN 1.0 ELSE 0 END) AS r FROM orders)
      SELECT 'amount' AS role, 'amount_text' AS "column", round(a, 6) AS failure_rate, a > 0.15 AS warns FROM f
      UNION ALL SELECT 'sla_deadline', 'due', round(s, 6), s > 0.15 FROM f
      UNION ALL SELECT 'registration_date', 'opened_text', round(r, 6), r > 0.15 FROM f""",
    "quality_banner": f"""WITH t AS ({_REPEATED_SQL})
      SELECT count(*) AS row_count,
        CAST(4 * count(*) - count(flag) - count(line_status) - count(quantity) - count(line_number) AS BIGINT) AS missing_cells,
        round(100.0 - (4 * count(*) - count(flag) - count(line_status) - count(quantity) - count(line_number)) * 100.0
          / (4 * count(*)), 1) AS completeness_pct,
        count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM t)) AS duplicate_rows FROM t""",
    "data_quality_score": f"""WITH t AS ({_REPEATED_SQL}), m AS (SELECT
        (4 * count(*) - count(flag) - count(line_status) - count(quantity) - count(line_number)) / (4.0 * count(*)) AS missing,
        (count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM t))) / CAST(count(*) AS DOUBLE) AS dup FROM t)
      SELECT CAST(round_even(100.0 - (missing * 45.0 + dup * 25.0), 0) AS INTEGER) AS quality_score,
        round(missing, 6) AS missing_ratio, round(dup, 6) AS duplicate_ratio, 0.0 AS review_ratio FROM m""",
    "fuzzy_value_match": f"""WITH vocab AS ({_FUZZY_VOCAB_SQL}),
      vals AS (SELECT p_name AS value, count(*) AS row_count FROM part WHERE p_name IS NOT NULL GROUP BY p_name),
      base AS (SELECT value, row_count, match, lower(value) AS n,
          (1 - levenshtein(lower(value), match) / CAST(greatest(length(value), length(match)) AS DOUBLE)) * 100.0 AS b
        FROM vals, vocab),
      scored AS (SELECT value, row_count, match, round(CASE WHEN n = match THEN 100.0
          WHEN contains(n, match) OR contains(match, n) THEN greatest(b, 85.0) ELSE b END, 1) AS score FROM base),
      ranked AS (SELECT *, row_number() OVER (PARTITION BY value ORDER BY score DESC, match) AS rank FROM scored
        WHERE score >= 70)
      SELECT value, row_count, CAST(rank AS INTEGER) AS rank, match, score FROM ranked WHERE rank <= 3""",
    "fuzzy_value_join": r"""WITH v AS (SELECT url AS value, count(*) AS row_count, trim(lower(regexp_replace(url, '[\s_.-]+', ' ', 'g'))) AS n
        FROM pages WHERE url IS NOT NULL GROUP BY url),
      base AS (SELECT a.value, a.row_count, b.value AS match, a.n AS mine, b.n AS other,
          (1 - levenshtein(a.n, b.n) / CAST(greatest(length(a.n), length(b.n)) AS DOUBLE)) * 100.0 AS b FROM v a, v b WHERE a.n <> '' AND b.n <> ''),
      scored AS (SELECT value, row_count, match, round(CASE WHEN mine = other THEN 100.0
          WHEN contains(mine, other) OR contains(other, mine) THEN greatest(b, 85.0) ELSE b END, 1) AS score FROM base),
      ranked AS (SELECT *, row_number() OVER (PARTITION BY value ORDER BY score DESC, match) AS rank FROM scored WHERE score >= 90)
      SELECT value, row_count, CAST(rank AS INTEGER) AS rank, match, score FROM ranked WHERE rank <= 3""",
    "clean_timezone": "SELECT event_id, ts FROM events",
    "clean_decimal": "SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(14, 2)) AS DOUBLE) AS price FROM orders",
    "clean_null_type": "SELECT *, CAST(NULL AS VARCHAR) AS note FROM orders",
    "csv_mixed_headers": """SELECT CAST(o_orderkey AS VARCHAR) AS key, CAST(o_custkey AS VARCHAR) AS who,
      CASE WHEN o_orderkey % 3 = 1 THEN o_orderstatus END AS status FROM orders""",
    "csv_quoted": """SELECT o_orderkey AS key, 'say "' || o_orderstatus || '" now' || CASE WHEN o_orderkey % 2 = 0 THEN chr(10) ELSE ',' END || 'then' AS note,
      count(*) OVER () AS rows, count(*) OVER () AS keys FROM orders""",
    "csv_latin1": "SELECT c_custkey AS key, 'Zoë Müßig ' || CAST(c_custkey AS VARCHAR) AS name FROM customer",
    "clean_dates_mixed": """WITH t AS (SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) AS d FROM orders),
      s AS (SELECT *, o_orderkey % 10 AS shape, day(d) AS dd, month(d) AS mm FROM t)
      SELECT o_orderkey, CASE shape WHEN 0 THEN CASE WHEN dd <= 12 THEN make_timestamp(year(d), dd, mm, 0, 0, 0) ELSE d END
          WHEN 1 THEN d + INTERVAL '10:30' HOUR_MINUTE WHEN 4 THEN d + INTERVAL 11 HOUR WHEN 6 THEN d + INTERVAL 11045 SECOND
          WHEN 9 THEN d + INTERVAL 47100 SECOND ELSE d END AS opened,
        shape IN (0, 1, 8, 9) AND dd <= 12 AND dd <> mm AS is_ambiguous FROM s""".replace("INTERVAL '10:30' HOUR_MINUTE", "INTERVAL 37800 SECOND"),
    "infer_types_one_scan": f"WITH {_DIRTY_SQL} SELECT * EXCLUDE (distinct_count) FROM ({_DIRTY_TYPES})",
    "column_profile_approx": f"SELECT \"column\", null_count, null_pct, true AS is_close FROM ({_PROFILE_SQL})",
    "cleaning_losses": """SELECT 'amount_text' AS "column", count(*) FILTER (o_orderkey % 10 <> 4) AS filled, CAST(0 AS BIGINT) AS lost FROM orders
      UNION ALL SELECT 'opened_text', count(*) FILTER (o_orderkey % 17 <> 0), 0 FROM orders
      UNION ALL SELECT 'opened_serial', count(*), 0 FROM orders""",
    "clean_whitespace": r"""WITH t AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS v FROM documents)
      SELECT doc_id, md5(v) AS text_md5, length(v) AS text_length FROM t""",
    "clean_null_tokens": """SELECT count(*) AS rows, count(*) FILTER (o_orderkey % 10 <> 4) AS amounts,
      count(*) FILTER (o_orderkey % 17 <> 0) AS dates, count(*) FILTER (o_orderkey % 7 <> 5) AS statuses FROM orders""",
    "clean_numeric": f"SELECT 'ORD  ' || CAST(o_orderkey AS VARCHAR) AS ticket_id, {TRUE_AMOUNT} AS amount_text FROM orders",
    "clean_dates": f"""SELECT 'ORD  ' || CAST(o_orderkey AS VARCHAR) AS ticket_id, {TRUE_DATE} AS opened_text,
      date_trunc('day', CAST(o_orderdate AS TIMESTAMP)) AS opened_serial FROM orders""",
    "business_key_duplicates": """WITH k AS (SELECT *, CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR)
        AS line_key FROM lineitem), r AS (SELECT line_key, count(*) AS n FROM k GROUP BY ALL)
      SELECT line_key, CAST(sum(n) AS BIGINT) AS occurrences FROM (
        SELECT line_key, count(*) AS n FROM k GROUP BY line_key, l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity,
          l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate)
      GROUP BY line_key HAVING sum(n) > 1 AND min(n) = 1""",
    "iqr_outliers": _OUTLIER_SQL,
    "drop_empty_rows": f"SELECT * FROM ({_REPEATED_SQL}) WHERE NOT (flag IS NULL AND line_status IS NULL AND quantity IS NULL AND line_number IS NULL)",
    "drop_duplicate_rows": f"SELECT DISTINCT * FROM ({_REPEATED_SQL})",
    "canonical_status": """SELECT CASE o_orderkey % 7 WHEN 0 THEN 'CLOSED' WHEN 1 THEN 'CLOSED' WHEN 2 THEN 'CLOSED'
      WHEN 3 THEN 'PENDING' WHEN 4 THEN 'Weird State' WHEN 5 THEN 'NULL' ELSE 'REOPENED' END AS status_text,
      count(*) AS rows FROM orders GROUP BY 1""",
    "clean_table": f"""SELECT {TRUE_TICKET} AS ticket_id, {TRUE_AMOUNT} AS amount_text, {TRUE_DATE} AS opened_text,
      CASE o_orderkey % 7 WHEN 0 THEN 'CLOSED' WHEN 1 THEN 'CLOSED' WHEN 2 THEN 'CLOSED' WHEN 3 THEN 'PENDING'
        WHEN 4 THEN 'Weird State' WHEN 5 THEN NULL ELSE 'REOPENED' END AS status_text,
      date_trunc('day', CAST(o_orderdate AS TIMESTAMP)) AS opened_serial, o_custkey AS customer FROM orders""",
    "cleaning_report": """WITH c AS (SELECT count(*) AS n, count(*) FILTER (o_orderkey % 5 = 3) AS padded_amounts,
        count(*) FILTER (o_orderkey % 7 IN (0, 1, 4)) AS padded_status, count(*) FILTER (o_orderkey % 10 = 4) AS a,
        count(*) FILTER (o_orderkey % 17 = 0) AS d, count(*) FILTER (o_orderkey % 7 = 5) AS s FROM orders)
      SELECT 1 AS step_order, 'timezone_columns_normalized' AS step, CAST(0 AS BIGINT) AS affected, '' AS columns FROM c
      UNION ALL SELECT 2, 'null_type_columns_coerced', 0, '' FROM c
      UNION ALL SELECT 3, 'decimal_columns_coerced', 0, '' FROM c
      UNION ALL SELECT 4, 'values_whitespace_trimmed', n + padded_amounts + padded_status, '' FROM c
      UNION ALL SELECT 5, 'values_null_normalized', a + d + s, '' FROM c
      UNION ALL SELECT 6, 'columns_dtype_converted', 1, 'amount_text' FROM c
      UNION ALL SELECT 7, 'date_columns_standardized', 2, 'opened_serial, opened_text' FROM c
      UNION ALL SELECT 8, 'business_key_duplicate_groups', 0, '' FROM c
      UNION ALL SELECT 9, 'outlier_columns_flagged', 0, '' FROM c
      UNION ALL SELECT 10, 'rows_removed_fully_empty', 0, '' FROM c
      UNION ALL SELECT 11, 'rows_removed_exact_duplicates', 0, '' FROM c""",
}

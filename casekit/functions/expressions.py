"""Column expressions shared by the operators. All of them stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Texts that mean "no value" when cleaning (matched as written).
CLEANING_NULL_TOKENS = ("NA", "N/A", "-", "--", "NULL", "null", "None", "none", "nil", "NIL", "#N/A", "")
# Texts that mean "no value" at ingest (matched trimmed and lower-cased).
INGEST_NULL_TOKENS = (
    "nan", "none", "null", "na", "n/a", "n.a.", "n.a", "nil", "nat", "<na>", "-", "--", "?", "unknown", "",
)
# Texts read as booleans.
TRUE_TOKENS = ("true", "yes", "y", "1", "t")
FALSE_TOKENS = ("false", "no", "n", "0", "f")
# Spreadsheet day numbers for 1970-01-01 and about 2100-01-01, and day zero.
SERIAL_DATE_MIN = 25569
SERIAL_DATE_MAX = 73050
SERIAL_DATE_ORIGIN = "1899-12-30"

# Fixed value: signs that are left out of a number text.
CURRENCY_MARKS = r"[₹$€£¥,\s]"
NUMBER_TEXT = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"

# Date texts: three parts with a month by number or by name, a time of day if any, or eight digits.
_TIME = r"(?:[ T]+(\d{1,2}):(\d{2})(?::(\d{2}(?:\.\d+)?))? ?([AaPp][Mm])?Z?)?"
YEAR_FIRST = rf"^(\d{{4}})[-/. ](\d{{1,2}})[-/. ](\d{{1,2}}){_TIME}$"
YEAR_LAST = rf"^(\d{{1,2}})([-/. ])(\d{{1,2}})[-/. ](\d{{4}}|\d{{2}}){_TIME}$"
NAMED_MONTH = rf"^(\d{{1,2}})(?:st|nd|rd|th)?[-/. ]+([A-Za-z]{{3,9}})\.?,?[-/. ]+(\d{{4}}|\d{{2}}){_TIME}$"
MONTH_FIRST = rf"^([A-Za-z]{{3,9}})\.?[-/. ]+(\d{{1,2}})(?:st|nd|rd|th)?,?[-/. ]+(\d{{4}}){_TIME}$"
SIGNS = ("-", "/", ".", " ")
MONTHS = ("january february march april may june july august september october november december").split()
# A two-digit year up to this one is of this century.
CENTURY_PIVOT = 68
DAY_ORDERS = ("by sign", "month first", "day first")
ISO_DATE_SHAPE = r"^\d{4}-\d{1,2}-\d{1,2}([ T]\d{1,2}:\d{2}(:\d{2}(\.\d+)?)?)?$"

US_PER_HOUR = 3_600_000_000.0
US_PER_DAY = 86_400_000_000.0
US_PER_UNIT = {"hours": US_PER_HOUR, "days": US_PER_DAY, "weeks": 7 * US_PER_DAY}


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def text(c: Column | str) -> Column:
    return F.trim(col(c).cast("string"))


def key_text(c: Column | str) -> Column:
    return F.lower(text(c))


def in_tokens(c: Column | str, tokens: Iterable[str]) -> Column:
    """Case-blind token test that is false, never null, for a missing value."""
    return F.coalesce(key_text(c).isin(*tokens), F.lit(False))


def collapse_spaces(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(col(c), r"\s+", " "))


def null_if_placeholder(c: Column | str) -> Column:
    c = col(c)
    return F.when(~c.isin(*CLEANING_NULL_TOKENS) & (F.trim(c) != ""), F.trim(c))


def sanitized_text(c: Column | str) -> Column:
    """Ingest form of a mixed column: trimmed, placeholders null, `11.0` written `11`."""
    t = text(c)
    return F.when(~F.lower(t).isin(*INGEST_NULL_TOKENS), F.regexp_replace(t, r"^(-?\d+)\.0+$", "$1"))


def finite(c: Column | str) -> Column:
    """A double with NaN and the infinities read as missing."""
    v = col(c).cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))), v)


def number_from_text(c: Column | str) -> Column:
    """`₹1,234.5`, `45%` or plain numbers as double; anything else is null."""
    bare = F.regexp_replace(col(c), CURRENCY_MARKS, "")
    bare = F.trim(F.regexp_replace(bare, r"\s*%\s*$", ""))
    return F.when(bare.rlike(NUMBER_TEXT), bare.try_cast("double"))


def as_number(c: Column | str, dtype: T.DataType) -> Column:
    """Numeric reading of any flat column; text that is not a plain number becomes null."""
    if isinstance(dtype, T.NumericType):
        return finite(c)
    t = text(c)
    return F.when(t.rlike(NUMBER_TEXT), finite(t.try_cast("double")))


def numeric(df: DataFrame, name: str) -> Column:
    return as_number(F.col(f"`{name}`"), df.schema[name].dataType)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value worked out once a row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _groups(t: Column, shape: str, n: int) -> Column:
    """All n groups of a shape by one match, missing ones empty; another number of parts if it does not match."""
    return F.split(F.regexp_replace(t, shape, "\x01".join(f"${k + 1}" for k in range(n))), "\x01", -1)


def _moment(y: Column, m: Column, d: Column, parts: Column, first: int) -> Column:
    """A naive timestamp from year, month and day texts and the time groups; null if there is no such day."""
    hour, minute, second, half = (F.get(parts, F.lit(first + k)) for k in range(4))
    year = F.when(F.length(y) > 2, y).otherwise(F.concat(F.when(y <= str(CENTURY_PIVOT), "20").otherwise("19"), y))
    day = F.concat(year, F.lit("-"), m, F.lit("-"), d)
    hours = hour.try_cast("int")
    hours = F.when(F.lower(half) == "pm", hours % 12 + 12).when(F.lower(half) == "am", hours % 12).otherwise(hours)
    time = F.concat(F.lit(" "), hours.cast("string"), F.lit(":"), minute, F.when(second == "", ":00").otherwise(F.concat(F.lit(":"), second)))
    return F.when(hour == "", day).otherwise(F.concat(day, time)).try_cast("timestamp_ntz")


def _month_numbers() -> Column:
    """Month names and their beginnings of three letters or more → number as text."""
    names = {name[:k]: str(i + 1) for i, name in enumerate(MONTHS) for k in range(3, len(name) + 1)} | {"sept": "9"}
    return F.create_map(*[F.lit(x) for pair in names.items() for x in pair])


def date_from_text(c: Column | str, order: str = "by sign") -> Column:
    """Mixed-format dates as naive timestamps; one column may mix all known shapes.

    The first signs of a text tell which shape it can have, so each cell is matched against one shape, or two where
    a month may be a number or a name, and one match gives all parts. Where a day and a month by number could
    change places, `order` decides: "month first", "day first", or "by sign": month first with slashes and dots, day
    first with dashes. A part over 12 is the day anyway.
    """

    def named(name: Column) -> Column:
        return F.try_element_at(_month_numbers(), F.lower(name))

    def shaped(t: Column, shape: str, n: int, read: Callable[[Callable[[int], Column], Column], Column], other: Column | None = None) -> Column:
        def body(parts: Column) -> Column:
            found = F.when(F.size(parts) == n, read(lambda k: F.get(parts, F.lit(k)), parts))
            return found if other is None else found.otherwise(other)

        return let(_groups(t, shape, n), body)

    def numbers(p: Callable[[int], Column], parts: Column) -> Column:
        a, sign, b = p(0), p(1), p(2)
        day_first = {"by sign": sign == "-", "month first": F.lit(False), "day first": F.lit(True)}[order]
        swapped = (day_first & ((F.length(b) == 1) | (b <= "12"))) | ((F.length(a) == 2) & (a > "12"))
        return _moment(p(3), F.when(swapped, b).otherwise(a), F.when(swapped, a).otherwise(b), parts, 4)

    def by_shape(t: Column) -> Column:
        begins_with_letter = F.ascii(t).between(65, 122)
        by_name = shaped(t, NAMED_MONTH, 7, lambda p, parts: _moment(p(2), named(p(1)), p(0), parts, 3))
        return (
            F.when(F.length(t) < 6, F.lit(None).cast("timestamp_ntz"))
            .when(begins_with_letter, shaped(t, MONTH_FIRST, 7, lambda p, parts: _moment(p(2), named(p(0)), p(1), parts, 3)))
            .when(F.substring(t, 5, 1).isin(*SIGNS) & t.rlike(r"^\d{4}"), F.when(t.rlike(ISO_DATE_SHAPE), t.try_cast("timestamp_ntz")).otherwise(
                shaped(t, YEAR_FIRST, 7, lambda p, parts: _moment(p(0), p(1), p(2), parts, 3))
            ))
            .when((F.length(t) == 8) & t.rlike(r"^\d{8}$"), F.try_make_timestamp_ntz(
                F.substring(t, 1, 4).try_cast("int"), F.substring(t, 5, 2).try_cast("int"), F.substring(t, 7, 2).try_cast("int"),
                F.lit(0), F.lit(0), F.lit(0).cast("decimal(8,6)"),
            ))
            .when(F.ascii(t).between(48, 57), shaped(t, YEAR_LAST, 8, numbers, by_name))
        )

    return let(F.replace(text(c), F.lit("_"), F.lit("-")), by_shape)


def is_ambiguous_date(c: Column | str) -> Column:
    """Whether a date text has a day and a month by number that could change places."""
    t = F.replace(text(c), F.lit("_"), F.lit("-"))
    a, b = (F.regexp_extract(t, YEAR_LAST, k).try_cast("int") for k in (1, 3))
    return F.coalesce(t.rlike(YEAR_LAST) & (a <= 12) & (b <= 12) & (a != b), F.lit(False))


def date_from_serial(c: Column | str) -> Column:
    """Spreadsheet day number as a naive timestamp."""
    v = finite(c)
    origin = F.lit(SERIAL_DATE_ORIGIN).cast("timestamp_ntz")
    day = F.floor(v)
    seconds = ((v - day) * 86400).cast("decimal(18,6)")
    return origin + F.make_dt_interval(day.cast("int"), F.lit(0), F.lit(0), seconds)


def as_timestamp(c: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.StringType):
        return date_from_text(c)
    if isinstance(dtype, T.TimestampNTZType):
        return c
    return c.cast("timestamp_ntz")


def us_between(start: Column | str, end: Column | str) -> Column:
    """Microseconds between two naive timestamps, whatever the session's time zone."""
    seconds = (col(end) - col(start)).cast("interval second").cast("decimal(20,6)")
    return (seconds * 1_000_000).cast("bigint")


def capped(value: Column, cap: Column) -> Column:
    """Upper clip that keeps a missing value missing."""
    return F.when(value.isNotNull(), F.least(value, cap))


def rate(part: Column, whole: Column, digits: int = 2) -> Column:
    return F.round(F.try_divide(part * F.lit(100.0), whole), digits)


def share_pct(part: Column, whole: Column, exact: bool) -> Column:
    """A share in percent, rounded half up to hundredths: by whole numbers if both are, so that ties are exact."""
    if not exact:
        return F.round(F.try_divide(part * F.lit(100.0), whole), 2)
    twice = F.nullif(F.abs(whole) * 2, F.lit(0))
    up = F.abs(part) * 20_000 + F.abs(whole)
    return F.signum(part) * F.signum(whole) * ((up - up % twice) / twice) / 100.0


def any_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def all_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def banded(value: Column, excellent: float, good: float, fair: float, higher_is_better: bool = True) -> Column:
    """Benchmark label from three thresholds."""
    if higher_is_better:
        chain = (
            F.when(value >= excellent, "excellent").when(value >= good, "good").when(value >= fair, "fair")
        )
    else:
        chain = (
            F.when(value <= excellent, "excellent").when(value <= good, "good").when(value <= fair, "fair")
        )
    return F.when(value.isNull(), "na").otherwise(chain.otherwise("critical"))


def pct_change(current: Column, previous: Column) -> Column:
    return F.round(F.try_divide((current - previous) * 100.0, F.abs(previous)), 2)


def one_row(df: DataFrame) -> Column:
    """The single row of `df` as a struct usable inside another plan's expressions."""
    return df.select(F.struct("*")).scalar()


def attach_row(df: DataFrame, row: DataFrame, name: str) -> DataFrame:
    """Adds the single row of `row` to every row of `df` as the struct column `name`.

    As a column the subquery stands in the plan once, however often its fields are used.
    """
    return df.withColumn(name, one_row(row))


# Bucket letter → (truncation unit, label pattern).
PERIODS = {"D": "day", "W": "week", "M": "month", "Q": "quarter", "Y": "year"}


def period_start(c: Column | str, grain: str) -> Column:
    """First day of the period as a date; no time zone is involved."""
    day = col(c).cast("date")
    return day if grain == "D" else F.trunc(day, PERIODS[grain])


def month_label(c: Column | str) -> Column:
    return F.date_format(col(c), "yyyy-MM")

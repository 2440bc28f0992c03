"""Naive timestamps must not feel the session's time zone or its clock changes."""

import pytest
from pyspark.sql import functions as F

from casekit.functions.expressions import date_from_text, period_start, us_between
from casekit.operators import executive
from casekit.plans.roles import Roles


@pytest.fixture(params=["America/Sao_Paulo", "America/New_York", "UTC"])
def zone(spark, request):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", request.param)
    yield request.param
    spark.conf.set("spark.sql.session.timeZone", before)


PAIRS = [("1999-10-02 12:00:00", "1999-10-03 12:00:00"), ("2024-03-09 12:00:00", "2024-03-10 12:00:00"),
         ("1960-01-01 00:00:00", "1960-01-02 00:00:00.000001")]


def frame(spark):
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(PAIRS)], "i int, a string, b string")
    return df.select("i", F.col("a").cast("timestamp_ntz").alias("a"), F.col("b").cast("timestamp_ntz").alias("b"))


def test_spans_are_whole_days(spark, zone):
    got = [r[0] for r in frame(spark).orderBy("i").select(us_between("a", "b")).collect()]
    assert got == [86_400_000_000, 86_400_000_000, 86_400_000_001]


def test_periods_and_text_dates(spark, zone):
    row = frame(spark).where("i = 0").select(
        period_start("a", "M").cast("string").alias("m"), date_from_text(F.lit("3_OCT_1999")).cast("string").alias("d")
    ).first()
    assert (row["m"], row["d"]) == ("1999-10-01", "1999-10-03 00:00:00")


def test_half_split(spark, zone):
    df = frame(spark).select(F.col("i").alias("record_id"), F.col("b").alias("registration_date"))
    roles = Roles({c: c for c in df.columns})
    halves = {r["record_id"]: r["half"] for r in executive.split_halves(roles.view(df), roles).collect()}
    assert halves == {2: 1, 0: 2, 1: 2}

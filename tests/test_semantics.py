"""Hand-made frames for rules on which an SQL twin could share a mistake."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from casekit.functions.expressions import date_from_text, number_from_text, one_row, sanitized_text
from casekit.functions.order_stats import Quantile, average_rank_share, quantiles_of
from casekit.operators import aggregates, breakdowns, cleaning, datasets, executive, filters, geo, insights, kpis
from casekit.operators import lifecycle as L
from casekit.operators import matrices, profiling
from casekit.plans import roles as R
from casekit.plans.roles import Roles
from casekit.sources import files


def column(df, name):
    return [r[name] for r in df.collect()]


def ts(text):
    return dt.datetime.fromisoformat(text)


CASE_SCHEMA = (
    "record_id bigint, registration_date timestamp_ntz, closing_date timestamp_ntz, sla_deadline timestamp_ntz, "
    "status string, category string, zone string"
)


def case_frame(spark, rows):
    df = spark.createDataFrame(rows, CASE_SCHEMA)
    roles = Roles({c: c for c in df.columns})
    return df, roles


# ---- order statistics -------------------------------------------------------------------


@pytest.mark.parametrize("values", [[1.0], [5.0, 5.0, 5.0], [-3.0, 0.0, 2.5, 1e12], [0.1, 0.2, 0.3, 0.4, 1000.0]])
def test_quantiles_interpolate_exactly(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    probs = [0.0, 0.25, 0.5, 0.95, 1.0]
    got = quantiles_of(df, "v", [Quantile(f"q{i}", p) for i, p in enumerate(probs)]).first()
    ordered = sorted(values)
    for i, p in enumerate(probs):
        pos = p * (len(values) - 1)
        low, high = ordered[int(pos)], ordered[min(int(pos) + 1, len(values) - 1)]
        assert got[f"q{i}"] == pytest.approx(low + (high - low) * (pos - int(pos)))


def test_quantiles_per_key_with_a_hot_value(spark):
    rows = [("hot", 7.0)] * 500 + [("hot", float(i)) for i in range(100)] + [("cold", 1.0), ("cold", 4.0), (None, 9.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r["k"]: (r["n"], r["m"]) for r in quantiles_of(df, "v", [Quantile("m", 0.5)], ["k"]).collect()}
    assert got == {"hot": (600, 7.0), "cold": (2, 2.5)}


def test_quantiles_skip_nan_null_and_infinity(spark):
    df = spark.createDataFrame([(1.0,), (3.0,), (None,), (float("nan"),), (float("inf"),)], "v double")
    assert quantiles_of(df, "v", [Quantile("m", 0.5)]).first()["m"] == 2.0


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([], "v double")
    assert quantiles_of(df, "v", [Quantile("m", 0.5)]).first()["m"] is None


def test_cap_applies_before_interpolation(spark):
    df = spark.createDataFrame([(0.0,), (10.0,)], "v double")
    assert quantiles_of(df, "v", [Quantile("m", 0.5, 4.0)]).first()["m"] == 2.0


def test_average_rank_share(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 2.0), (4, 3.0)], "i int, v double")
    got = {r["i"]: r["rank_share"] for r in average_rank_share(df, "v").collect()}
    assert got == {1: 0.25, 2: 0.625, 3: 0.625, 4: 1.0}


# ---- aggregates ---------------------------------------------------------------------------


def moderate(spark):
    zones = ["Zone A", "Zone B", "Zone C", "Zone D", None]
    rows = [(zones[i % 5], float(i * 37 % 4990) + 10, 1000 + i % 50) for i in range(500)]
    return spark.createDataFrame(rows, "zone string, amount double, consumer_id bigint")


@pytest.mark.parametrize("agg", aggregates.AGGREGATIONS)
def test_null_keys_never_form_a_group(spark, agg):
    assert set(column(aggregates.group_aggregate(moderate(spark), ["zone"], "amount", agg), "zone")) == {
        "Zone A", "Zone B", "Zone C", "Zone D"
    }


def test_count_counts_rows_not_values(spark):
    df = spark.createDataFrame([("a", None), ("a", 1.0)], "k string, v double")
    assert column(aggregates.group_aggregate(df, ["k"], "v", "count"), "value") == [2]


@pytest.mark.parametrize("agg", aggregates.AGGREGATIONS)
def test_empty_and_single_row(spark, agg):
    empty = spark.createDataFrame([], "zone string, amount double")
    assert aggregates.group_aggregate(empty, ["zone"], "amount", agg).collect() == []
    one = spark.createDataFrame([("Zone A", 1234.56)], "zone string, amount double")
    value = aggregates.group_aggregate(one, ["zone"], "amount", agg).first()["value"]
    assert value == (1 if agg in ("count", "nunique") else 1234.56)


@pytest.mark.parametrize("keys,value", [(["nope"], None), (["zone"], "nope"), ([], None), (["nested"], None)])
def test_bad_columns_are_refused_when_planning(spark, keys, value):
    df = moderate(spark).withColumn("nested", F.array(F.lit(1)))
    with pytest.raises(ValueError):
        aggregates.group_aggregate(df, keys, value, "sum")


def test_text_measures_are_read_as_numbers(spark):
    df = spark.createDataFrame([("a", "1.5"), ("a", "x"), ("a", "2")], "k string, v string")
    assert aggregates.group_aggregate(df, ["k"], "v", "sum").first()["value"] == 3.5


def test_median_of_a_group_without_numbers_is_missing(spark):
    df = spark.createDataFrame([("a", None), ("b", 2.0)], "k string, v double")
    got = {r["k"]: r["value"] for r in aggregates.group_aggregate(df, ["k"], "v", "median").collect()}
    assert got == {"a": None, "b": 2.0}


def test_other_clipping(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "v string")
    assert sorted(column(aggregates.clip_to_other(df, ["v"], 1), "v")) == ["(Other)", "(Other)", "a", "a"]


def test_bounded_sample_is_repeatable(spark):
    df = spark.range(1000).repartition(7)
    a, b = aggregates.bounded_sample(df, "id", 50), aggregates.bounded_sample(df.repartition(3), "id", 50)
    assert column(a, "id") == column(b, "id") and a.count() == 50


# ---- clips, fences, outliers ----------------------------------------------------------------


def test_clip_keeps_missing_durations_missing(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (None,)], "d double")
    from casekit.functions.expressions import capped

    assert df.select(F.avg(capped(F.col("d"), F.lit(10.0)))).first()[0] == 1.5


def test_zero_quartile_range_keeps_everything(spark):
    df = spark.createDataFrame([(v,) for v in (4.0, 4.0, 4.0, 4.0, 100.0)], "v double")
    assert filters.outlier_filter(df, "v", "iqr").count() == 5


def test_fewer_than_four_values_keep_everything(spark):
    df = spark.createDataFrame([(v,) for v in (1.0, 2.0, 1000.0)], "v double")
    for method in ("iqr", "zscore", "percentile"):
        assert filters.outlier_filter(df, "v", method).count() == 3


def test_outlier_filter_keeps_missing_values(spark):
    df = spark.createDataFrame([(v,) for v in (1.0, 2.0, 3.0, 4.0, 5.0, 900.0, None)], "v double")
    assert sorted(column(filters.outlier_filter(df, "v", "iqr").where("v IS NOT NULL"), "v")) == [1, 2, 3, 4, 5]
    assert filters.outlier_filter(df, "v", "iqr").where("v IS NULL").count() == 1


def test_age_fence_never_below_a_year(spark):
    df = spark.createDataFrame([(True, 1.0), (True, 2.0), (True, 5000.0)], "is_pending boolean, age_days double")
    q = one_row(L.age_quantiles(df))
    got = df.select(L.fenced_age(F.col("age_days"), q).alias("a")).collect()
    # quartiles of 1, 2, 3650 are 1.5 and 1826: the fence is above the ceiling.
    assert sorted(r["a"] for r in got) == [1.0, 2.0, 3650.0]


# ---- cleaning -------------------------------------------------------------------------------


def dup_groups(spark, rows):
    df = spark.createDataFrame(rows, "id bigint, v string")
    return {r["id"]: r["occurrences"] for r in cleaning.business_key_duplicates(df, "id").collect()}


def test_business_key_duplicates(spark):
    assert dup_groups(spark, [(7, "A"), (7, "A"), (7, "B"), (7, "B")]) == {}
    assert dup_groups(spark, [(7, "A"), (7, "B")]) == {7: 2}
    assert dup_groups(spark, [(7, "A"), (7, "A"), (7, "B")]) == {7: 3}
    assert dup_groups(spark, [(None, "A"), (None, "B")]) == {}


def test_mixed_dates(spark):
    texts = ["2024-01-02", "02_DEC_2024", "3/4/2024", "x", "07-JUNE-2026", "2024", "2024-01-02 03:04:05", "31-2-2024"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r["i"]: r["d"] for r in df.select("i", date_from_text("t").alias("d")).collect()}
    assert got == {
        0: ts("2024-01-02"), 1: ts("2024-12-02"), 2: ts("2024-03-04"), 3: None, 4: ts("2026-06-07"), 5: None,
        6: ts("2024-01-02T03:04:05"), 7: None,
    }


def test_text_numbers(spark):
    texts = ["₹1,234.5", "45%", "12x", " -3 ", "1e3", "NaN", "5d", ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r["i"]: r["n"] for r in df.select("i", number_from_text("t").alias("n")).collect()}
    assert got == {0: 1234.5, 1: 45.0, 2: None, 3: -3.0, 4: 1000.0, 5: None, 6: None, 7: None}


def test_ingest_text(spark):
    texts = [" 11.0 ", "11.50", "Unknown", "?", "n/a", " Ok  go ", "-", "-7.00"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r["i"]: r["n"] for r in df.select("i", sanitized_text("t").alias("n")).collect()}
    assert got == {0: "11", 1: "11.50", 2: None, 3: None, 4: None, 5: "Ok  go", 6: None, 7: "-7"}


def test_cleaning_null_tokens_are_case_sensitive(spark):
    df = spark.createDataFrame([("NULL",), ("null",), ("Null",), ("unknown",), ("  ",), ("#N/A",)], "t string")
    assert column(cleaning.nullify_placeholders(df), "t") == [None, None, "Null", "unknown", None, None]


def test_canonical_status(spark):
    df = spark.createDataFrame([(" Done ",), ("WIP",), ("escalated",), (" Odd one ",), (None,)], "s string")
    assert column(cleaning.canonicalize_status(df, "s"), "s") == ["CLOSED", "PENDING", "REOPENED", "Odd one", None]


def test_clean_table_keeps_columns_that_do_not_parse(spark):
    rows = [(i, "1,000" if i % 2 else "many", "2024-01-01" if i % 3 else "soon") for i in range(40)]
    df = spark.createDataFrame(rows, "id bigint, amount string, opened string")
    done = cleaning.clean_table(df, Roles({"record_id": "id"}))
    assert done.conversions.numbers == [] and done.conversions.text_dates == []
    assert dict(done.cleaned.dtypes) == {"id": "bigint", "amount": "string", "opened": "string"}


def test_clean_table_removes_rows_last(spark):
    rows = [(1, " a "), (1, "a"), (None, "-"), (2, "b")]
    done = cleaning.clean_table(spark.createDataFrame(rows, "id bigint, v string"), Roles({"record_id": "id"}))
    assert sorted((r["id"], r["v"]) for r in done.cleaned.collect()) == [(1, "a"), (2, "b")]
    report = {r["step"]: r["affected"] for r in done.report.collect()}
    assert report["values_whitespace_trimmed"] == 1
    assert report["values_null_normalized"] == 1
    assert report["rows_removed_fully_empty"] == 1
    assert report["rows_removed_exact_duplicates"] == 1
    assert report["business_key_duplicate_groups"] == 0


def test_header_sanitising():
    assert files.sanitize_names(["Case ID", "case/ID", "Case ID", " 1st date ", "%%", "Amount (₹)"]) == [
        "Case_ID", "case_ID_2", "Case_ID_3", "_1st_date", "column", "Amount"
    ]


def test_latin1_csv(spark, tmp_path):
    path = tmp_path / "cities.csv"
    path.write_bytes("name;n\nMálaga;1\n".encode("latin-1"))
    df = files.scan_csv(spark, str(path), "name string, n int", sep=";", encoding="ISO-8859-1")
    assert df.first()["name"] == "Málaga"


# ---- profiling ------------------------------------------------------------------------------


def test_type_inference(spark):
    n = 120
    rows = [
        (f"C{i:04d}", f"2024-01-{i % 28 + 1:02d}", "Yes" if i % 2 else "no", f"₹{i % 40}.5", f"{i % 30}%",
         float(45000 + i % 60), f"kind {i % 3}", f"words {i * 7 % 90} and more", str(10000 + i % 70), None)
        for i in range(n)
    ]
    names = "case_id,opened,flag,price,ratio,serial,kind,remark,digits,blank".split(",")
    types = ["string"] * 5 + ["double"] + ["string"] * 4
    df = spark.createDataFrame(rows, ", ".join(f"{a} {b}" for a, b in zip(names, types)))
    got = {r["column"]: (r["inferred_type"], r["confidence"]) for r in profiling.infer_types(df).collect()}
    assert got == {
        "case_id": ("id", 0.95), "opened": ("datetime", 0.95), "flag": ("boolean", 0.9), "price": ("currency", 0.95),
        "ratio": ("percentage", 0.9), "serial": ("datetime", 0.8), "kind": ("categorical", 0.85),
        "remark": ("text", 0.4), "digits": ("numeric", 0.95), "blank": ("text", 0.4),
    }


def test_whole_floats_become_integer_text(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (None,)], "v double")
    assert column(profiling.type_override(df, "v", "id"), "v") == ["1", "2", None]
    mixed = spark.createDataFrame([(1.0,), (2.5,)], "v double")
    assert column(profiling.type_override(mixed, "v", "text"), "v") == ["1.0", "2.5"]


# ---- filters ----------------------------------------------------------------------------------


def test_last_second_of_the_end_day_is_kept(spark):
    df = spark.createDataFrame([(ts("2024-01-05T23:59:59.700"),), (ts("2024-01-06"),)], "t timestamp_ntz")
    assert filters.date_range(df, "t", None, "2024-01-05").count() == 1
    assert filters.chart_date_range(df, "t", None, "2024-01-05").count() == 0


def test_search_needle_is_not_a_pattern(spark):
    df = spark.createDataFrame([("a.b",), ("axb",), (None,)], "t string")
    assert column(filters.text_search(df, "A.B", ["t"]), "t") == ["a.b"]


def test_malformed_predicates_are_skipped(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "n int, t string")
    bad = [("x", "eq", 1), ("n", "eq", None), ("t", "in", []), ("n", "between", (1,)), ("n", "~", 1)]
    assert filters.where_all(df, filters.predicates(df, bad)).count() == 2
    assert filters.where_all(df, filters.predicates(df, [("n", "between", (2, None))])).count() == 1


def test_drill_topology_stops_at_blank_places(spark):
    df = spark.createDataFrame([("N", "x"), ("N", " nan "), ("N", None), ("", "y")], "zone string, circle string")
    nodes = {(r["level"], r["zone"], r["circle"]) for r in filters.drill_topology(df, ["zone", "circle"]).collect()}
    assert nodes == {(1, "N", None), (2, "N", "x")}


# ---- KPIs and breakdowns ---------------------------------------------------------------------


@pytest.mark.parametrize(
    "status,closing,group_a,group_b",
    [(True, False, True, False), (False, True, True, True), (True, True, True, True), (False, False, False, False)],
)
def test_eligibility_truth_table(status, closing, group_a, group_b):
    mapped = {"record_id", "officer", "category", "registration_date", "sla_deadline", "zone"}
    mapped |= {"status"} if status else set()
    mapped |= {"closing_date"} if closing else set()
    roles = Roles({r: r for r in mapped})
    for metric in R.EITHER_LIFECYCLE:
        assert (R.missing_for(metric, roles) == []) is group_a
    for metric in R.CLOSING_ANCHORED:
        assert (R.missing_for(metric, roles) == []) is group_b


def test_unmapped_roles_give_an_ineligible_row(spark):
    df, roles = case_frame(spark, [(1, ts("2024-01-01"), None, None, "Open", "a", "z")])
    row = breakdowns.officer_productivity(roles.view(df), roles).first()
    assert row["is_eligible"] is False and row["missing_roles"] == ["officer"]


def test_unconfirmed_roles_do_not_resolve():
    roles = Roles({"status": "s"}, frozenset({"status"}))
    assert roles.resolve("status") is None and not roles.has("status")


def test_growth_compares_observed_months(spark):
    rows = [(i, ts("2024-01-05"), None, None, "Open", "a", "z") for i in range(2)]
    rows += [(i, ts("2024-03-05"), None, None, "Open", "a", "z") for i in range(3)]
    df, roles = case_frame(spark, rows)
    growth = {r["kpi"]: r["pct_change"] for r in kpis.growth_measures(roles.view(df)).collect()}
    assert growth == {"mom_growth": 50.0, "qoq_growth": None, "yoy_growth": None}


def test_growth_from_zero_is_missing(spark):
    rows = [("a", "2024-01-01")] + [("b", "2024-02-01")] * 5 + [("a", "2024-02-01")]
    df = spark.createDataFrame(rows, "c string, d string").withColumn("d", F.col("d").cast("timestamp_ntz"))
    got = {r["c"]: r["growth_pct"] for r in datasets.growth(df, "d", "c").collect()}
    assert got == {"a": 0.0, "b": None}


def test_equal_risk_scores_are_all_low(spark):
    rows = [(i, ts("2024-01-01"), None, None, "Open", "a", z) for i, z in enumerate("xyzxyz")]
    df, roles = case_frame(spark, rows)
    assert set(column(breakdowns.hierarchy_risk(roles.view(df), roles), "risk_tier")) == {"Low"}


def test_empty_table_has_eligible_kpis_without_values(spark):
    df, roles = case_frame(spark, [])
    rows = {r["kpi"]: r for r in kpis.kpi_table(roles.view(df), roles).collect()}
    assert rows["closure_rate"]["value"] is None and rows["closure_rate"]["is_eligible"]
    assert rows["total_cases"]["band"] == "na"


def test_synthetic_cases(spark):
    rows = [
        (i, ts("2025-01-01") + dt.timedelta(days=i % 45), None, None, "Closed" if i % 3 == 0 else "Pending",
         f"cat {i % 3}", "North" if i % 2 == 0 else "South")
        for i in range(60)
    ]
    df, roles = case_frame(spark, rows)
    table = {r["kpi"]: r["value"] for r in kpis.kpi_table(roles.view(df), roles).collect()}
    assert (table["total_cases"], table["pending_cases"], table["closure_rate"]) == (60.0, 40.0, 33.33)
    trend = breakdowns.monthly_trend(roles.view(df), roles).collect()
    assert [(r["period"], r["total"]) for r in trend] == [("2025-01", 46), ("2025-02", 14)]


# ---- executive -------------------------------------------------------------------------------


def test_zero_median_deviation_gives_zero_scores(spark):
    df = spark.createDataFrame([(5.0,), (5.0,), (5.0,), (9.0,)], "v double")
    assert column(executive.with_modified_z(df, "v"), "z_score") == [0.0] * 4


def hotspots(spark, volumes, longer_than=None):
    rows, i = [], 0
    for name, n in volumes.items():
        for _ in range(n):
            rows.append((i, ts("2024-01-01"), None, None, "Open", name, "z"))
            i += 1
    df, roles = case_frame(spark, rows)
    found = executive.pareto_hotspots(roles.view(df), roles, longer_than=longer_than, keep=3).orderBy("position")
    return [(r["category"], r["omitted_count"]) for r in found.collect()]


def test_pareto_cut_is_inclusive(spark):
    assert hotspots(spark, {"a": 50, "b": 30, "c": 20}) == [("a", 0), ("b", 0)]


def test_long_hotspot_lists_are_cut(spark):
    assert hotspots(spark, {c: 10 for c in "abcdefghij"}, 5) == [("a", 5), ("b", 5), ("c", 5)]
    assert hotspots(spark, {c: 10 for c in "abcdefghij"}) == [(c, 0) for c in "abcdefgh"]


def test_pareto_tree_opens_vital_branches_only(spark):
    rows = []
    for zone, category, n in (("n", "x", 8), ("s", "y", 2)):
        rows += [(len(rows) + i, ts("2024-01-01"), None, None, "Open", category, zone) for i in range(n)]
    df, roles = case_frame(spark, rows)
    df = df.withColumn("circle", F.col("category"))
    roles = Roles({c: c for c in df.columns})
    got = {(r["depth"], r["path"], r["is_vital_few"]) for r in executive.pareto_hierarchy(roles.view(df), roles).collect()}
    assert got == {(1, "n", True), (1, "s", False), (2, "n › x", True)}


def test_halves_split_ties_by_id(spark):
    rows = [(i, ts("2024-01-01"), None, None, "Open", "a", "z") for i in range(7)]
    df, roles = case_frame(spark, rows)
    halves = {r["record_id"]: r["half"] for r in executive.split_halves(roles.view(df), roles).collect()}
    assert halves == {0: 1, 1: 1, 2: 1, 3: 2, 4: 2, 5: 2, 6: 2}


# ---- charts, positions, insights --------------------------------------------------------------


def test_rolling_average_fills_gaps(spark):
    df = spark.createDataFrame([("2024-01-01",), ("2024-01-01",), ("2024-01-04",)], "d string").select(
        F.col("d").cast("timestamp_ntz").alias("d")
    )
    got = datasets.rolling_average(df, "d", "D", 2).orderBy("period").collect()
    assert [(r["value"], r["rolling_average"]) for r in got] == [(2, 2), (0, 1), (0, 0), (1, 0.5)]


def test_calendar_needs_a_week_of_dates(spark):
    df = spark.createDataFrame([("2024-01-01",)] * 6, "d string").select(F.col("d").cast("timestamp_ntz").alias("d"))
    assert datasets.calendar_heatmap(df, "d", least_dates=7).count() == 0
    assert datasets.calendar_heatmap(df, "d").count() == 366
    assert datasets.calendar_heatmap(df.union(df), "d").count() == 366


def test_constant_metric_sits_in_the_middle(spark):
    rows = [(i, ts("2024-01-01"), ts("2024-01-03"), ts("2024-02-01"), "Closed", "a", "xy"[i % 2]) for i in range(4)]
    df, roles = case_frame(spark, rows)
    got = matrices.performance_matrix(roles.view(df), roles, "zone").collect()
    assert {r["avg_resolution_scaled"] for r in got} == {50.0}


def test_valid_positions(spark):
    df = spark.createDataFrame([(0.0, 0.0), (91.0, 0.0), (10.0, 20.0), (None, 1.0)], "lat double, lon double")
    assert df.where(geo.valid_position(F.col("lat"), F.col("lon"))).collect() == [(10.0, 20.0)]


def test_first_tier_with_any_position_serves_all_rows(spark):
    rows = [(1, "f1", None, None, "d1"), (2, "f2", None, None, "d1")]
    df = spark.createDataFrame(rows, "record_id bigint, feeder string, latitude double, longitude double, division string")
    roles = Roles({c: c for c in df.columns})
    keys = spark.createDataFrame([(" f1 ", 1.0, 2.0)], "key string, lat double, lon double")
    centre = spark.createDataFrame([("d1", 5.0, 6.0)], "key string, lat double, lon double")
    got = geo.resolve_positions(df, roles, keys, centre).orderBy("record_id").collect()
    assert [r["geo_status"] for r in got] == [geo.BY_KEY, geo.DROPPED]
    got = geo.resolve_positions(df, roles, None, centre).collect()
    assert {r["geo_status"] for r in got} == {geo.BY_BOUNDARY}
    assert {r["geo_status"] for r in geo.resolve_positions(df, roles).collect()} == {geo.DROPPED}


def test_anomaly_rules(spark):
    flat = spark.createDataFrame([(float(v),) for v in (1, 2, 3)], "v double")
    assert insights.anomaly(flat, "v").first()["is_anomaly"] is False
    odd = spark.createDataFrame([(float(v),) for v in (1, 1, 2, 2, 3, 100)], "v double")
    assert insights.anomaly(odd, "v").first()["is_anomaly"] is True


def test_trend_direction(spark):
    df = spark.createDataFrame([(f"2024-0{i}", float(10 * i)) for i in range(1, 6)], "p string, v double")
    row = insights.trend(df, "p", "v").first()
    assert (row["direction"], row["severity"], row["slope"]) == ("up", "warning", 10.0)


def test_risk_model_choice():
    everything = Roles({r: r for r in ("registration_date", "status", "priority", "business_criticality", "reopen_flag")})
    assert L.risk_model(everything) == "enterprise"
    assert L.risk_model(everything, "standard") == "standard"
    assert L.risk_model(everything.without("business_criticality")) == "advanced"
    assert L.risk_model(everything.without("priority")) == "standard"
    assert L.risk_model(Roles({"category": "c"})) == "minimum"


# ---- the table object ---------------------------------------------------------------------------


def test_case_table_end_to_end(spark, sf_dir):
    from casekit.api import CaseTable
    from casekit.checks.tables import ROLES, cases

    table = CaseTable(cases(spark, sf_dir), ROLES)
    asia = table.filtered({"status": ["Open", "Closed"]}, [("zone", "ASIA")])
    total = {r["kpi"]: r["value"] for r in asia.kpis().collect()}["total_cases"]
    assert 0 < total < table.view.count()
    assert set(table.breakdowns()) == {
        "officer_productivity", "category_breakdown", "monthly_trend", "hierarchy_risk", "top_repeat_consumers",
        "sla_breach_detail",
    }
    assert set(asia.executive()) == {
        "executive_kpis", "executive_deltas", "hierarchy_anomalies", "pareto_hierarchy", "pareto_hotspots"
    }
    chart = asia.chart("bar", ("1996-01-01", "1998-12-31"), x="circle", n=3)
    assert chart.count() == 3
    assert asia.chart("risk_matrix", group="category").count() == 5
    assert asia.chart("bar", x="feeder").first()["missing_roles"] == ["feeder"]
    assert insights.concentration(chart, ["circle"], "value").count() == 1
    assert CaseTable(cases(spark, sf_dir), ROLES.without("registration_date")).executive()["executive_kpis"].first()[
        "is_eligible"
    ] is False

"""CSV files as people have them, header names, mixed dates, staging and order statistics, on hand-made input."""

import datetime
import os
import random
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from casekit.api import CaseTable
from casekit.functions.expressions import DAY_ORDERS, date_from_text, is_ambiguous_date
from casekit.functions.order_stats import Quantile, quantiles_of, row_numbers, running_sums
from casekit.operators import aggregates, executive, geo, matrices, profiling
from casekit.plans.roles import Roles
from casekit.sources import files


def write(folder, **texts):
    for name, content in texts.items():
        (folder / f"{name}.csv").write_bytes(content if isinstance(content, bytes) else content.encode())
    return f"{folder}/*.csv"


def test_files_with_other_headers_are_united_by_name(spark, tmp_path):
    path = write(tmp_path, a="a,b\n1,2\n", b="b,a,c\n3,4,5\n", c="a,b\n6,7\n", d="", e="﻿a;b\n8;9\n")
    rows = files.scan_csv(spark, path, sep=None).select("a", "b", "c").collect()
    assert sorted(tuple(r) for r in rows) == [("1", "2", None), ("4", "3", "5"), ("6", "7", None), ("8", "9", None)]


def test_quoted_line_breaks_and_quotes(spark, tmp_path):
    path = write(tmp_path, a='id,note\n1,"say ""hi"" now"\n2,"two\nlines"\n3,"a,b"\n4,plain\n')
    df = files.scan_csv(spark, path, multi_line=True)
    assert sorted(r["note"] for r in df.collect()) == ["a,b", "plain", 'say "hi" now', "two\nlines"]
    assert df.count() == df.select("id").count() == len(df.select("id").collect()) == 4


def test_rows_that_do_not_fit_are_kept_and_counted(spark, tmp_path):
    path = write(tmp_path, a="id,price\n1,2.5\n2,oops\n3\nx,1.0\n")
    df = files.scan_csv(spark, path, "id bigint, price double")
    assert [tuple(r) for r in df.orderBy(F.col("id").asc_nulls_last()).collect()] == [(1, 2.5), (2, None), (3, None), (None, 1.0)]
    assert df.select("id").count() == 4
    marked = files.scan_csv(spark, path, "id bigint, price double", keep_bad_rows=True)
    assert files.bad_rows(marked).first()[0] == 3
    assert files.scan_csv(spark, path, "id bigint, price double", drop_bad_rows=True).count() == 1


def test_encoding_is_found_by_the_whole_file(spark, tmp_path):
    late = "name\n" + "plain\n" * 5000
    path = write(tmp_path, a=(late + "Zoë\n").encode("latin-1"), b=late + "Zoë\n")
    assert files.scan_csv(spark, path, encoding=None).where("name = 'Zoë'").count() == 2


@pytest.mark.parametrize(
    "raw, clean",
    [
        (["A", "A_2", "A"], ["A", "A_2", "A_3"]), (["id", "ID"], ["id", "ID_2"]), (["a", "a", "a"], ["a", "a_2", "a_3"]),
        (["Total (€)", "  ", "2nd", "__x__"], ["Total", "column", "_2nd", "x"]), ([], []),
    ],
)
def test_header_names(raw, clean):
    assert files.sanitize_names(raw) == clean


DATES = {
    "13/04/2024": "2024-04-13", "3/4/2024 10:30": "2024-03-04 10:30", "2024/01/02": "2024-01-02", "2 Jan 2024": "2024-01-02",
    "02-DEC-2024 11:00": "2024-12-02 11:00", "January 5, 2024": "2024-01-05", "2024-01-02T03:04:05Z": "2024-01-02 03:04:05",
    "20240102": "2024-01-02", "1/2/24": "2024-01-02", "3-4-2024": "2024-04-03", "4-13-2024": "2024-04-13", "12.31.1999": "1999-12-31",
    "2024-02-30": None, "31/31/2024": None, "x": None, "": None, "1/2/2024 1:05 pm": "2024-01-02 13:05", "Sept 3rd, 2024": "2024-09-03",
    "12 Foo 2024": None, "2024-1-2 25:00": None,
}


def test_mixed_dates(spark):
    df = spark.createDataFrame([(t,) for t in DATES], "t string")
    got = {r["t"]: r["d"] for r in df.select("t", date_from_text("t").alias("d")).collect()}
    assert got == {t: d and datetime.datetime.fromisoformat(d) for t, d in DATES.items()}


def test_day_order(spark):
    df = spark.createDataFrame([("3/4/2024",), ("3-4-2024",), ("13/4/2024",), ("4/4/2024",)], "t string")
    columns = [F.dayofmonth(date_from_text("t", o)) for o in DAY_ORDERS]
    assert [tuple(r) for r in df.select(*columns).collect()] == [(4, 4, 3), (3, 4, 3), (13, 13, 13), (4, 4, 4)]
    assert [r[0] for r in df.select(is_ambiguous_date("t")).collect()] == [True, True, False, False]


def numpy_quantile(values, q):
    values = sorted(values)
    at = q * (len(values) - 1)
    low = values[int(at)]
    return low + (values[min(int(at) + 1, len(values) - 1)] - low) * (at - int(at))


@pytest.mark.parametrize("far", [None, 1e4, -1e9, 1e300])
def test_order_statistics_with_a_far_outlier(far, spark):
    r = random.Random(2)
    values = [1.7e9 + r.random() * 1e3 for _ in range(5000)] + [1.7e9] * 500 + ([1.7e9 + 1e3 * far] if far else [])
    keyed = [(i % 3, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(keyed, "k int, v double")
    wanted = [Quantile("a", 0.25), Quantile("b", 0.5), Quantile("c", 0.95)]
    row = quantiles_of(df, "v", wanted).first()
    assert [row[q.name] for q in wanted] == pytest.approx([numpy_quantile(values, q.prob) for q in wanted], rel=1e-12)
    for row in quantiles_of(df, "v", wanted, ["k"]).collect():
        own = [v for k, v in keyed if k == row["k"]]
        assert [row[q.name] for q in wanted] == pytest.approx([numpy_quantile(own, q.prob) for q in wanted], rel=1e-12)


def test_few_values_are_sorted_whatever_the_outlier(spark):
    """200,000 distinct values and one outlier 10,000 times their spread: the last step sees under a thousandth."""
    df = spark.range(200_000).select((1.7e15 + F.col("id") * 1.0).alias("v")).union(spark.createDataFrame([(1.7e15 + 2e9,)], "v double"))
    found = quantiles_of(df, "v", [Quantile("a", 0.5)])
    assert found.first()["a"] == 1.7e15 + 100_000
    seen = []
    stack = [found._jdf.queryExecution().executedPlan()]
    while stack:
        node = stack.pop()
        if "Exchange" in node.nodeName() and "__value" in node.outputPartitioning().toString():
            seen.append(node)
        children = node.children()
        stack += [children.apply(i) for i in range(children.size())]
        if node.nodeName() == "AdaptiveSparkPlan":
            stack.append(node.executedPlan())
    assert len(seen) <= 1  # values are only shuffled in the last step


def test_running_sums_and_row_numbers(spark):
    r = random.Random(3)
    rows = [(r.choice("ab"), i, r.choice([1, 1, 1, 2, 7])) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, i int, v int")
    got = {(x["k"], x["i"]): (x["upto"], x["total"]) for x in running_sums(df, "v", "i", ["k"]).collect()}
    for k in "ab":
        own, upto = sorted(((-v, i) for key, i, v in rows if key == k)), 0
        total = -sum(v for v, _ in own)
        for v, i in own:
            upto -= v
            assert got[(k, i)] == (upto, total)
    numbered = sorted((x["n"], x["v"], x["i"]) for x in row_numbers(df, F.col("v").asc(), F.col("i").asc(), out="n").collect())
    assert [(v, i) for _, v, i in numbered] == sorted((v, i) for _, i, v in rows) and [n for n, _, _ in numbered] == list(range(400))


def test_charts_never_raise(spark):
    df = spark.createDataFrame([(1, "Open", 2.0, [1])], "id bigint, status string, amount double, tags array<int>")
    table = CaseTable(df, Roles({"record_id": "id", "status": "status", "amount": "amount", "category": "tags"}))
    for kind, params in (
        ("performance_matrix", {}), ("officer_performance_matrix", {}), ("pending_age_distribution", {}), ("geo_concentration", {}),
        ("geographical_concentration_map", {}), ("no such chart", {}), ("bar", {"x": "zone"}), ("bar", {"x": "category"}),
        ("correlation", {"columns": ["amount"]}),
    ):
        assert table.chart(kind, **params).first()["is_eligible"] is False, kind
    assert profiling.role_parse_failures(df, Roles({"status": "status"})).count() == 0
    assert aggregates.correlation_matrix(df, ["amount"]).first()["is_eligible"] is False
    assert geo.concentration(df, table.roles).first()["is_eligible"] is False
    assert matrices.performance_matrix(table.view, table.roles).first()["is_eligible"] is False


def test_executive_without_pending_rows(spark):
    df = spark.createDataFrame([(1, "Closed", datetime.datetime(2024, 1, 1), "n")], "id bigint, status string, opened timestamp_ntz, zone string")
    roles = Roles({"record_id": "id", "status": "status", "registration_date": "opened", "zone": "zone"})
    assert executive.pareto_hierarchy(roles.view(df), roles).count() == 0
    for result in CaseTable(df, roles).executive().values():
        result.collect()


def test_rows_that_differ_in_nested_columns_are_not_duplicates(spark):
    df = spark.createDataFrame([(1, [1]), (1, [2]), (1, [1])], "a int, b array<int>")
    assert profiling.quality_banner(df).first()["duplicate_rows"] == 1


def test_staged_tables_go_with_the_session(tmp_path):
    code = (
        "from casekit.session import local_session; from casekit.sources.files import stage; import os;"
        "s = local_session(2); assert stage(s.range(5), 'x').count() == 5; assert os.listdir(os.environ['STAGE']); s.stop()"
    )
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = os.environ | {"STAGE": str(tmp_path), "PYTHONPATH": root, "PYSPARK_SUBMIT_ARGS": f"--conf spark.checkpoint.dir=file://{tmp_path} pyspark-shell"}
    subprocess.run([sys.executable, "-c", code], env=env, check=True, timeout=120, cwd=tmp_path)
    assert not [d for d in os.listdir(tmp_path) if d.startswith("casekit-")]


def test_heads_of_many_files_come_from_one_job(spark, tmp_path):
    """Odd names, empty files, a packed one and long files: headers and rows as if each were read by itself."""
    import gzip

    names = [f"a {k}%20+ü.csv" for k in range(60)]
    for k, name in enumerate(names):
        header = "id,name" if k % 3 else "name;id"
        row = ("{i},n{i}" if k % 3 else "n{i};{i}")
        lines = "".join(row.format(i=k * 1000 + i) + "\n" for i in range(k))
        (tmp_path / name).write_text("" if k == 7 else ("﻿" if k == 8 else "") + header + "\n" + lines, "utf-8")
    (tmp_path / "packed.csv.gz").write_bytes(gzip.compress(b"id,extra\n1,x\n"))
    (tmp_path / "long.csv").write_text("id,name\n" + "77,z\n" * 400_000)
    group = "heads"
    spark.sparkContext.setJobGroup(group, group)
    shapes = files.csv_shapes(spark, [str(tmp_path)], None, "UTF-8")
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup(group)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(jobs) <= 2  # Spark lists more than 32 paths by a job of its own
    assert {s.names: len(f) for s, f in shapes.items()} == {("name", "id"): 20, ("id", "name"): 40, ("id", "extra"): 1}
    df = files.scan_csv(spark, str(tmp_path), sep=None)
    assert df.count() == sum(range(60)) - 7 + 1 + 400_000
    assert df.where("name = concat('n', id)").count() == sum(range(60)) - 7

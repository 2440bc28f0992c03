"""Tables written for later reads: clustered rows, trigram blocks, additive cells."""

import os
import random

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from casekit.checks.tables import ROLES, cases, table
from casekit.operators import breakdowns, filters, kpis
from casekit.operators.cube import CaseCube, StaleCube
from casekit.operators.search_index import build_search_index
from casekit.sources import files


@pytest.fixture
def as_at_scale(spark):
    """Small partitions stay apart, as large ones would, and plans are printed whole."""
    changed = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.maxMetadataStringLength": "2000"}
    before = {k: spark.conf.get(k) for k in changed}
    for k, v in changed.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def files_read(df):
    """Files that the scans of a collected DataFrame opened."""
    df.collect()
    todo, found = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            todo.append(node.plan())
        elif kind == "FileSourceScanExec":
            found += node.metrics().get("numFiles").get().value()
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return found


def test_index_finds_what_the_scan_finds(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    odd = spark.createDataFrame(
        [(-1, None, None, None), (-2, "", "", ""), (-3, "ab", "İstanbul ß 😀😀x", "x"), (-4, "100%_a.b", "a'b\\c", "é")], docs.schema
    )
    docs = docs.union(odd).cache()
    index = build_search_index(docs, ["text", "source"], 64)
    words = [w for r in docs.where("doc_id % 97 = 0").select("text").limit(9).collect() for w in (r[0] or "").split()[3:5]]
    for needle in ["the.", "THE", "a", "", "ab", "😀x", "😀😀x", "100%_", "a'b\\c", "no such text", "aaaa", *words]:
        found = index.search(needle).collect()
        wanted = filters.text_search(docs, needle, ["text", "source"]).collect()
        assert sorted(map(repr, found)) == sorted(map(repr, wanted)), needle
    assert index.search("web", ["source"]).count() == filters.text_search(docs, "web", ["source"]).count()
    with pytest.raises(ValueError):
        index.search("x", ["lang"])


def test_index_reads_only_blocks_that_can_hold_the_needle(spark):
    rng = random.Random(5)
    rows = [(i, "".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=30)) + f" ticket-{i:06d}") for i in range(4000)]
    index = build_search_index(spark.createDataFrame(rows, "id int, note string"), ["note"], 128)
    few = index.search("ticket-003917")
    assert files_read(few.select("id")) < index.blocks <= files_read(index.rows.select("id"))
    hits = index.candidates("ticket-003917", ["note"]).collect()
    assert 1 <= len(hits) <= index.blocks // 4
    assert [r["id"] for r in few.collect()] == [3917]
    pruned = few._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in pruned


def test_index_of_nothing(spark):
    index = build_search_index(spark.createDataFrame([], "id int, note string"), ["note"])
    assert index.blocks == 0 and index.search("abc").collect() == [] and index.search("").collect() == []
    with pytest.raises(ValueError):
        build_search_index(index.rows, ["note"], 100)


def test_drill_filter_skips_row_groups(spark, sf_dir, tmp_path, as_at_scale):
    path = str(tmp_path / "clustered")
    padded = cases(spark, sf_dir).withColumn("zone", F.concat(F.lit(" "), "zone", F.lit("  ")))
    files.write_clustered(padded, path, ["zone", "registration_date"], ["record_id"])
    rows = spark.read.parquet(path)
    drill = rows.where(filters.drill_condition(rows, [("zone", "ASIA")], trimmed=True))
    assert "EqualTo(zone,ASIA)" in drill._jdf.queryExecution().executedPlan().toString()
    assert drill.count() == cases(spark, sf_dir).where("zone = 'ASIA'").count()
    groups = hold = 0
    for name in os.listdir(path):
        if name.endswith(".parquet"):
            meta = pq.ParquetFile(f"{path}/{name}").metadata
            for g in range(meta.num_row_groups):
                by_name = {meta.row_group(g).column(c).path_in_schema: meta.row_group(g).column(c) for c in range(meta.num_columns)}
                stats = by_name["zone"].statistics
                groups, hold = groups + 1, hold + (stats.min <= "ASIA" <= stats.max)
    assert groups >= 4 and hold < groups


def test_a_filter_state_reaches_the_scan(spark, sf_dir, tmp_path, as_at_scale):
    path = str(tmp_path / "state")
    files.write_clustered(cases(spark, sf_dir), path, ["zone", "registration_date"])
    rows = spark.read.parquet(path)
    state = {"date_range": ("1996-01-01", "1996-12-31"), "status": ["Open"]}
    kept = filters.apply_filters(rows, ROLES, state, [("zone", "ASIA")], trimmed=True)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters") :].split("\n")[0]
    for part in ("EqualTo(status,Open)", "EqualTo(zone,ASIA)", "GreaterThanOrEqual(registration_date", "LessThan(registration_date"):
        assert part in pushed


def test_hot_place_is_spread_over_tasks(spark, tmp_path, as_at_scale):
    path = str(tmp_path / "hot")
    rows = spark.range(20_000).select(F.lit("same").alias("zone"), F.col("id").alias("record_id"))
    files.write_clustered(rows, path, ["zone"])
    sizes = [r["n"] for r in spark.read.parquet(path).groupBy("_metadata.file_path").agg(F.count("*").alias("n")).collect()]
    assert len(sizes) > 1 and max(sizes) < 20_000 / 2 and sum(sizes) == 20_000


def made(spark, tmp_path, *parts):
    cube = CaseCube(spark, str(tmp_path / "cube"), ROLES, ("zone", "circle"))
    for rows in parts:
        files.write_parquet(rows, str(tmp_path / "cases"), mode="append")
        cube.refresh(str(tmp_path / "cases"))
    return cube


def test_cells_add_up_to_the_direct_figures(spark, sf_dir, tmp_path):
    all_cases = cases(spark, sf_dir)
    blank = all_cases.limit(3).withColumns({"registration_date": F.lit(None).cast(all_cases.schema["registration_date"].dataType),
                                            "zone": F.lit(None).cast("string"), "status": F.lit(None).cast("string")})
    parts = [all_cases.where("record_id % 4 = 0"), all_cases.where("record_id % 4 > 0"), blank]
    cube = made(spark, tmp_path, *parts)
    direct = ROLES.view(spark.read.parquet(str(tmp_path / "cases")))
    assert cube.counts().collect() == kpis.count_measures(direct, ROLES).collect()
    assert cube.monthly_trend().collect() == breakdowns.monthly_trend(direct, ROLES).collect()
    assert cube.refresh(str(tmp_path / "cases")) == 0
    assert cube.counts().collect() == kpis.count_measures(direct, ROLES).collect()


def test_a_refresh_reads_new_files_only(spark, sf_dir, tmp_path):
    seen = []

    def read(session, paths):
        seen.append(sorted(paths))
        return session.read.parquet(*paths)

    cube = CaseCube(spark, str(tmp_path / "cube"), ROLES, ("zone",), read)
    for k in range(2):
        files.write_parquet(cases(spark, sf_dir).where(f"record_id % 2 = {k}"), str(tmp_path / "cases"), mode="append")
        cube.refresh(str(tmp_path / "cases"))
    assert len(seen) == 2 and not set(seen[0]) & set(seen[1])


def test_an_unfinished_or_stale_refresh(spark, sf_dir, tmp_path):
    cube = made(spark, tmp_path, cases(spark, sf_dir).where("record_id % 2 = 0"))
    before = cube.counts().collect()
    files.write_parquet(spark.read.parquet(str(tmp_path / "cube/cases")).drop("batch"), str(tmp_path / "cube/cases/batch=broken"))
    assert cube.counts().collect() == before
    gone = next(f for f in os.listdir(tmp_path / "cases") if f.endswith(".parquet"))
    files.write_parquet(cases(spark, sf_dir).limit(1), str(tmp_path / "cases"), mode="overwrite")
    assert not os.path.exists(tmp_path / "cases" / gone)
    with pytest.raises(StaleCube):
        cube.refresh(str(tmp_path / "cases"))


def test_a_cube_of_nothing(spark, tmp_path):
    cube = CaseCube(spark, str(tmp_path / "cube"), ROLES, ("zone",))
    row = cube.counts().first()
    assert row["total_cases"] == 0 and row["closure_rate"] == 0.0
    assert cube.monthly_trend().collect() == [] and cube.hierarchy(["zone"]).where("level > 0").collect() == []


def test_sketches_of_consumers_unite_within_their_error(spark, tmp_path):
    n = 60_000
    rows = spark.range(n * 2).select(
        F.col("id").alias("record_id"), (F.col("id") % n).alias("consumer_id"), F.lit("Open").alias("status"),
        F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(CAST(id % 360 AS INT))").alias("registration_date"),
        F.concat(F.lit("z"), F.col("id") % 3).alias("zone"),
    )
    from casekit.plans.roles import identity_roles

    cube = CaseCube(spark, str(tmp_path / "cube"), identity_roles(rows), ("zone",))
    for k in range(2):
        files.write_parquet(rows.where(f"record_id % 2 = {k}"), str(tmp_path / "cases"), mode="append")
        cube.refresh(str(tmp_path / "cases"))
    total = cube.distinct_consumers().first()[0]
    assert abs(total - n) < 0.05 * n  # three standard errors
    exact = {r["zone"]: r["e"] for r in rows.groupBy("zone").agg(F.count_distinct("consumer_id").alias("e")).collect()}
    for r in cube.distinct_consumers(["zone"]).collect():
        assert abs(r["unique_consumers"] - exact[r["zone"]]) < 0.05 * exact[r["zone"]]
    assert cube.distinct_consumers(["month_start"]).count() == 12


def test_duplicates_by_digest_are_the_duplicates(spark, monkeypatch):
    from casekit.operators import cleaning

    rng = random.Random(3)
    pick = lambda *values: rng.choice(values)
    rows = [(pick(None, 1, 2), pick(None, 1, 2), pick(None, "", "a"), pick(0.0, -0.0, float("nan"), None), pick(None, [1], [])) for _ in range(3000)]
    df = spark.createDataFrame(rows, "a int, b int, c string, d double, e array<int>")
    wanted = sorted(map(repr, df.dropDuplicates().withColumn("d", F.col("d") + 0.0).collect()))
    for limit in (cleaning.BROADCAST_DIGESTS, 3):
        monkeypatch.setattr(cleaning, "BROADCAST_DIGESTS", limit)
        assert sorted(map(repr, cleaning.drop_duplicate_rows(df).withColumn("d", F.col("d") + 0.0).collect())) == wanted
    # Rows that only share a digest stay apart.
    monkeypatch.setattr(cleaning, "BROADCAST_DIGESTS", 100)
    monkeypatch.setattr(cleaning, "row_digest", lambda df: F.xxhash64(F.coalesce(F.col("a"), F.lit(0)) % 2))
    assert sorted(map(repr, cleaning.drop_duplicate_rows(df).withColumn("d", F.col("d") + 0.0).collect())) == wanted
    # Two nulls in different places are different digests.
    monkeypatch.undo()
    two = spark.createDataFrame([(None, 1), (1, None)], "a int, b int")
    assert cleaning.repeated_digests(two).count() == 0 and cleaning.drop_duplicate_rows(two).count() == 2


def test_a_table_without_duplicates_shuffles_no_rows(spark, sf_dir):
    from casekit.operators import cleaning

    kept = cleaning.drop_duplicate_rows(table(spark, sf_dir, "orders"))
    assert "Exchange" not in kept._jdf.queryExecution().executedPlan().toString()
    assert kept.count() == table(spark, sf_dir, "orders").count()
    empty = spark.createDataFrame([], "a int, b string")
    assert cleaning.drop_duplicate_rows(empty).collect() == []

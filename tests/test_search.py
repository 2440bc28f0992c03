"""Fuzzy joins against all pairs, shares at ties, order statistics of few rows against ranges."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from casekit.functions import order_stats
from casekit.functions.expressions import share_pct
from casekit.checks.tables import ROLES, cases
from casekit.operators import executive, fuzzy, kpis, summary


def all_pairs(values, entries, min_score, top):
    con = duckdb.connect()
    con.execute("CREATE TABLE v (value VARCHAR); CREATE TABLE e (match VARCHAR)")
    con.executemany("INSERT INTO v VALUES (?)", [[x] for x in values])
    con.executemany("INSERT INTO e VALUES (?)", [[x] for x in entries])
    norm = r"trim(lower(regexp_replace({}, '[\s_.-]+', ' ', 'g')))"
    rows = con.execute(f"""WITH a AS (SELECT value, count(*) AS n, {norm.format('value')} AS x FROM v WHERE value IS NOT NULL GROUP BY 1),
        b AS (SELECT DISTINCT match, {norm.format('match')} AS y FROM e WHERE match IS NOT NULL),
        s AS (SELECT value, n, match, x, y, (1 - levenshtein(x, y) / greatest(length(x), length(y))::DOUBLE) * 100 AS q FROM a, b WHERE x <> '' AND y <> ''),
        t AS (SELECT value, n, match, round(CASE WHEN x = y THEN 100.0 WHEN contains(x, y) OR contains(y, x) THEN greatest(q, 85.0) ELSE q END, 1) AS score FROM s)
        SELECT value, n, row_number() OVER (PARTITION BY value ORDER BY score DESC, match) AS rank, match, score FROM t
        WHERE score >= {min_score} QUALIFY rank <= {top}""").fetchall()
    return sorted(map(tuple, rows))


def names(rng, n):
    parts = ["an", "be", "cor", "del", "er", "fin", "go", "hart", "il", "jo", "kel", "lo", "man", "ner", "os"]
    return ["".join(rng.choices(parts, k=rng.randint(1, 6))) + rng.choice(["", " x", "-" + rng.choice(parts)]) for _ in range(n)]


@pytest.mark.parametrize("min_score, size", [(70.0, 700), (85.0, 700), (92.0, 2000), (30.0, 60)])
def test_fuzzy_join_is_all_pairs(spark, min_score, size):
    rng = random.Random(size)
    values, entries = names(rng, size) + [None, "", "--", "a", "ab", "A_b"], names(rng, size) + [None, "", "b", "ab", "ab"]
    entries += [v[:k] + rng.choice("abc") + v[k + 1 :] for v in values[: size // 3] if v for k in [rng.randrange(len(v))]]
    frames = [spark.createDataFrame([(x, 1) for x in part], "name string, score int") for part in (values, entries)]
    found = fuzzy.fuzzy_join(frames[0], "name", frames[1].withColumnRenamed("name", "entry"), "entry", min_score, 5)
    assert sorted(map(tuple, found.collect())) == all_pairs(values, entries, min_score, 5)


def test_fuzzy_join_of_nothing(spark):
    none, one = spark.createDataFrame([], "n string"), spark.createDataFrame([("abc",)], "n string")
    for a, b in ((none, one), (one, none), (none, none)):
        assert fuzzy.fuzzy_join(a, "n", b, "n").collect() == []


def test_the_index_brings_up_few_pairs(spark):
    """Candidates of 10,000 names against 10,000 are a small part of all pairs, and the work does not need them all."""
    rng = random.Random(1)
    letters = "abcdefghijklmnopqrstuvwxyz"
    texts = ["".join(rng.choices(letters, k=rng.randint(10, 16))) for _ in range(10_000)]
    noisy = [t[:5] + rng.choice(letters) + t[6:] for t in texts]
    values = spark.createDataFrame([(t,) for t in texts], "mine string")
    entries = spark.createDataFrame([(t,) for t in noisy], "norm string")
    pairs = fuzzy.fuzzy_candidates(values, entries, 80.0)
    found = pairs.agg(F.count("*"), F.count_if(fuzzy.fuzzy_score(F.col("mine"), F.col("norm")) >= 80)).first()
    assert found[1] >= len(set(texts)) and found[0] < 400_000, found


def addresses(rng, n):
    """Texts of which most letters are the same in all."""
    hosts = ["tionsh", "blog-ththre", "m.theran", "casino"]
    ends = ["", "/", ".html", "?page=2&ref=x", "?utm_source=feed", "#top"]
    return [f"http{rng.choice(['', 's'])}://{rng.choice(hosts)}.example.{rng.choice(['net', 'org'])}/{rng.choice(['en', 'de', 'fr'])}/{rng.randrange(90_000)}{rng.choice(ends)}" for _ in range(n)]


def test_common_parts_bring_up_few_pairs(spark):
    """What most texts share is asked for last: all pairs of 2,500 addresses share a piece, few of them are near."""
    texts = sorted(set(addresses(random.Random(4), 2_500)))
    values, entries = (spark.createDataFrame([(t,) for t in texts], f"{name} string") for name in ("mine", "norm"))
    pairs = fuzzy.fuzzy_candidates(values, entries, 95.0)
    found = pairs.agg(F.count("*"), F.count_if(fuzzy.fuzzy_score(F.col("mine"), F.col("norm")) >= 95)).first()
    assert found[1] >= len(texts) and found[0] < 200_000, found


@pytest.mark.parametrize("min_score", [80.0, 90.0])
def test_fuzzy_join_of_addresses_is_all_pairs(spark, min_score):
    """Values settled by few edits have the same best entries as those compared with all."""
    rng = random.Random(5)
    values, entries = addresses(rng, 500) + ["a", "\u00e4" * 30], addresses(rng, 500) + ["a", "x" * 300, "x" * 299]
    entries += values[:100] + [v[:9] + v[10:] for v in values[:60]] + [v.upper() for v in values[:30]] + [v.replace(".", "_") for v in values[:30]]
    frames = [spark.createDataFrame([(x,) for x in part], f"{name} string") for part, name in ((values + ["x" * 301], "value"), (entries, "entry"))]
    found = fuzzy.fuzzy_join(frames[0], "value", frames[1], "entry", min_score)
    assert sorted(map(tuple, found.collect())) == all_pairs(values + ["x" * 301], entries, min_score, 3)


def test_edits_of_many_pairs_at_once(spark):
    rng = random.Random(6)
    letters = "abc\u00e9\U0001f600\0"
    rows = []
    for _ in range(3_000):
        a = [rng.choice(letters) for _ in range(rng.randint(0, 14))]
        b = list(a)
        for _ in range(rng.randint(0, 5)):
            k = rng.randint(0, len(b))
            b[k : k + rng.randint(0, 1)] = rng.choices(letters, k=rng.randint(0, 1))
        rows.append(("".join(a), "".join(b), rng.randint(0, 5)))
    df = spark.createDataFrame(rows, "mine string, norm string, most int").withColumn("wanted", F.levenshtein("mine", "norm")).toPandas()
    found = fuzzy.edits_by_columns(df["mine"], df["norm"], df["most"])
    assert found.fillna(-1).tolist() == df["wanted"].where(df["wanted"] <= df["most"], -1).tolist()
    signs = [fuzzy.letter_sets(df[c]).to_numpy().astype("int64") for c in ("mine", "norm")]
    for one, other in (signs, signs[::-1]):
        lost = [[sum((int(x) & ~int(y) & (2**64 - 1)).bit_count() for x, y in zip(p[k], q[k])) for k in (slice(0, fuzzy.LETTERS), slice(fuzzy.LETTERS, None))] for p, q in zip(one, other)]
        assert all(a <= n and b <= 2 * n for (a, b), n in zip(lost, df["wanted"]))


def test_shares_at_ties(spark):
    """A share on exactly half a hundredth goes up, whatever its binary fraction is."""
    df = spark.createDataFrame([(201, 20_000), (-201, 20_000), (1, 3), (0, 7), (5, 0), (None, 4)], "a long, b long")
    got = [r[0] for r in df.select(share_pct(F.col("a"), F.col("b"), True)).collect()]
    assert got == [1.01, -1.01, 33.33, 0.0, None, None]


def test_few_rows_are_as_many(spark, monkeypatch):
    """The one-task paths and the ranges give the same numbers."""
    rng = random.Random(3)
    rows = [(i, f"k{i % 7}", rng.choice([None, 1.0, 2.5, rng.random() * 100])) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, k string, v double")
    wanted = [order_stats.Quantile("a", 0.25), order_stats.Quantile("b", 0.9, 50.0)]

    def everything(few):
        monkeypatch.setattr(order_stats, "FEW_ROWS", 10_000 if few else 0)
        summed = order_stats.running_sums(df, "v", "id", ["k"])
        return [
            sorted((r["id"], round(r["upto"], 6), round(r["total"], 6)) for r in summed.collect()),
            sorted((r["id"], r["n"]) for r in order_stats.row_numbers(df, F.col("v").desc_nulls_last(), F.col("id").asc(), out="n").collect()),
            sorted((r["id"], round(r["rank_share"], 12)) for r in order_stats.average_rank_share(df, "v", few).collect()),
            sorted(tuple(r) for r in order_stats.quantiles_of(df, "v", wanted, ["k"], few).collect()),
            [tuple(r) for r in order_stats.quantiles_of(df, "v", wanted, few=few).collect()],
        ]

    assert everything(True) == everything(False)


@pytest.mark.parametrize("reference", [None, "1997-03-01"])
def test_two_scans_give_all_kpis(spark, sf_dir, monkeypatch, reference):
    """The summary's figures, with values at hand and with values in a table, are those of one query each."""
    view = cases(spark, sf_dir)
    apart = {}
    for df in (kpis.count_measures(view, ROLES), kpis.resolution_measures(view, ROLES), kpis.age_measures(view, ROLES, reference),
               kpis.consumer_measures(view, ROLES)):
        apart |= df.first().asDict()
    apart |= {r["kpi"]: r["pct_change"] for r in kpis.growth_measures(view).collect()}
    for rows in (10**9, 0):
        monkeypatch.setattr(summary, "HERE_ROWS", rows)
        found = {r["kpi"]: r["value"] for r in kpis.kpi_table(view, ROLES, reference).collect()}
        assert len(found) == len(kpis.UNITS)
        for name, value in found.items():
            assert value == pytest.approx(apart[name], abs=0.0101), name


def test_kpis_scan_the_cases_twice(spark, sf_dir):
    """What is left to compute after planning reads no case table, and planning reads it twice."""
    view = cases(spark, sf_dir)
    for plan in (kpis.kpi_table(view, ROLES), executive.executive_kpis(view, ROLES)):
        assert "Scan parquet" not in plan._jdf.queryExecution().executedPlan().toString()


def test_kpis_of_no_rows(spark, sf_dir):
    none = cases(spark, sf_dir).where("false")
    assert {r["value"] for r in kpis.kpi_table(none, ROLES).collect()} == {None}
    assert executive.executive_kpis(none, ROLES).count() == 1

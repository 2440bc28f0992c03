"""The URL rules, spelling variants and whitening against brute-force versions, and their edge cases."""

import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from casekit.llm import registry, spelling, url_filter, whitening

LOWER = {c: c + 32 for c in range(65, 91)}


def same_as_sql(spark, sf_dir, name, tables):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = registry.QUERIES[name](spark, sf_dir)
    cursor = con.execute(registry.ORACLE[name])
    columns = [c[0] for c in cursor.description]
    theirs = Counter(tuple(row[columns.index(c)] for c in df.columns) for row in cursor.fetchall())
    assert sorted(columns) == sorted(df.columns)
    assert Counter(tuple(r) for r in df.collect()) == theirs


# ---- URL rules ------------------------------------------------------------------------


def slow_verdict(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    raw = re.match(r"[^/?#]*", rest).group()
    host, path = raw.translate(LOWER), re.match(r"[^?#]*", rest[len(raw) :]).group()
    fits = [
        (len((h + p).encode()), len(h.encode()), h + p, action == "block")
        for h, p, action in rules
        if (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    best = max(fits, default=None)
    return host, path, best and best[2], default if best is None else ("block" if best[3] else "allow")


URLS = [
    None, "", "no scheme", "http://", "://", "http://net", "http://net/", "http://NET/x", "http://a.Example.NET/en/1#t",
    "http://a.example.net/EN/1", "http://xexample.com/de/1", "https://example.com/de/?q=1", "https://b.example.com/de",
    "http://x.org/fr/ü", "http://x.org?u=http://net/", "a://b://net/", "http://.net/", "http://net./", "http://x.net:80/",
    "http://" + "a." * 100_000 + "net/x", "http://example.com/de/" + "x" * 300_000, "http://ÄÖ.net/é", "http://org/fr/\nx",
]


def url_rows(spark):
    rows = [(i, u, "h", "p", 1) for i, u in enumerate(URLS)] + [(None, "http://net/", "h", "p", 1), (3, "http://", "h", "p", 1)]
    return spark.createDataFrame(rows, "page_id long, url string, host string, rule string, verdict int")


@pytest.mark.parametrize("most_bytes", [1 << 30, 0])
def test_url_verdicts(spark, most_bytes):
    """Mapped array and join agree with the plain definition, on odd URLs and random rules."""
    rng = random.Random(3)
    hosts = ["net", "example.net", "example.com", "org", "a.org", "b.a.org", "xn--e.com"]
    rules = list(registry.URL_RULES) + [
        (rng.choice(hosts), "/" + "/".join(rng.choices(["en", "de", "a"], k=rng.randint(0, 2))), rng.choice(["allow", "block"]))
        for _ in range(30)
    ]
    rules = list({(h, p): (h, p, a) for h, p, a in rules}.values()) + [("plain.de", "", "block"), ("ÄÖ.net", "/é", "allow")]
    urls = [
        f"http://{rng.choice(['', 'www.', 'b.a.'])}{rng.choice(hosts)}/{rng.choice(['en', 'de', 'a', 'ex'])}/{rng.choice(['a', 'en/1'])}"
        for _ in range(300)
    ]
    frame = url_rows(spark).union(spark.createDataFrame([(1000 + i, u, "", "", 0) for i, u in enumerate(urls)], "a long, b string, c string, d string, e int"))
    found = url_filter.url_verdicts(frame, spark.createDataFrame(rules, "host string, path string, action string"), most_bytes=most_bytes)
    assert found.columns == ["page_id", "host", "path", "rule", "verdict"]
    expected = Counter((r["page_id"], *slow_verdict(r["url"], rules)) for r in frame.collect())
    assert Counter(tuple(r) for r in found.collect()) == expected


def test_url_rules_without_rows(spark):
    none = spark.createDataFrame([], "host string, path string, action string")
    some = spark.createDataFrame([("net", None, "block"), (None, "/", "block"), ("x", "/", "other"), ("net", "", "allow")], none.schema)
    frame = url_rows(spark).where("page_id = 7")
    assert [tuple(r) for r in url_filter.url_verdicts(frame, none, default="block").collect()] == [(7, "net", "/x", None, "block")]
    assert [tuple(r) for r in url_filter.url_verdicts(frame, some).collect()] == [(7, "net", "/x", "net", "block")]
    assert url_filter.url_verdicts(frame.where("false"), some).collect() == []


def test_equal_digests_are_told_apart_by_text(tmp_path):
    """Stored texts decide, also where many digests are equal."""
    texts = [b"net/", b"org/", b"com/"]
    digests = np.array([5, 5, 9], np.uint64)
    (tmp_path / "s").write_bytes(url_filter._layout(digests, texts, [1, 0, 1]))
    shard = url_filter.Shard(str(tmp_path / "s"))
    probes = [b"org/", b"net/", b"de/", b"com/", b"xx/"]
    assert sorted(shard.find(np.array([5, 5, 5, 9, 4], np.uint64), probes)) == [(0, 0), (1, 1), (3, 1)]


def test_many_shards(spark):
    """A list over several shards is the list in one."""
    rules = spark.createDataFrame([(f"h{i}.net", "/", "block") for i in range(500)], "host string, path string, action string")
    array = url_filter.digest_array(rules, shard_rules=50)
    assert len(array.shards) > 5 and array.n_rules == 500
    frame = spark.createDataFrame([(i, f"http://a.h{i}.net/") for i in range(0, 600, 7)], "page_id long, url string")
    own = frame.select("page_id", url_filter.host_of(frame.url).alias("host"), url_filter.path_of(frame.url).alias("path"))
    found = {r["page_id"]: r["rule"] for r in url_filter._probed(own, array).collect()}
    assert found == {i: f"h{i}.net/" if i < 500 else None for i in range(0, 600, 7)}


def test_urls_as_sql(spark, sf_dir):
    same_as_sql(spark, sf_dir, "op12_urls", ["pages"])


# ---- whitening ------------------------------------------------------------------------


def slow_whitening(vectors, components=4):
    """By the dense covariance and LAPACK."""
    x = np.floor(256 * np.array(vectors, np.float64)).astype(np.int64)
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    centred = fit - sums / n
    values, turn = np.linalg.eigh(centred.T @ centred / n)
    values, turn = values[::-1][:components], turn[:, ::-1][:, :components]
    deviation = [sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, sums)) for row in x]
    return n, deviation, (x - sums / n) @ turn / np.sqrt(values), values / np.trace(centred.T @ centred / n)


def check_whitening(found, vectors, ids):
    n, deviation, expected, explained = slow_whitening(vectors)
    rows = [r.asDict() for r in found.collect()]
    assert len(rows) == len(ids) * expected.shape[1]
    got = {(r["vec_id"], r["component"]): r for r in rows}
    mine = np.array([[got[i, k + 1]["whitened"] for k in range(expected.shape[1])] for i in ids])
    mine *= np.sign(np.sum(mine * expected, axis=0))
    assert np.abs(mine - expected).max() < 1e-8
    assert all(r["n"] == n and r["identity_error"] < 1e-9 for r in rows)
    assert [got[i, 1]["deviation"] for i in ids] == deviation
    assert np.allclose([got[ids[0], k + 1]["explained"] for k in range(expected.shape[1])], explained, rtol=1e-10)


@pytest.mark.parametrize("table", ["sf0.01", "sf0.1"])
def test_whitening_query(spark, table):
    rows = spark.read.parquet(f"/root/testdata/{table}/embeddings.parquet").collect()
    found = registry.QUERIES["op13_whitening"](spark, f"/root/testdata/{table}")
    check_whitening(found, [r["embedding"] for r in rows], [r["vec_id"] for r in rows])


def test_whitening_odd_rows(spark):
    """Null, short, empty and non-finite vectors go; copies count once; clashing columns and null ids do not matter."""
    rng = np.random.default_rng(5)
    vectors = (rng.standard_normal((60, 6)) * [9, 5, 3, 2, 1, 1]).tolist()
    rows = [(i, v, "x", 1.0) for i, v in enumerate(vectors)]
    odd = [None, [], [1.0], [None] * 6, [float("nan")] * 6, [float("inf")] + [0.0] * 5]
    rows += [(100 + i, v, None, None) for i, v in enumerate(odd)] + [(200, vectors[3], "y", 0.0)]
    schema = "vec_id long, embedding array<double>, component string, n double"
    check_whitening(whitening.whiten(spark.createDataFrame(rows, schema)), [*vectors, vectors[3]], [*range(60), 200])
    twice = whitening.whiten(spark.createDataFrame(rows + rows[:2] + [(None, vectors[0], "", 0.0)], schema))
    assert Counter(r["vec_id"] for r in twice.collect()) == Counter({**{i: 4 for i in [*range(60), 200]}, 0: 8, 1: 8, None: 4})
    for few in ([], rows[:1], [rows[0], (9, rows[0][1], "", 0.0)]):
        assert whitening.whiten(spark.createDataFrame(few, schema)).collect() == []
    assert {r["component"] for r in whitening.whiten(spark.createDataFrame(rows[:2], schema)).collect()} == {1}


def test_whitening_keeps_large_values_exact(spark):
    rows = [(0, [3.0e13, 1.0]), (1, [-3.0e13, 2.0]), (2, [1.0, 5.0])]
    found = {r["vec_id"]: r["deviation"] for r in whitening.whiten(spark.createDataFrame(rows, "vec_id int, embedding array<double>")).collect()}
    assert found[0] is None and found[2] == slow_whitening([v for _, v in rows])[1][2]


@pytest.mark.parametrize("gap", [1e-1, 1e-3, 1e-5])
def test_jacobi_davidson_on_close_eigenvalues(gap):
    """Residuals reach rounding level, also where the last wanted value has a close neighbour outside."""
    size = 48
    q, _ = np.linalg.qr(np.random.default_rng(2).standard_normal((size, size)))
    values = np.array([10, 6, 5, 4, 4 - gap, *np.linspace(3.9, 0.1, size - 5)])
    matrix = (q * values) @ q.T
    calls = []
    pairs = whitening.jacobi_davidson(lambda b: calls.append(b.shape) or matrix @ b, size, 4)
    assert np.allclose(pairs.values, values[:4], rtol=1e-13)
    assert pairs.residuals.max() <= 16 * 2.3e-16 * 10 * size**0.5
    assert np.abs(np.abs(np.sum(q[:, :4] * pairs.vectors, axis=0)) - 1).max() < 1e-13 / gap**2
    assert len(calls) < 200


def test_jacobi_davidson_on_ties_and_low_rank():
    matrix = np.diag([5.0, 5, 5, 5, 5, 1, 0, 0, 0, 0])
    pairs = whitening.jacobi_davidson(lambda b: matrix @ b, 10, 4)
    assert np.allclose(pairs.values, 5) and np.allclose(pairs.vectors.T @ pairs.vectors, np.eye(4))
    assert np.allclose(whitening.jacobi_davidson(lambda b: 0 * b, 3, 4).values, 0)
    with pytest.raises(ArithmeticError):
        whitening.jacobi_davidson(lambda b: b + np.random.default_rng().standard_normal(b.shape), 9, 2, rounds=5)


# ---- spelling variants ----------------------------------------------------------------


def slow_variants(docs, least=5, times=5):
    counts = Counter()
    for key, text in docs:
        for run in re.findall(r"[A-Za-z\u00C0-\u00FF]+", text or ""):
            run = run.translate(LOWER)
            crc = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            counts[run if crc % 199 else run[: crc % len(run)] + run[crc % len(run) + 1 :]] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= least}
    cuts = defaultdict(set)
    for w in words:
        for i in range(len(w)):
            cuts[w[:i] + w[i + 1 :]].add((w, i))
    near = defaultdict(set)
    for w in words:
        for other, _ in cuts.get(w, ()):
            near[w].add(other)
            near[other].add(w)
    for group in cuts.values():
        for a, i in group:
            near[a] |= {b for b, j in group if i == j and a != b}
    forms = {}
    for w, n in words.items():
        best = min(near[w], key=lambda o: (-words[o], o), default=None)
        forms[w] = best if best is not None and words[best] >= times * n else None

    def root(w):
        while forms[w] is not None:
            w = forms[w]
        return w

    return Counter((w, forms[w], root(w), n, len(near[w]), forms[w] and words[forms[w]]) for w, n in words.items())


def variants(df):
    return Counter(tuple(r) for r in df.collect())


def test_variants_of_documents(spark, sf_dir):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert variants(registry.QUERIES["op11_spelling"](spark, sf_dir)) == slow_variants(docs)


def test_variants_of_dense_words(spark, monkeypatch):
    """Words over few letters have neighbours of every kind at every place; every node is hot."""
    monkeypatch.setattr(spelling, "HOT_SHARE", 10)
    rng = random.Random(11)
    pool = ["".join(rng.choices("abÀé", [5, 3, 1, 1], k=rng.randint(4, 9))) for _ in range(2500)]
    pool += ["a" * n for n in range(6, 40)] + ["x" * 4000, "x" * 3999 + "y", "x" * 2000 + "y" + "x" * 2000, "common"]
    docs = [(i % 37, " ".join(w.upper() if i % 3 else w for w in rng.choices(pool, k=300) + ["common"] * 60)) for i in range(120)]
    docs += [(1000 + i, "\u00d7-".join(w + "1" for w in pool[-40:])) for i in range(6)]
    docs += [(None, None), (None, "commom " * 7), (5, ""), (5, "commoner " * 5), (5, "commoner " * 5), (6, "漢字" * 50)]
    frame = spark.createDataFrame([(i, t, "w", 1) for i, t in docs], "doc_id long, text string, word string, n int")
    expected = slow_variants(docs)
    assert sum(1 for row in expected if row[4]) > 500
    assert variants(spelling.spelling_variants(frame)) == expected


def test_variants_chain_to_a_root(spark):
    words = {"abcdefgh": 600, "abcdefg": 100, "abcdef": 20, "abcdex": 4, "zzzzzz": 9}
    docs = [(7, " ".join(w for w, n in words.items() for _ in range(n)))]
    found = {r["word"]: r.asDict() for r in spelling.spelling_variants(spark.createDataFrame(docs, "doc_id int, text string"), least_count=4).collect()}
    assert {w: found[w]["root"] for w in words} == dict.fromkeys(list(words)[:4], "abcdefgh") | {"zzzzzz": "zzzzzz"}
    assert found["abcdex"]["form"] == "abcdef" and found["abcdefgh"]["form"] is None and found["zzzzzz"]["n_near"] == 0


def test_variants_of_nothing(spark):
    for rows in ([], [(1, None)], [(1, "short")]):
        assert spelling.spelling_variants(spark.createDataFrame(rows, "doc_id long, text string")).collect() == []


def test_variants_as_sql(spark, sf_dir):
    same_as_sql(spark, sf_dir, "op11_spelling", ["documents"])

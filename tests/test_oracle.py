"""Every registered query against its independent SQL twin, value by value."""

import datetime
import decimal
import math

import duckdb
import pytest

from casekit.checks.registry import ORACLE, QUERIES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, (bool, str)) or v is None:
        return v
    if isinstance(v, (int, float, decimal.Decimal)):
        return None if math.isnan(float(v)) else float(v)
    if isinstance(v, (datetime.date, datetime.datetime)):
        return v.isoformat()
    return str(v)


def in_order(rows, columns):
    """Rows with columns by name, sorted by everything but the last digits of floats."""
    order = [columns.index(c) for c in sorted(columns)]
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda r: [(v is None, round(v, 1) if isinstance(v, float) else v) if not isinstance(v, str)
                                      else (False, v) for v in r].__repr__())


# Medians and quartiles that both sides round to cents, where a tie of binary fractions may go either way.
ROUNDING_TIES = {"agg_median": 0.0101, "describe_by_group": 0.0101}


def close(a, b, tie=1e-9):
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=tie)
    return a == b


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(name, spark, duck, sf_dir):
    df = QUERIES[name](spark, sf_dir)
    mine = in_order([tuple(r) for r in df.collect()], df.columns)
    cursor = duck.execute(ORACLE[name])
    columns = [c[0] for c in cursor.description]
    theirs = in_order(cursor.fetchall(), columns)
    assert sorted(df.columns) == sorted(columns)
    assert len(mine) == len(theirs)
    tie = ROUNDING_TIES.get(name, 1e-9)
    wrong = [(a, b) for a, b in zip(mine, theirs) if not all(close(x, y, tie) for x, y in zip(a, b))]
    assert not wrong, wrong[:3]


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs_without_twin(name, spark, sf_dir):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_every_twin_has_a_query():
    assert set(ORACLE) <= set(QUERIES)

"""Every registered query runs on sf0.001 and matches its DuckDB oracle."""

import math

import duckdb
import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def own_oracles():
    """Keys of the reference's operators (others have tests of their own)."""
    E.oracle_sql()
    from tablekit.acceptance import ORACLE
    return list(ORACLE)


def _norm(v):
    if v is None:
        return "<null>"
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if hasattr(v, "isoformat"):
        return v.isoformat(sep=" ") if hasattr(v, "hour") else v.isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x) for x in v) + "]"
    return str(v)


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted("|".join(_norm(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def test_entry(spark):
    df = E.entry(spark)
    assert "row_index" in df.columns and df.count() >= 0


def test_every_query_has_an_oracle_or_a_reason():
    qs, oracle = E.queries(), E.oracle_sql()
    assert set(oracle) <= set(qs)
    from tablekit.acceptance import ORACLE, QUERIES
    assert set(QUERIES) == set(ORACLE) <= set(qs)


@pytest.mark.parametrize("key", sorted(own_oracles()))
def test_query_matches_oracle(spark, con, key):
    sdf = E.queries()[key](spark, SF)
    cur = con.execute(E.oracle_sql()[key])
    ocols = [d[0] for d in cur.description]
    orows = cur.fetchall()
    assert sorted(sdf.columns) == sorted(ocols)
    assert _rows(sdf.columns, [tuple(r) for r in sdf.collect()]) == _rows(ocols, orows)

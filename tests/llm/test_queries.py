"""Every registered query with SQL against that SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from glosa.llm import queries
from glosa.session import TABLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def norm(rows, cols):
    at = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(([round(r[i], 6) if isinstance(r[i], float) else r[i] for i in at] for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, tables, name):
    got = queries.QUERIES[name](spark, SF)
    res = tables.execute(queries.ORACLES[name])
    cols = [d[0] for d in res.description]
    assert sorted(got.columns) == sorted(cols)
    assert norm([tuple(r) for r in got.collect()], got.columns) == norm(res.fetchall(), cols)


def test_registered():
    have = entry.queries()
    assert {n.split("_")[0] for n in have if n.startswith("op")} >= {f"op{i}" for i in range(1, 14)} and "pipeline" in have
    assert set(queries.ORACLES) <= set(entry.oracle_sql())

"""The registered queries of the engine against DuckDB."""

import os
from decimal import Decimal

import pytest

from tessera import queries

duckdb = pytest.importorskip("duckdb")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in queries.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    return float(v) if isinstance(v, Decimal) else v


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, duck, name):
    df = queries.queries()[name](spark, SF)
    cur = duck.execute(queries.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    key = lambda r: tuple((x is not None, str(x)) for x in r)
    want = sorted((tuple(plain(r[names.index(c)]) for c in order) for r in cur.fetchall()), key=key)
    got = sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=key)
    assert got == want


@pytest.mark.parametrize("name", ["bulk_upsert", "point_lookup", "range_delete", "range_update"])
def test_more_customers_than_the_added_numbers(spark, tmp_path, name):
    """Customers with the numbers that the query adds, too, as a larger table has."""
    con = duckdb.connect()
    con.execute(f"""COPY (SELECT i AS c_custkey, 'Customer#' || i AS c_name, CAST(i % 25 AS INTEGER) AS c_nationkey, 0.5 AS c_acctbal, 'BUILDING' AS c_mktsegment
        FROM range(102000) r(i) WHERE i < 2000 OR i > 99900) TO '{tmp_path}/customer.parquet'""")
    con.execute(f"CREATE VIEW customer AS SELECT * FROM read_parquet('{tmp_path}/customer.parquet')")
    df = queries.queries()[name](spark, str(tmp_path))
    cur = con.execute(queries.oracle_sql()[name])
    want = cur.fetchall()
    assert len(want) > 0 and sorted(tuple(r) for r in df.select(*[d[0] for d in cur.description]).collect()) == sorted(want)


def test_entry(spark):
    import __spark_entry__

    if os.path.isdir(SF):
        assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_without_the_training_data_operators():
    """The engine's queries stay where the subpackage, or a library that it needs, is missing."""
    import subprocess
    import sys
    from pathlib import Path

    code = "import sys; sys.modules['tessera.llm'] = None; import __spark_entry__ as e; print(sorted(e.queries()) == sorted(e.engine_queries.queries()), 'flagship' in e.oracle_sql())"
    out = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parents[1], capture_output=True, text=True, timeout=120)
    assert out.stdout.split() == ["True", "True"], out.stderr

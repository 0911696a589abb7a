"""The driver contract: entry() on sf0.001 and every oracle against DuckDB."""
import importlib.util
import os
import sys

import duckdb
import pytest

from conftest import SF001

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, os.path.join(ROOT, "tools"))

spec = importlib.util.spec_from_file_location("entry_mod", os.path.join(ROOT, "__spark_entry__.py"))
entry_mod = importlib.util.module_from_spec(spec)
spec.loader.exec_module(entry_mod)

ORACLES = entry_mod.oracle_sql()
# model fits have no SQL twin; they are covered by test_models_job
NO_ORACLE = sorted(set(entry_mod.queries()) - set(ORACLES))


@pytest.fixture(scope="module")
def con():
    from quarry.plans.tables import TABLES
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    return c


def test_entry_smoke(spark):
    df = entry_mod.entry(spark)
    assert df.count() > 0 and "median" in df.columns


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(entry_mod.queries())
    assert len(ORACLES) >= 70


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, con, name):
    from compare import rows_of
    df = entry_mod.queries()[name](spark, SF001)
    srows, scols = df.collect(), df.columns
    cur = con.execute(ORACLES[name])
    ocols = [d[0] for d in cur.description]
    assert sorted(scols) == sorted(ocols)
    assert rows_of(scols, srows) == rows_of(ocols, cur.fetchall())

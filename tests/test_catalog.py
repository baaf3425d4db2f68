import math

import duckdb
import pytest

import __spark_entry__ as entry_module
from wattloom.plans import catalog, fixtures

TABLES = "region nation customer supplier part orders lineitem events".split()


def same(a, b):
    if a is None or b is None or a != a or b != b:
        return (a is None or a != a) == (b is None or b != b)
    if isinstance(a, float) or isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)
    return a == b


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_matches_its_sql(spark, sf_dir, name):
    got = catalog.QUERIES[name](spark, sf_dir)
    columns = sorted(got.columns)
    rows = sorted((tuple(r[c] for c in columns) for r in got.collect()), key=str)
    if name not in catalog.ORACLE_SQL:
        assert rows
        return
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    want = con.execute(catalog.ORACLE_SQL[name]).df()
    assert sorted(want.columns) == columns
    expected = sorted((tuple(None if v is None or v != v else (v.to_pydatetime() if hasattr(v, "to_pydatetime") else v) for v in r) for r in want[columns].itertuples(index=False)), key=str)
    assert len(rows) == len(expected)
    if rows != expected:
        assert all(all(map(same, a, b)) for a, b in zip(rows, expected))


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


def test_stored_jobs_are_dealt_over_the_cores(spark, sf_dir):
    """All events lie in one file; their profiles are made and read by more than one task."""
    assert len(spark.read.parquet(f"{sf_dir}/events.parquet").inputFiles()) == 1
    for made in (fixtures.jobs(spark, sf_dir), fixtures.raw_trace(spark, sf_dir)):
        assert len(made.inputFiles()) >= spark.sparkContext.defaultParallelism

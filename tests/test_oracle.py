"""Every registered query against its DuckDB oracle on sf0.001."""

import duckdb
import pytest

import __spark_entry__ as E
from check_oracle import TABLES, frame_hash
from claimscope.plans.registry import QUERIES as REGISTERED
from conftest import SF_SMALL

# the library's own queries; optional subpackages test theirs
QUERIES = {name: fn for name, fn in E.queries().items() if name in REGISTERED}
SQL = {name: sql for name, sql in E.oracle_sql().items() if name in REGISTERED}
FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(SQL)


def test_entry(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["section", "rank", "key", "name", "paid", "patients", "claim_lines", "n"]


@pytest.fixture
def plans(monkeypatch):
    """The executed plans of everything that is checkpointed or collected."""
    from pyspark.sql.classic.dataframe import DataFrame
    seen = []
    for method in ("checkpoint", "collect", "toPandas"):
        def watched(self, *args, _real=getattr(DataFrame, method), **kw):
            out = _real(self, *args, **kw)
            seen.append(self._jdf.queryExecution().executedPlan().toString())
            return out
        monkeypatch.setattr(DataFrame, method, watched)
    return seen


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_oracle(spark, con, plans, name):
    got = QUERIES[name](spark, SF_SMALL).toPandas()
    want = con.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want)
    assert frame_hash(got)[0] == frame_hash(want)[0]
    # no cross or nested-loop join, below checkpoints either
    assert plans and not [w for p in plans for w in FORBIDDEN if w in p]

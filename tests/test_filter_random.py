"""Random filter combinations: the dashboard and a page of rows vs the SQL oracle."""

import random

import duckdb
import pytest

from check_oracle import TABLES, frame_hash
from claimscope.functions.filters import Filter
from claimscope.operators import dashboard, rows
from claimscope.plans import oracle_sql as O
from claimscope.plans.inputs import Inputs
from conftest import SF_SMALL

MONTHS = ["", "1996-03", "1997-07", "1998-12", "2000-02"]
CODES = ["", "t1019", " T2042 ,d1110", "99213, ,", "A0425,S0215,G0299", "nosuch"]
STATES = ["", " ny", "CA ", "scx", "zz"]
AMOUNTS = ["", "0", "1000", "10.005", "-5", "50000", "100000000"]
BILLING = ["", " 1000000007", "1000000002"]


def random_filters(n, seed=11):
    rnd = random.Random(seed)
    out = []
    for _ in range(n):
        a, b = rnd.choice(MONTHS), rnd.choice(MONTHS)
        out.append(Filter(month_from=a or None, month_to=b or None, hcpcs=rnd.choice(CODES),
                          state=rnd.choice(STATES), paid_min=rnd.choice(AMOUNTS) or None,
                          paid_max=rnd.choice(AMOUNTS) or None,
                          billing_npi=rnd.choice(BILLING)))
    return out


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


@pytest.mark.parametrize("flt", random_filters(6))
def test_random_filter_dashboard(spark, con, flt):
    i = Inputs(spark, SF_SMALL)
    got = dashboard.dashboard_long(i.fact(), i.lookup(), i.descs(), flt).toPandas()
    want = con.execute(O.dashboard_long(flt)).df()
    assert len(got) == len(want)
    assert frame_hash(got)[0] == frame_hash(want)[0]


@pytest.mark.parametrize("flt", random_filters(4, seed=5))
def test_random_filter_rows(spark, con, flt):
    i = Inputs(spark, SF_SMALL)
    got = rows.rows_page(i.fact(), flt, "claim_lines", "asc", 30, 5).toPandas()
    want = con.execute(O.rows_page(flt, "claim_lines", "asc", 30, 5)).df()
    assert frame_hash(got)[0] == frame_hash(want)[0]

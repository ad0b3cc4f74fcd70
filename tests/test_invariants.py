"""Invariants of the recorded dashboards, checked on the fixture data."""

import pytest

from claimscope.functions.filters import Filter
from claimscope.functions.sectors import OTHER
from claimscope.operators import dashboard, leaders
from claimscope.plans.inputs import Inputs
from conftest import SF_SMALL


@pytest.fixture(scope="module")
def dash(spark):
    i = Inputs(spark, SF_SMALL)
    d = dashboard.dashboard_long(i.fact(), i.lookup(), i.descs())
    o = dashboard.dashboard_long(i.fact(), i.lookup(), i.descs(), Filter.exclude_extreme())
    return i, {r_key(r): r for r in d.collect()}, {r_key(r): r for r in o.collect()}


def r_key(r):
    return (r.section, r.rank)


def section(rows, name):
    return [r for k, r in sorted(rows.items(), key=lambda kv: kv[0]) if k[0] == name]


def test_monthly_and_hist_add_up(dash):
    i, d, _ = dash
    total = d[("summary", 1)].n
    assert sum(r.n for r in section(d, "monthly")) == total  # no null month in the data
    hist_n = sum(r.n for r in section(d, "hist"))
    gap = i.fact().where("paid is null or paid <= 0").count()
    assert total - hist_n == gap


def test_extreme_preset_removes_exactly_the_top_buckets(dash):
    i, d, o = dash
    removed = d[("summary", 1)].n - o[("summary", 1)].n
    over = i.fact().where("paid > 100000000 or paid is null").count()
    assert removed == over
    # buckets below 8 are untouched by the preset
    low = {r.key: r.n for r in section(d, "hist") if int(r.key) < 8}
    low_o = {r.key: r.n for r in section(o, "hist") if int(r.key) < 8}
    assert low == low_o


def test_hist_has_no_filled_buckets(dash):
    _, d, _ = dash
    assert all(r.n > 0 for r in section(d, "hist"))
    keys = [int(r.key) for r in section(d, "hist")]
    assert keys == sorted(keys)


def test_top_lists_never_increase(dash):
    _, d, o = dash
    for rows in (d, o):
        for name in ("top_sectors", "top_hcpcs", "top_billing", "top_servicing", "top_states"):
            p = [r.paid for r in section(rows, name)]
            assert p == sorted(p, reverse=True) and 0 < len(p) <= 12


def test_other_only_in_dashboard_fold(spark, dash):
    i, d, _ = dash
    assert OTHER in {r.key for r in section(d, "top_sectors")}
    lead = leaders.sector_leaders(i.fact(), i.lookup(), i.sectors())
    secs = {r.sector for r in lead.select("sector").distinct().collect()}
    assert OTHER not in secs and len(secs) == 12
    assert lead.groupBy("sector").count().where("count > 8").count() == 0

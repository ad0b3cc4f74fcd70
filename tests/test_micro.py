"""Hand-computed answers on the 12-row micro fixture."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from claimscope.functions.filters import Filter
from claimscope.functions.sectors import OTHER, code_sectors
from claimscope.operators import cubes, dashboard, leaders, providers, rows, stats


def rows_of(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.collect()]


def test_summary(micro):
    s = dashboard.summary(dashboard.grouping_sets(micro)).collect()[0]
    assert (s.rows, s.patients, s.claim_lines) == (12, 52, 70)
    assert Decimal(repr(s.paid)) == Decimal("2000100001766.29")
    assert (s.hcpcs_n, s.billing_n, s.servicing_n) == (7, 4, 5)


def test_monthly_hides_null_month(micro):
    m = dashboard.monthly(dashboard.grouping_sets(micro))
    assert rows_of(m, "month", "n") == [("2018-01", 4), ("2018-02", 4), ("2018-03", 3)]


def test_hist(micro):
    h = dashboard.hist(dashboard.grouping_sets(micro))
    assert rows_of(h, "bucket", "n") == [(-2, 1), (0, 1), (1, 1), (2, 3), (3, 1), (8, 1), (12, 1)]


def test_extreme_preset_is_inclusive_and_drops_null(micro):
    assert Filter.exclude_extreme().apply(micro).count() == 10


def test_code_filter_upper_cases_and_skips_blanks(micro):
    got = Filter(hcpcs=" t1019, , ").apply(micro)
    assert sorted(rows_of(got, "billing_npi", "paid")) == sorted(
        [("B1", Decimal("100.00")), ("B1", Decimal("250.50")), ("B2", Decimal("350.50")),
         ("B3", Decimal("9.99"))])


def test_filter_parameters():
    assert Filter(state=" ny ").clauses() and Filter(hcpcs=" , ").clauses() == []
    with pytest.raises(ValueError):
        Filter(paid_min="abc").clauses()
    f = Filter(month_from="2018-01", state="x", billing_npi="B1").scoped("month_from")
    assert f == Filter(month_from="2018-01")


def test_top_providers_per_code_tie_break(micro, micro_lookup):
    t = leaders.top_providers_by_code(micro, micro_lookup, "billing", 12).where("hcpcs = 'T1019'")
    assert sorted(rows_of(t, "rk", "npi", "paid")) == [(1, "B1", 350.5), (2, "B2", 350.5)]


def test_sector_fold(micro):
    ts = dashboard.top_sectors(dashboard.grouping_sets(micro))
    got = {r.key: r.paid for r in ts.collect()}
    assert got["Home health & personal care"] == pytest.approx(710.99)
    assert got[OTHER] == pytest.approx(2000000000000.00)  # codes 20 and W1793 (null paid)
    assert got["Dental"] == pytest.approx(-20.0)
    assert got["Physician & clinical services"] == pytest.approx(75.30)       # 99213
    assert got["Behavioral health & community services"] == pytest.approx(1e8)  # 90834


def test_sector_leaders_inner_join(micro, micro_lookup):
    sect = code_sectors(micro)
    out = leaders.sector_leaders(micro, micro_lookup, sect)
    secs = {r.sector for r in out.collect()}
    assert OTHER not in secs and None not in secs
    assert "B4" in {r.npi for r in out.collect()}        # 90834 is classified
    assert all(r.npi is not None for r in out.collect())  # row 9 (null billing) excluded


def test_states(micro):
    assert rows_of(stats.distinct_values(micro, "billing_state"), "billing_state", "idx") == [
        ("CA", 0), ("NY", 1)]


def test_peers_of_b1(micro, micro_lookup, micro_descs):
    codes = providers.peer_codes(micro, micro_descs, "B1").orderBy("rank")
    assert rows_of(codes, "code", "paid", "description") == [
        ("T1019", 350.5, "Personal care"), ("99213", 75.25, None)]
    p = providers.peers(micro, micro_lookup, "B1").orderBy("rank")
    assert rows_of(p, "npi", "paid", "codes", "name") == [
        ("B1", 425.75, 2, "Alpha Clinic"), ("B2", 350.55, 2, "Beta Care")]


def test_peers_errors(micro, micro_lookup):
    with pytest.raises(ValueError):
        providers.peers(micro, micro_lookup, "  ")
    assert providers.peers(micro, micro_lookup, "nobody").count() == 0


def test_find_provider(micro, micro_lookup):
    with pytest.raises(ValueError):
        providers.find_provider(micro, micro_lookup, " ab ")
    got = rows_of(providers.find_provider(micro, micro_lookup, "CARE"), "npi", "paid")
    assert got == [("B2", 350.55)]
    # registered but bills nothing: drops out
    assert providers.find_provider(micro, micro_lookup, "Sam One").count() == 0


def test_provider_index(micro, micro_lookup):
    idx = providers.provider_index(micro, micro_lookup).collect()
    assert len(idx) == 1
    r = idx[0]
    assert (r.npi, r.name, r.state) == ("B4", "Delta Group", "TX")
    assert r.total == 100000000.0 and r.paid_on_codes == 100000000.0
    assert list(r.codes) == ["90834", "W1793"]


def test_rows_page_order_and_caps(micro):
    page = rows.rows_page(micro, sort="bogus", direction="DESC", limit=3, offset=0)
    assert [r.paid for r in page.collect()] == [2e12, 1e8, 1000.0]
    asc = rows.rows_page(micro, sort="paid", direction="ASC", limit=9999, offset=0).collect()
    assert len(asc) == 12 and asc[-1].paid is None  # nulls last either way
    with pytest.raises(ValueError):
        rows.rows_page(micro, limit=-1)


def test_pages_concatenate_to_full_order(micro):
    full = [tuple(r) for r in rows.rows_page(micro, sort="hcpcs", direction="asc", limit=500).collect()]
    pages = []
    for off in range(0, 12, 5):
        pages += [tuple(r) for r in rows.rows_page(micro, sort="hcpcs", direction="asc", limit=5,
                                                   offset=off).collect()]
    assert pages == full


def test_cubes_match_grouping_sets(micro):
    cmc = cubes.cube_month_code(micro)
    s = cubes.cubes_summary(cmc, hcpcs="T1019").collect()[0]
    d = dashboard.summary(dashboard.grouping_sets(micro, Filter(hcpcs="T1019"))).collect()[0]
    assert (s.rows, s.paid, s.patients, s.claim_lines) == (d.rows, d.paid, d.patients, d.claim_lines)
    # the cube has no rows without a code, so compare under a code filter
    m1 = rows_of(cubes.cubes_monthly(cmc, month_from="2018-02", hcpcs="t1019,99213"),
                 "month", "paid", "n")
    m2 = rows_of(dashboard.monthly(dashboard.grouping_sets(
        micro, Filter(month_from="2018-02", hcpcs="t1019,99213"))), "month", "paid", "n")
    assert m1 == m2 and len(m1) == 2


def test_dataset_stats_and_coverage(micro):
    s = stats.dataset_stats(micro).collect()[0]
    assert (s.rows, s.hcpcs_count, s.billing_npis, s.servicing_npis) == (12, 7, 4, 5)
    c = stats.state_coverage(micro).collect()[0]
    assert (c.with_state, c.rows, c.pct) == (8, 12, 66.7)


def test_dashboard_long_is_consistent(micro, micro_lookup, micro_descs):
    long = dashboard.dashboard_long(micro, micro_lookup, micro_descs)
    secs = {r.section for r in long.select("section").distinct().collect()}
    assert secs == {"summary", "distinct", "monthly", "hist", "top_sectors", "top_hcpcs",
                    "top_billing", "top_servicing", "top_states"}
    top_b = long.where("section = 'top_billing'").orderBy("rank").collect()
    assert [r.key for r in top_b] == ["B4", "B1", "B2", "B3"]
    assert top_b[0].name == "Delta Group"
    # invariant: top-list paid never increases
    for sec in ("top_hcpcs", "top_billing", "top_servicing", "top_states", "top_sectors"):
        p = [r.paid for r in long.where(F.col("section") == sec).orderBy("rank").collect()]
        assert p == sorted(p, reverse=True)


def test_dashboard_dict_matches_long(micro, micro_lookup, micro_descs):
    parts = dashboard.dashboard(micro, micro_lookup, micro_descs)
    long = dashboard.dashboard_long(micro, micro_lookup, micro_descs)
    assert parts["summary"].collect()[0].rows == long.where("section = 'summary'").collect()[0].n
    a = rows_of(parts["top_billing"].orderBy("rank"), "key", "name", "paid")
    b = rows_of(long.where("section = 'top_billing'").orderBy("rank"), "key", "name", "paid")
    assert a == b
    assert rows_of(parts["hist"], "bucket", "n") == [
        (int(r.key), r.n) for r in long.where("section = 'hist'").orderBy("rank").collect()]


@pytest.mark.parametrize("flt", [Filter(), Filter(hcpcs="t1019,99213"), Filter(month_from="2018-02"),
                                 Filter(month_from="2018-01", month_to="2018-02", hcpcs="T1019,d0120")])
def test_dashboard_from_cube_equals_fact_dashboard(micro, micro_lookup, micro_descs, flt):
    """Every section the cube can hold, null groups included."""
    fact_long = dashboard.dashboard_long(micro, micro_lookup, micro_descs, flt)
    cube_long = cubes.cubes_dashboard_long(cubes.cube_dashboard(micro), micro_descs, flt.month_from,
                                           flt.month_to, flt.hcpcs)
    want = fact_long.where("section not in ('top_billing', 'top_servicing') and (section <> 'distinct' or key = 'hcpcs')")
    assert sorted(map(repr, cube_long.collect())) == sorted(map(repr, want.collect()))
    assert cube_long.where("section = 'top_states'").count() > 0

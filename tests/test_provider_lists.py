"""Provider sections from lists and bitmaps against the fact."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from claimscope.functions.filters import Filter
from claimscope.operators import provider_lists as L
from claimscope.schema import SPENDING


@pytest.fixture(scope="module")
def fact(spark):
    """Ties, negative and null sums, a null month, and providers that are never at
    the head of a list but have the largest totals."""
    r = random.Random(7)
    out = []
    for m in [f"2018-{i:02d}" for i in range(1, 7)] + [None]:
        for p in range(60):
            if r.random() < 0.8:
                paid = None if r.random() < 0.1 else Decimal(r.randint(-2000, 5000)) / 100
                out.append((f"B{p:02d}" if p else None, f"S{p % 40}", r.choice(["T1019", "t1019", "D1110", None]), m, 1, 2, paid, "NY"))
        out += [(f"STEADY{i}", "S1", "T1019", m, 1, 1, Decimal("49.00"), "NY") for i in range(3)]
        out += [(f"ONCE{m}{i}", "S2", "D1110", m, 1, 1, Decimal("90.00"), "NY") for i in range(4)]
    return spark.createDataFrame(out, SPENDING).cache()


FILTERS = [Filter(), Filter(month_from="2018-02", month_to="2018-04"), Filter(month_from="2019-01"), Filter(month_to="2018-01")]


@pytest.mark.parametrize("flt", FILTERS + [Filter(hcpcs="t1019, d1110"), Filter(month_from="2018-03", hcpcs="D1110"), Filter(hcpcs="none")])
@pytest.mark.parametrize("role", L.ROLES)
def test_equal_to_the_fact(spark, fact, role, flt):
    of = L.LISTS["code" if flt.hcpcs else "month"]
    lists = L.provider_list(fact, role, of).cache()
    npi = f"{role}_npi"
    rows = flt.apply(fact).where(F.col(npi).isNotNull()).groupBy(npi).agg(
        F.coalesce(F.sum("paid"), F.lit(0)).alias("paid"), F.sum("patients").alias("patients"), F.sum("claim_lines").alias("c"),
        F.count(F.lit(1)).alias("n")).collect()
    want = sorted(rows, key=lambda r: (-r.paid, r[npi]))
    for k in (3, 12, 500):
        got = L.top_listed(lists, L.list_levels(lists, of), flt, k, of).orderBy("rank").collect()
        assert [tuple(r) for r in got] == [(i + 1, *r) for i, r in enumerate(want[:k])]
    bits = L.provider_bitmaps(lists, L.provider_index_table(fact, role), of)
    assert L.distinct_listed(bits, flt).first().n == len(rows)


def test_heads_and_what_they_leave_out():
    levels = [("a", 2, 90), ("a", 5, 50), ("a", 9, -4), ("b", 1, 70), ("b", 1, 10), ("c", 40, -3), ("c", 1, -9)]
    ends, most, whole = L.heads(levels, 3)
    assert dict(ends) == {"a": 50, "b": 10, "c": -3} and most == 50 and not whole
    assert L.heads(levels, 100)[1:] == (0, True) and L.heads([], 5) == ([], 0, True)


def test_few_entries_are_read(spark):
    rows = [(f"P{i:04d}", "S", "T1019", f"2018-{m:02d}", 1, 1, Decimal(100000 // (i + 1)), "NY") for i in range(1500) for m in (1, 2, 3)]
    lists = L.provider_list(spark.createDataFrame(rows, SPENDING), "billing")
    levels = [(r.month, r.n, r.least) for r in L.list_levels(lists).collect()]
    ends, most, whole = L.heads(levels, L.DEPTH * 12)
    assert not whole and most < 3 * (100000 // 12) and len(ends) == 3


def test_a_list_has_no_more_words_than_entries(spark):
    lists = spark.createDataFrame([("C1", "2018-01", f"p{i:04}") for i in (0, 63, 64, 700)] + [("C2", "2018-01", "p0063"), (None, None, "p0001")],
                                  "hcpcs_norm string, month string, npi string")
    index = spark.createDataFrame([(f"p{i:04}", i) for i in range(701)], "npi string, idx long")
    bits = L.provider_bitmaps(lists, index, L.LISTS["code"])
    assert dict(bits.dtypes)["bits"] == "bigint" and bits.count() == 5
    assert L.distinct_listed(bits, Filter()).first().n == 5
    assert L.distinct_listed(bits, Filter(hcpcs="C1")).first().n == 4
    assert L.distinct_listed(bits.limit(0), Filter()).first().n == 0

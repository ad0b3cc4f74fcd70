"""Dashboards of a range of amounts from whole parts and cut ones, against the fact."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from claimscope.functions.filters import Filter
from claimscope.operators import dashboard, paid_range
from claimscope.operators import provider_lists as PL
from claimscope.schema import NPI_LOOKUP, SPENDING

EDGES = ["-50.00", "-0.01", "0.00", "0.01", "0.09", "0.10", "1.00", "9.99", "10.00", "99999999.99", "100000000.00",
         "100000000.01", "999999999999.99", "99999999999999.99", "100000000000000.00", "9999999999999999.99"]


@pytest.fixture(scope="module")
def fact(spark):
    r = random.Random(3)
    amounts = [*map(Decimal, EDGES), None]
    rows = [(f"B{i % 41:02d}" if i % 13 else None, f"S{i % 29}", r.choice(["T1019", "99213", None]),
             r.choice(["2018-01", "2018-02", "2019-07", None]), 1, 2,
             r.choice(amounts) if i % 3 else Decimal(r.randint(-10 ** r.randint(1, 9), 10 ** r.randint(1, 9))) / 100,
             r.choice(["NY", "CA", None])) for i in range(900)]
    return spark.createDataFrame(rows, SPENDING).cache()


@pytest.fixture(scope="module")
def stored(fact):
    made = {"cube_paid": paid_range.cube_paid(fact)}
    for role in PL.ROLES:
        name = f"provider_paid_{role}"
        lists = PL.provider_list(fact.withColumn("part", paid_range.part()), role, paid_range.LIST)
        index = PL.provider_index_table(fact, role)
        made |= {name: lists, f"provider_index_{role}": index, f"{name}_levels": PL.list_levels(lists, paid_range.LIST),
                 f"{name}_bitmaps": PL.provider_bitmaps(lists, index, paid_range.LIST)}
    made = {name: df.cache() for name, df in made.items()}
    assert set(made) == set(paid_range.tables())
    return made.__getitem__


FILTERS = [Filter.exclude_extreme(), Filter(paid_min="0"), Filter(paid_min="0.01", paid_max="0.01"),
           Filter(paid_min="-7.005", paid_max="99999999999999.99"), Filter(month_from="2018-02", paid_min=3, paid_max=250000.5),
           Filter(paid_min="1e20"), Filter(paid_max="-1e20"), Filter(paid_min="10", paid_max="5")]


@pytest.mark.parametrize("flt", FILTERS)
def test_equal_to_the_fact(spark, fact, stored, flt):
    lookup, descs = spark.createDataFrame([("B01", "One", "NY")], NPI_LOOKUP), spark.createDataFrame([("T1019", "Care")], "hcpcs string, name string")
    got = paid_range.dashboard_long(stored, fact, lookup, descs, flt)
    want = dashboard.dashboard_long(fact, lookup, descs, flt)
    assert got.columns == want.columns
    plain = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert plain(got) == plain(want)


def test_parts_never_fall(spark):
    rows = spark.createDataFrame([(i, Decimal(a)) for i, a in enumerate(EDGES)], "i int, paid decimal(18,2)")
    parts = [r.p for r in rows.select("i", paid_range.part().alias("p")).orderBy("i").collect()]
    assert parts == sorted(parts) and parts[:4] == [paid_range.NOT_POSITIVE] * 3 + [-2]
    # each amount lies within the range that is read for its part
    for p in set(parts):
        within = {r.i for r in rows.where(paid_range._edges(p)).collect()}
        assert within >= {i for i, q in enumerate(parts) if q == p}


def test_only_cut_rows_are_read(spark, fact, tmp_path):
    fact.write.parquet(str(tmp_path / "fact"))
    flt = Filter.exclude_extreme()
    cuts = paid_range.cut_parts(spark, flt)
    assert cuts == (None, 8)
    rows = paid_range.cut_rows(spark.read.parquet(str(tmp_path / "fact")), flt, cuts)
    assert {r.paid for r in rows.select("paid").collect()} == {Decimal("100000000.00")}
    pushed = [x for x in rows._jdf.queryExecution().executedPlan().toString().splitlines() if "PushedFilters" in x]
    assert len(pushed) == 1 and "LessThanOrEqual(paid,100000000.00)" in pushed[0] and "GreaterThanOrEqual(paid,99999999.9" in pushed[0]


def test_which_filters_are_answered():
    assert paid_range.answers(Filter(paid_min="1")) and paid_range.answers(Filter(paid_max=5, month_to="2018-02"))
    for flt in (Filter(), Filter(paid_min=""), Filter(paid_min="1", hcpcs="T1019"), Filter(paid_max="1", state="ny"),
                Filter(paid_max="inf"), Filter(paid_min="nan")):
        assert not paid_range.answers(flt)
    with pytest.raises(ValueError):
        paid_range.answers(Filter(paid_min="much"))

"""Rows by position: pages against plain sorting, and plans that sort little."""

import random
import re
import tempfile
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from claimscope.functions.filters import Filter
from claimscope.operators import order, rows
from claimscope.operators.order import Key
from claimscope.plans.build import build_from_fixture
from claimscope.plans.inputs import Inputs
from claimscope.schema import ROW_COLUMNS, SPENDING
from conftest import SF_SMALL


@pytest.fixture(scope="module")
def built(spark):
    root = tempfile.mkdtemp(prefix="claimscope-test-order-", dir="/tmp") + "/build"
    build_from_fixture(spark, SF_SMALL, root, with_bake=False)
    return Inputs.from_build(spark, root)


def plain(got, sort, direction):
    """All rows sorted in Python."""
    out = list(got)
    for c in reversed([sort, *[c for c in ROW_COLUMNS if c != sort]]):
        down = c == sort and direction == "desc"
        out.sort(key=lambda r: r[c] if r[c] is not None else 0 if c in ("paid", "patients", "claim_lines") else "", reverse=down)
        out.sort(key=lambda r: r[c] is None)
    return [tuple(r[c] if c != "paid" or r[c] is None else float(r[c]) for c in ROW_COLUMNS) for r in out]


def skewed(spark):
    """A third of the rows have one amount, many are equal in all columns."""
    r = random.Random(4)
    out = []
    for i in range(900):
        paid = Decimal("10.00") if i % 3 == 0 else None if i % 17 == 0 else Decimal(r.randint(-500, 10 ** r.randint(1, 9))) / 100
        code = r.choice(["A", "AB", "ABC", "é1", "", None])
        out.append((r.choice(["B1", "B22", None]), "S1" if i % 3 == 0 else r.choice(["S1", "S2"]), code, r.choice(["2018-01", "2018-02"]),
                    1, r.choice([1, 2 ** 40]), paid, r.choice(["NY", None])))
    return spark.createDataFrame(out, SPENDING).repartition(2)


@pytest.mark.parametrize("sort,direction", [("paid", "desc"), ("hcpcs", "asc"), ("claim_lines", "asc")])
def test_pages_equal_plain_sorting(spark, sort, direction):
    df = skewed(spark)
    want = plain(df.collect(), sort, direction)
    keys = rows.sort_keys(sort, direction)
    listed = df.select(*ROW_COLUMNS)
    for offset, limit, enough in ((0, 5, 3), (297, 40, 10), (880, 50, 7), (900, 5, 1), (0, 0, 1), (0, 1000, 4)):
        got = order.page(listed, keys, offset, limit, enough=enough).collect()
        assert [tuple(r[:-1]) + (None if r.paid is None else float(r.paid),) for r in got] == want[offset:offset + limit]


@pytest.mark.parametrize("sort,direction", [("paid", "desc"), ("hcpcs", "asc")])
def test_walk_gives_every_row_once(spark, sort, direction):
    df = skewed(spark).cache()
    want = plain(df.collect(), sort, direction)
    got, last, seen = [], None, 0
    page = rows.rows_page(df, sort=sort, direction=direction, limit=250)
    while True:
        page = page.cache()
        got += [tuple(r) for r in page.orderBy(*[k.order() for k in rows.sort_keys(sort, direction)]).collect()]
        place = rows.next_place(page, sort, direction, last, seen)
        if place is None:
            break
        last, seen = place
        page = rows.rows_after(df, last, seen, sort=sort, direction=direction, limit=250)
    assert got == want


def test_equal_rows_beyond_the_page_end_are_kept(spark):
    one = ("B1", "S1", "T1019", "2018-01", 1, 1, Decimal("5.00"), "NY")
    df = spark.createDataFrame([one] * 5 + [("B2",) + one[1:]], SPENDING)
    first = rows.rows_page(df, limit=2)
    last, seen = rows.next_place(first)
    assert seen == 2 and rows.rows_after(df, last, seen, limit=10).count() == 4


def _plan(spark, df):
    spark.conf.set("spark.sql.maxMetadataStringLength", "4000")
    try:
        df.collect()
        return df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")


@pytest.mark.parametrize("n", [1001, 2000, 4200])
def test_top_rows_push_a_bound_and_shuffle_no_table(spark, built, n):
    df = rows.top_rows(built.fact(), n)
    plan = _plan(spark, df)
    assert "GreaterThanOrEqual(paid" in plan
    # one merge of the rows above the bound; nothing is sorted before it
    assert "TakeOrderedAndProject" in plan and "Exchange" not in plan and "Window" not in plan
    assert len(df.collect()) == n


def test_rows_above_the_bound_are_few(spark, built):
    fact = built.fact().select(*ROW_COLUMNS)
    for offset, limit in ((0, 2000), (3000, 50), (5500, 500)):
        keys = rows.sort_keys()
        first, last = order.locate(fact, keys, offset, 64), order.locate(fact, keys, offset + limit - 1, 64)
        inside = fact.where(first.from_here() & last.up_to_here())
        assert limit <= inside.count() <= limit + 2 * 64
        before = fact.where(~F.coalesce(first.from_here(), F.lit(False)))
        assert before.count() == first.before <= offset


def test_stored_counts_and_ordered_table(spark, built):
    fact = built.fact()
    path = tempfile.mkdtemp(prefix="claimscope-test-ordered-", dir="/tmp")
    order.counted(fact, Key("paid", False)).write.parquet(f"{path}/counts")
    counts = spark.read.parquet(f"{path}/counts")
    rows.write_ordered_rows(fact, f"{path}/rows", rows_per_range=500)
    total = fact.count()
    assert counts.agg(F.sum("n")).first()[0] == total
    for offset, limit in ((0, 30), (495, 30), (3456, 1200), (total - 10, 50), (total, 5)):
        want = rows.rows_page(fact, limit=limit, offset=offset).collect()
        assert rows.rows_page(fact, limit=limit, offset=offset, counts=counts).collect() == want
        stored = rows.ordered_rows_page(spark, f"{path}/rows", limit=limit, offset=offset)
        assert stored.collect() == want
    df = rows.ordered_rows_page(spark, f"{path}/rows", limit=20, offset=3000)
    read = _plan(spark, df)
    assert re.search(r"PartitionFilters: \[[^]]*range", read)
    assert rows.rows_page(fact, Filter(state="ny"), limit=10, counts=counts).collect() == rows.rows_page(
        fact, Filter(state="ny"), limit=10).collect()


@pytest.mark.parametrize("walkers", [1, 3])
def test_a_walk_lists_every_row_once_and_reads_its_own_ranges(spark, monkeypatch, walkers):
    rows_of = [("B%d" % (i % 3), "S", "T%d" % (i % 2), "2018-01", 1, 1, Decimal(i % 5) if i % 7 else None, None) for i in range(230)]
    rows_of += [("B", "S", "T", "2018-02", 1, 1, Decimal("2.00"), "NY")] * 60  # pages and walkers begin among equal rows
    fact = spark.createDataFrame(rows_of, SPENDING)
    path = tempfile.mkdtemp(prefix="claimscope-test-walk-", dir="/tmp")
    rows.write_ordered_rows(fact, f"{path}/table", rows_per_range=40)
    read, inner = [], order._ranges_at

    def counted(spark, table, schema, first, end, ranges):
        read.append(end - first)
        return inner(spark, table, schema, first, end, ranges)
    monkeypatch.setattr(order, "_ranges_at", counted)
    assert rows.walk(spark, f"{path}/table", f"{path}/out", limit=20, walkers=walkers) == 15
    want = rows.rows_page(fact, limit=1000).collect()
    got = spark.read.parquet(f"{path}/out").orderBy("page").collect()
    key = lambda r: tuple(str(v) for v in r[:8])
    for n in range(15):
        assert sorted(key(r) for r in got if r.page == n) == sorted(key(r) for r in want[n * 20:n * 20 + 20])
    assert max(read) <= 20 + 60  # a page and the rows equal to the last one, never the table


def test_a_walk_of_no_rows(spark):
    path = tempfile.mkdtemp(prefix="claimscope-test-walk-", dir="/tmp")
    rows.write_ordered_rows(spark.createDataFrame([], SPENDING), f"{path}/table")
    assert rows.walk(spark, f"{path}/table", f"{path}/out") == 1
    assert spark.read.parquet(f"{path}/out").count() == 0


def test_more_pages_of_a_walk_make_no_more_jobs_and_begin_where_the_last_ended(spark):
    rows_of = [("B%d" % (i % 3), "S", "T%d" % (i % 2), "2018-01", i % 4, 1, Decimal(i % 9) if i % 7 else None, None) for i in range(200)]
    rows_of += [("B", "S", "T", "2018-02", 1, 1, Decimal("2.00"), "NY")] * 50
    path = tempfile.mkdtemp(prefix="claimscope-test-walk-", dir="/tmp")
    rows.write_ordered_rows(spark.createDataFrame(rows_of, SPENDING), f"{path}/table", rows_per_range=30)
    started = lambda: spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs()
    jobs = []
    for limit in (50, 7):
        before = started()
        assert rows.walk(spark, f"{path}/table", f"{path}/out{limit}", limit=limit, walkers=2) == -(-250 // limit)
        jobs.append(started() - before)
    assert jobs[1] <= jobs[0] + 4
    got = spark.read.parquet(f"{path}/out7").collect()
    ranges = order.ordered_ranges(spark, f"{path}/table")
    for n in (1, 12, 35):
        last, seen = order.ordered_place(spark, f"{path}/table", rows.STORED, rows.sort_keys(), n * 7 - 1, ranges)
        last["paid"] = None if last["paid"] is None else float(last["paid"])  # as pages have it
        want = rows.ordered_rows_after(spark, f"{path}/table", last, seen, n * 7, limit=7, ranges=ranges).collect()
        assert sorted(map(str, want)) == sorted(str(type(r)(**{c: r[c] for c in want[0].__fields__})) for r in got if r.page == n)


def test_a_walk_of_a_table_without_places_is_an_error(spark):
    path = tempfile.mkdtemp(prefix="claimscope-test-walk-", dir="/tmp")
    fact = spark.createDataFrame([("B", "S", "T", "2018-02", 1, 1, Decimal("2.00"), "NY")] * 9, SPENDING)
    rows.write_ordered_rows(fact, f"{path}/table")
    stored = spark.read.parquet(f"{path}/table/rows").drop("at").cache()
    stored.count()
    stored.write.mode("overwrite").partitionBy("range").parquet(f"{path}/table/rows")
    with pytest.raises(Exception, match="without places"):
        rows.walk(spark, f"{path}/table", f"{path}/out", limit=2, walkers=1)

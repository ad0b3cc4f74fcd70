"""The interleaved copy of the fact: ranks, layout, row groups read."""

import glob
import tempfile
from decimal import Decimal

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from claimscope.functions.filters import Filter
from claimscope.plans.build import bake, build_fact
from claimscope.plans.inputs import Inputs
from claimscope.operators.stats import distinct_values
from claimscope.operators.provider_lists import provider_index_table
from claimscope.sources import fixture, interleaved as Z
from claimscope.sources.tables import FACT_OPTIONS, clustered, fact_at, finish_table, latest_build
from conftest import SF_SMALL


def _copy(fact):
    return Z.interleaved(fact, provider_index_table(fact, "billing"), provider_index_table(fact, "servicing"),
                         distinct_values(fact, "billing_state"))


def test_rank_counts_cut_points(spark):
    cuts = [f"{j:03d}" for j in range(2, 9)]                       # 7 cuts, 3 bits
    values = ["000", "002", "0025", "008", "9", None]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    got = {r.v: r.r for r in df.select("v", Z.rank(F.col("v"), cuts, "string", 3).alias("r")).collect()}
    assert got == {v: 0 if v is None else sum(c <= v for c in cuts) for v in values}
    assert df.select(Z.rank(F.col("v"), [], "string", 3).alias("r")).distinct().collect()[0].r == 0


def test_bits_by_turns(spark):
    df = spark.createDataFrame([(5, 3), (0, 7), (7, 0)], "a int, b int")
    got = {(r.a, r.b): r.z for r in df.select("*", Z.interleave(["a", "b"], 3).alias("z")).collect()}
    plain = {ab: int("".join(x + y for x, y in zip(f"{ab[0]:03b}", f"{ab[1]:03b}")), 2) for ab in got}
    assert got == plain


def test_cut_points_of_an_index(spark):
    index = spark.createDataFrame([(f"k{i:02d}", i) for i in range(20)], "npi string, idx long")
    assert Z.index_cuts(index, "npi", 2) == ["k05", "k10", "k15"]
    few = index.where("idx < 2")
    assert Z.index_cuts(few, "npi", 2) == ["k00", "k01", "k01"]
    assert Z.index_cuts(index.limit(0), "npi", 2) == []


def test_rows_are_those_of_the_fact(spark, micro):
    fact = micro.unionByName(micro).withColumn("hcpcs_norm", F.upper("hcpcs"))
    copy = _copy(fact)
    assert copy.columns == fact.columns
    assert sorted(map(str, copy.collect())) == sorted(map(str, fact.collect()))
    assert _copy(fact.limit(0)).count() == 0


def _groups(path, column, low, high):
    """Row groups whose minimum and maximum admit a value in [low, high], of all."""
    read = total = 0
    for f in glob.glob(f"{path}/**/*.parquet", recursive=True):
        meta = pq.ParquetFile(f).metadata
        for g in range(meta.num_row_groups):
            total += 1
            chunk = next(c for c in map(meta.row_group(g).column, range(meta.num_columns)) if c.path_in_schema == column)
            s = chunk.statistics
            read += s is None or not s.has_min_max or (s.min <= high and s.max >= low)
    return read, total


def test_fewer_row_groups_are_read(spark):
    fact = fixture.spending(spark, SF_SMALL).withColumn("hcpcs_norm", F.upper("hcpcs"))
    month = F.concat(F.lit("1998-0"), F.pmod(F.xxhash64(*fact.columns), F.lit(2)) + 1)
    fact = fact.withColumn("month", month).repartition(2).checkpoint()
    one, two = (tempfile.mkdtemp(prefix="claimscope-test-layout-", dir="/tmp") + "/t" for _ in range(2))
    small = FACT_OPTIONS | {"maxRecordsPerFile": 20}
    finish_table(clustered(fact), one, ["month"], **small)
    finish_table(_copy(fact), two, ["month"], **small)
    npi = lambda c: fact.groupBy(c).count().where(F.col(c).isNotNull()).orderBy(F.desc("count"), c).first()[0]
    billing, servicing = npi("billing_npi"), npi("servicing_npi")
    for column, low, high in (("billing_npi", billing, billing), ("servicing_npi", servicing, servicing),
                              ("billing_state", "NY", "NY"), ("paid", Decimal("60000"), Decimal("1e15"))):
        (a, n), (b, m) = _groups(one, column, low, high), _groups(two, column, low, high)
        assert b / m < 0.75 * a / n, (column, a, n, b, m)


@pytest.fixture(scope="module")
def build(spark):
    root = tempfile.mkdtemp(prefix="claimscope-test-interleaved-", dir="/tmp")
    build_fact(spark, fixture.spending_raw(spark, SF_SMALL), fixture.npi_lookup(spark, SF_SMALL), root,
               fixture.code_desc(spark, SF_SMALL))
    assert "fact_interleaved" in bake(spark, root, only=("fact_interleaved",))
    return root


def test_the_copy_is_read_where_it_helps(spark, build):
    i = Inputs.from_build(spark, build)
    place = lambda flt: i.fact_for(flt).inputFiles()[0].rsplit("/v=", 1)[1].split("/")[1]
    for flt in (Filter(state="ny"), Filter(billing_npi="1000000007", month_from="1997-01"), Filter(paid_min="10")):
        assert place(flt) == "fact_interleaved"
    for flt in (Filter(), Filter(month_from="1997-01"), Filter(hcpcs="T1019"), Filter(hcpcs="T1019", state="ny")):
        assert place(flt) == "fact"
    same = fact_at(spark, latest_build(spark, build))
    copy = i.fact_for(Filter(state="ny"))
    assert copy.exceptAll(same).count() == 0 and same.exceptAll(copy).count() == 0


def test_filters_are_pushed(spark, build, capsys):
    flt = Filter(state="ny", month_from="1997-01", paid_min="10")
    flt.apply(Inputs.from_build(spark, build).fact_for(flt)).explain("formatted")
    plan = capsys.readouterr().out
    assert "PartitionFilters: [isnotnull(month" in plan
    assert "EqualTo(billing_state,NY)" in plan and "GreaterThanOrEqual(paid,10.00)" in plan

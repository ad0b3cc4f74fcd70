"""Hot keys: one billing provider holding a third of all rows, plus null keys.

The state join and the per-group rankings must give the same answer whether
AQE broadcasts, shuffles, or splits the skewed partition."""

from pyspark.sql import functions as F

from claimscope.functions.sectors import code_sectors
from claimscope.operators import leaders, providers
from claimscope.sources import fixture
from claimscope.sources.joins import add_billing_state
from conftest import SF_SMALL

FORCE_SHUFFLE = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
}


def _hot_raw(spark):
    raw = fixture.spending_raw(spark, SF_SMALL)
    # half of the rows again, chosen by a hash of their content (so the
    # choice does not depend on the plan), all billed by one provider: it
    # now holds about a third of the rows
    pick = F.xxhash64(*[F.col(c) for c in raw.columns]) % 2 == 0
    hot = raw.where(F.col("billing_npi").isNotNull() & pick)
    return raw.unionByName(hot.withColumn("billing_npi", F.lit("1000000007")))


def _with_conf(spark, conf, make):
    old = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        return sorted(map(tuple, make().collect()), key=repr)
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def test_state_join_same_under_skew_split(spark):
    lookup = fixture.npi_lookup(spark, SF_SMALL)

    def make():
        j = add_billing_state(_hot_raw(spark), lookup)
        return j.groupBy("billing_npi", "billing_state").agg(F.count(F.lit(1)).alias("n"),
                                                             F.sum("paid").alias("p"))
    default = _with_conf(spark, {}, make)
    split = _with_conf(spark, FORCE_SHUFFLE, make)
    assert default == split
    hot = [r for r in default if r[0] == "1000000007"]
    nulls = [r for r in default if r[0] is None]
    assert hot and nulls and nulls[0][1] is None  # null keys never match


def test_rankings_same_under_skew(spark):
    lookup = fixture.npi_lookup(spark, SF_SMALL)

    def make_leaders():
        fact = add_billing_state(_hot_raw(spark), lookup)
        return leaders.sector_leaders(fact, lookup, code_sectors(fact))

    def make_index():
        fact = add_billing_state(_hot_raw(spark), lookup)
        return providers.provider_index(fact, lookup).withColumn("codes", F.concat_ws(",", "codes"))

    for make in (make_leaders, make_index):
        assert _with_conf(spark, {}, make) == _with_conf(spark, FORCE_SHUFFLE, make)


def test_a_large_registry_is_cut_to_the_providers_that_bill(spark, monkeypatch):
    from claimscope.sources import joins
    raw, lookup = _hot_raw(spark), spark.createDataFrame(
        [(f"X{i}", "n", "TX") for i in range(50)] + [("B1", "n", "NY"), ("B1", "m", "CA"), (None, "n", "ZZ")],
        "npi string, name string, state string")
    raw = raw.where("rand(1) < 0.01").unionByName(raw.limit(3).withColumn("billing_npi", F.lit("B1")))
    raw = raw.localCheckpoint()
    want = sorted(add_billing_state(raw, lookup).collect(), key=str)
    assert {r.billing_state for r in want} >= {"NY", "CA"}
    monkeypatch.setattr(joins, "SMALL_REGISTRY", 10)
    for most in (0, 10):
        monkeypatch.setattr(joins, "MOST_BROADCAST", most)
        named, few = joins._billing(lookup, raw)
        assert sorted(r._rstate for r in named.collect()) == ["CA", "NY"] and few == (most > 0)
        joined = add_billing_state(raw, lookup)
        assert sorted(joined.collect(), key=str) == want
        if few:
            assert "BroadcastHashJoin" in joined._jdf.queryExecution().executedPlan().toString()

"""Batch build: fact table, versioned replace, CSV ingest, plan shape."""

import tempfile

import pytest
from pyspark.sql import functions as F

from claimscope.functions.filters import Filter
from claimscope.operators import dashboard, leaders, providers, rows
from claimscope.plans.build import build_fact, bake
from claimscope.plans.inputs import Inputs
from claimscope.sources import fixture
from claimscope.sources.joins import add_billing_state
from claimscope.plans import serve as V
from claimscope.sources.tables import latest_build, read_claims_csv, read_fact
from conftest import SF_SMALL


@pytest.fixture(scope="module")
def built(spark):
    root = tempfile.mkdtemp(prefix="claimscope-test-build-", dir="/tmp")
    build_fact(spark, fixture.spending_raw(spark, SF_SMALL), fixture.npi_lookup(spark, SF_SMALL),
               root, fixture.code_desc(spark, SF_SMALL))
    return root


def _totals(df):
    r = df.agg(F.count(F.lit(1)).alias("n"), F.sum("paid").alias("p"),
               F.count("billing_state").alias("s")).collect()[0]
    return r.n, r.p, r.s


def test_built_fact_equals_view(spark, built):
    view = fixture.spending(spark, SF_SMALL)
    fact = read_fact(spark, built)
    assert _totals(fact) == _totals(view)
    cols = ["billing_npi", "servicing_npi", "hcpcs", "month", "patients", "claim_lines", "paid",
            "billing_state"]
    assert fact.select(cols).exceptAll(view.select(cols)).count() == 0
    assert fact.where("hcpcs_norm <> upper(hcpcs)").count() == 0


def test_state_join_is_idempotent(spark):
    view = fixture.spending(spark, SF_SMALL)
    again = add_billing_state(view, fixture.npi_lookup(spark, SF_SMALL))
    assert again.columns == view.columns
    assert again.exceptAll(view).count() == 0 and view.exceptAll(again).count() == 0


def test_csv_round_trip(spark):
    from claimscope.schema import SOURCE_COLUMNS
    raw = fixture.spending_raw(spark, SF_SMALL)
    path = tempfile.mkdtemp(prefix="claimscope-test-csv-", dir="/tmp") + "/claims"
    raw.select(*[F.col(dst).cast("string").alias(src) for src, dst in SOURCE_COLUMNS]) \
       .write.option("header", True).csv(path)
    back = read_claims_csv(spark, path)
    assert back.schema == raw.schema
    assert back.exceptAll(raw).count() == 0 and raw.exceptAll(back).count() == 0


def test_queries_on_built_equal_queries_on_view(spark, built):
    a = Inputs(spark, SF_SMALL)
    b = Inputs.from_build(spark, built)
    for make in (
        lambda i: dashboard.dashboard_long(i.fact(), i.lookup(), i.descs(), Filter(hcpcs="T2042")),
        lambda i: leaders.top_providers_by_state(i.fact(), i.lookup()),
        lambda i: providers.peers(i.fact(), i.lookup(), "1000000007"),
        lambda i: rows.rows_page(i.fact(), Filter(month_from="1998-01"), "month", "asc", 40, 10),
    ):
        x, y = make(a), make(b)
        assert x.exceptAll(y).count() == 0 and y.exceptAll(x).count() == 0


def test_bake_writes_tables(spark, built):
    times = bake(spark, built)
    assert {"cube_month_code", "dash_default", "provider_index", "sector_leaders"} <= set(times)
    d = spark.read.parquet(f"{latest_build(spark, built)}/dash_default")
    assert d.where("section = 'summary'").collect()[0].n == read_fact(spark, built).count()


def test_partition_count_independence(spark):
    i = Inputs(spark, SF_SMALL)
    q = dashboard.dashboard_long(i.fact(), i.lookup(), i.descs())
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        one = q.collect()
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        eight = dashboard.dashboard_long(i.fact(), i.lookup(), i.descs()).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert sorted(map(tuple, one), key=repr) == sorted(map(tuple, eight), key=repr)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plan_pruning_on_built_fact(spark, built):
    fact = read_fact(spark, built)
    f = Filter(month_from="1996-01", month_to="1996-12", hcpcs="t1019").apply(fact)
    f.collect()
    plan = f._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month" in plan
    assert "In(hcpcs_norm" in plan or "EqualTo(hcpcs_norm" in plan
    assert "ReadSchema" in plan


def test_plan_top_k_per_group_is_limited_before_shuffle(spark, built):
    i = Inputs.from_build(spark, built)
    df = leaders.sector_leaders(i.fact(), i.lookup(), i.sectors())
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_plan_peers_prunes_by_code(spark, built):
    i = Inputs.from_build(spark, built)
    spark.conf.set("spark.sql.maxMetadataStringLength", "4000")
    try:
        df = providers.peer_totals(i.fact(), "1000000007")
        df.collect()
        plan = _plan(df)
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    pushed = [x for x in plan.split("PushedFilters")[1:] if "In(hcpcs_norm" in x]
    assert pushed and "LeftSemi" not in plan


def test_registry_csv(spark):
    from claimscope.sources.tables import REGISTRY_NAME, REGISTRY_STATE, read_registry_csv
    lk = fixture.npi_lookup(spark, SF_SMALL)
    path = tempfile.mkdtemp(prefix="claimscope-test-reg-", dir="/tmp") + "/registry"
    rows_ = lk.select(F.col("npi").alias("NPI"), F.col("name").alias(REGISTRY_NAME),
                      F.concat(F.lit(" "), F.lower("state"), F.lit(" ")).alias(REGISTRY_STATE),
                      F.lit("x").alias("Other Column"))
    no_npi = spark.createDataFrame([(None, "no npi", "ny", "x")],
                                   "a string, b string, c string, d string")
    rows_.union(no_npi).write.option("header", True).csv(path)
    back = read_registry_csv(spark, path)
    assert back.exceptAll(lk).count() == 0 and lk.exceptAll(back).count() == 0


def test_json_map_round_trip(spark):
    from claimscope.functions.sectors import code_sectors
    from claimscope.sources.tables import read_json_map, write_json_map
    m = code_sectors(fixture.spending_raw(spark, SF_SMALL))
    path = tempfile.mkdtemp(prefix="claimscope-test-json-", dir="/tmp") + "/sectors"
    write_json_map(m, path)
    back = read_json_map(spark, path)
    assert back.exceptAll(m).count() == 0 and m.exceptAll(back).count() == 0


def test_amount_precision_report(spark):
    from claimscope.sources.tables import amount_precision_report
    path = tempfile.mkdtemp(prefix="claimscope-test-amt-", dir="/tmp") + "/claims.csv"
    rows_ = ["BILLING_PROVIDER_NPI_NUM,SERVICING_PROVIDER_NPI_NUM,HCPCS_CODE,CLAIM_FROM_MONTH,"
             "TOTAL_PATIENTS,TOTAL_CLAIM_LINES,TOTAL_PAID",
             "1,2,T1019,2018-01,3,4,10.50", "1,2,T1019,2018-02,3,4,1.005", "1,2,T1019,2018-03,3,4,7"]
    with open(path, "w") as f:
        f.write("\n".join(rows_) + "\n")
    r = amount_precision_report(spark, path).collect()[0]
    assert (r.rounded_rows, r.rows) == (1, 3)
    with pytest.raises(Exception, match="more than two decimals"):
        read_claims_csv(spark, path).collect()
    back = read_claims_csv(spark, path, rounding="round").orderBy("month").collect()
    assert [str(x.paid) for x in back] == ["10.50", "1.01", "7.00"]


def test_filter_from_query_params():
    f = Filter.from_params({"month_from": ["2018-01"], "hcpcs": ["a, b"], "sort": ["paid"]})
    assert f == Filter(month_from="2018-01", hcpcs="a, b")


def test_dense_index_across_partitions(spark):
    from claimscope.operators.topk import dense_index
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "37")
        keys = spark.range(5000).select(F.format_string("k%05d", (F.col("id") * 7919) % 5000)
                                        .alias("k"))
        got = dense_index(keys.union(keys), "k").orderBy("idx").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert [r.idx for r in got] == list(range(5000))
    assert [r.k for r in got] == sorted(r.k for r in got)


def test_bake_is_restarted_and_repeated(spark, monkeypatch):
    from claimscope.plans import build as B
    from claimscope.sources.tables import is_baked, table_exists
    root = tempfile.mkdtemp(prefix="claimscope-test-bake-", dir="/tmp") + "/build"
    build_fact(spark, fixture.spending_raw(spark, SF_SMALL), fixture.npi_lookup(spark, SF_SMALL), root,
               fixture.code_desc(spark, SF_SMALL))
    at = latest_build(spark, root)
    finish, written = B.finish_table, []

    def dies(df, path):
        if path.endswith("/provider_totals"):
            df.limit(1).write.parquet(f"{path}/_temporary/0")       # what a dead writer leaves
            raise RuntimeError("lost")
        written.append(path)
        return finish(df, path)

    monkeypatch.setattr(B, "finish_table", dies)
    with pytest.raises(RuntimeError, match="lost"):
        bake(spark, root)
    monkeypatch.setattr(B, "finish_table", finish)
    assert not is_baked(spark, at) and not table_exists(spark, f"{at}/provider_totals") and len(written) > 5
    again = bake(spark, root)
    assert is_baked(spark, at) and "provider_totals" in again and not {p.split("/")[-1] for p in written} & set(again)
    assert bake(spark, root) == {}
    i = Inputs.from_build(spark, root)
    from claimscope.operators import cubes
    for name in cubes.ROLLED:
        own = getattr(cubes, name)(i.fact())
        baked = i.stored(name).select(own.columns)
        assert baked.dtypes == own.dtypes
        assert baked.exceptAll(own).count() == 0 and own.exceptAll(baked).count() == 0


def test_build_with_bake_is_marked_last(spark, monkeypatch):
    from claimscope.plans import build as B
    root = tempfile.mkdtemp(prefix="claimscope-test-last-", dir="/tmp") + "/build"
    raw, lookup = fixture.spending_raw(spark, SF_SMALL).limit(50), fixture.npi_lookup(spark, SF_SMALL)
    build_fact(spark, raw, lookup, root)
    monkeypatch.setattr(B, "bake_at", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError, match="lost"):
        build_fact(spark, raw, lookup, root, with_bake=True)
    assert latest_build(spark, root) == f"{root}/v=1"               # readers stay with the whole one


def test_stored_search_equals_the_fact(spark, built):
    from claimscope.operators import search
    bake(spark, built, only=("name_grams",))
    i = Inputs.from_build(spark, built)
    odd = i.lookup().where("name like 'Supplier%'").limit(40).select(
        "npi", F.concat(F.lit("\u0130\u212aa\u00df "), "name", F.lit("_100%\\")).alias("name"), "state")
    lookup = i.lookup().join(odd.select("npi"), "npi", "left_anti").unionByName(odd.select(*i.lookup().columns))
    totals = search.provider_totals(i.fact(), lookup).cache()
    grams = search.name_grams(totals).cache()
    for text in ("supplier#00000001", "SUPPLIER#", "su_plier%1", "s%r%9", "000", "\u212aa\u00df", "kass", "_100%\\", "nothing like it"):
        want = providers.find_provider(i.fact(), lookup, text).collect()
        got = search.find_stored(totals, grams, text)
        assert got.collect() == want, text
    plan = _plan(V.find_provider(i, "supplier#"))
    assert "name_grams" in plan and "/fact" not in plan
    for bad in ("", " ab ", None):
        with pytest.raises(ValueError):
            search.find_stored(totals, grams, bad)


def test_rebuild_shows_no_stale_table(spark):
    root = tempfile.mkdtemp(prefix="claimscope-test-rebuild-", dir="/tmp")
    raw, lookup = fixture.spending_raw(spark, SF_SMALL), fixture.npi_lookup(spark, SF_SMALL)
    from claimscope.operators import cubes
    build_fact(spark, raw.limit(0), lookup, root)
    bake(spark, root, only=("cube_month_code",))
    old = Inputs.from_build(spark, root)
    assert old.cube("cube_month_code", cubes.cube_month_code).count() == 0
    build_fact(spark, raw, lookup, root)
    new = Inputs.from_build(spark, root)
    assert new.built != old.built
    want = cubes.cube_month_code(new.fact())
    assert new.cube("cube_month_code", cubes.cube_month_code).exceptAll(want).count() == 0 and want.count() > 0
    assert set(bake(spark, root, only=("cube_month_code",))) == {"cube_dashboard", "cube_month_code"}
    assert bake(spark, root, only=("cube_month_code",)) == {}


def test_unmarked_build_is_ignored(spark):
    import os
    root = tempfile.mkdtemp(prefix="claimscope-test-mark-", dir="/tmp")
    build_fact(spark, fixture.spending_raw(spark, SF_SMALL).limit(5), fixture.npi_lookup(spark, SF_SMALL), root)
    os.makedirs(f"{root}/v=2/fact")
    assert latest_build(spark, root) == f"{root}/v=1"


def test_hot_month_and_code_is_spread(spark):
    from claimscope.sources.tables import clustered
    raw = fixture.spending(spark, SF_SMALL)
    hot = raw.withColumn("month", F.lit("1997-05")).withColumn("hcpcs", F.lit("T1019"))
    laid = clustered(raw.unionByName(hot)).withColumn("p", F.spark_partition_id())
    old = spark.conf.get("spark.sql.adaptive.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        n = [r["count"] for r in laid.where("month = '1997-05' and hcpcs = 'T1019'").groupBy("p").count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)
    assert len(n) >= 3 and max(n) < 0.6 * sum(n)


CSV_HEAD = ("BILLING_PROVIDER_NPI_NUM,SERVICING_PROVIDER_NPI_NUM,HCPCS_CODE,CLAIM_FROM_MONTH,"
            "TOTAL_PATIENTS,TOTAL_CLAIM_LINES,TOTAL_PAID")


def _csv(name, *lines):
    path = tempfile.mkdtemp(prefix="claimscope-test-csv-", dir="/tmp") + f"/{name}.csv"
    with open(path, "w") as f:
        f.write("\n".join(lines) + "\n")
    return path


def test_csv_binds_by_name(spark):
    path = _csv("claims", ",".join(CSV_HEAD.split(",")[::-1]), "10.50,4,3,2018-01,T1019,2,1")
    r = read_claims_csv(spark, path).first()
    assert (r.billing_npi, r.servicing_npi, r.hcpcs, r.month, r.patients, r.claim_lines, str(r.paid)) == (
        "1", "2", "T1019", "2018-01", 3, 4, "10.50")


def test_csv_short_row_fails(spark):
    path = _csv("claims", CSV_HEAD, "1,2,T1019,2018-01,3,4,10.50", "1,2,T1019,2018-01")
    with pytest.raises(Exception, match="MALFORMED|Malformed"):
        read_claims_csv(spark, path).collect()


def test_registry_doubled_quotes(spark):
    from claimscope.sources.tables import REGISTRY_NAME, REGISTRY_STATE, read_registry_csv
    path = _csv("registry", f'NPI,"{REGISTRY_NAME}","{REGISTRY_STATE}"', '"1","ACME ""BEST"", LLC","ny"')
    assert tuple(read_registry_csv(spark, path).first()) == ("1", 'ACME "BEST", LLC', "NY")


def test_lookup_prefers_a_state(spark):
    from claimscope.sources.tables import dedupe_lookup
    df = spark.createDataFrame([("1", "A", "NY"), ("1", "A", None), ("2", None, None), ("2", "B", None)],
                               "npi string, name string, state string")
    assert sorted(map(tuple, dedupe_lookup(df).collect())) == [("1", "A", "NY"), ("2", "B", None)]


@pytest.mark.parametrize("n,parts", [(12263, 8), (12263, 200), (1_000_000, 8)])
def test_dense_index_survives_persist(spark, n, parts):
    from claimscope.operators.topk import dense_index
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        keys = spark.range(n).select(F.format_string("k%07d", (F.col("id") * 7919) % n).alias("k"))
        got = dense_index(keys, "k").persist()
        wrong = got.where(F.substring("k", 2, 7).cast("long") != F.col("idx")).count()
        assert (got.count(), wrong) == (n, 0)
        got.unpersist()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_amounts_out_of_range_and_between_cents(spark, micro):
    n = lambda **kw: Filter(**kw).apply(micro).count()
    known = micro.where("paid is not null").count()
    assert n(paid_max="1e27") == known and n(paid_min="1e27") == 0 and n(paid_min="-inf") == known
    assert n(paid_min="75.251") == micro.where("paid >= 75.26").count()
    assert n(paid_max="75.259") == micro.where("paid <= 75.25").count()


def test_backslash_in_a_name(spark, micro, micro_lookup):
    more = micro_lookup.unionByName(spark.createDataFrame([("B9", "Back\\slash 100% Co", "NY")], micro_lookup.schema))
    fact = micro.unionByName(micro.where("billing_npi = 'B1'").withColumn("billing_npi", F.lit("B9")))
    assert [r.npi for r in providers.find_provider(fact, more, "ck\\sl").collect()] == ["B9"]
    assert [r.npi for r in providers.find_provider(fact, more, "b_ck%co").collect()] == ["B9"]


def test_search_totals_every_match(spark):
    i = Inputs(spark, "/root/testdata/sf0.1")
    got = providers.find_provider(i.fact(), i.lookup(), "supplier#").collect()
    every = (i.fact().join(i.lookup().where("name ilike '%supplier#%'"), F.col("billing_npi") == F.col("npi"))
             .groupBy("npi").agg(F.sum("paid").alias("p")))
    assert every.count() > 400
    want = every.orderBy(F.col("p").desc(), "npi").limit(10).collect()
    assert [(r.npi, r.paid) for r in got] == [(r.npi, float(r.p)) for r in want]


def test_pages_go_on_beyond_any_offset(spark):
    fact = Inputs(spark, "/root/testdata/sf0.1").fact()
    a = rows.rows_page(fact, limit=5, offset=100_000).collect()
    b = rows.rows_page(fact, limit=5, offset=100_005).collect()
    assert a != b and rows.rows_page(fact, limit=700).count() == 700
    with pytest.raises(ValueError):
        rows.rows_page(fact, limit=-1)


def test_non_local_master_needs_a_checkpoint_folder():
    from claimscope import session

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return {}

    class Session:
        sparkContext, conf = Context(), {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.checkpoint_dir(Session())
    assert session.is_local("local[*]") and not session.is_local("local-cluster[2,1,1024]")

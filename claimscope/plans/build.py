"""The batch build: raw inputs → clustered fact table → aggregate tables.

Every build is a new version folder under ``root`` (``v=N``); its marker is
written last and readers use the newest marked one. Each step writes Parquet and
later steps read what earlier ones wrote, which also cuts the lineage:

1. ``npi_lookup`` – provider registry, one row per NPI.
2. ``fact``       – payment rows ⟕ registry state, clustered by (month, code).
3. ``codes`` (distinct codes with their dense index), ``code_desc`` (as given;
   empty without descriptions) and ``sector_map`` (as given, or by the rules).
4. cubes, top lists, leaders, largest rows, provider index, dataset
   statistics, search tables and the two precomputed dashboards (:func:`bake`;
   they go into the build whose fact they were computed from).
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession

from claimscope.functions.filters import Filter
from claimscope.operators import provider_lists as PL
from claimscope.operators import cubes, dashboard, leaders, order, paid_range, providers, rows, search, stats
from claimscope.sources import fixture
from claimscope.sources.interleaved import interleaved
from claimscope.sources.joins import add_billing_state
from claimscope.sources.quarantine import accepted_claims, land_claims
from claimscope.sources.tables import (BAKED, FACT_OPTIONS, complete_build, dedupe_lookup, fact_at, finish_table, latest_build, mark,
                                       new_build, read_claims_csv, read_json_map, read_registry_csv, table_exists,
                                       write_fact, write_table)


def build_fact(spark: SparkSession, raw: DataFrame, lookup: DataFrame, root: str,
               descs: DataFrame | None = None, sectors: DataFrame | None = None, with_bake: bool = False) -> dict:
    """Steps 1–3, and 4 if ``with_bake``, as a new complete build: readers go on with
    the last one until the marker is written, after the last table. ``raw`` has the
    seven fact columns; ``lookup`` npi/name/state; ``descs`` hcpcs/name; ``sectors``
    hcpcs/sector. Returns the seconds of each step."""
    build, timings = new_build(spark, root), {}

    def timed(name, work):
        t0 = time.time()
        work()
        timings[name] = time.time() - t0

    def code_tables():
        write_table(stats.distinct_values(fact_at(spark, build), "hcpcs"), f"{build}/codes")
        codes = spark.read.parquet(f"{build}/codes")
        known = spark.createDataFrame([], "hcpcs string, name string") if descs is None else descs
        write_table(known.select("hcpcs", "name"), f"{build}/code_desc")
        write_table(stats.sector_map(codes) if sectors is None else sectors.select("hcpcs", "sector"),
                    f"{build}/sector_map")

    timed("npi_lookup", lambda: write_table(dedupe_lookup(lookup), f"{build}/npi_lookup"))
    registry = spark.read.parquet(f"{build}/npi_lookup")
    timed("fact", lambda: write_fact(add_billing_state(raw, registry), f"{build}/fact"))
    timed("code_tables", code_tables)
    if with_bake:
        timings.update(bake_at(spark, build))
    complete_build(spark, build)
    return timings


def build_from_files(spark: SparkSession, claims: str, registry: str, root: str,
                     descriptions: str | None = None, sectors: str | None = None,
                     rounding: str = "fail", with_bake: bool = False, quarantine: str | None = None) -> dict:
    """A build from the raw files: claims CSV, registry CSV, and optional
    JSON objects of code descriptions and code sectors. A bad claims row fails the
    build; with ``quarantine``, a folder, it is set apart there, and the build has the
    good rows."""
    if quarantine:
        land_claims(spark, claims, quarantine, rounding)
        raw = accepted_claims(spark, quarantine)
    else:
        raw = read_claims_csv(spark, claims, rounding)
    return build_fact(spark, raw, read_registry_csv(spark, registry), root,
                      read_json_map(spark, descriptions, "hcpcs", "name") if descriptions else None,
                      read_json_map(spark, sectors, "hcpcs", "sector") if sectors else None, with_bake)


CUBES = ("cube_dashboard", "cube_month_code", "cube_code_bucket", "cube_month_state", "cube_state_code")
#: What searches and pages read instead of the fact.
SEARCH = ("provider_totals", "name_grams", "order_paid")
#: Tables of a build that are written only when named: as large as the fact.
OPTIONAL = ("fact_interleaved",)


def bake(spark: SparkSession, root: str, only=None) -> dict:
    """Step 4: the materialised aggregates, from the built fact table
    (``only``: a subset of table names), of the latest build. ``OPTIONAL`` ones are
    written only if they are named.

    Can be repeated: a finished table stays as it is (the fact of a build never
    changes), one that a failed run has left is written again, and the marker of a
    whole bake is written after the last table. The cubes are added up from
    ``cube_dashboard``, so that the fact is read once for all five. Returns the
    seconds of each table written."""
    return bake_at(spark, latest_build(spark, root), only)


def bake_at(spark: SparkSession, build: str, only=None) -> dict:
    """:func:`bake` into the version folder ``build``, which need not be complete."""
    fact = fact_at(spark, build)
    read = lambda name: spark.read.parquet(f"{build}/{name}")
    lookup, descs, sectors = read("npi_lookup"), read("code_desc"), read("sector_map")

    def rolled(name):
        return lambda: cubes.rolled(name, read("cube_dashboard"))

    def indexed(name, **by):
        def make():
            cube = read(name)
            for key, table in by.items():
                cube = cubes.with_index(cube, key, read(table), {"hcpcs": "code_idx", "month": "month_idx",
                                                                "billing_state": "state_idx"}[key])
            return cube
        return make

    listed = {}
    for role in PL.ROLES:
        listed[f"provider_index_{role}"] = (lambda r: lambda: PL.provider_index_table(fact, r))(role)
        for kind, of in PL.LISTS.items():
            name = f"provider_{kind}_{role}"
            of_rows = fact.withColumn("part", paid_range.part()) if kind == "paid" else fact
            listed[name] = (lambda rows, r, o: lambda: PL.provider_list(rows, r, o))(of_rows, role, of)
            if kind != "code":
                listed[f"{name}_levels"] = (lambda n, o: lambda: PL.list_levels(read(n), o))(name, of)
            listed[f"{name}_bitmaps"] = (lambda n, r, o: lambda: PL.provider_bitmaps(
                read(n), read(f"provider_index_{r}"), o))(name, role, of)

    # in this order: some read what is written before them
    tables = {
        "months": lambda: stats.distinct_values(fact, "month"),
        "states": lambda: stats.distinct_values(fact, "billing_state"),
        "cube_dashboard": lambda: cubes.cube_dashboard(fact),
        **{name: rolled(name) for name in CUBES if name != "cube_dashboard"},
        "cube_paid": lambda: paid_range.cube_paid(fact),
        "top_providers_state_billing": lambda: leaders.top_providers_by_state(fact, lookup, "billing"),
        "top_providers_state_servicing": lambda: leaders.top_providers_by_state(fact, lookup, "servicing"),
        "top_providers_code_billing": lambda: leaders.top_providers_by_code(fact, lookup, "billing"),
        "top_providers_code_servicing": lambda: leaders.top_providers_by_code(fact, lookup, "servicing"),
        "order_paid": lambda: order.counted(fact, order.Key("paid", False)),
        "top_rows": lambda: rows.top_rows(fact, counts=read("order_paid")),
        "provider_totals": lambda: search.provider_totals(fact, lookup),
        "name_grams": lambda: search.name_grams(read("provider_totals")),
        **listed,
        "fact_interleaved": lambda: interleaved(fact, read("provider_index_billing"), read("provider_index_servicing"),
                                                read("states")),
        "sector_leaders": lambda: leaders.sector_leaders(fact, lookup, sectors),
        "provider_index": lambda: providers.provider_index(fact, lookup),
        "meta": lambda: stats.meta(fact),
        "state_coverage": lambda: stats.state_coverage(fact),
        "dash_default": lambda: dashboard.dashboard_long(fact, lookup, descs, sectors=sectors),
        "dash_outliers": lambda: dashboard.dashboard_long(fact, lookup, descs, Filter.exclude_extreme(), sectors=sectors),
        "cube_month_code_indexed": indexed("cube_month_code", month="months", hcpcs="codes"),
        "cube_code_bucket_indexed": indexed("cube_code_bucket", hcpcs="codes"),
        "cube_month_state_indexed": indexed("cube_month_state", month="months", billing_state="states"),
        "cube_state_code_indexed": indexed("cube_state_code", billing_state="states", hcpcs="codes"),
    }
    needs = {**{name: ("cube_dashboard",) for name in CUBES if name != "cube_dashboard"},
             "name_grams": ("provider_totals",), "top_rows": ("order_paid",),
             "fact_interleaved": ("provider_index_billing", "provider_index_servicing", "states")}
    for name in listed:
        base = name.removesuffix("_levels").removesuffix("_bitmaps")
        if name != base:
            needs[name] = (base, f"provider_index_{base.split('_')[-1]}") if name.endswith("_bitmaps") else (base,)
    chosen = set(tables) - set(OPTIONAL) if only is None else {*only, *[n for t in only for n in needs.get(t, ())]}
    timings = {}
    for name, make in tables.items():
        if name in chosen and not table_exists(spark, f"{build}/{name}"):
            t0 = time.time()
            if name in OPTIONAL:
                finish_table(make(), f"{build}/{name}", ["month"], **FACT_OPTIONS)
            else:
                finish_table(make(), f"{build}/{name}")
            timings[name] = time.time() - t0
    if only is None:
        mark(spark, f"{build}/{BAKED}")
    return timings


def build_from_fixture(spark: SparkSession, sf_dir: str, root: str, with_bake: bool = True) -> dict:
    """The whole build with the driver's tables standing in for the raw
    inputs (the fixture views of :mod:`claimscope.sources.fixture`)."""
    return build_fact(spark, fixture.spending_raw(spark, sf_dir), fixture.npi_lookup(spark, sf_dir),
                      root, fixture.code_desc(spark, sf_dir), with_bake=with_bake)

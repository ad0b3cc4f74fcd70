"""Benchmark: build the clustered fact table once, then time the headline queries.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

The build (registry + fact table, like the one-time conversion of the
original tool) is timed once as ``etl_build``, the four cubes as
``etl_cubes``, the tables of searches and pages as ``etl_search``; the sum ``value`` covers the queries only. The queries then run against
the built Parquet tables: one untimed warm-up round over all of them, then
``BENCH_RUNS`` timed rounds (median per query reported). Queries execute fully via the ``noop`` sink, so result size does
not go through the driver. Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time
import uuid

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "dashboard_long",            # one-scan dashboard, no filter
    "dash_filter_month_range",   # month filter: directory pruning
    "dash_filter_codes",         # code filter: row-group pruning on hcpcs_norm
    "dash_filter_paid_range",    # paid-only filter: the full-scan case
    "dash_exclude_extreme",
    "dash_filter_billing_npi",
    "sector_leaders",
    "top_providers_code_billing",
    "top_providers_state_servicing",
    "find_provider",
    "peer_codes",
    "peers",
    "provider_index",
    "rows_page",
    "top_rows",
    "cube_month_code",           # baked cube, read back
    "cubes_monthly",
    "dash_from_cubes",           # month range + codes answered from the cubes alone
    "dash_from_cubes_codes",
    "dataset_stats",
    "meta",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    from claimscope.plans.build import CUBES, SEARCH, bake, build_fact
    from claimscope.plans.inputs import Inputs
    from claimscope.plans.registry import QUERIES
    from claimscope.session import checkpoint_dir, get_spark
    from claimscope.sources import fixture

    spark = get_spark(f"local[{cpus}]", shuffle_partitions=cpus)
    root = f"{checkpoint_dir(spark).rstrip('/')}/bench-{uuid.uuid4().hex[:8]}"

    t0 = time.time()
    build_fact(spark, fixture.spending_raw(spark, sf_dir), fixture.npi_lookup(spark, sf_dir), root,
               fixture.code_desc(spark, sf_dir))
    etl = time.time() - t0
    t0 = time.time()
    bake(spark, root, only=CUBES)
    etl_cubes = time.time() - t0
    t0 = time.time()
    bake(spark, root, only=SEARCH)
    etl_search = time.time() - t0

    inputs = Inputs.from_build(spark, root)
    samples = {name: [] for name in HEADLINE}
    # round 0 warms the JVM over every query; rounds 1..runs are timed,
    # interleaved so no query is favoured by its position
    for rnd in range(runs + 1):
        for name in HEADLINE:
            t0 = time.time()
            QUERIES[name][0](inputs).write.format("noop").mode("overwrite").save()
            if rnd:
                samples[name].append(time.time() - t0)
    times = {name: round(statistics.median(v), 3) for name, v in samples.items()}
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "headline_queries_total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": {"etl_build": round(etl, 3), "etl_cubes": round(etl_cubes, 3),
                    "etl_search": round(etl_search, 3), **times},
        "sf": float(m.group(1)) if m else sf_dir,
        "cpus": cpus,
        "runs": runs,
    }))
    spark.stop()


if __name__ == "__main__":
    main()

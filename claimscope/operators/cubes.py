"""Materialised aggregates (cubes) and the dashboard answered from them.

The four cubes hold exact DECIMAL sums, so any roll-up of a cube under a
filter on its own dimensions equals the same aggregate over the fact: all
four measures are additive.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimscope.functions.expressions import paid_bucket, valid_state
from claimscope.functions.filters import Filter, parse_codes
from claimscope.operators.topk import top_k

CUBE_KEYS = ["month", "hcpcs", "billing_state", "bucket"]
CUBE_MEASURES = ["paid", "patients", "claim_lines", "n"]


def _sums(paid_only: bool = False):
    out = [F.sum("paid").alias("paid")]
    if not paid_only:
        out += [F.sum("patients").alias("patients"), F.sum("claim_lines").alias("claim_lines")]
    return out + [F.count(F.lit(1)).alias("n")]


def cube_month_code(fact: DataFrame) -> DataFrame:
    return (fact.where(F.col("month").isNotNull() & F.col("hcpcs").isNotNull())
                .groupBy("month", "hcpcs").agg(*_sums()))


def cube_code_bucket(fact: DataFrame) -> DataFrame:
    """Per code and log-10 bucket of positive amounts: paid and n only."""
    return (fact.where(F.col("hcpcs").isNotNull() & (F.col("paid") > 0))
                .groupBy("hcpcs", paid_bucket("paid").alias("bucket")).agg(*_sums(True)))


def cube_month_state(fact: DataFrame) -> DataFrame:
    return (fact.where(F.col("month").isNotNull() & valid_state("billing_state"))
                .groupBy("month", "billing_state").agg(*_sums()))


def cube_state_code(fact: DataFrame) -> DataFrame:
    return (fact.where(F.col("hcpcs").isNotNull() & valid_state("billing_state"))
                .groupBy("billing_state", "hcpcs").agg(*_sums()))


def cube_dashboard(fact: DataFrame) -> DataFrame:
    """Per month, code, state and paid bucket, null groups included, so that
    sums over it equal sums over the fact. A group without any amount keeps a
    null sum."""
    return (fact.groupBy("month", "hcpcs", "billing_state", paid_bucket("paid").alias("bucket"))
                .agg(*_sums()))


#: Each cube: its keys, the cells of ``cube_dashboard`` it adds up, its sums.
ROLLED = {
    "cube_month_code": (["month", "hcpcs"], "month is not null and hcpcs is not null", False),
    "cube_code_bucket": (["hcpcs", "bucket"], "hcpcs is not null and bucket is not null", True),
    "cube_month_state": (["month", "billing_state"], "month is not null and length(billing_state) = 2", False),
    "cube_state_code": (["billing_state", "hcpcs"], "hcpcs is not null and length(billing_state) = 2", False),
    "cube_dashboard": (CUBE_KEYS, "true", False),
}
SUM_TYPE = "decimal(28,2)"


def cells(fact: DataFrame, name: str) -> DataFrame:
    """The sums that :func:`rolled` makes the cube ``name`` of, by its own keys only, null
    groups included: they have every value of the keys that the fact has."""
    keys, _, paid_only = ROLLED[name]
    return fact.groupBy(*[paid_bucket("paid").alias(k) if k == "bucket" else F.col(k) for k in keys]).agg(*_sums(paid_only))


def rolled(name: str, dashboard: DataFrame) -> DataFrame:
    """The cube ``name`` from :func:`cube_dashboard`, or from parts of it (one per
    batch of rows, in any split): cells with the same keys are added up. The result
    is that of the cube's own function on all the rows."""
    keys, cells, paid_only = ROLLED[name]
    return _roll(dashboard.where(cells), keys, paid_only).withColumn("paid", F.col("paid").cast(SUM_TYPE))


def merged(name: str, parts: DataFrame) -> DataFrame:
    """Parts of the cube ``name`` itself, of several batches of rows, as one."""
    keys, _, paid_only = ROLLED[name]
    return _roll(parts, keys, paid_only).withColumn("paid", F.col("paid").cast(SUM_TYPE))


def out(cube: DataFrame) -> DataFrame:
    """Output types: money as double."""
    return cube.withColumn("paid", F.col("paid").cast("double"))


def with_index(cube: DataFrame, key: str, index: DataFrame, index_col: str) -> DataFrame:
    """Replace ``key`` by its dense index (``index`` has ``key, idx``)."""
    idx = index.select(F.col(key).alias("_ik"), F.col("idx").alias(index_col))
    j = cube.join(idx, F.col(key) == F.col("_ik"))
    return j.drop("_ik", key)


def _filter_cube(cube: DataFrame, month_from=None, month_to=None, hcpcs=None) -> DataFrame:
    if month_from:
        cube = cube.where(F.col("month") >= month_from)
    if month_to:
        cube = cube.where(F.col("month") <= month_to)
    codes = parse_codes(hcpcs)
    if codes:
        cube = cube.where(F.upper("hcpcs").isin(codes))
    return cube


def _roll(df: DataFrame, keys, paid_only=False) -> DataFrame:
    aggs = [F.sum("paid").alias("paid")]
    if not paid_only:
        aggs += [F.sum("patients").alias("patients"), F.sum("claim_lines").alias("claim_lines")]
    aggs.append(F.sum("n").alias("n"))
    return df.groupBy(*keys).agg(*aggs)


def cubes_summary(cube_mc: DataFrame, month_from=None, month_to=None, hcpcs=None) -> DataFrame:
    """Totals for a month range / code list, from the month × code cube."""
    c = _filter_cube(cube_mc, month_from, month_to, hcpcs)
    r = c.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("rows"),
              F.coalesce(F.sum("paid"), F.lit(0)).cast("double").alias("paid"),
              F.coalesce(F.sum("patients"), F.lit(0)).cast("long").alias("patients"),
              F.coalesce(F.sum("claim_lines"), F.lit(0)).cast("long").alias("claim_lines"),
              F.countDistinct("hcpcs").alias("hcpcs_n"))
    return r


def cubes_monthly(cube_mc: DataFrame, month_from=None, month_to=None, hcpcs=None) -> DataFrame:
    c = _filter_cube(cube_mc, month_from, month_to, hcpcs)
    return out(_roll(c, ["month"])).orderBy("month")


def cubes_top_codes(cube_mc: DataFrame, month_from=None, month_to=None, hcpcs=None,
                    k: int = 12) -> DataFrame:
    c = _roll(_filter_cube(cube_mc, month_from, month_to, hcpcs), ["hcpcs"])
    t = top_k(c.withColumn("paid", F.coalesce("paid", F.lit(0))), k, "paid", "hcpcs")
    return out(t.select("rank", F.col("hcpcs").alias("key"), "paid", "patients",
                        "claim_lines", "n"))


def cubes_hist(cube_cb: DataFrame, hcpcs=None) -> DataFrame:
    """Histogram under a code filter, from the code × bucket cube (it has no
    month, so it answers code filters only)."""
    c = _roll(_filter_cube(cube_cb, hcpcs=hcpcs), ["bucket"], paid_only=True)
    return out(c).orderBy("bucket")


def cubes_dashboard_long(cube: DataFrame, descs: DataFrame, month_from=None, month_to=None,
                         hcpcs=None, k: int = 12, sectors: DataFrame | None = None) -> DataFrame:
    """The dashboard from :func:`cube_dashboard` alone - no fact scan: all
    sections of ``dashboard_long`` but those of billing and servicing
    providers, which the cube does not hold. Same layout and, for the same
    filter, the same rows. One grouping-set pass over the filtered cube.
    """
    from claimscope.operators import dashboard as dash
    flt = Filter(month_from=month_from, month_to=month_to, hcpcs=hcpcs)
    rows = flt.apply(cube)
    a1 = (rows.groupingSets([[]] + [[c] for c in CUBE_KEYS], *CUBE_KEYS)
              .agg(F.grouping_id(*CUBE_KEYS).alias("_g"), F.sum("paid").alias("paid"),
                   F.sum("patients").alias("patients"), F.sum("claim_lines").alias("claim_lines"),
                   F.coalesce(F.sum("n"), F.lit(0)).alias("n")))
    names = {15: "total", 7: "month", 11: "hcpcs", 13: "billing_state", 14: "bucket"}
    gid = F.coalesce(*[F.when(F.col("_g") == g, F.lit(dash.GID[name])) for g, name in names.items()])
    absent = F.lit(None).cast("string")
    a1 = a1.select("month", "hcpcs", absent.alias("billing_npi"), absent.alias("servicing_npi"),
                   "billing_state", "bucket", gid.alias("gid"), "paid", "patients", "claim_lines", "n")
    return dash.sections_long(a1, descs, k, sectors, providers=None)

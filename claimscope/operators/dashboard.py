"""The one-scan dashboard: seven grouping sets over the filtered fact.

``grouping_sets`` computes, in one scan and one shuffle, the total and the
groups by month, code, billing provider, servicing provider, state and
log-scale payment bucket; every dashboard section is a slice of it. The null
key of a real group (e.g. rows with no billing provider) and the rolled-up
null are told apart by the grouping id, never by ``IS NULL``.

The groups (millions at full scale) stay on the executors: each section is a
filter plus a top-k or a small fold over the aggregate, and only those few
rows reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimscope.functions.expressions import measure_sums, money, paid_bucket, zero_if_null
from claimscope.functions.filters import DASHBOARD_SCOPE, NO_FILTER, Filter
from claimscope.functions.sectors import OTHER, classify
from claimscope.session import checkpoint_dir
from claimscope.operators.topk import top_k
from claimscope.sources.joins import attach, with_names

TOP_N = 12

GROUP_COLS = ["month", "hcpcs", "billing_npi", "servicing_npi", "billing_state", "bucket"]
# grouping_id bits: first grouping column is the high bit; a set bit means
# "rolled up". Grand total = all six rolled up.
GID = {"total": 63, "month": 31, "hcpcs": 47, "billing_npi": 55, "servicing_npi": 59,
       "billing_state": 61, "bucket": 62}


def grouping_sets(fact: DataFrame, flt: Filter = NO_FILTER) -> DataFrame:
    """All seven groupings in one aggregate; ``paid`` stays DECIMAL."""
    df = flt.scoped(*DASHBOARD_SCOPE).apply(fact)
    df = df.select("month", "hcpcs", "billing_npi", "servicing_npi", "billing_state",
                   paid_bucket("paid").alias("bucket"), "paid", "patients", "claim_lines")
    sets = [[]] + [[c] for c in GROUP_COLS]
    return (df.groupingSets(sets, *GROUP_COLS)
              .agg(F.grouping_id(*GROUP_COLS).alias("gid"), *measure_sums()))


def grouping_sets_out(a1: DataFrame) -> DataFrame:
    """A1 with output types (money as double)."""
    return a1.select(*GROUP_COLS, F.col("gid").cast("long").alias("gid"),
                     money("paid").alias("paid"), "patients", "claim_lines", "n")


def _rec(key: str | None = None) -> list:
    cols = [] if key is None else [F.col(key).alias("key")]
    return cols + [zero_if_null("paid").alias("paid"),
                   zero_if_null("patients").alias("patients"),
                   zero_if_null("claim_lines").alias("claim_lines"), F.col("n")]


def summary(a1: DataFrame) -> DataFrame:
    """One row: totals plus exact distinct counts of non-null keys."""
    gid = F.col("gid")
    total = gid == GID["total"]
    return a1.agg(
        F.coalesce(F.max(F.when(total, F.col("n"))), F.lit(0)).cast("long").alias("rows"),
        money(F.coalesce(F.max(F.when(total, F.col("paid"))), F.lit(0))).alias("paid"),
        F.coalesce(F.max(F.when(total, F.col("patients"))), F.lit(0)).cast("long").alias("patients"),
        F.coalesce(F.max(F.when(total, F.col("claim_lines"))), F.lit(0)).cast("long")
         .alias("claim_lines"),
        F.count(F.when((gid == GID["hcpcs"]) & F.col("hcpcs").isNotNull(), 1)).alias("hcpcs_n"),
        F.count(F.when((gid == GID["billing_npi"]) & F.col("billing_npi").isNotNull(), 1))
         .alias("billing_n"),
        F.count(F.when((gid == GID["servicing_npi"]) & F.col("servicing_npi").isNotNull(), 1))
         .alias("servicing_n"),
    )


def monthly(a1: DataFrame) -> DataFrame:
    df = a1.where((F.col("gid") == GID["month"]) & F.col("month").isNotNull())
    return df.select("month", *_rec()).withColumn("paid", money("paid")).orderBy("month")


def hist(a1: DataFrame) -> DataFrame:
    """Log-scale histogram; rows with paid ≤ 0 or null have no bucket and
    are not shown; empty buckets are not filled."""
    df = a1.where((F.col("gid") == GID["bucket"]) & F.col("bucket").isNotNull())
    return df.select("bucket", *_rec()).withColumn("paid", money("paid")).orderBy("bucket")


def _group_slice(a1: DataFrame, key: str) -> DataFrame:
    return (a1.where((F.col("gid") == GID[key]) & F.col(key).isNotNull())
              .select(*_rec(key)))


def top_groups(a1: DataFrame, key: str, k: int = TOP_N) -> DataFrame:
    """Top-k keys of one grouping by paid (null sum counted as 0)."""
    t = top_k(_group_slice(a1, key), k, "paid", "key")
    return t.select("rank", "key", money("paid").alias("paid"), "patients", "claim_lines", "n")


def top_codes(a1: DataFrame, descs: DataFrame, k: int = TOP_N,
              materialised: bool = False) -> DataFrame:
    """Top codes with their description (``materialised``: ``a1`` is
    already checkpointed, so the top-k need not be)."""
    return attach(top_groups(a1, "hcpcs", k), descs, [("key", "hcpcs")], ["name"],
                  materialise=not materialised)


def top_providers(a1: DataFrame, lookup: DataFrame, key: str, k: int = TOP_N,
                  materialised: bool = False) -> DataFrame:
    return with_names(top_groups(a1, key, k), lookup, key="key", bounded=True,
                      materialise=not materialised)


def top_sectors(a1: DataFrame, k: int = TOP_N, sectors: DataFrame | None = None) -> DataFrame:
    """Fold the per-code groups into sectors (unclassified codes → Other).

    Runs over the code groups only – one row per distinct code – so codes
    are classified once each, not once per fact row. ``sectors`` is a stored
    code → sector map; without it the codes are classified here."""
    codes = _group_slice(a1, "hcpcs")
    if sectors is None:
        codes = classify(codes, "key", "sector")
    else:
        codes = codes.join(sectors.select(F.col("hcpcs").alias("key"), "sector"), "key", "left")
    by_sector = (codes.groupBy(F.coalesce(F.col("sector"), F.lit(OTHER)).alias("key"))
                      .agg(F.sum("paid").alias("paid"), F.sum("patients").alias("patients"),
                           F.sum("claim_lines").alias("claim_lines")))
    t = top_k(by_sector, k, "paid", "key")
    return t.select("rank", "key", money("paid").alias("paid"), "patients", "claim_lines")


def _materialised(a1: DataFrame) -> DataFrame:
    """Checkpoint the aggregate into the shared checkpoint folder (set from
    the session's ``spark.checkpoint.dir``, or a scratch folder when unset)."""
    checkpoint_dir(a1.sparkSession)
    return a1.checkpoint(eager=True)


def dashboard(fact: DataFrame, lookup: DataFrame, descs: DataFrame,
              flt: Filter = NO_FILTER, k: int = TOP_N,
              sectors: DataFrame | None = None) -> dict:
    """All eight sections as DataFrames sharing one grouping-set aggregate.

    The aggregate (one row per group – never the fact rows) is computed once
    and checkpointed, so the eight small jobs scan the fact once; a lost
    executor does not lose it.
    """
    a1 = _materialised(grouping_sets(fact, flt))
    return {
        "summary": summary(a1),
        "monthly": monthly(a1),
        "top_sectors": top_sectors(a1, k, sectors),
        "top_hcpcs": top_codes(a1, descs, k, materialised=True),
        "top_billing": top_providers(a1, lookup, "billing_npi", k, materialised=True),
        "top_servicing": top_providers(a1, lookup, "servicing_npi", k, materialised=True),
        "top_states": top_groups(a1, "billing_state", k),
        "hist": hist(a1),
    }


LONG_COLUMNS = ["section", "rank", "key", "name", "paid", "patients", "claim_lines", "n"]

# section name → (grouping id, grouping column) of the ranked sections
_TOP_SECTIONS = {"top_hcpcs": (GID["hcpcs"], "hcpcs"),
                 "top_billing": (GID["billing_npi"], "billing_npi"),
                 "top_servicing": (GID["servicing_npi"], "servicing_npi"),
                 "top_states": (GID["billing_state"], "billing_state")}


def _section_of(pairs) -> F.Column:
    expr = None
    for section, (gid, _) in pairs:
        c = F.col("gid") == gid
        expr = F.when(c, F.lit(section)) if expr is None else expr.when(c, F.lit(section))
    return expr


def _key_of(pairs) -> F.Column:
    expr = None
    for _, (gid, col) in pairs:
        c = F.col("gid") == gid
        v = F.col(col).cast("string")
        expr = F.when(c, v) if expr is None else expr.when(c, v)
    return expr


def dashboard_long(fact: DataFrame, lookup: DataFrame, descs: DataFrame,
                   flt: Filter = NO_FILTER, k: int = TOP_N,
                   sectors: DataFrame | None = None) -> DataFrame:
    """The whole dashboard as one DataFrame (one scan of the fact):
    ``section, rank, key, name, paid, patients, claim_lines, n``.

    The grouping-set aggregate is checkpointed (written to the shared
    checkpoint folder) before it is sliced. Without that cut, Catalyst pushes
    each section's ``gid`` filter below the aggregate into the Expand and the
    fact would be scanned once per section. The checkpoint holds one row per
    group (not per fact row) and survives the loss of an executor.

    The slices are then few small plans over the checkpoint: the four top-k
    sections share one ``row_number`` window partitioned by section with a
    ``rank <= k`` cut (a partial WindowGroupLimit before the shuffle, so each
    task ships at most k rows per section); monthly and histogram share one
    positional window (their domains – months, log-10 buckets – are small);
    the totals and distinct counts are one aggregate unpivoted with ``stack``.
    Names are attached to at most 3·k ranked keys.

    ``summary`` carries the totals (rows in ``n``); ``distinct`` the three
    distinct-key counts in ``n``. ``sectors`` is an optional stored code →
    sector map; without it the codes are classified on the fly.
    """
    return sections_long(grouping_sets(fact, flt), descs, k, sectors, providers=lookup)


def sections_long(a1: DataFrame, descs: DataFrame, k: int = TOP_N, sectors: DataFrame | None = None,
                  providers: DataFrame | None = None) -> DataFrame:
    """The long layout of a grouping-set aggregate, which is checkpointed here.
    Without ``providers`` (the registry) the sections and counts of billing and
    servicing providers are left out."""
    a1 = _materialised(a1)
    s = summary(a1)
    totals = s.select(F.expr(
        "stack(4, 'summary', 1L, cast(null as string), paid, patients, claim_lines, rows,"
        " 'distinct', 1L, 'hcpcs', cast(null as double), cast(null as bigint), cast(null as bigint),"
        " hcpcs_n,"
        " 'distinct', 2L, 'billing', cast(null as double), cast(null as bigint), cast(null as bigint),"
        " billing_n,"
        " 'distinct', 3L, 'servicing', cast(null as double), cast(null as bigint),"
        " cast(null as bigint), servicing_n)"
        " as (section, rank, key, paid, patients, claim_lines, n)"))
    if providers is None:
        totals = totals.where((F.col("section") == "summary") | (F.col("key") == "hcpcs"))
    totals = totals.select("section", "rank", "key", F.lit(None).cast("string").alias("name"),
                           "paid", "patients", "claim_lines", "n")

    # monthly + histogram: every row, ranked by position
    pos_pairs = [("monthly", (GID["month"], "month")), ("hist", (GID["bucket"], "bucket"))]
    pos = (a1.where(F.col("gid").isin(GID["month"], GID["bucket"]))
             .select(_section_of(pos_pairs).alias("section"), "month", "bucket",
                     _key_of(pos_pairs).alias("key"), *_rec())
             .where(F.col("key").isNotNull()))
    w = Window.partitionBy("section").orderBy(F.col("bucket").asc(), F.col("month").asc())
    pos = pos.select("section", F.row_number().over(w).cast("long").alias("rank"), "key",
                     F.lit(None).cast("string").alias("name"), money("paid").alias("paid"),
                     "patients", "claim_lines", "n")

    # the four top-k sections in one ranked window
    by_provider = ("top_billing", "top_servicing")
    top_pairs = [(name, v) for name, v in _TOP_SECTIONS.items() if providers is not None or name not in by_provider]
    tops = (a1.where(F.col("gid").isin(*[g for _, (g, _) in top_pairs]))
              .select(_section_of(top_pairs).alias("section"), _key_of(top_pairs).alias("key"),
                      *_rec())
              .where(F.col("key").isNotNull()))
    w = Window.partitionBy("section").orderBy(F.col("paid").desc(), F.col("key").asc())
    tops = (tops.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
                .select("section", F.col("rank").cast("long").alias("rank"), "key",
                        money("paid").alias("paid"), "patients", "claim_lines", "n"))
    names = descs.select(F.lit("code").alias("_kind"), F.col("hcpcs").alias("_nk"), "name")
    if providers is not None:
        names = names.unionByName(providers.select(F.lit("npi").alias("_kind"), F.col("npi").alias("_nk"), "name"))
    tops = tops.withColumn("_kind", F.when(F.col("section") == "top_hcpcs", F.lit("code"))
                                     .when(F.col("section") != "top_states", F.lit("npi")))
    tops = attach(tops, names, [("_kind", "_kind"), ("key", "_nk")], ["name"])
    tops = tops.select("section", "rank", "key", "name", "paid", "patients", "claim_lines", "n")

    ts = top_sectors(a1, k, sectors)
    ts = ts.select(F.lit("top_sectors").alias("section"), "rank", "key",
                   F.lit(None).cast("string").alias("name"), "paid", "patients", "claim_lines",
                   F.lit(None).cast("long").alias("n"))
    return totals.unionByName(pos).unionByName(ts).unionByName(tops)

"""Dataset statistics, distinct value lists and the sector tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimscope.functions.expressions import money, valid_state
from claimscope.functions.sectors import classify, code_sectors
from claimscope.operators.topk import dense_index


def _key_counts(fact: DataFrame, keys: dict) -> DataFrame:
    """One aggregate over grouping sets ``()`` and ``(k)`` for each key:
    rows, total paid, and per key the number of non-null groups, min and max.

    Exact distinct counts without Spark's multi-distinct rewrite (which
    expands every row once per distinct column before any map-side
    combining): each grouping set is partially aggregated per key before the
    shuffle, so only one row per (task, key value) is shipped. Measured about
    1.7x faster than ``count(DISTINCT …)`` ×5 at sf0.1.
    """
    names = list(keys)
    df = fact.select(*[c.alias(n) for n, c in keys.items()], "paid")
    g = df.groupingSets([[]] + [[n] for n in names], *names).agg(
        F.grouping_id(*names).alias("_gid"), F.count(F.lit(1)).alias("_n"),
        F.sum("paid").alias("_p"))
    full = (1 << len(names)) - 1
    aggs = [F.coalesce(F.max(F.when(F.col("_gid") == full, F.col("_n"))), F.lit(0))
             .cast("long").alias("rows"),
            money(F.max(F.when(F.col("_gid") == full, F.col("_p")))).alias("total_paid")]
    for pos, n in enumerate(names):
        only = F.col("_gid") == full - (1 << (len(names) - 1 - pos))
        aggs += [F.count(F.when(only & F.col(n).isNotNull(), 1)).alias(f"_{n}_count"),
                 F.min(F.when(only, F.col(n))).alias(f"_{n}_min"),
                 F.max(F.when(only, F.col(n))).alias(f"_{n}_max")]
    return g.agg(*aggs)


def dataset_stats(fact: DataFrame) -> DataFrame:
    """Rows, exact distinct codes / billing / servicing providers (nulls not
    counted) and total paid, in one grouping-set aggregate."""
    k = _key_counts(fact, {"hcpcs": F.col("hcpcs"), "billing_npi": F.col("billing_npi"),
                           "servicing_npi": F.col("servicing_npi")})
    return k.select("rows", F.col("_hcpcs_count").alias("hcpcs_count"),
                    F.col("_billing_npi_count").alias("billing_npis"),
                    F.col("_servicing_npi_count").alias("servicing_npis"), "total_paid")


def distinct_values(fact: DataFrame, col: str, index_col: str = "idx") -> DataFrame:
    """Sorted non-null distinct values of ``col`` with their 0-based dense
    index; for the state column only two-letter states."""
    df = fact.select(col)
    if col == "billing_state":
        df = df.where(valid_state(col))
    return dense_index(df, col, index_col)


def state_coverage(fact: DataFrame) -> DataFrame:
    """Share of rows with a billing state, in % rounded half-up to one
    decimal; computed in integers so it is exact."""
    c = fact.agg(F.count("billing_state").alias("with_state"), F.count(F.lit(1)).alias("rows"))
    pct = F.expr("(2000 * with_state + rows) div (2 * rows)") / F.lit(10.0)
    return c.select("with_state", "rows", pct.alias("pct"))


def sector_map(fact: DataFrame) -> DataFrame:
    """``hcpcs → sector`` for every distinct classified code (raw code as key;
    unclassified codes are left out)."""
    return code_sectors(fact, "hcpcs")


def sector_code_counts(fact: DataFrame) -> DataFrame:
    """Distinct codes per sector (null sector = unclassified)."""
    codes = fact.select("hcpcs").where(F.col("hcpcs").isNotNull()).distinct()
    return (classify(codes, "hcpcs", "sector")
                 .groupBy("sector").agg(F.count(F.lit(1)).alias("codes")))


def meta(fact: DataFrame) -> DataFrame:
    """One row: the dataset statistics plus the size and span of the month,
    code and state lists, in a single grouping-set aggregate."""
    k = _key_counts(fact, {"hcpcs": F.col("hcpcs"), "billing_npi": F.col("billing_npi"),
                           "servicing_npi": F.col("servicing_npi"), "month": F.col("month"),
                           "st": F.when(valid_state("billing_state"), F.col("billing_state"))})
    return k.select("rows", F.col("_hcpcs_count").alias("hcpcs_count"),
                    F.col("_billing_npi_count").alias("billing_npis"),
                    F.col("_servicing_npi_count").alias("servicing_npis"), "total_paid",
                    F.col("_month_min").alias("first_month"),
                    F.col("_month_max").alias("last_month"),
                    F.col("_month_count").alias("months"), F.col("_st_count").alias("states"))

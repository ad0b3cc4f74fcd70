"""Top providers per group: per sector (leaders), per state and per code.

One parametrised plan: filter → two-stage hash aggregate on (group, provider)
→ ``row_number() <= k`` per group (partial WindowGroupLimit before the
shuffle) → registered names. The name join runs after the cut, on at most
k rows per group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimscope.functions.expressions import money, round2, valid_state
from claimscope.functions.filters import LEADERS_SCOPE, NO_FILTER, Filter
from claimscope.operators.topk import top_k_per_group
from claimscope.sources.joins import with_names


def top_providers_per_group(df: DataFrame, group: str, npi_col: str, k: int,
                            lookup: DataFrame) -> DataFrame:
    """``group, npi, paid, patients, claim_lines, rk, name`` for the top k
    providers (by the unrounded paid sum, then npi) of every group."""
    g = (df.groupBy(F.col(group), F.col(npi_col).alias("npi"))
           .agg(F.sum("paid").alias("_p"), F.sum("patients").alias("patients"),
                F.sum("claim_lines").alias("claim_lines")))
    ranked = top_k_per_group(g, group, k, "_p", "npi")
    ranked = ranked.select(group, "npi", money(round2("_p")).alias("paid"), "patients",
                           "claim_lines", "rk")
    return with_names(ranked, lookup, key="npi")


def sector_leaders(fact: DataFrame, lookup: DataFrame, sectors: DataFrame,
                   flt: Filter = NO_FILTER, k: int = 8) -> DataFrame:
    """Top billing providers of every sector under the filter.

    ``sectors`` is the code → sector map (one row per classified code, see
    ``code_sectors``). The fact is first aggregated by (code, provider); that
    meets the map and folds to (sector, provider), so the plan is right
    whatever size the map has. The inner join on the raw code drops
    unclassified codes; rows need a billing provider.
    """
    df = flt.scoped(*LEADERS_SCOPE).apply(fact)
    by_code = (df.where(F.col("billing_npi").isNotNull() & F.col("hcpcs").isNotNull())
                 .groupBy("hcpcs", "billing_npi")
                 .agg(F.sum("paid").alias("paid"), F.sum("patients").alias("patients"),
                      F.sum("claim_lines").alias("claim_lines")))
    named = by_code.join(sectors.select("hcpcs", "sector"), "hcpcs")
    out = top_providers_per_group(named, "sector", "billing_npi", k, lookup)
    return out.orderBy("sector", F.col("paid").desc_nulls_last(), "rk")


def top_providers_by_state(fact: DataFrame, lookup: DataFrame, role: str = "billing",
                           k: int = 12) -> DataFrame:
    """Top providers per (two-letter) billing state. ``role='servicing'``
    ranks servicing providers within the billing provider's state."""
    npi_col = f"{role}_npi"
    df = fact.where(valid_state("billing_state") & F.col(npi_col).isNotNull())
    return top_providers_per_group(df, "billing_state", npi_col, k, lookup)


def top_providers_by_code(fact: DataFrame, lookup: DataFrame, role: str = "billing",
                          k: int = 12) -> DataFrame:
    """Top providers per billing code (raw code, case-sensitive)."""
    npi_col = f"{role}_npi"
    df = fact.where(F.col("hcpcs").isNotNull() & F.col(npi_col).isNotNull())
    return top_providers_per_group(df, "hcpcs", npi_col, k, lookup)

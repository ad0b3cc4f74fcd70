"""Provider-centred queries: name search, peer comparison, provider index."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimscope.functions.expressions import money, round2
from claimscope.functions.filters import NO_FILTER, PEERS_SCOPE, Filter
from claimscope.operators.search import matches, ranked, wanted
from claimscope.operators.topk import top_k_per_group
from claimscope.sources.joins import attach, with_names


def find_provider(fact: DataFrame, lookup: DataFrame, name: str, k: int = 10) -> DataFrame:
    """Registered providers whose name contains ``name`` (case-insensitive;
    ``%`` and ``_`` act as wildcards, a backslash stands for itself), with
    their billed totals: the top ``k`` by paid of all that match.

    The fact is aggregated to one row per billing provider first, so the join
    with the matches is small on both sides whatever their number;
    :func:`claimscope.operators.search.find_stored` does without the fact. Matches
    that bill nothing drop out. Returns ``npi, name, state, paid``.
    """
    found = matches(lookup.select("npi", "name", "state"), wanted(name))
    totals = (fact.where(F.col("billing_npi").isNotNull())
                  .groupBy(F.col("billing_npi").alias("_billed")).agg(F.sum("paid").alias("paid")))
    return ranked(found.join(totals, F.col("npi") == F.col("_billed")), k)


def _subject(npi: str) -> str:
    v = (npi or "").strip()
    if not v:
        raise ValueError("missing npi")
    return v


def peer_codes(fact: DataFrame, descs: DataFrame, npi: str, flt: Filter = NO_FILTER,
               k: int = 8) -> DataFrame:
    """The subject's top ``k`` codes by (rounded) paid under the scope filter:
    ``rank, code, description, paid``."""
    subject = _subject(npi)
    df = flt.scoped(*PEERS_SCOPE).apply(fact)
    df = df.where((F.col("billing_npi") == subject) & F.col("hcpcs").isNotNull())
    g = df.groupBy("hcpcs").agg(round2(F.sum("paid")).alias("paid"))
    top = (g.orderBy(F.col("paid").desc_nulls_last(), F.col("hcpcs").asc()).limit(k)
             .withColumn("rank", F.row_number().over(
                 Window.orderBy(F.col("paid").desc_nulls_last(), F.col("hcpcs").asc())).cast("long")))
    d = descs.select("hcpcs", F.col("name").alias("description"))
    j = attach(top, d, [("hcpcs", "hcpcs")], ["description"])
    return j.select("rank", F.col("hcpcs").alias("code"), "description", money("paid").alias("paid"))


def peers(fact: DataFrame, lookup: DataFrame, npi: str, flt: Filter = NO_FILTER,
          codes: int = 8, k: int = 12) -> DataFrame:
    """Billing providers of the subject's top codes, ranked by paid on them.

    Eager in part: the subject's top codes (at most ``codes`` values) are
    looked up first, so the second scan gets them as literals and prunes. The
    subject is ranked like anyone else and may be absent. Returns ``rank, npi,
    name, paid, patients, claim_lines, codes``.
    """
    g = peer_totals(fact, npi, flt, codes)
    order = [F.col("paid").desc_nulls_last(), F.col("npi").asc()]
    top = g.orderBy(*order).limit(k).withColumn(
        "rank", F.row_number().over(Window.orderBy(*order)).cast("long"))
    top = top.select("rank", "npi", money("paid").alias("paid"), "patients", "claim_lines", "codes")
    return with_names(top, lookup, key="npi", bounded=True)


def peer_totals(fact: DataFrame, npi: str, flt: Filter = NO_FILTER, codes: int = 8) -> DataFrame:
    """Every billing provider's totals on the subject's top codes (before the
    top-k cut): ``npi, paid, patients, claim_lines, codes``."""
    subject = _subject(npi)
    scoped = flt.scoped(*PEERS_SCOPE).apply(fact)
    top_codes = (scoped.where((F.col("billing_npi") == subject) & F.col("hcpcs").isNotNull())
                       .groupBy("hcpcs").agg(round2(F.sum("paid")).alias("_p"))
                       .orderBy(F.col("_p").desc_nulls_last(), F.col("hcpcs").asc())
                       .limit(codes).select("hcpcs"))
    named = [r.hcpcs for r in top_codes.collect()]
    rows = scoped.where(F.col("billing_npi").isNotNull() & F.col("hcpcs").isin(named))
    if "hcpcs_norm" in scoped.columns:  # the column the table is clustered by
        rows = rows.where(F.col("hcpcs_norm").isin(sorted({c.upper() for c in named})))
    return rows.groupBy(F.col("billing_npi").alias("npi")).agg(
        round2(F.sum("paid")).alias("paid"), F.sum("patients").alias("patients"),
        F.sum("claim_lines").alias("claim_lines"), F.countDistinct("hcpcs").alias("codes"))


def peer_subject(lookup: DataFrame, npi: str) -> DataFrame:
    """``npi, name`` of the subject (name null when not registered)."""
    subject = _subject(npi)
    # a global aggregate always yields exactly one row; the npi filter is
    # pushed into the registry scan
    return lookup.where(F.col("npi") == subject).agg(
        F.lit(subject).alias("npi"), F.max("name").alias("name"))


def provider_index(fact: DataFrame, lookup: DataFrame, min_total: str = "1000000",
                   k: int = 8) -> DataFrame:
    """Providers billing at least ``min_total`` over coded rows, with their
    top ``k`` codes.

    One aggregate on (provider, code), then one shuffle on the provider
    serves both the provider total (a window sum) and the code ranking; a
    provider holds at most one row per distinct code there. Returns ``npi,
    name, state, total, codes`` (array, best first; null sums last) ``,
    paid_on_codes`` ordered by total descending.
    """
    t = (fact.where(F.col("billing_npi").isNotNull() & F.col("hcpcs").isNotNull())
             .groupBy(F.col("billing_npi").alias("npi"), "hcpcs")
             .agg(F.sum("paid").alias("p")))
    t = t.withColumn("_total", F.sum("p").over(Window.partitionBy("npi")))
    t = t.where(F.col("_total") >= F.lit(min_total).cast("decimal(18,2)"))
    ranked = top_k_per_group(t, "npi", k, "p", "hcpcs")
    per = ranked.groupBy("npi").agg(
        F.max("_total").alias("_total"),
        F.sort_array(F.collect_list(F.struct("rk", "hcpcs"))).alias("_codes"),
        F.sum("p").alias("_poc"))
    per = per.select("npi", money(round2("_total")).alias("total"),
                     F.transform("_codes", lambda x: x["hcpcs"]).alias("codes"),
                     money(round2("_poc")).alias("paid_on_codes"))
    names = lookup.select(F.col("npi").alias("_nk"), F.col("name").alias("_nm"),
                          F.col("state").alias("_ns"))
    j = per.join(names, F.col("npi") == F.col("_nk"), "left")
    return (j.select("npi", F.col("_nm").alias("name"), F.col("_ns").alias("state"), "total",
                     "codes", "paid_on_codes")
             .orderBy(F.col("total").desc(), F.col("npi").asc()))

"""The dashboard's provider sections from stored lists and bitmaps, without the fact.

Top providers under a month range (and codes) come from lists, one per month (or
code and month), of providers with their sums, best first, by the threshold
algorithm: the heads of the lists are read to a common depth; every provider met
there gets its exact total; a provider met in no head has at most the sum of the
values at which the heads end. Once the k-th total is above that, the top k is
known; else the heads get longer.

Distinct providers are counted from bitmaps over their dense index, one set per
month (or code and month), joined by OR. A bitmap is kept as words of 64 providers,
those without any left out: a list has no more words than entries, however few of all
providers it holds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimscope.functions.expressions import money
from claimscope.functions.filters import Filter, parse_codes
from claimscope.operators import order
from claimscope.operators.topk import dense_index
from claimscope.sources.joins import with_names

ROLES = ("billing", "servicing")
MEASURES = ["paid", "patients", "claim_lines", "n"]
#: How far below the k-th entry the heads first end, and how much longer they get.
DEPTH, LONGER = 8, 8
#: What a list is of: all rows of a month, or those of a (normalised) code or of a part
#: of the amounts (see ``paid_range``) in it.
LISTS = {"month": ["month"], "code": ["hcpcs_norm", "month"], "paid": ["month", "part"]}


def provider_list(fact: DataFrame, role: str, of: Sequence[str] = ("month",)) -> DataFrame:
    """``*of, npi, paid, patients, claim_lines, n``: the sums of each provider in each
    list (null sums count as 0), laid out by list, best first."""
    npi = F.col(f"{role}_npi")
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    if "hcpcs_norm" in of:
        fact = fact.withColumn("hcpcs_norm", F.upper("hcpcs"))
    sums = (fact.where(npi.isNotNull()).groupBy(*of, npi.alias("npi"))
                .agg(zero("paid").cast("decimal(28,2)").alias("paid"), zero("patients").cast("long").alias("patients"),
                     zero("claim_lines").cast("long").alias("claim_lines"), F.count(F.lit(1)).alias("n")))
    by = [*[F.col(c) for c in of], F.col("paid").desc(), F.col("npi")]
    return sums.repartitionByRange(*by).sortWithinPartitions(*by)


def list_levels(lists: DataFrame, of: Sequence[str] = ("month",)) -> DataFrame:
    """``*of, n, least``: the entries of each list counted per value range; a few
    thousand ranges a list."""
    level = order.coarse(lists, "paid")
    return (lists.groupBy(*of, level.alias("_level")).agg(F.count(F.lit(1)).alias("n"), F.min("paid").alias("least"))
                 .drop("_level"))


def near_heads(levels: DataFrame, of: Sequence[str], depth: int) -> DataFrame:
    """Of each list the ranges that its first ``depth`` entries lie in and the next one:
    what :func:`heads` looks at, so that no more reaches the driver."""
    down = Window.partitionBy(*of).orderBy(F.col("least").desc())
    before = F.coalesce(F.sum("n").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return (levels.withColumn("_in", before < depth).withColumn("_last_in", F.lag("_in", 1, True).over(down))
                  .where("_in or _last_in").drop("_in", "_last_in"))


def in_lists(table: DataFrame, flt: Filter) -> DataFrame:
    """The rows of a list or bitmap table under the filter's months and codes."""
    return flt.scoped("month_from", "month_to", "hcpcs").apply(table)


def heads(levels: list, depth: int) -> tuple[list, object, bool]:
    """``levels`` rows (list key, n, least) → where each list's head of ``depth``
    entries or more ends, the most that a provider in no head can have, and whether
    the heads are the whole lists."""
    by: dict = {}
    for key, n, least in levels:
        by.setdefault(key, []).append((least, n))
    ends, most, whole = [], 0, True
    for key, ranges in by.items():
        ranges.sort(key=lambda r: r[0], reverse=True)
        seen, at = 0, 0
        while at < len(ranges) and seen < depth:
            seen += ranges[at][1]
            at += 1
        ends.append((key, ranges[at - 1][0]))
        if at < len(ranges):
            whole = False
            most += max(ranges[at - 1][0], 0)
    return ends, most, whole


def top_listed(lists: DataFrame, levels: DataFrame, flt: Filter, k: int = 12, of: Sequence[str] = ("month",)) -> DataFrame:
    """``rank, key, paid, patients, claim_lines, n``: the top ``k`` providers over the
    lists under the filter, ties to smaller npis. Eager: the rounds end with ``k`` rows."""
    spark, of = lists.sparkSession, list(of)
    entries = in_lists(lists, flt)
    levels, depth = in_lists(levels, flt).select(*of, "n", "least"), DEPTH * k
    types = [f"_{c} {entries.schema[c].dataType.simpleString()}" for c in of]
    ranked = [F.col("paid").desc(), F.col("npi").asc()]
    schema = "rank long, key string, paid decimal(38,2), patients long, claim_lines long, n long"
    while True:
        counted = [(tuple(r[c] for c in of), r.n, r.least) for r in near_heads(levels, of, depth).collect()]
        ends, most, whole = heads(counted, depth)
        if not ends:
            return spark.createDataFrame([], schema)
        # a row per list
        bounds = spark.createDataFrame([(*key, least) for key, least in ends], ", ".join([*types, "_least decimal(28,2)"]))
        same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in of]
        met = entries.where(F.col("paid") >= min(least for _, least in ends)).join(
            F.broadcast(bounds), [*same, F.col("paid") >= F.col("_least")]).select("npi").distinct()
        totals = entries.join(met, "npi", "left_semi").groupBy("npi").agg(*[F.sum(c).alias(c) for c in MEASURES])
        best = totals.orderBy(*ranked).limit(k).collect()
        if whole or (len(best) == k and best[-1].paid > most):
            best.sort(key=lambda r: (-r.paid, r.npi))
            return spark.createDataFrame([(i + 1, r.npi, *[r[c] for c in MEASURES]) for i, r in enumerate(best)], schema)
        depth *= LONGER


def provider_index_table(fact: DataFrame, role: str) -> DataFrame:
    """``npi, idx``: the dense index of the role's providers."""
    return dense_index(fact.select(F.col(f"{role}_npi").alias("npi")), "npi")


def provider_bitmaps(lists: DataFrame, index: DataFrame, of: Sequence[str] = ("month",)) -> DataFrame:
    """``*of, bucket, bits``: the providers of each list as bitmaps of their index, in
    words of 64."""
    return (lists.select(*of, "npi").join(index, "npi")
                 .groupBy(*of, F.shiftright("idx", 6).alias("bucket"))
                 .agg(F.bit_or(F.expr("shiftleft(1L, cast(idx & 63 as int))")).alias("bits"))
                 .repartitionByRange(*of, "bucket").sortWithinPartitions(*of, "bucket"))


def distinct_listed(bitmaps: DataFrame, flt: Filter) -> DataFrame:
    """One row ``n``: the distinct providers of the lists under the filter."""
    every = in_lists(bitmaps, flt).groupBy("bucket").agg(F.bit_or("bits").alias("bits"))
    return every.agg(F.coalesce(F.sum(F.bit_count("bits")), F.lit(0)).cast("long").alias("n"))


def kind_of(flt: Filter) -> str:
    """Which lists answer a filter: those of codes if it names any."""
    return "code" if parse_codes(flt.hcpcs) else "month"


def tables(flt: Filter) -> list[str]:
    """The stored tables that :func:`provider_sections` reads."""
    kind = kind_of(flt)
    of_each = ("", "_bitmaps") if kind == "code" else ("", "_levels", "_bitmaps")
    return [f"provider_{kind}_{role}{part}" for role in ROLES for part in of_each]


def provider_sections(stored, lookup: DataFrame, flt: Filter, k: int = 12) -> DataFrame:
    """The sections ``top_billing`` and ``top_servicing`` and the counts of distinct
    providers, in the layout of ``dashboard_long``. ``stored`` gives a baked table by
    its name; the filter may have months and codes."""
    kind = kind_of(flt)
    of, out = LISTS[kind], None
    for at, role in enumerate(ROLES):
        lists = stored(f"provider_{kind}_{role}")
        levels = list_levels(in_lists(lists, flt), of) if kind == "code" else stored(f"provider_{kind}_{role}_levels")
        both = provider_section(role, at, lists, levels, stored(f"provider_{kind}_{role}_bitmaps"), lookup, flt, k, of)
        out = both if out is None else out.unionByName(both)
    return out


def provider_section(role: str, at: int, lists: DataFrame, levels: DataFrame, bitmaps: DataFrame, lookup: DataFrame,
                     flt: Filter, k: int, of: Sequence[str]) -> DataFrame:
    """The ranking of a role (the ``at``-th of ``ROLES``) and its count of distinct
    providers over the lists under the filter."""
    top = with_names(top_listed(lists, levels, flt, k, of), lookup, key="key", bounded=True, materialise=False)
    top = top.select(F.lit(f"top_{role}").alias("section"), "rank", "key", "name", money("paid").alias("paid"),
                     "patients", "claim_lines", "n")
    n = distinct_listed(bitmaps, flt)
    n = n.select(F.lit("distinct").alias("section"), F.lit(at + 2).cast("long").alias("rank"), F.lit(role).alias("key"),
                 F.lit(None).cast("string").alias("name"), F.lit(None).cast("double").alias("paid"),
                 F.lit(None).cast("long").alias("patients"), F.lit(None).cast("long").alias("claim_lines"), "n")
    return top.unionByName(n)

"""Provider search by trigrams of the names, on tables stored with a build.

``provider_totals`` has a row per registered provider that bills, with its total;
``name_grams`` has a row per provider and three consecutive characters of its
lower-cased name, laid out by them. A search looks up the trigrams of what it is
given, keeps the providers that have all of them and compares their names with the
pattern itself; the fact is not read. A pattern without three plain characters in a
row compares the names of all providers instead.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimscope.functions.expressions import money, round2

SIZE = 3


def provider_totals(fact: DataFrame, lookup: DataFrame) -> DataFrame:
    """``npi, name, state, paid`` of every registered provider that bills."""
    totals = (fact.where(F.col("billing_npi").isNotNull())
                  .groupBy(F.col("billing_npi").alias("npi")).agg(F.sum("paid").alias("paid")))
    named = totals.join(lookup.select("npi", "name", "state"), "npi").select("npi", "name", "state", "paid")
    return named.repartitionByRange("npi").sortWithinPartitions("npi")


def name_grams(totals: DataFrame) -> DataFrame:
    """``gram, npi``: the distinct trigrams of each name."""
    name = F.lower("name")
    starts = F.sequence(F.lit(1), F.length(name) - (SIZE - 1))
    grams = F.array_distinct(F.transform(starts, lambda i: F.substring(name, i, F.lit(SIZE))))
    found = totals.where(F.length(name) >= SIZE).select(F.explode(grams).alias("gram"), "npi")
    # the provider is part of the range key, so a common trigram is spread
    return found.repartitionByRange("gram", "npi").sortWithinPartitions("gram", "npi")


def grams_of(pattern: str) -> list[str]:
    """The trigrams that a name must have to match: those of the runs between
    wildcards. Characters whose lower case could differ between systems cut a run."""
    out = set()
    for run in re.findall(r"[\x00-\x7f]+", re.sub("[%_]", "\u0080", pattern)):
        out |= {run[i:i + SIZE].lower() for i in range(len(run) - SIZE + 1)}
    return sorted(out)


def wanted(name: str | None) -> str:
    """What is searched for; at least three characters."""
    text = (name or "").strip()
    if len(text) < 3:
        raise ValueError("need at least 3 characters")
    return text


def matches(names: DataFrame, text: str) -> DataFrame:
    """The rows whose ``name`` contains ``text`` (case-insensitive; ``%`` and ``_``
    act as wildcards, a backslash stands for itself)."""
    escaped = text.replace("\\", "\\\\")
    return names.where(F.col("name").ilike(f"%{escaped}%"))


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The top ``k`` by paid: ``npi, name, state, paid``."""
    return (found.withColumn("paid", round2("paid")).orderBy(F.col("paid").desc_nulls_last(), F.col("npi").asc())
                 .limit(k).select("npi", "name", "state", money("paid").alias("paid")))


def find_stored(totals: DataFrame, grams: DataFrame, name: str, k: int = 10) -> DataFrame:
    """:func:`claimscope.operators.providers.find_provider` from the stored tables."""
    text = wanted(name)
    need = grams_of(text)
    if need:
        have = grams.where(F.col("gram").isin(need)).groupBy("npi").agg(F.count(F.lit(1)).alias("_n"))
        totals = totals.join(have.where(F.col("_n") == len(need)).select("npi"), "npi", "left_semi")
    return ranked(matches(totals, text), k)

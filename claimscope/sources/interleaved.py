"""A second layout of the fact, for filters that name no code.

The fact is in order of month and code. A filter on a provider, a state or an amount
prunes little there. The interleaved copy is in order of month and of one number that
has the bits of the four ranks by turns (billing provider, servicing provider, state,
amount): rows near each other are near in every column, so the minima and maxima of a
row group are narrow in all four. Months prune folders in both.

A rank is the number of cut points up to a value. Cut points of providers and states
come from their dense indexes, of amounts from percentiles; there are ``2^bits - 1`` of
each, whatever the size of the data, and they are literals of the plan: no join. They
decide where rows lie, never which rows an answer has.

Defined cases: null has rank 0; a column without values has no cut points and rank 0
throughout; an empty fact gives an empty table; equal rows stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimscope.functions.filters import Filter
from claimscope.schema import MONEY

#: Bits of a rank.
BITS = 6
COLUMNS = ("billing_npi", "servicing_npi", "billing_state", "paid")


def index_cuts(index: DataFrame, key: str, bits: int = BITS) -> list:
    """Cut points at equal distances in a dense index (``key, idx``); values repeat
    where there are fewer values than cut points."""
    most = index.agg(F.max("idx")).first()[0]
    if most is None:
        return []
    places = [j * (most + 1) >> bits for j in range(1, 1 << bits)]
    at = {r.idx: r[key] for r in index.where(F.col("idx").isin(sorted(set(places)))).collect()}
    return [at[p] for p in places]


def amount_cuts(fact: DataFrame, bits: int = BITS) -> list:
    """Cut points of the amounts with about as many rows between each two."""
    parts = [j / (1 << bits) for j in range(1, 1 << bits)]
    return fact.agg(F.percentile_approx("paid", parts)).first()[0] or []


def rank(value: Column, cuts: list, kind: str, bits: int = BITS) -> Column:
    """The number of cut points up to ``value``, found by halving."""
    if not cuts:
        return F.lit(0)
    table = F.array(*[F.lit(c).cast(kind) for c in cuts])
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(bits))])
    return F.aggregate(steps, F.lit(0), lambda at, step:
                       at + F.when(F.element_at(table, at + step) <= value, step).otherwise(F.lit(0)))


def interleave(ranks: list[str], bits: int = BITS) -> Column:
    """The bits of the rank columns by turns, highest first."""
    out = F.lit(0).cast("long")
    for b in range(bits):
        for d, name in enumerate(reversed(ranks)):
            bit = F.shiftright(F.col(name), b).bitwiseAND(F.lit(1)).cast("long")
            out = out + F.shiftleft(bit, b * len(ranks) + d)
    return out


def interleaved(fact: DataFrame, billing: DataFrame, servicing: DataFrame, states: DataFrame) -> DataFrame:
    """The rows of the fact laid out by (month, interleaved ranks). ``billing``,
    ``servicing`` and ``states`` are the dense indexes of the three columns. The other
    sort columns spread rows of one rank, as those of a heavy provider, over partitions."""
    cuts = dict(zip(COLUMNS, (index_cuts(billing, billing.columns[0]), index_cuts(servicing, servicing.columns[0]),
                              index_cuts(states, states.columns[0]), amount_cuts(fact))))
    kinds = {c: "string" for c in COLUMNS} | {"paid": MONEY.simpleString()}
    names = [f"_rank{i}" for i in range(len(COLUMNS))]
    ranked = fact.select("*", *[rank(F.col(c), cuts[c], kinds[c]).alias(n) for c, n in zip(COLUMNS, names)])
    key = ["month", "_at", "billing_npi", "servicing_npi", "hcpcs_norm", "paid"]
    placed = ranked.withColumn("_at", interleave(names))
    return placed.repartitionByRange(*key).sortWithinPartitions(*key).select(*fact.columns)


def helps(flt: Filter) -> bool:
    """A filter that the interleaved copy prunes better than the order by code: it names
    a provider, a state or an amount, and no code."""
    rest = flt.scoped("billing_npi", "servicing_npi", "state", "paid_min", "paid_max")
    return flt.scoped("hcpcs").is_empty() and not rest.is_empty()

"""The dashboard under a range of amounts, from stored cells and the rows of cut ones.

Amounts fall into parts: one for each log-10 bucket of positive amounts, one below
these for zero and negative ones, null for null. The part never falls while the amount
rises. So under a range every part strictly between those of its two ends lies wholly
inside it, whatever rounding the logarithm has, and only the one or two parts that hold
an end are cut. Whole parts come from the cube and the provider lists of a build; the
rows of cut parts are read from the fact, once, under a range that the scan can use.
"""

from __future__ import annotations

import functools
import math
import operator
from decimal import ROUND_CEILING, ROUND_FLOOR, Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimscope.functions.expressions import col, measure_sums, paid_bucket
from claimscope.functions.filters import Filter, amount_bound
from claimscope.operators import cubes
from claimscope.operators import provider_lists as PL
from claimscope.session import checkpoint_dir

#: The part of zero and negative amounts: 0.01, the least positive one, is in -2.
NOT_POSITIVE = -3
#: Amounts this near to a power of ten may fall on its other side in doubles.
SLACK = Decimal("1e-12")
PART_KEYS = ["month", "hcpcs", "billing_state", "part"]
#: What the filter may have besides the amounts.
SCOPE = ("month_from", "month_to", "paid_min", "paid_max")
# one grouping set for the cells and one per provider role, over the cut rows
CUT_COLS = ["month", "part", "hcpcs", "billing_state", "billing_npi", "servicing_npi"]
CUT_SETS = [["month", "part", "hcpcs", "billing_state"], ["month", "part", "billing_npi"], ["month", "part", "servicing_npi"]]
CUT_GID = {"cells": 0b000011, "billing": 0b001101, "servicing": 0b001110}
LIST = PL.LISTS["paid"]


def part(paid: Column | str = "paid") -> Column:
    p = col(paid)
    return F.when(p <= 0, F.lit(NOT_POSITIVE)).otherwise(paid_bucket(p))


def cube_paid(fact: DataFrame) -> DataFrame:
    """Sums per month, code, state and part, null groups included."""
    return fact.groupBy("month", "hcpcs", "billing_state", part().alias("part")).agg(*measure_sums())


def answers(flt: Filter) -> bool:
    """Whether the filter is one of amounts, and of months at most besides, so that
    :func:`dashboard_long` can answer it."""
    ends = [v for v in (flt.paid_min, flt.paid_max) if v not in (None, "")]
    rest = flt.scoped(*[n for n in vars(flt) if n not in SCOPE])
    return bool(ends) and rest.is_empty() and all(math.isfinite(float(v)) for v in ends)


def cut_parts(spark, flt: Filter) -> tuple[int | None, int | None]:
    """The parts that the two ends of the range lie in; None where it is open."""
    ends = [None if v in (None, "") else amount_bound(v, r)
            for v, r in ((flt.paid_min, ROUND_CEILING), (flt.paid_max, ROUND_FLOOR))]
    one = spark.createDataFrame([(0,)], "x int")
    return tuple(one.select(*[F.lit(None).cast("int") if e is None else part(e) for e in ends]).first())


def whole(cuts: tuple[int | None, int | None]) -> Column:
    """The parts that lie inside the range as a whole."""
    low, high = cuts
    p = F.col("part")
    return functools.reduce(operator.and_, [p.isNotNull(), *([] if low is None else [p > low]), *([] if high is None else [p < high])])


def _edges(p: int) -> Column:
    """A range of amounts that holds all of the part ``p``."""
    if p == NOT_POSITIVE:
        return F.col("paid") <= F.lit(Decimal("0.00")).cast("decimal(18,2)")
    cent, top = Decimal("0.01"), Decimal(10) ** 16
    least = (Decimal(10) ** p * (1 - SLACK)).quantize(cent, ROUND_FLOOR)
    most = (Decimal(10) ** (p + 1) * (1 + SLACK)).quantize(cent, ROUND_CEILING)
    if least >= top:  # beyond what the column can hold
        return F.lit(False)
    at_least = F.col("paid") >= F.lit(least).cast("decimal(18,2)")
    return at_least if most >= top else at_least & (F.col("paid") <= F.lit(most).cast("decimal(18,2)"))


def cut_rows(fact: DataFrame, flt: Filter, cuts: tuple[int | None, int | None]) -> DataFrame:
    """The fact rows under the filter whose part is cut, with their ``part``."""
    held = sorted({p for p in cuts if p is not None})
    near = functools.reduce(operator.or_, [_edges(p) for p in held])
    rows = flt.scoped(*SCOPE).apply(fact).where(near)
    return rows.withColumn("part", part()).where(F.col("part").isin(held))


def cut_sums(rows: DataFrame) -> DataFrame:
    """The cells and the sums of billing and of servicing providers of the cut rows,
    one scan; checkpointed, since each is read on its own."""
    made = (rows.select(*CUT_COLS, "paid", "patients", "claim_lines").groupingSets(CUT_SETS, *CUT_COLS)
                .agg(F.grouping_id(*CUT_COLS).alias("_g"), *measure_sums()))
    checkpoint_dir(rows.sparkSession)
    return made.checkpoint(eager=True)


def _list_of(sums: DataFrame, role: str) -> DataFrame:
    npi = f"{role}_npi"
    zero = lambda c, t: F.coalesce(F.col(c), F.lit(0)).cast(t).alias(c)
    return (sums.where((F.col("_g") == CUT_GID[role]) & F.col(npi).isNotNull())
                .select(*LIST, F.col(npi).alias("npi"), zero("paid", "decimal(28,2)"), zero("patients", "long"),
                        zero("claim_lines", "long"), "n"))


def tables() -> list[str]:
    """The stored tables that :func:`dashboard_long` reads."""
    return ["cube_paid", *[f"provider_paid_{role}{end}" for role in PL.ROLES for end in ("", "_levels", "_bitmaps")],
            *[f"provider_index_{role}" for role in PL.ROLES]]


def dashboard_long(stored, fact: DataFrame, lookup: DataFrame, descs: DataFrame, flt: Filter, k: int = 12,
                   sectors: DataFrame | None = None) -> DataFrame:
    """The whole dashboard under a range of amounts (and months), in the layout and with
    the rows of :func:`claimscope.operators.dashboard.dashboard_long`. ``stored`` gives
    a baked table by its name. Eager, as the parts it is made of are."""
    if not answers(flt):
        raise ValueError("a filter of amounts, and of months at most besides")
    flt = flt.scoped(*SCOPE)
    cuts = cut_parts(fact.sparkSession, flt)
    inside, sums = whole(cuts), cut_sums(cut_rows(fact, flt, cuts))
    measures = ["paid", "patients", "claim_lines", "n"]
    cells = (stored("cube_paid").where(inside).select(*PART_KEYS, *measures)
             .unionByName(sums.where(F.col("_g") == CUT_GID["cells"]).select(*PART_KEYS, *measures)))
    bucket = F.when(F.col("part") != NOT_POSITIVE, F.col("part")).alias("bucket")
    rest = cubes.cubes_dashboard_long(cells.select("month", "hcpcs", "billing_state", bucket, *measures), descs,
                                      flt.month_from, flt.month_to, k=k, sectors=sectors)
    out, months = rest, flt.scoped("month_from", "month_to")
    for at, role in enumerate(PL.ROLES):
        name, cut = f"provider_paid_{role}", _list_of(sums, role)
        lists = stored(name).where(inside).unionByName(cut)
        levels = stored(f"{name}_levels").where(inside).unionByName(PL.list_levels(cut, LIST))
        bits = stored(f"{name}_bitmaps").where(inside).unionByName(
            PL.provider_bitmaps(cut, stored(f"provider_index_{role}"), LIST))
        out = out.unionByName(PL.provider_section(role, at, lists, levels, bits, lookup, months, k, LIST))
    return out

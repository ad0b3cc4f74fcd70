"""Dimension joins shared by the build and the queries."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimscope.session import checkpoint_dir


#: A registry of more rows than the first is cut to the providers that bill; a cut one
#: of at most the second is broadcast, about 50 bytes a row.
SMALL_REGISTRY, MOST_BROADCAST = 200_000, 1_000_000


def _billing(lookup: DataFrame, billed: DataFrame) -> tuple[DataFrame, bool]:
    """The registry rows (``_rk, _rstate``) that may match, and whether these are few
    enough to be broadcast though the registry is not."""
    right = lookup.select(F.col("npi").alias("_rk"), F.col("state").alias("_rstate"))
    if right.count() <= SMALL_REGISTRY:
        return right, False
    named = billed.select(F.col("billing_npi").alias("_rk")).where(F.col("_rk").isNotNull()).distinct()
    checkpoint_dir(lookup.sparkSession)
    right = right.join(named, "_rk", "left_semi").checkpoint(eager=True)
    return right, right.count() <= MOST_BROADCAST


def add_billing_state(fact: DataFrame, lookup: DataFrame, billed: DataFrame | None = None) -> DataFrame:
    """Left-join the billing provider's registered state onto every row.

    Most of a large registry bills nothing. It is first cut to the providers named in
    ``billed`` (the fact itself by default; any table that has at least its
    ``billing_npi``), and if these are few they are broadcast, so that the rows of the
    fact need not be shuffled. That is eager for a large registry.

    Rows whose ``billing_npi`` is null can never match, but in a shuffled join
    they would all hash to one reducer. They get a join key spread by a hash of
    a few other columns of the row instead, and the join condition still requires a non-null npi, so
    no null row ever matches. A hot non-null provider is split by AQE's skew
    join (the preserved left side may be split); when the lookup is small at
    runtime AQE turns the join into a broadcast.

    Any existing ``billing_state`` is dropped first, so re-running the step on
    its own output gives the same table.
    """
    fact = fact.drop("billing_state")
    cols = fact.columns
    spread_by = [c for c in ("servicing_npi", "month", "claim_lines") if c in cols] or cols
    spread = F.concat(F.lit("\u0000"), F.xxhash64(*[F.col(c) for c in spread_by]).cast("string"))
    left = fact.withColumn("_jk", F.coalesce(F.col("billing_npi"), spread))
    right, few = _billing(lookup, fact if billed is None else billed)
    joined = left.join(F.broadcast(right) if few else right, (F.col("_jk") == F.col("_rk")) & F.col("billing_npi").isNotNull(),
                       "left")
    return joined.select(*cols, F.col("_rstate").alias("billing_state"))


def attach(small: DataFrame, dim: DataFrame, on: list[tuple[str, str]], cols: list[str],
           materialise: bool = True) -> DataFrame:
    """Left-join ``cols`` of a large dimension onto a small frame of proven size.

    In an outer join the preserved side cannot be the broadcast (build) side,
    so ``small LEFT JOIN dim`` would broadcast or shuffle the dimension. This
    instead streams the dimension once through an *inner* join against the
    broadcast keys of ``small``, then left-joins the few hits back onto
    ``small`` (both sides tiny). ``on`` pairs (small column, dim column).
    Every column is renamed before joining, so ``small`` may itself derive
    from ``dim`` (no ambiguous self-join).

    ``small`` is used twice (its keys, then its rows). Its two uses are
    pruned to different columns, so Spark would not reuse their exchanges and
    everything below ``small`` – typically an aggregate over the fact – would
    run twice. With ``materialise`` the (proven small) frame is therefore
    checkpointed once into the shared checkpoint folder; pass False when it
    already reads a materialised input.
    """
    if materialise:
        checkpoint_dir(small.sparkSession)
        small = small.checkpoint(eager=True)
    kcols = [f"_ak{i}" for i in range(len(on))]
    dcols = [f"_ad{i}" for i in range(len(on))]
    vcols = [f"_av{i}" for i in range(len(cols))]
    keys = small.select(*[F.col(s).alias(k) for (s, _), k in zip(on, kcols)]).distinct()
    # as literals as well, which go below the dimension's own aggregates and joins
    named = keys.collect()
    for i, (_, dc) in enumerate(on):
        dim = dim.where(F.col(dc).isin(sorted({r[i] for r in named if r[i] is not None})))
    d = dim.select(*[F.col(dc).alias(a) for (_, dc), a in zip(on, dcols)],
                   *[F.col(c).alias(v) for c, v in zip(cols, vcols)])
    cond = functools.reduce(operator.and_, [F.col(a) == F.col(k) for a, k in zip(dcols, kcols)])
    hits = d.join(F.broadcast(keys), cond).select(*kcols, *vcols)
    cond = functools.reduce(operator.and_, [F.col(s) == F.col(k) for (s, _), k in zip(on, kcols)])
    out = small.join(F.broadcast(hits), cond, "left")
    return out.select(*small.columns, *[F.col(v).alias(c) for c, v in zip(cols, vcols)])


def with_names(ranked: DataFrame, lookup: DataFrame, key: str = "npi",
               bounded: bool = False, materialise: bool = True) -> DataFrame:
    """Attach the registered name of each provider in ``ranked[key]``.

    ``bounded`` says the ranked side has a proven small size (a global
    top-k): the registry is then only streamed past the broadcast keys
    (:func:`attach`). Otherwise (k rows per group, no fixed bound) a plain
    left join: AQE broadcasts the registry when it is small at runtime and
    otherwise shuffles both sides – measured faster than :func:`attach`
    without hints, and the registry shuffle is small next to the fact.
    """
    if bounded:
        return attach(ranked, lookup, [(key, "npi")], ["name"], materialise)
    names = lookup.select(F.col("npi").alias("_nk"), F.col("name").alias("_nm"))
    joined = ranked.join(names, F.col(key) == F.col("_nk"), "left")
    return joined.select(*ranked.columns, F.col("_nm").alias("name"))

"""Mixing sources to target weights by systematic sampling.

Every source gets a target number of words; each of its documents is then
expected ``target / source size`` times. The expected copies are prefix-summed
over the source's documents, one random offset in [0, 1) is added, and a document is
emitted once for every integer that its interval crosses. So a document comes
out floor or ceil of its expectation, and a source as a whole within one copy.

The documents of a source are laid out by size, so that the words of the sample
differ from the target by no more than the largest document, whatever the offset.

Nothing is gathered per source: documents are counted by source and size before the
shuffle, the counts are prefix-summed, and only rows of one source and size are ranked
together. Where these are many, they are split by a hash into cells of about
``cell_rows``. Texts are read once, to count their words. Sources are numbered and
their bounds added up over range partitions, so there may be any number of them.

Defined cases: null text has size 0; a null source is a source of its own, the
last; sources without words have target 0 and no copies; repeated rows are
separate documents, and equal ones share their copies; other columns are handed
through, those called ``size``, ``source_size``, ``target`` or ``copies`` are replaced; an
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimscope.llm.prefix_trie import running
from claimscope.llm.staging import staged

#: Weights of the sources in code point order, repeating; the share of all
#: sizes that the mix takes; the most a source may be repeated.
WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST = 2.0
#: Rows of one source and size that are ranked together.
CELL_ROWS = 100_000


def word_count(text: Column) -> Column:
    r"""Number of ``[^\x20\x09-\x0D]+`` in a text; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE,
                   most: float = MOST) -> DataFrame:
    """``source, source_size`` → the same with ``target``.

    Targets are ``min(most * size, level * weight)`` where the level spends
    ``share`` of all sizes: stopping at the bound and resharing the excess by
    weight, until none is above, ends there. Sources are sorted by the level at
    which they reach their bound; running sums of the bounds tell which do. The driver
    sees two numbers.
    """
    total = (sizes.agg(F.sum("source_size")).first()[0] or 0) * float(share)
    named = running(sizes.withColumn("_all", F.lit(0)), "_all", [F.col("source").isNull(), F.col("source")],
                    {"_at": F.lit(1).cast("long")}, "mix-sources")
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_at") % len(weights) + 1).cast("int"))
    cap = F.col("source_size") * F.lit(float(most))
    t = named.select("source", "source_size", "_all", pick.alias("_w"), cap.alias("_cap"), (cap / pick).alias("_bound"))
    t = staged(t, "mix-bounds")
    weight = t.agg(F.sum("_w")).first()[0] or 0.0
    t = running(t, "_all", [F.col("_bound"), F.col("source").isNull(), F.col("source")],
                {"_stopped": F.col("_cap"), "_gone": F.col("_w")}, "mix-levels")
    # with all smaller bounds stopped, the level that spends the rest; the first source
    # that stays below its bound fixes the level of all after it
    level = (F.lit(total) - F.col("_stopped")) / (F.lit(weight) - F.col("_gone"))
    first = (t.withColumn("_level", level).where(F.col("_bound") >= F.col("_level"))
              .agg(F.min(F.struct("_stopped", "_gone", "_level")).alias("x")).first().x)
    share_of = F.col("_cap") if first is None else F.least("_cap", F.lit(first._level) * F.col("_w"))
    return t.select("source", "source_size", share_of.alias("target"))


def mix(docs: DataFrame, text: str = "text", source: str = "source", keys: tuple = ("doc_id",),
        size: Column | None = None, cell_rows: int = CELL_ROWS, seed: int = 20240229) -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target`` and ``copies`` (how
    often the mix holds the document; 0 for those it leaves out).

    ``keys`` break ties in the order; rows equal in them and in size are ordered
    arbitrarily but share their copies evenly. ``size`` counts a document by something
    else than the words of ``text``, which need not be there then."""
    added = ("size", "source_size", "target", "copies")
    rest = [c for c in docs.columns if c not in added]
    col = lambda c: F.col("`" + c.replace("`", "``") + "`")
    d = docs.select(*[col(c).alias(f"c{i}") for i, c in enumerate(rest)], col(source).alias("_src"),
                    *[col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
                    (word_count(col(text)) if size is None else F.coalesce(size, F.lit(0))).alias("_size"))
    d = staged(d, "mix-rows")
    names = [f"_k{i}" for i in range(len(keys))]
    per_size = staged(d.groupBy("_src", "_size").agg(F.count(F.lit(1)).alias("_n")), "mix-sizes")
    # sizes of a source with many rows get cells; there are fewer of them than rows / cell_rows
    hot = per_size.where(F.col("_n") > cell_rows).select(
        F.col("_src").alias("_hs"), F.col("_size").alias("_hz"), F.ceil(F.col("_n") / cell_rows).alias("_cells"))
    d = d.join(F.broadcast(hot), F.col("_src").eqNullSafe(F.col("_hs")) & (F.col("_size") == F.col("_hz")), "left")
    d = d.withColumn("_cell", F.coalesce(F.pmod(F.xxhash64(*names, F.lit(seed)), F.col("_cells")), F.lit(0)).cast("long"))
    d = d.drop("_hs", "_hz", "_cells")
    cell = ["_src", "_size", "_cell"]
    counted = staged(d.groupBy(*cell).agg(F.count(F.lit(1)).alias("_n")), "mix-cells")
    sizes = counted.groupBy(F.col("_src").alias("source")).agg(F.sum(F.col("_n") * F.col("_size")).alias("source_size"))
    targets = staged(source_targets(staged(sizes, "mix-totals")), "mix-targets")
    before = Window.partitionBy("_src").orderBy("_size", "_cell").rowsBetween(Window.unboundedPreceding, -1)
    start = F.pmod(F.xxhash64(F.col("_src"), F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    # keys that are never null: rows are ranked and joined in one and the same partitioning
    apart = {"_named": F.coalesce(F.col("_src").cast("string"), F.lit("")), "_none": F.col("_src").isNull()}
    place = [*apart, "_size", "_cell"]
    # a row per source, size and cell
    cells = (counted.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
                    .join(targets, F.col("_src").eqNullSafe(F.col("source"))).withColumns(apart)
                    .select(*place, "_before", "source_size", "target", rate.alias("_rate"), start.alias("_offset")))
    by = Window.partitionBy(*place).orderBy(*[F.col(k).asc_nulls_last() for k in names])
    placed = d.withColumns(apart).withColumn("_i", F.row_number().over(by)).join(cells, place)
    crossed = lambda i: F.floor(i * F.col("_rate") + F.col("_offset"))
    at = F.col("_before") + F.col("_i")
    return placed.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(rest)], F.col("_size").alias("size"), "source_size",
                         "target", (crossed(at) - crossed(at - 1)).cast("int").alias("copies"))


def emitted(mixed: DataFrame) -> DataFrame:
    """One row for each copy of a mixed document."""
    rows = mixed.where(F.col("copies") > 0)
    return rows.withColumn("copies", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("copies")

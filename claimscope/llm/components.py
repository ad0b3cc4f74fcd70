"""Connected components of a link table, by large and small stars.

Before a round each task replaces its links by stars of their own components, so
that most chains are gone before anything is shuffled. A round is two aggregates of
minima with a join each; a hub's links are cut up by the adaptive skew join. Each
round is written to the shared folder. The number of rounds grows with the logarithm
of the longest chain; they end when every component is one star. The driver sees
one row per round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimscope.llm.staging import discard, staged

#: Vertices that a task holds while it contracts its links.
HELD = 200_000


def _contracted(held: int):
    """mapInArrow function: links → the stars of what they connect, ``held`` vertices or
    somewhat more at a time."""
    def run(batches):
        import pyarrow as pa

        root: dict[int, int] = {}

        def find(v: int) -> int:
            while (up := root.get(v, v)) != v:
                root[v] = v = root.get(up, up)
            return v

        def stars():
            return pa.RecordBatch.from_arrays([pa.array(list(root), pa.int64()), pa.array([find(v) for v in list(root)], pa.int64())],
                                              names=["a", "b"])

        for batch in batches:
            for x, y in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
                p, q = find(x), find(y)
                if p != q:
                    root[max(p, q)] = min(p, q)
            if len(root) >= held:
                yield stars()
                root.clear()
        if root:
            yield stars()
    return run


def contracted(links: DataFrame, held: int = HELD) -> DataFrame:
    """Links ``a > b`` that connect what ``links`` connect, fewer of them: in a
    task each vertex has one, to the smallest that the task knows it connected to."""
    return links.select("a", "b").mapInArrow(_contracted(held), "a long, b long")


def _large_star(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return (both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                .where("a <> b"))


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    pairs = down.join(least, "a")
    return (pairs.select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct())


def _settled(e: DataFrame) -> bool:
    """Every component of the links is one star: no vertex has two links down, and none
    with a link down has one up."""
    ends = (e.select(F.col("a").alias("v"), F.lit(1).alias("down"), F.lit(0).alias("up"))
             .unionByName(e.select(F.col("b").alias("v"), F.lit(0).alias("down"), F.lit(1).alias("up"))))
    loose = ends.groupBy("v").agg(F.sum("down").alias("down"), F.max("up").alias("up")).where("down > 1 OR down > 0 AND up > 0")
    return not loose.agg(F.count(F.lit(1))).first()[0]


def components(links: DataFrame) -> DataFrame:
    """Links ``a, b`` (in any order, repeats allowed) → ``a, b``: each linked
    vertex but the smallest of its component, with that smallest one."""
    e = staged(contracted(links.where("a <> b")).distinct(), "links")
    while not _settled(e):
        last, e = e, staged(_small_star(_large_star(contracted(e))), "links")
        discard(last)
    return e

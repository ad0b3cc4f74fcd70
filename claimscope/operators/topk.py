"""Top-k building blocks with a fixed tie-break.

Every ranking orders by the measure (descending, nulls last) and then by the
key (ascending), so equal totals always come out in the same order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimscope.session import checkpoint_dir


def _order(measure: str, key: str | list[str]) -> list[Column]:
    keys = [key] if isinstance(key, str) else list(key)
    return [F.col(measure).desc_nulls_last()] + [F.col(k).asc_nulls_last() for k in keys]


def top_k(df: DataFrame, k: int, measure: str, key: str | list[str],
          rank_col: str = "rank") -> DataFrame:
    """Global top-k: one ``TakeOrderedAndProject`` (each task keeps its own k,
    the driver merges k per task), then a 1..k rank over those k rows."""
    order = _order(measure, key)
    head = df.orderBy(*order).limit(k)
    return head.withColumn(rank_col, F.row_number().over(Window.orderBy(*order)).cast("long"))


def top_k_per_group(df: DataFrame, group: str | list[str], k: int, measure: str,
                    key: str | list[str], rank_col: str = "rk") -> DataFrame:
    """Top-k rows of every group.

    ``row_number() <= k`` directly above the window lets Catalyst insert a
    partial ``WindowGroupLimit`` before the shuffle, so at most k rows per
    group leave each map task: a group holding most of the data still sends
    only k rows per task to its reducer.
    """
    groups = [group] if isinstance(group, str) else list(group)
    w = Window.partitionBy(*groups).orderBy(*_order(measure, key))
    return (df.withColumn(rank_col, F.row_number().over(w))
              .where(F.col(rank_col) <= k)
              .withColumn(rank_col, F.col(rank_col).cast("long")))


def dense_index(values: DataFrame, key: str, index_col: str = "idx") -> DataFrame:
    """0-based position of each distinct ``key`` in ascending order.

    Distributed: the keys are range-partitioned and sorted, each row gets its
    position inside its partition, and the per-partition counts (one row per
    partition, so bounded) give every partition its starting offset. No
    single-partition window over the keys themselves. Eager: the partitioned
    keys are checkpointed, because counts and positions must come from one and
    the same evaluation of the range partitioning.
    """
    ordered = (values.select(key).where(F.col(key).isNotNull()).distinct()
               .repartitionByRange(F.col(key)).sortWithinPartitions(key)
               .withColumn("_pid", F.spark_partition_id())
               .withColumn("_pos", F.monotonically_increasing_id()))
    # position inside the partition: the id's low 33 bits
    ordered = ordered.withColumn("_pos", F.col("_pos").bitwiseAND(F.lit((1 << 33) - 1)))
    checkpoint_dir(values.sparkSession)
    ordered = ordered.checkpoint(eager=True)
    counts = ordered.groupBy("_pid").agg(F.count(F.lit(1)).alias("_cnt"))
    offsets = counts.withColumn(
        "_off", F.coalesce(F.sum("_cnt").over(
            Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return (ordered.join(F.broadcast(offsets.select("_pid", "_off")), "_pid")
            .select(F.col(key), (F.col("_off") + F.col("_pos")).cast("long").alias(index_col)))

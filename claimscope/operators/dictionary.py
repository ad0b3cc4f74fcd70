"""Indexes of keys that survive growth: known keys keep theirs, new ones follow.

A dictionary is kept as parts, one per batch. A batch adds only the keys that no
earlier part has; they are numbered in ascending order from the next free index on. So
the indexes are dense over all parts, no stored index ever changes, and a batch that is
repeated writes the same part. :func:`sorted_view` gives the ascending positions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimscope.operators.topk import dense_index


def new_keys(known: DataFrame | None, values: DataFrame, key: str) -> DataFrame:
    """``key, idx``: the distinct keys of ``values`` that ``known`` (``key, idx``) lacks,
    from its next free index on. Null is no key."""
    fresh = values.select(key).where(F.col(key).isNotNull()).distinct()
    if known is None:
        return dense_index(fresh, key)
    numbered = dense_index(fresh.join(known.select(key), key, "left_anti"), key)
    free = known.agg(F.coalesce(F.max("idx") + 1, F.lit(0)).alias("_free")).first()[0]
    return numbered.select(key, (F.col("idx") + F.lit(free)).cast("long").alias("idx"))


def sorted_view(dictionary: DataFrame, key: str) -> DataFrame:
    """``key, idx, position``: with the place of each key in ascending order."""
    return dictionary.join(dense_index(dictionary, key, "position"), key).select(key, "idx", "position")

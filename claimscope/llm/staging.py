"""Intermediate tables in the shared folder, and Arrow text helpers."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from claimscope.session import checkpoint_dir

#: While a stage is written, Arrow batches have at most so many rows: with long
#: texts the usual 10,000 are a large part of a Python worker's memory.
BATCH, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000


def stage_path(spark: SparkSession, name: str) -> str:
    """A new path under the cluster's shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Write ``df`` to the shared folder and return the table read back: the
    lineage is cut and a lost executor costs no recomputation of what is
    before it."""
    spark = df.sparkSession
    path = stage_path(spark, name)
    rows = int(spark.conf.get(BATCH))
    spark.conf.set(BATCH, str(min(rows, BATCH_ROWS) if rows > 0 else BATCH_ROWS))
    try:
        df.write.partitionBy(*partition_by).parquet(path)
    finally:
        spark.conf.set(BATCH, str(rows))
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete staged tables whose last reader has run."""
    for t in tables:
        jvm = t.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(t._staged_at)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def utf8_buffer(column) -> tuple[np.ndarray, np.ndarray]:
    """An Arrow string column → its UTF-8 bytes as one uint8 array, and the
    n+1 offsets of the rows in it. A null row has no bytes."""
    import pyarrow as pa
    import pyarrow.compute as pc

    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[
        column.offset:column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0]:off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def row_chunks(offsets: np.ndarray, most: int):
    """Row ranges ``(a, b)`` of at most ``most`` bytes each, or one row."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1
        b = min(max(b, a + 1), n)
        yield a, b
        a = b

"""Incremental ingest: claims CSV files arriving in a folder → the fact table and its cubes.

The original tool converts its CSV once and re-runs the conversion when the
source changes. Here the same conversion (typed read → billing-state join →
clustered Parquet) runs as a Structured Streaming query over a landing
folder, so new files are picked up without rebuilding the table:

* the source is ``readStream.csv`` by header names, cast with ANSI semantics
  as in the batch reader;
* each micro-batch is joined with the registry (one row per NPI, as in the batch
  build), clustered by (month, code) and written by ``foreachBatch`` into its own
  ``fact/batch=<id>`` folder with ``overwrite`` - a retried batch rewrites exactly its
  own folders, so the table is exactly-once even though ``foreachBatch`` itself is
  at-least-once;
* the cubes are kept as mergeable parts: a batch adds its own part of every cube
  (``cubes/<name>/batch=<id>``), computed from the batch's rows alone. Readers add
  the parts up by key; :func:`compact_cubes` writes them as one. The fact is never
  scanned again;
* the dense indexes of codes, months and states only grow: a batch adds its new keys
  (``indexes/<key>/batch=<id>``) after those of all batches before it;
* a batch counts once its marker ``done/<id>`` is there, which is written after its
  last table and taken away before a retry rewrites them;
* progress lives in the streaming checkpoint, which the caller names, so a
  restarted query resumes where it stopped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from claimscope.functions.expressions import valid_state
from claimscope.operators import cubes, dictionary
from claimscope.schema import SPENDING
from claimscope.sources.joins import add_billing_state
from claimscope.sources.tables import (FACT_SCHEMA_DDL, clustered, dedupe_lookup, mark, names_in, read_csv_by_name,
                                       typed_claims, unmark)

#: ``cubes/upto=<id>``: one set of all cubes that stands for the batches up to that id.
UPTO = "upto="
#: The keys that have an index.
INDEXED = ("hcpcs", "month", "billing_state")


def claims_stream(spark: SparkSession, landing: str, max_files: int = 100) -> DataFrame:
    """The landing folder as a stream. The columns are those of the header of
    what has landed (by name, in file order); each file must have that header."""
    found = read_csv_by_name(spark, landing).schema
    raw = (spark.readStream.schema(found).option("header", True).option("enforceSchema", False)
                .option("mode", "FAILFAST").option("columnPruning", False).option("escape", '"')
                .option("maxFilesPerTrigger", max_files).csv(landing))
    return typed_claims(raw)


def write_batch(batch: DataFrame, batch_id: int, lookup: DataFrame, out: str) -> None:
    """A batch of fact rows (without the state), its part of every cube and its new keys.
    Batches are written one after the other."""
    spark = batch.sparkSession
    unmark(spark, f"{out}/done/{batch_id}")
    path = f"{out}/fact/batch={batch_id}"
    (clustered(add_billing_state(batch, dedupe_lookup(lookup))).write.mode("overwrite")
        .partitionBy("month").option("compression", "zstd").parquet(path))
    part = f"{out}/cubes/cube_dashboard/batch={batch_id}"
    _write(cubes.cube_dashboard(spark.read.schema(FACT_SCHEMA_DDL).parquet(path)), part)
    for name in cubes.ROLLED:
        if name != "cube_dashboard":
            _write(cubes.rolled(name, spark.read.parquet(part)), f"{out}/cubes/{name}/batch={batch_id}")
    for key in INDEXED:
        known, cells = read_stream_index(spark, out, key, before=batch_id), spark.read.parquet(part)
        cells = cells.where(valid_state(key)) if key == "billing_state" else cells
        _write(dictionary.new_keys(known, cells, key), f"{out}/indexes/{key}/batch={batch_id}")
    mark(spark, f"{out}/done/{batch_id}")


def _write(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)


def start_ingest(spark: SparkSession, landing: str, lookup_path: str, out: str,
                 checkpoint: str, available_now: bool = True):
    """Start the ingest query; returns the ``StreamingQuery``.

    ``checkpoint`` holds the progress and must outlive the process: with a new
    one every file is ingested again. ``available_now`` processes what has
    landed and stops (a scheduled incremental build); otherwise the query keeps
    running."""
    if not checkpoint:
        raise ValueError("the ingest needs a lasting checkpoint folder")

    def each(batch: DataFrame, batch_id: int) -> None:
        write_batch(batch, batch_id, batch.sparkSession.read.parquet(lookup_path), out)

    writer = (claims_stream(spark, landing).writeStream
              .foreachBatch(each).option("checkpointLocation", checkpoint))
    writer = writer.trigger(availableNow=True) if available_now else writer
    return writer.start()


def finished_batches(spark: SparkSession, out: str) -> list[int]:
    return sorted(int(n) for n in names_in(spark, f"{out}/done") if n.isdigit())


def read_stream_fact(spark: SparkSession, out: str) -> DataFrame:
    """All finished batches as one fact DataFrame."""
    columns = [*[f.name for f in SPENDING.fields], "hcpcs_norm"]
    paths = [f"{out}/fact/batch={b}" for b in finished_batches(spark, out)]
    if not paths:
        return spark.createDataFrame([], FACT_SCHEMA_DDL).select(*columns)
    return (spark.read.schema(FACT_SCHEMA_DDL + ", batch int").option("basePath", f"{out}/fact").parquet(*paths)
                 .select(*columns))


def read_stream_index(spark: SparkSession, out: str, key: str, before: int | None = None) -> DataFrame:
    """``key, idx`` over all finished batches (or those before one). The index that a
    key once has never changes."""
    paths = [f"{out}/indexes/{key}/batch={b}" for b in finished_batches(spark, out) if before is None or b < before]
    schema = f"{key} string, idx long"
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def _compacted(spark: SparkSession, out: str) -> int | None:
    """The last batch that the newest finished compaction stands for."""
    found = [int(n[len(UPTO):]) for n in names_in(spark, f"{out}/done") if n.startswith(UPTO)]
    return max(found, default=None)


def read_stream_cube(spark: SparkSession, out: str, name: str) -> DataFrame:
    """The cube ``name`` over all finished batches, added up from its parts."""
    upto = _compacted(spark, out)
    batches = [b for b in finished_batches(spark, out) if upto is None or b > upto]
    paths = [f"{out}/cubes/{name}/batch={b}" for b in batches]
    if upto is not None:
        paths.append(f"{out}/cubes/{name}/{UPTO}{upto}")
    if not paths:
        return getattr(cubes, name)(read_stream_fact(spark, out))
    parts = spark.read.parquet(paths[0])
    return cubes.merged(name, spark.read.schema(parts.schema).parquet(*paths))


def compact_cubes(spark: SparkSession, out: str) -> int | None:
    """Write the parts of every cube so far as one; returns the last batch in it.
    Can be repeated; readers use it once all cubes are written."""
    batches = finished_batches(spark, out)
    if not batches or batches[-1] == _compacted(spark, out):
        return _compacted(spark, out)
    for name in cubes.ROLLED:
        _write(read_stream_cube(spark, out, name), f"{out}/cubes/{name}/{UPTO}{batches[-1]}")
    mark(spark, f"{out}/done/{UPTO}{batches[-1]}")
    return batches[-1]

"""claimscope: provider-payment analytics on PySpark.

A fact table of payments (one row per billing provider, servicing provider,
billing code and month) is built once from raw input, clustered and written as
Parquet; every question is then a lazy DataFrame plan over it:

* ``functions``  – Column builders: the shared filter, the code → sector rule
  chain, the log-scale payment bucket, money formatting.
* ``sources``    – readers for the raw inputs and the derived fact view, and
  the Parquet writers of the batch build.
* ``operators``  – the analytic queries (dashboard by grouping sets, top-k
  per group, provider search, peer comparison, row paging, cubes, stats).
* ``plans``      – the batch build that materialises the fact table and the
  aggregate tables, and the named-query registry used by tests and bench.
* ``streaming``  – the fact-table ingest run as an incremental file stream.
"""

from claimscope.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]

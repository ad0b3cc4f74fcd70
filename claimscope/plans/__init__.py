"""Batch build (build), query inputs (inputs), the named-query registry
(registry) and its DuckDB oracle (oracle_sql, oracle_views)."""

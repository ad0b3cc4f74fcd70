"""Structured Streaming: the fact-table ingest as an incremental file stream.

The analytic queries themselves are batch (the original tool has no streams,
watermarks or stateful operators); only the ingest is streamed.
"""

from claimscope.streaming.ingest import (claims_stream, compact_cubes, finished_batches, read_stream_cube,
                                         read_stream_fact, read_stream_index, start_ingest, write_batch)

__all__ = ["claims_stream", "start_ingest", "write_batch", "finished_batches", "read_stream_fact",
           "read_stream_index", "read_stream_cube", "compact_cubes"]

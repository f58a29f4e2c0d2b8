"""Streaming forms of the incremental operators."""

from chronoframe.streaming.streams import (
    read_latest_snapshot, read_sink, read_stream, read_updates, run_available, sink_updates, stream_bucket_count,
    stream_change_points, stream_change_points_late, stream_dirs, stream_ingest_dedup, stream_upsert, use_rocksdb,
)

__all__ = ["read_latest_snapshot", "read_sink", "read_stream", "read_updates", "run_available", "sink_updates",
           "stream_bucket_count", "stream_change_points", "stream_change_points_late", "stream_dirs", "stream_ingest_dedup", "stream_upsert",
           "use_rocksdb"]

"""Streaming scorers."""

from redline.streaming.scores import (
    read_latest,
    run_available_now,
    run_to_path,
    running_metrics,
    stream_triples_metrics,
    write_version,
)

__all__ = ["read_latest", "run_available_now", "run_to_path", "running_metrics", "stream_triples_metrics", "write_version"]

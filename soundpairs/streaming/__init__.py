"""Structured Streaming forms of ingest, de-duplication, resolution and append."""

from soundpairs.streaming.jobs import (
    compact_again, latest_pairs, resolve_again, stream_append, stream_dedupe, stream_detections,
    stream_pages, stream_resolve, stream_stage1, watermark_dedupe,
)

__all__ = [
    "compact_again", "latest_pairs", "resolve_again", "stream_append", "stream_dedupe",
    "stream_detections", "stream_pages", "stream_resolve", "stream_stage1", "watermark_dedupe",
]

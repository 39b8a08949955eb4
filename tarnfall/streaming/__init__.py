"""Continuous ingestion."""

from tarnfall.streaming.ingest import stream_convert

__all__ = ["stream_convert"]

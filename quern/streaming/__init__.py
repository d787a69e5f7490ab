"""Streams: incremental ingest and live registries."""

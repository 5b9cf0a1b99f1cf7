"""Incremental ingest with Structured Streaming: an extension, the batch functions are the same."""

"""Structured Streaming forms of the incremental jobs and of the serving metrics."""

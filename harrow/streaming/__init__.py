"""Streaming forms of the incremental scans and of request scoring."""

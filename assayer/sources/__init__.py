"""Scans, ingest checks and sinks."""

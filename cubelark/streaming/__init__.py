"""Incremental ingest of layer tables."""

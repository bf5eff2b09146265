"""Ingest, validation, blocks, access, sampling, metrics and profiles over position tables."""

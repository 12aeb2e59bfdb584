"""Operators for building training corpora: deduplication, scans, scoring and packing."""

"""Operators for preparing text corpora: filters, deduplication, scans, scoring, packing and search."""

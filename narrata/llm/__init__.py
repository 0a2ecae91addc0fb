"""Operators for preparing training data: search, filters, deduplication, scoring, packing."""

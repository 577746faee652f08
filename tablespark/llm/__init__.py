"""Operators for preparing training corpora: search, filtering, deduplication, packing."""

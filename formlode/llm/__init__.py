"""Operators that prepare training corpora: deduplication, filters, mixing, packing, search."""

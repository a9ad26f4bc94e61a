"""Operators for building training data: filters, near-duplicate joins, search,
scans, packing and sharding. Nothing else in the library imports them."""

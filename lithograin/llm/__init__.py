"""Training-data operators: quality, deduplication, scoring, sharding, packing.

Nothing else in the library imports this subpackage.
"""

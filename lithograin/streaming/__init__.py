"""Rows handed on one by one, without holding a result in memory."""

from .rows import for_each_row, for_each_row_on_cluster

__all__ = ["for_each_row", "for_each_row_on_cluster"]

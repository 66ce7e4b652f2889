"""Grouping, global aggregates and DISTINCT."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.aggregates import Aggregate, compile_aggregate
from ..functions.predicates import TOTAL, Filter, resolve
from .scan import filtered


def aggregate(df: DataFrame, group_by: Sequence[str], aggs: Sequence[Aggregate], filters: Sequence[Filter] = (), semantics: str = TOTAL, strict: bool = True) -> DataFrame:
    """Group columns, then aggregates. NULL is a group of its own. Without group columns
    there is exactly one row, also for no input."""
    keys = [F.col(f"`{resolve(df, g)}`") for g in group_by]
    columns = [compile_aggregate(df, a, strict) for a in aggs]
    rows = filtered(df, filters, semantics)
    if not columns:
        return rows.select(*keys).distinct()
    return rows.groupBy(*keys).agg(*columns) if keys else rows.agg(*columns)


def distinct(df: DataFrame, columns: Sequence[str], filters: Sequence[Filter] = (), semantics: str = TOTAL) -> DataFrame:
    names = [F.col(f"`{resolve(df, c)}`") for c in columns]
    return filtered(df, filters, semantics).select(*names).distinct()


def count(df: DataFrame, filters: Sequence[Filter] = (), semantics: str = TOTAL) -> DataFrame:
    """One row, ``count``; the scan reads no column that no filter needs."""
    return filtered(df, filters, semantics).agg(F.count(F.lit(1)).alias("count"))

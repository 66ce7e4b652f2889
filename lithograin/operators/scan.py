"""Scans: filter, sort, offset, limit, projection - always in that order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ColumnNotFound, QueryError
from ..functions.ordering import sort_key
from ..functions.predicates import TOTAL, Filter, compile_filters, resolve


def filtered(df: DataFrame, filters: Sequence[Filter] = (), semantics: str = TOTAL) -> DataFrame:
    condition = compile_filters(df, filters, semantics)
    return df if condition is None else df.where(condition)


def paged(df: DataFrame, limit: int | None = None, offset: int | None = None) -> DataFrame:
    if (limit is not None and limit < 0) or (offset is not None and offset < 0):
        raise QueryError("limit and offset must not be negative")
    df = df.offset(offset) if offset else df
    return df if limit is None else df.limit(limit)


def ordered(df: DataFrame, keys: Sequence[tuple[str, bool]]) -> DataFrame:
    """``keys``: (column, descending). A sort isn't stable in a cluster: name enough columns."""
    return df.orderBy(*(sort_key(resolve(df, n), d) for n, d in keys)) if keys else df


def projected(df: DataFrame, projection: Sequence[int | str] | None) -> DataFrame:
    """Columns by index or name; None keeps all."""
    if projection is None:
        return df
    names = []
    for p in projection:
        if isinstance(p, int):
            if not 0 <= p < len(df.columns):
                raise ColumnNotFound(f"column {p}")
            names.append(df.columns[p])
        else:
            names.append(resolve(df, p))
    return df.select(*(F.col(f"`{n}`") for n in names))


def scan(df: DataFrame, filters: Sequence[Filter] = (), order: Sequence[tuple[str, bool]] = (), limit: int | None = None, offset: int | None = None, projection: Sequence[int | str] | None = None, semantics: str = TOTAL) -> DataFrame:
    return projected(paged(ordered(filtered(df, filters, semantics), order), limit, offset), projection)


def top_k(df: DataFrame, column: str, k: int, descending: bool = True, ties: Sequence[str] = ()) -> DataFrame:
    """The k first rows by a column; Spark keeps only k rows of each task."""
    return paged(ordered(df, [(column, descending), *((t, False) for t in ties)]), k)


def semi(df: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """Rows whose ``column`` is among ``keys``; Spark broadcasts the keys if they are small."""
    return df.join(keys.select(F.col(keys.columns[0]).alias(column)), column, "left_semi")

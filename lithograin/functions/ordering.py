"""Sort keys with NULL as the greatest value: last when ascending, first when descending."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sort_key(name: str, descending: bool = False) -> Column:
    column = F.col(f"`{name}`")
    return column.desc_nulls_first() if descending else column.asc_nulls_last()

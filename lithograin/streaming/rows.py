"""Row callbacks: on the driver a partition at a time, or on the executors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame


def for_each_row(df: DataFrame, visit: Callable[[tuple], None]) -> int:
    """Calls ``visit`` on the driver with every row's values; holds one partition at a time."""
    n = 0
    for row in df.toLocalIterator(prefetchPartitions=True):
        visit(tuple(row))
        n += 1
    return n


def for_each_row_on_cluster(df: DataFrame, visit: Callable[[tuple], None]) -> None:
    """Calls ``visit`` in the tasks; it may run again for rows of a task that is repeated."""

    def part(rows) -> None:
        for row in rows:
            visit(tuple(row))

    df.foreachPartition(part)

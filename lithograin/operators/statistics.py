"""Column statistics and row estimates."""

from __future__ import annotations

import math
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import Operator, resolve


def column_statistics(df: DataFrame, column: str) -> DataFrame:
    """One row: total_entries, cardinality (NULL counts as one value), n_nulls, min_value, max_value."""
    c = F.col(f"`{resolve(df, column)}`")
    return df.agg(
        F.count(F.lit(1)).alias("total_entries"),
        (F.count_distinct(c) + F.max(F.when(c.isNull(), 1).otherwise(0))).cast("long").alias("cardinality"),
        F.count_if(c.isNull()).alias("n_nulls"),
        F.min(c).alias("min_value"),
        F.max(c).alias("max_value"),
    )


@dataclass(frozen=True)
class ColumnStatistics:
    total_entries: int
    cardinality: int
    min_value: Any
    max_value: Any

    @classmethod
    def of(cls, df: DataFrame, column: str) -> ColumnStatistics:
        r = column_statistics(df, column).first()
        return cls(r["total_entries"], r["cardinality"] or 0, r["min_value"], r["max_value"])

    @property
    def avg_duplicates(self) -> float:
        return self.total_entries / self.cardinality if self.cardinality else 0.0

    @property
    def selectivity(self) -> float:
        return self.cardinality / self.total_entries if self.total_entries else 0.0

    @property
    def is_unique(self) -> bool:
        return self.avg_duplicates <= 1.0

    def _asked(self, op: Operator) -> list[tuple[Any, Any]] | None:
        """The ranges of values that an operator asks for; None where it isn't about ranges."""
        ends = {"lt": (self.min_value, None), "le": (self.min_value, None), "gt": (None, self.max_value), "ge": (None, self.max_value)}
        if op.kind in ("eq", "in"):
            return [(v, v) for v in op.values]
        if op.kind == "between":
            return [op.values]
        if op.kind in ends:
            return [tuple(op.value if end is None else end for end in ends[op.kind])]
        return None

    def _share(self, low, high) -> float:
        """Part of the rows with values in a range, if the distinct values lie evenly; a quarter where they aren't numbers."""
        point = 1 / max(self.cardinality, 1)
        if low == high:
            return point
        if not all(isinstance(x, (int, float)) for x in (low, high, self.min_value, self.max_value)):
            return 0.25
        width, inside = self.max_value - self.min_value, min(high, self.max_value) - max(low, self.min_value)
        return max(inside, 0) / width if width else float(inside >= 0)

    def estimate_rows(self, op: Operator) -> int:
        """Rows that an operator may keep; all rows where nothing is known."""
        ranges = self._asked(op)
        if ranges is None:
            return self.total_entries
        return min(self.total_entries, math.ceil(round(sum(self._share(*r) for r in ranges) * self.total_entries, 6)))

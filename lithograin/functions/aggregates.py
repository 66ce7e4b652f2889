"""Aggregates as data: COUNT(*), COUNT, SUM, AVG, MIN, MAX."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import QueryError
from ..types import INTEGRAL
from .predicates import resolve


@dataclass(frozen=True)
class Aggregate:
    kind: str
    column: str | None = None
    alias: str | None = None

    @property
    def name(self) -> str:
        return self.alias or (f"{self.kind}_{self.column}" if self.column else self.kind)


def count(alias: str | None = None) -> Aggregate:
    return Aggregate("count", None, alias)


def count_column(column: str, alias: str | None = None) -> Aggregate:
    return Aggregate("count", column, alias)


def sum_of(column: str, alias: str | None = None) -> Aggregate:
    return Aggregate("sum", column, alias)


def avg_of(column: str, alias: str | None = None) -> Aggregate:
    return Aggregate("avg", column, alias)


def min_of(column: str, alias: str | None = None) -> Aggregate:
    return Aggregate("min", column, alias)


def max_of(column: str, alias: str | None = None) -> Aggregate:
    return Aggregate("max", column, alias)


#: Bits of a part of a long. Sums of parts fit in longs for 2**42 rows, and need no wide decimals row by row.
PART = 21


def _exact_sum(c: Column) -> Column:
    """The sum of longs as decimal(38,0)."""
    low = (1 << PART) - 1
    parts = (F.shiftright(c, 2 * PART), F.shiftright(c, PART).bitwiseAND(F.lit(low)), c.bitwiseAND(F.lit(low)))
    sums = [F.sum(p).cast("decimal(28,0)") for p in parts]
    return (sums[0] * F.lit(1 << 2 * PART).cast("decimal(14,0)") + sums[1] * F.lit(1 << PART).cast("decimal(8,0)") + sums[2]).cast("decimal(38,0)")


def compile_aggregate(df: DataFrame, agg: Aggregate, strict: bool = True) -> Column:
    """SUM and AVG take integers only when ``strict``. A sum of longs is exact in between and
    fails only if the final value doesn't fit; sums of smaller integers stay in longs."""
    if agg.column is None:
        return F.count(F.lit(1)).alias(agg.name)
    name = resolve(df, agg.column)
    c, kind = F.col(f"`{name}`"), df.schema[name].dataType
    if agg.kind in ("sum", "avg"):
        integral = isinstance(kind, INTEGRAL)
        if strict and not integral:
            raise QueryError(f"{agg.kind.upper()} needs an integer column, but {name} is {kind.simpleString()}")
        if not isinstance(kind, T.NumericType):
            raise QueryError(f"{agg.kind.upper()} needs a numeric column, but {name} is {kind.simpleString()}")
        if isinstance(kind, T.LongType):
            total = _exact_sum(c)
            made = total.cast("long") if agg.kind == "sum" else total.cast("double") / F.count(c)
            return F.when(F.count(c) > 0, made).alias(agg.name)
        return (F.sum(c) if agg.kind == "sum" else F.avg(c)).alias(agg.name)
    made = {"count": F.count, "min": F.min, "max": F.max}.get(agg.kind)
    if made is None:
        raise QueryError(f"unknown aggregate {agg.kind}")
    return made(c).alias(agg.name)

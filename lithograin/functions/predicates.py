"""Filters as data, compiled to Spark columns under one of two NULL rules.

``total``: values have a total order with NULL as the greatest, and NULL equals NULL,
so ``>`` keeps NULL rows and ``= NULL`` finds them. ``ansi``: SQL's three-valued logic.
"""

from __future__ import annotations

import datetime
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ColumnNotFound, QueryError
from .like import like

TOTAL, ANSI = "total", "ansi"


@dataclass(frozen=True)
class Operator:
    kind: str
    values: tuple = ()

    @property
    def value(self) -> Any:
        return self.values[0]


def equals(x) -> Operator:
    return Operator("eq", (x,))


def not_equals(x) -> Operator:
    return Operator("ne", (x,))


def greater_than(x) -> Operator:
    return Operator("gt", (x,))


def greater_or_equal(x) -> Operator:
    return Operator("ge", (x,))


def less_than(x) -> Operator:
    return Operator("lt", (x,))


def less_or_equal(x) -> Operator:
    return Operator("le", (x,))


def between(low, high) -> Operator:
    return Operator("between", (low, high))


def is_in(values) -> Operator:
    return Operator("in", tuple(values))


def not_in(values) -> Operator:
    return Operator("not_in", tuple(values))


def matches(pattern: str) -> Operator:
    return Operator("like", (pattern,))


def not_matches(pattern: str) -> Operator:
    return Operator("not_like", (pattern,))


def is_null() -> Operator:
    return Operator("is_null")


def is_not_null() -> Operator:
    return Operator("is_not_null")


@dataclass(frozen=True)
class Filter:
    column: str
    operator: Operator


def resolve(df: DataFrame, name: str) -> str:
    """A column's name; ``colN`` stands for the Nth column if no column has that name."""
    if name in df.columns:
        return name
    if name.startswith("col") and name[3:].isdigit() and int(name[3:]) < len(df.columns):
        return df.columns[int(name[3:])]
    raise ColumnNotFound(name)


def literal(value, kind: T.DataType) -> Column:
    """The value as Spark would compare it with a column of that type; whole numbers are
    epoch milliseconds beside timestamps."""
    if value is None:
        return F.lit(None).cast(kind)
    if isinstance(kind, T.TimestampType) and isinstance(value, int) and not isinstance(value, bool):
        return F.timestamp_millis(F.lit(value))
    if isinstance(kind, T.StringType) and not isinstance(value, str):
        return F.lit(value).cast("string")
    if isinstance(kind, T.TimestampType) and isinstance(value, (str, datetime.date)):
        return F.lit(value).cast(kind)
    return F.lit(value)


def _total(c: Column, op: Operator, kind: T.DataType) -> Column:
    yes, no = F.lit(True), F.lit(False)
    x = [literal(v, kind) for v in op.values]
    null = bool(op.values) and op.values[0] is None
    match op.kind:
        case "eq":
            return c.eqNullSafe(x[0])
        case "ne":
            return ~c.eqNullSafe(x[0])
        case "gt":
            return no if null else (c > x[0]) | c.isNull()
        case "ge":
            return c.isNull() if null else (c >= x[0]) | c.isNull()
        case "lt":
            return c.isNotNull() if null else c < x[0]
        case "le":
            return yes if null else c <= x[0]
        case "between":
            low, high = (Operator("ge", op.values[:1]), Operator("le", op.values[1:]))
            if None not in op.values:
                return c.between(*x)
            return _total(c, low, kind) & _total(c, high, kind)
        case "in" | "not_in":
            listed = [v for v, raw in zip(x, op.values, strict=True) if raw is not None]
            found = c.isin(*listed) if listed else no
            found = found | c.isNull() if None in op.values else found
            return found if op.kind == "in" else ~F.coalesce(found, no)
        case "like":
            return like(c, op.value)
        case "not_like":
            return ~F.coalesce(like(c, op.value), no)
    raise QueryError(f"unknown operator {op.kind}")


def _ansi(c: Column, op: Operator, kind: T.DataType) -> Column:
    x = [literal(v, kind) for v in op.values]
    match op.kind:
        case "eq":
            return c == x[0]
        case "ne":
            return c != x[0]
        case "gt":
            return c > x[0]
        case "ge":
            return c >= x[0]
        case "lt":
            return c < x[0]
        case "le":
            return c <= x[0]
        case "between":
            return c.between(*x)
        case "in":
            return c.isin(*x) if x else F.lit(False)
        case "not_in":
            return ~c.isin(*x) if x else F.lit(True)
        case "like":
            return like(c, op.value)
        case "not_like":
            return ~like(c, op.value)
    raise QueryError(f"unknown operator {op.kind}")


def compile_operator(column: Column, op: Operator, kind: T.DataType, semantics: str = TOTAL) -> Column:
    """The condition for a WHERE, which keeps a row where it's true; it may be NULL where it isn't,
    so that the scan can take it over as it is."""
    if op.kind == "is_null":
        return column.isNull()
    if op.kind == "is_not_null":
        return column.isNotNull()
    if op.kind in ("like", "not_like") and not isinstance(kind, T.StringType):
        return F.lit(op.kind == "not_like")
    return (_total if semantics == TOTAL else _ansi)(column, op, kind)


def compile_filter(df: DataFrame, f: Filter, semantics: str = TOTAL) -> Column:
    name = resolve(df, f.column)
    return compile_operator(F.col(f"`{name}`"), f.operator, df.schema[name].dataType, semantics)


def compile_filters(df: DataFrame, filters, semantics: str = TOTAL) -> Column | None:
    """The conjunction of all filters; None without any."""
    parts = [compile_filter(df, f, semantics) for f in filters]
    return reduce(lambda a, b: a & b, parts) if parts else None

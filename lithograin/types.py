"""SQL type names, schemas and inference of a schema from Python rows."""

from __future__ import annotations

import datetime
from collections.abc import Iterable, Sequence

from pyspark.sql import types as T

from .errors import TypeMismatch

#: Accepted type names. FLOAT is 64 bits wide here, unlike in Spark's DDL.
TYPE_NAMES = {
    "INT": "int",
    "INTEGER": "int",
    "INT32": "int",
    "INT64": "bigint",
    "BIGINT": "bigint",
    "FLOAT32": "float",
    "FLOAT": "double",
    "DOUBLE": "double",
    "REAL": "double",
    "FLOAT64": "double",
    "VARCHAR": "string",
    "TEXT": "string",
    "STRING": "string",
    "TIMESTAMP": "timestamp",
    "DATETIME": "timestamp",
    "BOOLEAN": "boolean",
    "BOOL": "boolean",
}
INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
INT_RANGE = range(-(1 << 31), 1 << 31)


def spark_type(name: str) -> T.DataType:
    try:
        return T._parse_datatype_string(TYPE_NAMES[name.upper()])
    except KeyError:
        raise TypeMismatch(f"unknown type {name}") from None


def schema_of(columns: T.StructType | Iterable[tuple[str, str | T.DataType]]) -> T.StructType:
    """A nullable schema from (name, type name or type) pairs."""
    if isinstance(columns, T.StructType):
        return columns
    fields = [T.StructField(n, t if isinstance(t, T.DataType) else spark_type(t), True) for n, t in columns]
    names = [f.name for f in fields]
    if len(set(names)) != len(names):
        raise TypeMismatch("column names repeat")
    return T.StructType(fields)


def _type_of(value) -> T.DataType | None:
    match value:
        case None:
            return None
        case bool():
            return T.BooleanType()
        case int():
            return T.IntegerType() if value in INT_RANGE else T.LongType()
        case float():
            return T.DoubleType()
        case str():
            return T.StringType()
        case datetime.datetime():
            return T.TimestampType()
    raise TypeMismatch(f"no column type for {type(value).__name__}")


def _wider(a: T.DataType | None, b: T.DataType | None) -> T.DataType | None:
    if a is None or b is None or a == b:
        return b if a is None else a
    order = [T.IntegerType(), T.LongType(), T.DoubleType()]
    if a in order and b in order:
        return order[max(order.index(a), order.index(b))]
    raise TypeMismatch(f"values of {a.simpleString()} and {b.simpleString()} in one column")


def infer_schema(rows: Sequence[Sequence]) -> T.StructType:
    """Columns ``col0``, ``col1``, ...; integers widen to long and double. All null: string."""
    width = max((len(r) for r in rows), default=0)
    fields = []
    for i in range(width):
        kind = None
        for r in rows:
            kind = _wider(kind, _type_of(r[i]) if i < len(r) else None)
        fields.append(T.StructField(f"col{i}", kind or T.StringType(), True))
    return T.StructType(fields)


def fit_row(values: Sequence, schema: T.StructType) -> tuple:
    """Pads missing trailing values with NULL and widens integers; too many values are an error."""
    if len(values) > len(schema):
        raise TypeMismatch(f"{len(values)} values for {len(schema)} columns")
    padded = list(values) + [None] * (len(schema) - len(values))
    return tuple(_fit(v, f) for v, f in zip(padded, schema.fields, strict=True))


def _fit(value, field: T.StructField):
    kind = field.dataType
    if value is None:
        return None
    if isinstance(kind, (T.DoubleType, T.FloatType)) and isinstance(value, int) and not isinstance(value, bool):
        return float(value)
    if isinstance(kind, T.TimestampType) and isinstance(value, int) and not isinstance(value, bool):
        return datetime.datetime.fromtimestamp(value / 1000, datetime.UTC)
    if isinstance(kind, T.IntegerType) and isinstance(value, int) and value not in INT_RANGE:
        raise TypeMismatch(f"{value} is out of range for column {field.name}")
    return value

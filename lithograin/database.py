"""The database: named tables, direct data access, change, indexes, SQL text."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .config import Settings
from .errors import ColumnNotFound, IndexError_, InvalidOperation, RowNotFound, TableNotFound
from .functions.aggregates import Aggregate
from .functions.predicates import Filter, between, compile_filters, equals, greater_or_equal, greater_than, is_in, less_or_equal, less_than, literal, resolve
from .operators import aggregate as agg_ops
from .operators import scan as scan_ops
from .operators.statistics import ColumnStatistics
from .plans.builder import QueryBuilder
from .plans.sql import SqlResult, execute, split_statements
from .sources.files import Files, scratch_dir
from .sources.storage import RETENTION, ROW_ID, StoredTable
from .streaming import for_each_row
from .types import infer_schema, schema_of


class Database:
    """Tables in a folder, and DataFrames that are registered beside them for reading.

    Methods that return rows return DataFrames: nothing runs before an action.
    """

    def __init__(self, spark: SparkSession, data_dir: str | None = None, settings: Settings | None = None):
        self.spark = spark
        self.settings = settings or Settings()
        self.in_memory = data_dir == ":memory:" or (data_dir is None and self.settings.storage.in_memory)
        self.data_dir = scratch_dir(spark) if self.in_memory else (data_dir or self.settings.storage.data_dir).rstrip("/")
        self.semantics = self.settings.query.semantics
        self._registered: dict[str, DataFrame] = {}
        self._cached: dict[str, DataFrame] = {}
        self._files = Files(spark)

    @classmethod
    def open(cls, spark: SparkSession, data_dir: str, settings: Settings | None = None) -> Database:
        return cls(spark, data_dir, settings)

    @classmethod
    def temporary(cls, spark: SparkSession, settings: Settings | None = None) -> Database:
        """In a shared scratch folder that goes when the driver ends."""
        return cls(spark, ":memory:", settings)

    # Tables

    def _stored(self, name: str) -> StoredTable:
        table = StoredTable(self.spark, f"{self.data_dir}/{name}")
        if not table.exists():
            if name in self._registered:
                raise InvalidOperation(f"{name} is registered for reading only")
            raise TableNotFound(name)
        return table

    def register(self, name: str, df: DataFrame) -> None:
        """A DataFrame as a table for reading."""
        self._registered[name] = df

    def list_tables(self) -> list[str]:
        stored = [n for n in self._files.children(self.data_dir) if StoredTable(self.spark, f"{self.data_dir}/{n}").exists()]
        return sorted({*stored, *self._registered})

    def table(self, name: str, with_row_id: bool = False) -> DataFrame:
        if name in self._registered:
            return self._registered[name]
        rows = self._cached[name] if name in self._cached else self._stored(name).rows()
        return rows if with_row_id else rows.drop(ROW_ID)

    def create_table(self, name: str, columns: T.StructType | Sequence[tuple[str, Any]]) -> None:
        """Creates the table, or gives an existing one the new schema."""
        table = StoredTable(self.spark, f"{self.data_dir}/{name}")
        if table.exists():
            table.set_schema(schema_of(columns))
        else:
            table.create(schema_of(columns))
        self._changed(name)

    def drop_table(self, name: str, if_exists: bool = False) -> None:
        if self._registered.pop(name, None) is not None:
            return
        try:
            self._stored(name).drop()
        except TableNotFound:
            if not if_exists:
                raise
        self._changed(name)

    def schema(self, name: str) -> T.StructType:
        return self._registered[name].schema if name in self._registered else self._stored(name).schema()

    def set_schema(self, name: str, columns: T.StructType | Sequence[tuple[str, Any]]) -> None:
        self._stored(name).set_schema(schema_of(columns))
        self._changed(name)

    def _changed(self, name: str) -> None:
        if (old := self._cached.pop(name, None)) is not None:
            old.unpersist()

    # Change

    def insert_row(self, name: str, values: Sequence) -> int:
        return self.insert_batch(name, [values])[0]

    def insert_batch(self, name: str, rows: Sequence[Sequence]) -> list[int]:
        """Row ids in order. An unknown table is created with the types of these rows."""
        table = StoredTable(self.spark, f"{self.data_dir}/{name}")
        if not table.exists():
            if name in self._registered:
                raise InvalidOperation(f"{name} is registered for reading only")
            if not rows:
                return []
            table.create(infer_schema(rows))
        ids = table.insert(rows)
        self._changed(name)
        return ids

    def insert_dataframe(self, name: str, df: DataFrame) -> None:
        """Bulk load; an unknown table gets the DataFrame's columns."""
        table = StoredTable(self.spark, f"{self.data_dir}/{name}")
        if not table.exists():
            table.create(T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema]))
        table.load(df)
        self._changed(name)

    def _condition(self, name: str, filters: Sequence[Filter]) -> Column:
        found = compile_filters(self._stored(name).rows().drop(ROW_ID), filters, self.semantics)
        return F.lit(True) if found is None else found

    def _literals(self, name: str, assignments: dict[str, Any]) -> dict[str, Column]:
        rows = self.table(name)
        named = {resolve(rows, c): v for c, v in assignments.items()}
        return {c: literal(v, rows.schema[c].dataType) for c, v in named.items()}

    def update(self, name: str, filters: Sequence[Filter], assignments: dict[str, Any]) -> int:
        """Sets columns to values where all filters hold; the number of rows that matched."""
        return self.update_where(name, self._condition(name, filters), self._literals(name, assignments))

    def delete(self, name: str, filters: Sequence[Filter] = ()) -> int:
        """Deletes where all filters hold; without filters all rows."""
        return self.delete_where(name, self._condition(name, filters))

    def update_where(self, name: str, condition: Column, assignments: dict[str, Column]) -> int:
        table = self._stored(name)
        for c in assignments:
            if c not in table.schema().names:
                raise ColumnNotFound(c)
        n = table.update(condition, assignments)
        self._changed(name)
        return n

    def delete_where(self, name: str, condition: Column) -> int:
        n = self._stored(name).delete(condition)
        self._changed(name)
        return n

    def update_row(self, name: str, row_id: int, values: Sequence) -> None:
        """New values for one row, which keeps its id."""
        if not self.update_where(name, F.col(ROW_ID) == row_id, self._literals(name, dict(zip(self.schema(name).names, values, strict=False)))):
            raise RowNotFound(f"{name} has no row {row_id}")

    def delete_by_id(self, name: str, row_id: int) -> bool:
        return self.delete_where(name, F.col(ROW_ID) == row_id) > 0

    # Reading

    def _rows_for(self, name: str, filters: Sequence[Filter]) -> DataFrame:
        """The table without the files that indexed columns' statistics rule out."""
        if name in self._registered or name in self._cached or not filters:
            return self.table(name)
        return self._stored(name).rows_for(filters, self.semantics).drop(ROW_ID)

    def scan(self, name: str, filters: Sequence[Filter] = ()) -> DataFrame:
        return scan_ops.scan(self._rows_for(name, filters), filters, semantics=self.semantics)

    def scan_with_limit(self, name: str, filters: Sequence[Filter] = (), limit: int | None = None, offset: int | None = None) -> DataFrame:
        return scan_ops.scan(self._rows_for(name, filters), filters, limit=limit, offset=offset, semantics=self.semantics)

    def scan_with_projection(self, name: str, filters: Sequence[Filter] = (), limit: int | None = None, offset: int | None = None, projection: Sequence[int | str] | None = None) -> DataFrame:
        return scan_ops.scan(self._rows_for(name, filters), filters, limit=limit, offset=offset, projection=projection, semantics=self.semantics)

    def for_each_row(self, name: str, filters: Sequence[Filter], projection: Sequence[int | str] | None, visit: Callable[[tuple], None]) -> int:
        return for_each_row(self.scan_with_projection(name, filters, projection=projection), visit)

    def get_by_id(self, name: str, row_id: int) -> tuple | None:
        found = self.table(name, True).where(F.col(ROW_ID) == row_id).drop(ROW_ID).head(1)
        return tuple(found[0]) if found else None

    def get_by_ids(self, name: str, ids: Sequence[int], filters: Sequence[Filter] = (), projection: Sequence[int | str] | None = None) -> DataFrame:
        """Rows with these ids, unknown ids left out."""
        rows = self.table(name, True).where(F.col(ROW_ID).isin(*ids) if ids else F.lit(False)).drop(ROW_ID)
        return scan_ops.scan(rows, filters, projection=projection, semantics=self.semantics)

    def count(self, name: str, filters: Sequence[Filter] = ()) -> int:
        """Without filters the manifest of a stored table knows it."""
        if not filters and name not in self._registered:
            return self._stored(name).count()
        return agg_ops.count(self._rows_for(name, filters), filters, self.semantics).first()["count"]

    def aggregate(self, name: str, group_by: Sequence[str], aggs: Sequence[Aggregate], filters: Sequence[Filter] = ()) -> DataFrame:
        """COUNT, MIN and MAX of a whole stored table come from its manifest, if the columns are indexed."""
        made = agg_ops.aggregate(self._rows_for(name, filters), group_by, aggs, filters, self.semantics)
        if not group_by and not filters and name not in self._registered:
            known = self._from_manifest(name, aggs)
            if known is not None:
                return self.spark.createDataFrame([known], made.schema)
        return made

    def _from_manifest(self, name: str, aggs: Sequence[Aggregate]) -> tuple | None:
        table = self._stored(name)
        if not aggs or any(a.kind not in ("count", "min", "max") for a in aggs):
            return None
        out = []
        for a in aggs:
            if a.column is None:
                out.append(table.count())
                continue
            if (ends := table.ends(resolve(self.table(name), a.column))) is None:
                return None
            low, high, nulls, rows = ends
            out.append({"min": low, "max": high, "count": rows - nulls}[a.kind])
        return tuple(out)

    def distinct(self, name: str, columns: Sequence[str], filters: Sequence[Filter] = ()) -> DataFrame:
        return agg_ops.distinct(self._rows_for(name, filters), columns, filters, self.semantics)

    def query(self, name: str) -> QueryBuilder:
        return QueryBuilder(name, semantics=self.semantics)

    # By one column

    def search(self, name: str, column: str, value) -> DataFrame:
        return self.scan(name, [Filter(column, equals(value))])

    def range_query(self, name: str, column: str, low, high) -> DataFrame:
        return self.scan(name, [Filter(column, between(low, high))])

    def greater(self, name: str, column: str, value, inclusive: bool = False) -> DataFrame:
        return self.scan(name, [Filter(column, (greater_or_equal if inclusive else greater_than)(value))])

    def less(self, name: str, column: str, value, inclusive: bool = False) -> DataFrame:
        return self.scan(name, [Filter(column, (less_or_equal if inclusive else less_than)(value))])

    def prefix_search(self, name: str, column: str, prefix: str) -> DataFrame:
        """Texts that begin with the prefix; wildcards in it are ordinary characters."""
        rows = self.table(name)
        return rows.where(F.col(f"`{resolve(rows, column)}`").startswith(prefix))

    def search_all(self, name: str, conditions: Sequence[Filter]) -> DataFrame:
        """Rows that meet conditions on several indexed columns."""
        return self.scan(name, conditions)

    def search_any(self, name: str, column: str, values: Sequence) -> DataFrame:
        return self.scan(name, [Filter(column, is_in(values))])

    def top_k(self, name: str, column: str, k: int, descending: bool = True) -> DataFrame:
        """The k first rows by an indexed column."""
        if name not in self._registered and column not in self.list_indexes(name):
            raise IndexError_(f"{column} has no index")
        return scan_ops.top_k(self.table(name), column, k, descending)

    # Indexes and statistics

    def create_index(self, name: str, column: str, sort: bool = False) -> None:
        """Names the column as indexed; with ``sort`` its files are rewritten in its order,
        so that range filters skip row groups."""
        table = self._stored(name)
        if column not in table.schema().names:
            raise ColumnNotFound(column)
        table.create_index(column, sort)
        self._changed(name)

    def drop_index(self, name: str, column: str) -> None:
        self._stored(name).drop_index(column)

    def rebuild_index(self, name: str, column: str) -> ColumnStatistics:
        """Sorts the files by the column again, after changes, and gives fresh statistics."""
        self._stored(name).rebuild_index(column)
        self._changed(name)
        return self.column_stats(name, column)

    def list_indexes(self, name: str) -> list[str]:
        return self._stored(name).indexes()

    def column_stats(self, name: str, column: str) -> ColumnStatistics:
        return ColumnStatistics.of(self.table(name), column)

    def estimate_rows(self, name: str, filters: Sequence[Filter] = ()) -> int:
        """Rows of the files that filters on indexed columns leave: no fewer than match. Nothing is read."""
        return self._stored(name).rows_within(filters, self.semantics)

    def table_stats(self, name: str) -> dict[str, int]:
        n = self.count(name)
        return {"total_rows": n, "active_rows": n, "bytes": 0 if name in self._registered else self._stored(name).bytes()}

    # Memory and files

    def load_to_memory(self, name: str) -> None:
        """Keeps the table's rows in executor memory until it changes."""
        if name not in self._cached:
            self._cached[name] = self._stored(name).rows().cache()

    def save(self, data_dir: str | None = None) -> None:
        """Copies all stored tables to another folder, where a table of the same name gets the rows as its next state;
        without a folder, or with its own, there is nothing to do for a database in a folder, and without one it is an
        error for a database in memory."""
        if data_dir is None:
            if self.in_memory:
                raise InvalidOperation("a database in memory needs a folder to be saved in")
            return
        if self._files.same(data_dir, self.data_dir):
            return
        for name in self.list_tables():
            if name not in self._registered:
                StoredTable(self.spark, f"{data_dir.rstrip('/')}/{name}").take_over(self._stored(name))

    def vacuum(self, name: str, retention: float = RETENTION) -> int:
        """Deletes files that only states older than ``retention`` seconds list."""
        return self._stored(name).vacuum(retention)

    def compact(self, name: str, files: int = 1) -> None:
        self._stored(name).compact(files)
        self._changed(name)

    # SQL

    def sql(self, text: str) -> SqlResult:
        """Runs all statements of the text; the result of the last one."""
        result = SqlResult("")
        for statement in split_statements(text):
            result = execute(self, statement)
        return result

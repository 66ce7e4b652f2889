"""An immutable query builder: filter, sort, offset, limit, project."""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame

from ..errors import QueryError
from ..functions.predicates import Filter, Operator
from ..operators.scan import scan

if TYPE_CHECKING:
    from ..database import Database


@dataclass(frozen=True)
class QueryBuilder:
    table: str | None = None
    filters: tuple[Filter, ...] = ()
    keys: tuple[tuple[str, bool], ...] = ()
    columns: tuple[str, ...] | None = None
    most: int | None = None
    skip: int | None = None
    semantics: str | None = None

    def from_(self, table: str) -> QueryBuilder:
        return replace(self, table=table)

    def filter(self, column: str, operator: Operator) -> QueryBuilder:
        return self.add_filter(Filter(column, operator))

    def add_filter(self, f: Filter) -> QueryBuilder:
        return replace(self, filters=(*self.filters, f))

    def add_filters(self, filters) -> QueryBuilder:
        return replace(self, filters=(*self.filters, *filters))

    def select(self, *columns: str) -> QueryBuilder:
        return replace(self, columns=columns)

    def order_by(self, column: str, descending: bool = False) -> QueryBuilder:
        return replace(self, keys=(*self.keys, (column, descending)))

    def order_by_asc(self, column: str) -> QueryBuilder:
        return self.order_by(column)

    def order_by_desc(self, column: str) -> QueryBuilder:
        return self.order_by(column, True)

    def limit(self, n: int) -> QueryBuilder:
        return replace(self, most=n)

    def offset(self, n: int) -> QueryBuilder:
        return replace(self, skip=n)

    def apply(self, df: DataFrame, semantics: str = "total") -> DataFrame:
        """The plan over a DataFrame; nothing runs yet."""
        return scan(df, self.filters, self.keys, self.most, self.skip, self.columns, self.semantics or semantics)

    def execute(self, db: Database) -> DataFrame:
        if self.table is None:
            raise QueryError("no table: call from_()")
        return self.apply(db.table(self.table), db.semantics)

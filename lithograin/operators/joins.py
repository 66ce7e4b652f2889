"""Equi joins of named inputs, left-deep and in the given order.

NULL keys join NULL keys, and filters on one input apply before the join, so outer
joins keep unmatched rows. Output columns are ``alias_column``. Catalyst and adaptive
execution choose broadcast or sort-merge, build sides and the splitting of skew.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ColumnNotFound, QueryError
from ..functions.predicates import ANSI, TOTAL, Filter, compile_operator
from .scan import filtered, ordered, paged

KINDS = {"inner": "inner", "left": "left", "right": "right"}


@dataclass(frozen=True)
class Input:
    alias: str
    df: DataFrame
    filters: tuple[Filter, ...] = ()

    def frame(self, semantics: str) -> DataFrame:
        rows = filtered(self.df, self.filters, semantics)
        return rows.select(*(F.col(f"`{c}`").alias(f"{self.alias}_{c}") for c in rows.columns))


@dataclass(frozen=True)
class JoinChain:
    first: Input
    steps: tuple[tuple[Input, str, str, str], ...] = ()
    residual: tuple[Filter, ...] = ()
    keys: tuple[tuple[str, bool], ...] = ()
    columns: tuple[str, ...] | None = None
    skip: int | None = None
    most: int | None = None
    semantics: str = TOTAL

    @classmethod
    def of(cls, df: DataFrame, alias: str, filters: Sequence[Filter] = (), semantics: str = TOTAL) -> JoinChain:
        return cls(Input(alias, df, tuple(filters)), semantics=semantics)

    def join(self, df: DataFrame, alias: str, left: str, right: str, how: str = "inner", filters: Sequence[Filter] = ()) -> JoinChain:
        """``left`` = ``right``, either way round, as ``alias.column`` or an unambiguous column."""
        if how not in KINDS:
            raise QueryError(f"unknown join {how}")
        if alias in {i.alias for i in self.inputs()}:
            raise QueryError(f"alias {alias} is taken")
        return replace(self, steps=(*self.steps, (Input(alias, df, tuple(filters)), left, right, how)))

    def inputs(self) -> list[Input]:
        return [self.first, *(s[0] for s in self.steps)]

    def where(self, *filters: Filter) -> JoinChain:
        """Filters on the joined rows."""
        return replace(self, residual=(*self.residual, *filters))

    def order_by(self, name: str, descending: bool = False) -> JoinChain:
        return replace(self, keys=(*self.keys, (name, descending)))

    def select(self, *names: str) -> JoinChain:
        return replace(self, columns=names)

    def limit(self, n: int) -> JoinChain:
        return replace(self, most=n)

    def offset(self, n: int) -> JoinChain:
        return replace(self, skip=n)

    def resolve(self, name: str, inputs: list[Input]) -> str:
        alias, dot, column = name.partition(".")
        if dot:
            if any(i.alias == alias and column in i.df.columns for i in inputs):
                return f"{alias}_{column}"
            raise ColumnNotFound(name)
        owners = [i.alias for i in inputs if name in i.df.columns]
        if len(owners) > 1:
            raise QueryError(f"column {name} is ambiguous: {', '.join(owners)}")
        if not owners:
            raise ColumnNotFound(name)
        return f"{owners[0]}_{name}"

    def joined(self) -> DataFrame:
        rows, seen = self.first.frame(self.semantics), [self.first]
        for step, left, right, how in self.steps:
            new = step.frame(self.semantics)
            both = [*seen, step]
            sides = [self.resolve(left, both), self.resolve(right, both)]
            own = [s for s in sides if s in new.columns]
            if len(own) != 1:
                raise QueryError(f"{left} = {right} must name one column of {step.alias} and one of an earlier input")
            other = next(s for s in sides if s not in own)
            a, b = rows[f"`{other}`"], new[f"`{own[0]}`"]
            if taken := set(rows.columns) & set(new.columns):
                raise QueryError(f"two inputs give a column {sorted(taken)[0]}; use another alias than {step.alias}")
            rows = rows.join(new, a == b if self.semantics == ANSI else a.eqNullSafe(b), KINDS[how])
            seen = both
        for f in self.residual:
            name = self.resolve(f.column, seen)
            rows = rows.where(compile_operator(F.col(f"`{name}`"), f.operator, rows.schema[name].dataType, self.semantics))
        return rows

    def execute(self) -> DataFrame:
        rows, all_inputs = self.joined(), self.inputs()
        rows = ordered(rows, [(self.resolve(n, all_inputs), d) for n, d in self.keys])
        rows = paged(rows, self.most, self.skip)
        if self.columns is None:
            return rows
        return rows.select(*(F.col(f"`{self.resolve(c, all_inputs)}`") for c in self.columns))

    def count(self) -> DataFrame:
        """Joined rows, whatever the limit."""
        return self.joined().agg(F.count(F.lit(1)).alias("count"))

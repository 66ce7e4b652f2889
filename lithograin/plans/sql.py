"""SQL text. Statements that Spark can't run on Parquet tables, or reads differently, are
handled here; SELECT goes to Catalyst over views of the tables it names.

Differences from Spark that are kept: CREATE TABLE takes bare VARCHAR and 64-bit FLOAT,
NULL sorts as the greatest value, DROP TABLE ignores a missing table, identifiers are case-sensitive.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager
from dataclasses import dataclass
from decimal import Decimal
from typing import TYPE_CHECKING

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ColumnNotFound, ParserError, QueryError, TableNotFound
from ..types import schema_of

if TYPE_CHECKING:
    from ..database import Database


@dataclass(frozen=True)
class Token:
    kind: str  # word, string, number, mark
    text: str
    start: int
    end: int

    def is_(self, *words: str) -> bool:
        return self.kind in ("word", "mark") and self.text.upper() in words


@dataclass(frozen=True)
class SqlResult:
    """Rows of a query, or the number of rows a statement changed, and a message."""

    message: str
    rows: DataFrame | None = None
    affected: int | None = None


def tokenize(sql: str) -> list[Token]:
    """Words, strings, numbers and marks; comments are left out."""
    out: list[Token] = []
    i, n = 0, len(sql)
    while i < n:
        c = sql[i]
        if c.isspace():
            i += 1
        elif sql.startswith("--", i):
            i = n if (j := sql.find("\n", i)) < 0 else j
        elif sql.startswith("/*", i):
            if (j := sql.find("*/", i + 2)) < 0:
                raise ParserError("a comment isn't closed")
            i = j + 2
        elif c in "'\"`":
            j = i + 1
            while j < n and sql[j] != c:
                j += 2 if sql[j] == "\\" and c != "`" else 1
            if j >= n:
                raise ParserError("a string isn't closed")
            out.append(Token("word" if c == "`" else "string", sql[i : j + 1], i, j + 1))
            i = j + 1
        elif c.isalpha() or c == "_":
            j = i
            while j < n and (sql[j].isalnum() or sql[j] == "_"):
                j += 1
            out.append(Token("word", sql[i:j], i, j))
            i = j
        elif c.isdigit():
            j = i
            while j < n and (sql[j].isdigit() or sql[j] == "."):
                j += 1
            out.append(Token("number", sql[i:j], i, j))
            i = j
        else:
            two = sql[i : i + 2]
            j = i + 2 if two in ("<=", ">=", "!=", "<>") else i + 1
            out.append(Token("mark", sql[i:j], i, j))
            i = j
    return out


def split_statements(sql: str) -> list[str]:
    """The statements between semicolons; semicolons in strings and comments don't count."""
    out, start = [], 0
    for t in tokenize(sql):
        if t.is_(";"):
            out.append(sql[start : t.start])
            start = t.end
    out.append(sql[start:])
    return [s.strip() for s in out if tokenize(s)]


def is_complete(sql: str) -> bool:
    """Whether the last token is a semicolon."""
    try:
        found = tokenize(sql)
    except ParserError:
        return False
    return bool(found) and found[-1].is_(";")


class Reader:
    """Walks the tokens of one statement."""

    def __init__(self, sql: str):
        self.sql, self.tokens, self.at = sql, tokenize(sql), 0

    def peek(self) -> Token | None:
        return self.tokens[self.at] if self.at < len(self.tokens) else None

    def accept(self, *words: str) -> bool:
        for k, w in enumerate(words):
            t = self.tokens[self.at + k] if self.at + k < len(self.tokens) else None
            if t is None or not t.is_(w):
                return False
        self.at += len(words)
        return True

    def expect(self, *words: str) -> None:
        if not self.accept(*words):
            found = self.peek()
            raise ParserError(f"expected {' '.join(words)}, found {found.text if found else 'the end'}")

    def name(self) -> str:
        t = self.peek()
        if t is None or t.kind != "word":
            raise ParserError(f"expected a name, found {t.text if t else 'the end'}")
        self.at += 1
        return t.text.strip("`")

    def until(self, *words: str) -> str:
        """The text up to one of the words outside parentheses, or to the end."""
        start, depth = self.at, 0
        while (t := self.peek()) is not None:
            if depth == 0 and t.is_(*words):
                break
            depth += t.is_("(") - t.is_(")")
            if depth < 0:
                break
            self.at += 1
        if start == self.at:
            raise ParserError("an expression is missing")
        return self.sql[self.tokens[start].start : self.tokens[self.at - 1].end]

    def end(self) -> None:
        self.accept(";")
        if (t := self.peek()) is not None:
            raise ParserError(f"unexpected {t.text}")


def order_nulls_as_greatest(sql: str) -> str:
    """Adds NULLS LAST or FIRST to the sort keys of every ORDER BY that doesn't say."""
    tokens, inserts = tokenize(sql), []
    for i, t in enumerate(tokens[:-1]):
        if not (t.is_("ORDER") and tokens[i + 1].is_("BY")):
            continue
        depth = 0
        key: list[Token] = []
        for u in [*tokens[i + 2 :], None]:
            stop = u is None or (depth == 0 and u.is_("LIMIT", "OFFSET", ",", ";", ")", "ROWS", "RANGE"))
            if stop:
                if key and not any(x.is_("NULLS") for x in key):
                    descending = key[-1].is_("DESC")
                    inserts.append((key[-1].end, " NULLS FIRST" if descending else " NULLS LAST"))
                key = []
                if u is None or not u.is_(","):
                    break
                continue
            depth += u.is_("(") - u.is_(")")
            key.append(u)
    for at, text in sorted(inserts, reverse=True):
        sql = sql[:at] + text + sql[at:]
    return sql


@contextmanager
def case_sensitive(spark):
    before = spark.conf.get("spark.sql.caseSensitive")
    spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        yield
    finally:
        spark.conf.set("spark.sql.caseSensitive", before)


def execute(db: Database, sql: str) -> SqlResult:
    """Runs one statement."""
    r = Reader(sql)
    first = r.peek()
    if first is None:
        return SqlResult("")
    try:
        match first.text.upper():
            case "SELECT" | "WITH":
                return SqlResult("", rows=_select(db, sql))
            case "INSERT":
                return _insert(db, r)
            case "UPDATE":
                return _update(db, r)
            case "DELETE":
                return _delete(db, r)
            case "CREATE":
                return _create(db, r)
            case "DROP":
                return _drop(db, r)
            case "SHOW":
                return _show(db, r)
            case "USE":
                r.expect("USE")
                name = r.name()
                r.end()
                return SqlResult(f"To use {name}, open that database.")
    except ParseException as e:
        raise ParserError(str(e).splitlines()[0]) from e
    except AnalysisException as e:
        raise QueryError(str(e).splitlines()[0]) from e
    raise ParserError(f"unexpected {first.text}")


def _select(db: Database, sql: str) -> DataFrame:
    """Tables are named by common table expressions over views of unique names, so that no view of the session's is
    replaced or seen. The plan is made at once; the views go again."""
    tokens = tokenize(sql)
    words = {t.text.strip("`") for t in tokens if t.kind == "word"}
    own = {t.text.strip("`") for t, after, mark in zip(tokens, tokens[1:], tokens[2:], strict=False) if t.kind == "word" and after.is_("AS") and mark.is_("(")}
    views = {name: f"lithograin_{uuid.uuid4().hex}" for name in db.list_tables() if name in words and name not in own}
    text = order_nulls_as_greatest(sql.strip().rstrip(";"))
    named = ", ".join(f"`{name}` AS (SELECT * FROM {view})" for name, view in views.items())
    if named:
        text = f"WITH {named}, {text[tokens[0].end - tokens[0].start :]}" if tokens[0].is_("WITH") and text[:4].upper() == "WITH" else f"WITH {named} {text}"
    try:
        for name, view in views.items():
            db.table(name).createOrReplaceTempView(view)
        with case_sensitive(db.spark):
            rows = db.spark.sql(text)
        return qualified(rows) if _is_star_of_join(tokens) else rows
    finally:
        for view in views.values():
            db.spark.catalog.dropTempView(view)


def _is_star_of_join(tokens: list[Token]) -> bool:
    """SELECT * FROM ... JOIN ..., outside parentheses."""
    if len(tokens) < 3 or not (tokens[0].is_("SELECT") and tokens[1].is_("*") and tokens[2].is_("FROM")):
        return False
    depth = 0
    for t in tokens:
        depth += t.is_("(") - t.is_(")")
        if depth == 0 and t.is_("JOIN"):
            return True
    return False


def qualified(rows: DataFrame) -> DataFrame:
    """Columns named ``alias_column`` by the input that each comes from."""
    output = rows._jdf.queryExecution().analyzed().output()
    owners = [output.apply(i).qualifier() for i in range(output.size())]
    return rows.toDF(*(f"{o.last()}_{c}" if o.nonEmpty() else c for o, c in zip(owners, rows.columns, strict=True)))


#: Words that stand for a value.
WORDS = {"TRUE": True, "FALSE": False, "NULL": None}


def _plain(text: str) -> tuple[bool, object]:
    """Whether the text is a plain literal, and its value. Anything else is for Spark to read."""
    if (word := text.upper()) in WORDS:
        return True, WORDS[word]
    if text[:1] in "'\"" and text[:1] == text[-1:] and len(text) > 1 and "\\" not in text and text[0] not in text[1:-1]:
        return True, text[1:-1]
    digits = text[1:].lstrip() if text[:1] == "-" else text
    if digits.isascii() and digits.isdigit() and len(digits) < 19:
        return True, -int(digits) if text[0] == "-" else int(digits)
    whole, dot, rest = digits.partition(".")
    if dot and (whole + rest).isascii() and (whole + rest).isdigit() and len(digits) < 17:
        return True, -float(digits) if text[0] == "-" else float(digits)
    return False, None


def _insert(db: Database, r: Reader) -> SqlResult:
    r.expect("INSERT", "INTO")
    name, columns = r.name(), None
    if r.accept("("):
        columns = [r.name()]
        while r.accept(","):
            columns.append(r.name())
        r.expect(")")
    r.expect("VALUES")
    rows = []
    while True:
        r.expect("(")
        row = [r.until(",")]
        while r.accept(","):
            row.append(r.until(","))
        r.expect(")")
        rows.append(row)
        if not r.accept(","):
            break
    r.end()
    if columns is not None and any(len(row) != len(columns) for row in rows):
        raise QueryError("as many values as columns are needed")
    values = [[_plain(v) for v in row] for row in rows]
    # Spark reads what isn't a plain literal: expressions, escapes.
    odd = {(i, j): rows[i][j] for i, row in enumerate(values) for j, (is_plain, _) in enumerate(row) if not is_plain}
    read = db.spark.range(1).select(*(F.expr(v).alias(f"v{i}_{j}") for (i, j), v in odd.items())).first() if odd else {}
    values = [[read[f"v{i}_{j}"] if (i, j) in odd else v for j, (_, v) in enumerate(row)] for i, row in enumerate(values)]
    values = [[float(v) if isinstance(v, Decimal) else v for v in row] for row in values]
    if columns is not None:
        names = db.schema(name).names
        if missing := [c for c in columns if c not in names]:
            raise ColumnNotFound(missing[0])
        values = [[dict(zip(columns, row, strict=True)).get(n) for n in names] for row in values]
    ids = db.insert_batch(name, values)
    return SqlResult(f"{len(ids)} row(s) inserted", affected=len(ids))


def _where(r: Reader):
    if r.accept("WHERE"):
        text = r.until(";")
        r.end()
        return F.coalesce(F.expr(text), F.lit(False))
    r.end()
    return F.lit(True)


def _update(db: Database, r: Reader) -> SqlResult:
    r.expect("UPDATE")
    name = r.name()
    r.expect("SET")
    sets = {}
    while True:
        column = r.name()
        r.expect("=")
        sets[column] = F.expr(r.until(",", "WHERE", ";"))
        if not r.accept(","):
            break
    condition = _where(r)
    with case_sensitive(db.spark):
        n = db.update_where(name, condition, sets)
    return SqlResult(f"{n} row(s) updated", affected=n)


def _delete(db: Database, r: Reader) -> SqlResult:
    r.expect("DELETE", "FROM")
    name = r.name()
    condition = _where(r)
    with case_sensitive(db.spark):
        n = db.delete_where(name, condition)
    return SqlResult(f"{n} row(s) deleted", affected=n)


def _create(db: Database, r: Reader) -> SqlResult:
    r.expect("CREATE")
    if r.accept("INDEX"):
        index = r.name()
        r.expect("ON")
        table = r.name()
        r.expect("(")
        column = r.name()
        r.expect(")")
        r.end()
        db.create_index(table, column)
        return SqlResult(f"Index {index} created on {table}({column})")
    r.expect("TABLE")
    name = r.name()
    r.expect("(")
    columns = []
    while True:
        column, kind = r.name(), r.name()
        if r.accept("("):  # VARCHAR(n): the length isn't enforced
            r.until(")")
            r.expect(")")
        columns.append((column, kind))
        if not r.accept(","):
            break
    r.expect(")")
    r.end()
    db.create_table(name, schema_of(columns))
    return SqlResult(f"Table {name} created")


def _drop(db: Database, r: Reader) -> SqlResult:
    r.expect("DROP", "TABLE")
    r.accept("IF", "EXISTS")
    name = r.name()
    r.end()
    try:
        db.drop_table(name)
    except TableNotFound:
        return SqlResult("")
    return SqlResult(f"Table {name} dropped")


def _show(db: Database, r: Reader) -> SqlResult:
    r.expect("SHOW")
    if r.accept("TABLES"):
        rows = [(t,) for t in db.list_tables()]
        r.end()
        return SqlResult("", rows=db.spark.createDataFrame(rows, "table_name string"))
    r.expect("DATABASES")
    r.end()
    return SqlResult("", rows=db.spark.createDataFrame([(db.data_dir,)], "database_name string"))

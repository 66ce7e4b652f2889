"""Interactive shell and script runner."""

from __future__ import annotations

import argparse
import contextlib
import sys
import time
from collections.abc import Iterable

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from .config import Settings, ShellSettings
from .database import Database
from .errors import EngineError
from .plans.sql import is_complete, split_statements, tokenize

WIDEST = 50
HELP = """.exit, .quit   leave
.help          this text
.tables        list tables
.schema TABLE  columns of a table
.stats TABLE   rows and bytes of a table
.save [DIR]    save the database
Statements end with a semicolon."""


def format_cell(value, width: int = WIDEST) -> str:
    text = "NULL" if value is None else f"{value:.2f}" if isinstance(value, float) else str(value)
    return text if len(text) <= width else text[: width - 3] + "..."


def format_rows(names: list[str], rows: Iterable[Iterable]) -> str:
    cells = [[format_cell(v) for v in row] for row in rows]
    heads = [format_cell(n) for n in names]
    widths = [max(map(len, column)) for column in zip(heads, *cells, strict=True)]
    line = "+" + "+".join("-" * (w + 2) for w in widths) + "+"

    def row(values: list[str]) -> str:
        return "|" + "|".join(f" {v:<{w}} " for v, w in zip(values, widths, strict=True)) + "|"

    return "\n".join([line, row(heads), line, *(row(c) for c in cells), line])


@contextlib.contextmanager
def history(settings: ShellSettings):
    """Lines of earlier sessions, where the terminal library is there; the last ones are kept."""
    try:
        import readline
    except ImportError:
        yield
        return
    with contextlib.suppress(OSError):
        readline.read_history_file(settings.history_file)
    readline.set_history_length(settings.max_history_size)
    try:
        yield
    finally:
        with contextlib.suppress(OSError):
            readline.write_history_file(settings.history_file)


class Shell:
    def __init__(self, db: Database, out=None):
        self.db, self.out = db, out or sys.stdout
        self.limited = False  # whether the statement at hand has a LIMIT

    def say(self, text: str) -> None:
        print(text, file=self.out)

    def show(self, df: DataFrame) -> None:
        """At most ``default_limit`` rows of the settings are shown; the statement's own LIMIT may ask for more, up to ``max_limit``."""
        limits = self.db.settings.query
        most = limits.max_limit if self.limited else limits.default_limit
        rows = df.take(most + 1)
        self.say(format_rows(df.columns, rows[:most]))
        self.say(f"{len(rows)} row(s)" if len(rows) <= most else f"first {most} rows")

    def run_statement(self, sql: str) -> bool:
        began = time.monotonic()
        try:
            result = self.db.sql(sql)
            self.limited = any(t.is_("LIMIT") for t in tokenize(sql))
            if result.rows is not None:
                self.show(result.rows)
            elif result.message:
                self.say(result.message)
        except (EngineError, PySparkException) as e:
            self.say(f"Error: {type(e).__name__}: {str(e).splitlines()[0]}")
            return False
        self.say(f"({(time.monotonic() - began) * 1000:.2f}ms)")
        return True

    def run_command(self, line: str) -> bool:
        """A line that begins with a dot; False ends the shell."""
        name, *rest = line[1:].split() or [""]
        try:
            match name.lower():
                case "exit" | "quit":
                    return False
                case "help":
                    self.say(HELP)
                case "tables":
                    self.say("\n".join(self.db.list_tables()) or "no tables")
                case "schema" if rest:
                    self.say(format_rows(["column", "type"], [(f.name, f.dataType.simpleString()) for f in self.db.schema(rest[0])]))
                case "stats" if rest:
                    self.say(format_rows(["statistic", "value"], self.db.table_stats(rest[0]).items()))
                case "schema" | "stats":
                    self.say(f"Usage: .{name.lower()} TABLE")
                case "save":
                    self.db.save(*rest[:1])
                    self.say("saved")
                case _:
                    self.say(f"unknown command .{name}; try .help")
        except EngineError as e:
            self.say(f"Error: {type(e).__name__}: {e}")
        return True

    def run_script(self, text: str) -> bool:
        """All statements; dot commands may stand on lines of their own. False if any failed."""
        ok, buffer = True, []
        for line in [*text.splitlines(), ".flush"]:
            if line.startswith("."):
                for statement in split_statements("\n".join(buffer)):
                    ok = self.run_statement(statement) and ok
                buffer = []
                if line != ".flush" and not self.run_command(line):
                    break
            else:
                buffer.append(line)
        return ok

    def loop(self, read=input, remember: bool | None = None) -> None:
        """Until a command ends it. Lines from the terminal are remembered for later sessions."""
        with history(self.db.settings.repl) if remember or (remember is None and read is input) else contextlib.nullcontext():
            self._loop(read)

    def _loop(self, read) -> None:
        buffer = ""
        while True:
            try:
                line = read("      ...> " if buffer else self.db.settings.repl.prompt)
            except (EOFError, KeyboardInterrupt):
                break
            if not buffer and line.strip().startswith("."):
                if not self.run_command(line.strip()):
                    break
                continue
            buffer += line + "\n"
            if is_complete(buffer):
                for statement in split_statements(buffer):
                    self.run_statement(statement)
                buffer = ""


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="lithograin", description="SQL over Parquet tables, on Spark")
    parser.add_argument("script", nargs="?", help="file with SQL to run instead of the shell")
    parser.add_argument("--data-dir", help="folder of the tables")
    parser.add_argument("--memory", action="store_true", help="tables in a scratch folder")
    parser.add_argument("--config", help="JSON file with settings")
    given = parser.parse_args(args)
    settings = Settings.load(given.config) if given.config else Settings()
    spark = SparkSession.builder.appName("lithograin").getOrCreate()
    shell = Shell(Database(spark, ":memory:" if given.memory else given.data_dir, settings))
    if given.script:
        with open(given.script) as f:
            return 0 if shell.run_script(f.read()) else 1
    shell.loop()
    return 0

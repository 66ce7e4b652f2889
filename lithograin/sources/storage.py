"""A table: immutable Parquet files in parts, and numbered manifests that list the current ones.

An insert adds a part. An update or delete rewrites only the files that hold matching
rows. Each change writes the next manifest; readers take the latest, so they see a
whole change or none of it. Of two writers the second one fails to write the same number, and
changes nothing. No change deletes a file: readers of an older state keep what they read
until ``vacuum`` is called.

A manifest knows the rows of every file, and the least and greatest value and the NULLs of its
indexed columns, so that filters on those skip files before they are opened.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterable, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import IndexError_, TableNotFound, TypeMismatch
from ..functions.predicates import TOTAL, Filter, resolve
from ..types import fit_row
from .files import Files

ROW_ID = "_row_id"
#: Rows of an inserted batch that share a file.
ROWS_PER_FILE = 250_000
#: Seconds that ``vacuum`` leaves a state that is no longer the current one.
RETENTION = 7 * 24 * 3600
#: Characters of a value that a manifest holds; of a column with a longer one it knows nothing.
LONGEST = 256
#: Types whose least and greatest values a manifest holds.
ORDERED = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.StringType, T.BooleanType)


def _may_hold(stats: dict, op, semantics: str) -> bool:
    """Whether a file with these statistics can hold a matching row; yes where that isn't known."""
    low, high, nulls = stats["min"], stats["max"], stats["nulls"]
    with_nulls = semantics == TOTAL and nulls > 0

    def meets(least, greatest) -> bool:
        try:
            return low is not None and not (least is not None and high < least) and not (greatest is not None and low > greatest)
        except TypeError:
            return True

    match op.kind:
        case "eq":
            return nulls > 0 if op.value is None else meets(op.value, op.value)
        case "in":
            return any(nulls > 0 if v is None else meets(v, v) for v in op.values)
        case "between" if None not in op.values:
            return meets(*op.values)
        case "gt" | "ge" if op.value is not None:
            return with_nulls or meets(op.value, None)
        case "lt" | "le" if op.value is not None:
            return meets(None, op.value)
        case "is_null":
            return nulls > 0
    return True


class StoredTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.files = spark, path.rstrip("/"), Files(spark)

    # Manifest

    def _versions(self) -> list[int]:
        return sorted(int(n[1:-5]) for n in self.files.children(f"{self.path}/manifests") if n.startswith("m") and n.endswith(".json"))

    def _manifest_path(self, version: int) -> str:
        return f"{self.path}/manifests/m{version:010d}.json"

    def exists(self) -> bool:
        return bool(self._versions())

    def manifest(self) -> dict:
        found = self._versions()
        if not found:
            raise TableNotFound(self.path.rpartition("/")[2])
        return self.files.read_json(self._manifest_path(found[-1])) | {"version": found[-1]}

    def _commit(self, manifest: dict, **changes) -> None:
        new = {k: v for k, v in (manifest | changes).items() if k != "version"}
        self.files.write_json(self._manifest_path(manifest.get("version", -1) + 1), new)

    def vacuum(self, retention: float = RETENTION) -> int:
        """Deletes states that aren't the current one and are older than ``retention`` seconds, and the files that only
        they list; the number of files. What no manifest ever listed stays: it may be a writer's that hasn't finished."""
        versions = self._versions()
        oldest = time.time() - retention
        old = [v for v in versions[:-1] if self.files.modified(self._manifest_path(v)) <= oldest]
        kept = {f["path"] for v in versions if v not in old for f in self.files.read_json(self._manifest_path(v))["files"]}
        gone = {f["path"] for v in old for f in self.files.read_json(self._manifest_path(v))["files"]} - kept
        for path in sorted(gone):
            self.files.delete(f"{self.path}/parts/{path}")
        for part in {p.partition("/")[0] for p in gone} - {p.partition("/")[0] for p in kept}:
            if not any(n.endswith(".parquet") for n in self.files.children(f"{self.path}/parts/{part}")):
                self.files.delete(f"{self.path}/parts/{part}")
        for v in old:
            self.files.delete(self._manifest_path(v))
        return len(gone)

    # Schema

    def create(self, schema: T.StructType) -> None:
        if ROW_ID in schema.names:
            raise TypeMismatch(f"{ROW_ID} is the engine's own column")
        self._commit({"files": [], "schema": schema.json(), "indexes": [], "next_id": 1})

    def set_schema(self, schema: T.StructType) -> None:
        """New names and types for the same columns; stored values are cast when read."""
        m = self.manifest()
        if m["files"] and len(schema) < len(self.schema(m)):
            raise TypeMismatch("a table that has rows can't lose columns")
        indexes = [c for c in m["indexes"] if c in schema.names]
        if not m["files"]:
            self._commit(m, schema=schema.json(), indexes=indexes)
            return
        old = self.schema(m)
        columns = [F.col(f"`{o.name}`").cast(n.dataType).alias(n.name) for o, n in zip(old, schema, strict=False)]
        columns += [F.lit(None).cast(n.dataType).alias(n.name) for n in schema.fields[len(old) :]]
        changed = m | {"schema": schema.json(), "indexes": indexes}
        self._commit(changed, files=self._write(self.rows(m).select(ROW_ID, *columns), changed))

    def schema(self, manifest: dict | None = None) -> T.StructType:
        return T.StructType.fromJson(json.loads((manifest or self.manifest())["schema"]))

    # Rows

    def _stored_schema(self, manifest: dict) -> T.StructType:
        return T.StructType([T.StructField(ROW_ID, T.LongType()), *self.schema(manifest).fields])

    def rows(self, manifest: dict | None = None, files: Iterable[dict] | None = None) -> DataFrame:
        """All columns, the row id first."""
        m = manifest or self.manifest()
        chosen = m["files"] if files is None else list(files)
        schema = self._stored_schema(m)
        if not chosen:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/parts/{f['path']}" for f in chosen))

    def _files_for(self, m: dict, filters: Sequence[Filter], semantics: str) -> list[dict]:
        named = self.spark.createDataFrame([], self.schema(m))
        tests = [(resolve(named, f.column), f.operator) for f in filters]
        return [f for f in m["files"] if all(c not in f["stats"] or _may_hold(f["stats"][c], op, semantics) for c, op in tests)]

    def rows_for(self, filters: Sequence[Filter], semantics: str = TOTAL) -> DataFrame:
        """The rows of the files that can hold matches of all filters."""
        m = self.manifest()
        return self.rows(m, self._files_for(m, filters, semantics))

    def rows_within(self, filters: Sequence[Filter], semantics: str = TOTAL) -> int:
        m = self.manifest()
        return sum(f["rows"] for f in self._files_for(m, filters, semantics))

    def ends(self, column: str) -> tuple[Any, Any, int, int] | None:
        """Least and greatest value, NULLs and rows of an indexed column, from the manifest; None if it doesn't know."""
        m = self.manifest()
        known = [f["stats"].get(column) for f in m["files"]]
        if not known or not all(known):
            return None
        low = [s["min"] for s in known if s["min"] is not None]
        high = [s["max"] for s in known if s["max"] is not None]
        if any(isinstance(x, float) for x in (*low, *high)):
            return None  # not every fraction survives being written as text and NaN has its own order
        return min(low, default=None), max(high, default=None), sum(s["nulls"] for s in known), sum(f["rows"] for f in m["files"])

    def count(self) -> int:
        return sum(f["rows"] for f in self.manifest()["files"])

    def _write(self, df: DataFrame, manifest: dict) -> list[dict]:
        """Writes a part and describes its files."""
        part = f"p-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/parts/{part}")
        names = sorted(n for n in self.files.children(f"{self.path}/parts/{part}") if n.endswith(".parquet"))
        return self._describe(manifest, [f"{part}/{n}" for n in names], manifest["indexes"])

    def _describe(self, manifest: dict, paths: Sequence[str], columns: Sequence[str]) -> list[dict]:
        """Rows, greatest row id and statistics of ``columns`` of each file: a scan of those columns only, one row a file comes back."""
        if not paths:
            return []
        schema = self._stored_schema(manifest)
        kinds = {f.name: f.dataType for f in schema}
        ordered = [c for c in columns if isinstance(kinds.get(c), ORDERED)]
        rows = self.spark.read.schema(schema).parquet(*(f"{self.path}/parts/{p}" for p in paths))
        own = [g(F.col(f"`{c}`")) for c in ordered for g in (F.min, F.max, lambda x: F.count_if(x.isNull()))]
        found = {r[0]: tuple(r)[1:] for r in rows.groupBy(self._file_column()).agg(F.count(F.lit(1)), F.max(ROW_ID), *own).collect()}
        out = []
        for p in paths:
            n, top, *rest = found.get(p, (0, 0, *[None, None, 0] * len(ordered)))
            stats = {c: dict(zip(("min", "max", "nulls"), rest[3 * k : 3 * k + 3], strict=True)) for k, c in enumerate(ordered)}
            out.append({"path": p, "rows": n, "top": top, "stats": {c: x for c, x in stats.items() if max(len(str(x["min"])), len(str(x["max"]))) <= LONGEST}})
        return [f for f in out if f["rows"]]

    @staticmethod
    def _file_column() -> Column:
        return F.regexp_extract(F.input_file_name(), r"/parts/(p-[0-9a-f]+/[^/]+)$", 1).alias("file")

    def insert(self, rows: Sequence[Sequence]) -> list[int]:
        m = self.manifest()
        if not rows:
            return []
        schema, first = self.schema(m), m["next_id"]
        data = [(first + i, *fit_row(r, schema)) for i, r in enumerate(rows)]
        files = -(-len(data) // ROWS_PER_FILE)
        added = self._write(self.spark.createDataFrame(data, self._stored_schema(m)).coalesce(files), m)
        self._commit(m, files=[*m["files"], *added], next_id=first + len(rows))
        return list(range(first, first + len(rows)))

    def load(self, df: DataFrame) -> None:
        """Appends a DataFrame by column position; ids are unique, not gapless."""
        m = self.manifest()
        schema = self.schema(m)
        if len(df.columns) != len(schema):
            raise TypeMismatch(f"{len(df.columns)} columns for {len(schema)}")
        columns = [F.col(f"`{c}`").cast(f.dataType).alias(f.name) for c, f in zip(df.columns, schema, strict=True)]
        added = self._write(df.select((F.monotonically_increasing_id() + m["next_id"]).alias(ROW_ID), *columns), m)
        self._commit(m, files=[*m["files"], *added], next_id=max([m["next_id"], *(f["top"] + 1 for f in added)]))

    def _matches(self, m: dict, condition: Column) -> dict[str, int]:
        """Matching rows of each file that has any: one row a file comes to the driver."""
        if not m["files"]:
            return {}
        return {r["file"]: r["n"] for r in self.rows(m).where(condition).groupBy(self._file_column()).agg(F.count(F.lit(1)).alias("n")).collect()}

    def update(self, condition: Column, assignments: dict[str, Column]) -> int:
        m = self.manifest()
        hit = self._matches(m, condition)
        known = {f.name: f.dataType for f in self.schema(m)}
        if hit and assignments:
            # All assignments see the row as it was.
            columns = [F.when(condition, assignments[c].cast(t)).otherwise(F.col(f"`{c}`")).alias(c) if c in assignments else F.col(f"`{c}`") for c, t in known.items()]
            self._replace(m, hit, self._of(m, hit).select(ROW_ID, *columns))
        return sum(hit.values())

    def delete(self, condition: Column) -> int:
        m = self.manifest()
        hit = self._matches(m, condition)
        if hit:
            self._replace(m, hit, self._of(m, hit).where(~F.coalesce(condition, F.lit(False))))
        return sum(hit.values())

    def _of(self, m: dict, paths: Iterable[str]) -> DataFrame:
        chosen = set(paths)
        return self.rows(m, [f for f in m["files"] if f["path"] in chosen])

    def _replace(self, m: dict, old: dict[str, int], rows: DataFrame) -> None:
        self._commit(m, files=[*(f for f in m["files"] if f["path"] not in old), *self._write(rows, m)])

    def compact(self, files: int = 1) -> None:
        """All files become about ``files`` files."""
        m = self.manifest()
        if m["files"]:
            self._commit(m, files=self._write(self.rows(m).coalesce(files), m))

    def take_over(self, other: StoredTable) -> None:
        """The rows, schema and indexes of another table, as the next state of this one."""
        theirs = other.manifest()
        mine = self.manifest() if self.exists() else {}
        new = {k: theirs[k] for k in ("schema", "indexes", "next_id")}
        self._commit(mine | new, files=self._write(other.rows(theirs), new) if theirs["files"] else [])

    def bytes(self) -> int:
        return sum(self.files.size(f"{self.path}/parts/{f['path']}") for f in self.manifest()["files"])

    # Indexes: names and statistics in the manifest, and a rewrite sorted by the column for better pruning

    def indexes(self) -> list[str]:
        return self.manifest()["indexes"]

    def create_index(self, column: str, sort: bool = False) -> None:
        m = self.manifest()
        if column in m["indexes"]:
            raise IndexError_(f"an index on {column} exists")
        m["indexes"] = [*m["indexes"], column]
        if sort and m["files"]:
            self._commit(m, files=self._write_sorted(m, column))
            return
        own = {f["path"]: f["stats"] for f in self._describe(m, [f["path"] for f in m["files"]], [column])}
        self._commit(m, files=[f | {"stats": f["stats"] | own.get(f["path"], {})} for f in m["files"]])

    def _write_sorted(self, m: dict, column: str) -> list[dict]:
        """Files that hold ranges of the column, each sorted by it."""
        key = F.col(f"`{column}`").asc_nulls_last()
        return self._write(self.rows(m).repartitionByRange(key).sortWithinPartitions(key), m)

    def rebuild_index(self, column: str) -> None:
        m = self.manifest()
        if column not in m["indexes"]:
            raise IndexError_(f"no index on {column}")
        if m["files"]:
            self._commit(m, files=self._write_sorted(m, column))

    def drop_index(self, column: str) -> None:
        m = self.manifest()
        if column not in m["indexes"]:
            raise IndexError_(f"no index on {column}")
        files = [f | {"stats": {c: s for c, s in f["stats"].items() if c != column}} for f in m["files"]]
        self._commit(m, indexes=[c for c in m["indexes"] if c != column], files=files)

    def drop(self) -> None:
        self.files.delete(self.path)

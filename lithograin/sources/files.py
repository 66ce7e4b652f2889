"""File operations through Spark's own file systems, so that any store it reads will do."""

from __future__ import annotations

import atexit
import json
import re
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

from ..errors import StorageError

_scratch: list[tuple[SparkSession, str]] = []


class Files:
    def __init__(self, spark: SparkSession):
        self._context = spark.sparkContext
        self._jvm = self._context._jvm

    def _path(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self, path: str):
        return self._path(path).getFileSystem(self._context._jsc.hadoopConfiguration())

    def exists(self, path: str) -> bool:
        return self._fs(path).exists(self._path(path))

    def delete(self, path: str) -> None:
        self._fs(path).delete(self._path(path), True)

    def children(self, path: str) -> list[str]:
        if not self.exists(path):
            return []
        return sorted(s.getPath().getName() for s in self._fs(path).listStatus(self._path(path)))

    def read_json(self, path: str) -> dict:
        stream = self._fs(path).open(self._path(path))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def write_json(self, path: str, value: dict) -> None:
        """Written beside and then renamed, so that a reader finds a whole file. An error if the file is there already."""
        beside = f"{path}.{uuid.uuid4().hex}"
        stream = self._fs(path).create(self._path(beside), True)
        try:
            stream.write(bytearray(json.dumps(value).encode()))
        finally:
            stream.close()
        none = self._context._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        where = self._path(path)
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs(path).getUri(), self._context._jsc.hadoopConfiguration())
        try:
            context.rename(self._path(beside), where, none)  # never over a file that is there
        except Py4JJavaError as e:
            self.delete(beside)
            raise StorageError(f"{path} could not be written; another writer may have been first") from e

    def modified(self, path: str) -> float:
        """Seconds since the epoch."""
        return self._fs(path).getFileStatus(self._path(path)).getModificationTime() / 1000

    def same(self, one: str, other: str) -> bool:
        """Whether two paths name one place."""
        return self._fs(one).makeQualified(self._path(one)).equals(self._fs(other).makeQualified(self._path(other)))

    def size(self, path: str) -> int:
        return self._fs(path).getContentSummary(self._path(path)).getLength() if self.exists(path) else 0


def _remove_scratch() -> None:
    for spark, path in _scratch:
        if spark.sparkContext._jsc is not None:
            Files(spark).delete(path)
    _scratch.clear()


def scratch_dir(spark: SparkSession) -> str:
    """A new folder that driver and executors share, removed when the driver ends. Where ``spark.checkpoint.dir`` is
    unset, a local session gets a temporary one; on a cluster that is an error, because no machine's own folder is shared."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise StorageError(f"spark.checkpoint.dir must name a folder that all machines of {spark.sparkContext.master} share")
        base = "file://" + tempfile.mkdtemp(prefix="lithograin-")
        spark.conf.set("spark.checkpoint.dir", base)
    if not _scratch:
        atexit.register(_remove_scratch)
    path = f"{base.rstrip('/')}/lithograin-db-{uuid.uuid4().hex}"
    _scratch.append((spark, path))
    return path

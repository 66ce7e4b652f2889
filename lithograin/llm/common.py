"""Helpers that the training-data operators share.

* ``materialize`` cuts lineage with a Parquet table in the shared checkpoint folder.
* ``TextBatch`` splits a whole Arrow batch of texts into words with numpy, without
  a Python object per word.
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import re
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The ASCII white space of the word rule ``[^\x20\x09-\x0D]+``.
ASCII_SPACE = " \t\n\x0b\x0c\r"
CHECKPOINT_KEY = "spark.checkpoint.dir"

#: Folders that are still there, and the folder that a frame reads.
_written: dict[str, SparkSession] = {}
_path_of: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the test tables, by Spark's own reader (any file system)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where it is unset, a local session gets a
    temporary one; on a cluster that is an error, because no machine's own folder is shared."""
    found = spark.conf.get(CHECKPOINT_KEY, None)
    if not found:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise RuntimeError(f"{CHECKPOINT_KEY} must name a folder that all machines of {master} share")
        found = "file://" + tempfile.mkdtemp(prefix="lithograin-checkpoint-")
        spark.conf.set(CHECKPOINT_KEY, found)
    return found


def _delete(spark: SparkSession, path: str) -> None:
    context = spark.sparkContext
    if context._jsc is not None:
        where = context._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)


def _remove_written() -> None:
    for path, spark in _written.items():
        _delete(spark, path)
    _written.clear()


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, so that a lost executor
    costs a re-read and not a re-computation. Removed by ``release``, or when the driver ends."""
    spark = df.sparkSession
    if not _written:
        atexit.register(_remove_written)
    path = f"{shared_dir(spark).rstrip('/')}/lithograin-{name}-{uuid.uuid4().hex}"
    _written[path] = spark
    df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    _path_of[found] = path
    return found


def release(*frames: DataFrame) -> None:
    """Deletes what ``materialize`` wrote for these frames, when nothing that is still to run reads it."""
    for df in frames:
        path = _path_of.pop(df, None)
        if path is not None and (spark := _written.pop(path, None)) is not None:
            _delete(spark, path)


#: Ids that are broadcast at most (16 bytes each); more are joined by a shuffle.
BROADCAST_IDS = 1 << 21


def few(ids: DataFrame, most: int = BROADCAST_IDS) -> DataFrame:
    """The same rows, to be broadcast if they are counted and few."""
    return F.broadcast(ids) if ids.count() <= most else ids


#: Bytes of a batch that is handed to Python, where the session doesn't set it. By rows alone a batch of long texts has no bound.
BATCH_KEY, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def bound_batches(df: DataFrame) -> None:
    """Bounds the batches of texts that executors hand to Python workers."""
    if not df.sparkSession._jsparkSession.sessionState().conf().contains(BATCH_KEY):
        df.sparkSession.conf.set(BATCH_KEY, str(BATCH_BYTES))


_kept: dict[str, object] = {}


def kept_by_worker(owner: str, make: Callable[[], object] = lambda: None) -> object:
    """What a Python worker keeps for later tasks of one operator. Workers outlive tasks; one that turns to another
    operator gives back what the last one kept, so that a pipeline's stages don't add up in its memory."""
    if owner not in _kept:
        _kept.clear()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL(None).malloc_trim(0)
        _kept[owner] = make()
    return _kept[owner]


def text_or_empty(text: str | Column = "text") -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def _ascii_lower_table() -> np.ndarray:
    lut = np.arange(256, dtype=np.uint8)
    lut[65:91] += 32
    return lut


LOWER = _ascii_lower_table()
LOWER_BYTES = LOWER.tobytes()


def _space_table() -> np.ndarray:
    lut = np.zeros(256, dtype=bool)
    lut[[ord(c) for c in ASCII_SPACE]] = True
    return lut


SPACE = _space_table()


def _non_alnum_table() -> np.ndarray:
    """Bytes that end a word of the rule ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``."""
    lut = np.ones(256, dtype=bool)
    lut[0x30:0x3A] = False
    lut[0x61:0x7B] = False
    lut[0x80:] = False
    return lut


NON_ALNUM = _non_alnum_table()

_BASE = 0x9E3779B97F4A7C15 | 1


def _powers(n: int, base: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, by doubling."""
    out = np.ones(max(n, 1), dtype=np.uint64)
    have, step = 1, np.uint64(base)
    with np.errstate(over="ignore"):
        while have < n:
            take = min(have, n - have)
            out[have : have + take] = out[:take] * step
            have += take
            step = step * step
    return out


_INVERSE = pow(_BASE, -1, 1 << 64)
BLOCK_BYTES = 1 << 20
_tables: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, kept for blocks of the usual size."""
    if n > BLOCK_BYTES:
        return _powers(n, _BASE), _powers(n, _INVERSE)
    if not _tables:
        _tables.extend((_powers(BLOCK_BYTES, _BASE), _powers(BLOCK_BYTES, _INVERSE)))
    return _tables[0], _tables[1]


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(31))
        x = x * np.uint64(0x7FB5D329728EA185)
        x = x ^ (x >> np.uint64(27))
        x = x * np.uint64(0x81DADEF4BC2DD44D)
        return x ^ (x >> np.uint64(33))


class TextBatch:
    """The words of many texts at once.

    ``data``: lower-cased UTF-8 bytes of all texts; ``bounds``: where each text
    begins (one more at the end); ``starts``/``ends``: byte range of each word;
    ``doc``: the text of each word; ``first``: each text's first word (one more at
    the end). A word never spans two texts. Null texts count as empty.
    """

    def __init__(self, texts: pa.Array, separators: np.ndarray = SPACE):
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        if texts.null_count:
            texts = texts.fill_null("")
        wide = pa.types.is_large_string(texts.type)
        kind = np.int64 if wide else np.int32
        n = len(texts)
        _, offsets, data = texts.buffers()
        bounds = np.frombuffer(offsets, dtype=kind, count=n + 1, offset=texts.offset * np.dtype(kind).itemsize).astype(np.int64) if n else np.zeros(1, np.int64)
        raw = np.frombuffer(data, dtype=np.uint8)[bounds[0] : bounds[-1]] if data is not None and n else np.empty(0, np.uint8)
        self.raw = raw
        self.bounds = bounds - bounds[0]
        self.data = LOWER[raw]
        size = len(raw)
        inside = np.empty(size + 2, dtype=np.int8)
        inside[0] = inside[-1] = 0
        np.logical_not(separators[self.data], out=inside[1:-1].view(bool))
        edge = np.diff(inside)
        begins = np.flatnonzero(edge == 1)
        ends = np.flatnonzero(edge == -1)
        cuts = np.unique(self.bounds[1:-1])
        cuts = cuts[(cuts > 0) & (cuts < size)]
        if len(cuts):  # where two texts touch without white space, the word is cut
            cut = cuts[(inside[cuts] == 1) & (inside[cuts + 1] == 1)]
            begins = np.sort(np.concatenate([begins, cut]))
            ends = np.sort(np.concatenate([ends, cut]))
        self.starts, self.ends = begins, ends
        self.first = np.searchsorted(begins, self.bounds, side="left")
        self.counts = np.diff(self.first)
        self.n = n

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(self.n), self.counts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word: a polynomial in an odd base modulo 2**64 from a
        running sum over the bytes, then a finaliser with the word's length. Done in blocks
        of about a megabyte, so that a very long text needs no more memory at once."""
        out = np.empty(len(self.starts), dtype=np.uint64)
        at = 0
        while at < len(out):
            low = int(self.starts[at])
            to = max(at + 1, int(np.searchsorted(self.ends, low + BLOCK_BYTES, side="right")))
            starts, ends = self.starts[at:to] - low, self.ends[at:to] - low
            n = int(ends[-1])
            power, back = _power_tables(n)
            with np.errstate(over="ignore"):
                total = np.zeros(n + 1, dtype=np.uint64)
                np.cumsum((self.data[low : low + n].astype(np.uint64) + np.uint64(1)) * power[:n], out=total[1:])
                value = (total[ends] - total[starts]) * back[starts]
                out[at:to] = mix64(value + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
            at = to
        return out


def text_pieces(batch: pa.RecordBatch, column: int, max_bytes: int = 1 << 20, max_rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``max_bytes`` of text each, one row at least."""
    sizes = np.nan_to_num(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False)).astype(np.int64)
    group, at = np.cumsum(sizes) // max_bytes, 0
    while at < batch.num_rows:
        to = min(at + max_rows, max(at + 1, int(np.searchsorted(group, group[at], side="right"))))
        yield batch.slice(at, to - at)
        at = to


def hash_words(words: list[str], separators: np.ndarray = SPACE) -> np.ndarray:
    """Hashes of single words, equal to those of ``TextBatch``."""
    batch = TextBatch(pa.array(words, pa.string()), separators)
    if len(batch.starts) != len(words):
        raise ValueError("each entry must be one word")
    return batch.hashes()

"""Sequence packing by the sum-of-squares rule.

A document's token ids are cut into whole windows plus one rest. A rest goes to the
fill level where the squared counts of partially filled windows grow least; a level
array holds those counts. Each task packs its own documents. When it ends, or when
too many windows are open, open windows are closed by cutting pieces to fill them
up; what is left at the end becomes windows of powers of two, which need no padding.
"""

from __future__ import annotations

import os
import string
import zlib
from collections.abc import Iterator
from struct import pack

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, kept_by_worker, text_or_empty, text_pieces

WINDOW = 1024
#: The separator id that ends every document.
END_ID = 0
#: Open windows of a task before some are closed early; bounds a task's memory.
OPEN_LIMIT = 16384
#: Chunks of each of two generations whose ids a Python worker remembers, and bytes of a chunk; they bound its memory.
CACHE_LIMIT = 200_000
CACHE_BYTES = 64
#: New chunks that are encoded at once, end to end.
RUN = 256
#: ASCII letters, and ASCII symbols but for the apostrophe, which the splitting rule joins with some letters after it.
LETTER, SYMBOL = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
LETTER[list(string.ascii_letters.encode())] = True
SYMBOL[list(string.punctuation.replace("'", "").encode())] = True
#: Sequence ids of task k start at k << TASK_BITS.
TASK_BITS = 38


def _wide_space(data: np.ndarray) -> np.ndarray:
    """Where a white-space character beyond ASCII begins in UTF-8 bytes."""
    found = np.zeros(len(data), dtype=bool)
    lead = np.flatnonzero((data == 0xC2) | ((data >= 0xE1) & (data <= 0xE3)))
    if len(lead):
        padded = np.append(data, [0, 0])
        code = (padded[lead].astype(np.int64) << 16) | (padded[lead + 1].astype(np.int64) << 8) | padded[lead + 2]
        two = np.isin(code >> 8, [0xC285, 0xC2A0])
        three = np.isin(code, [0xE19A80, *range(0xE28080, 0xE2808B), 0xE280A8, 0xE280A9, 0xE280AF, 0xE2819F, 0xE38080])
        found[lead[two | three]] = True
    return found


class ChunkTokenizer:
    """Token ids of whole texts, by a ``tokenizers`` file.

    The tokenizer's splitting rule never joins what stands before a blank or a line break with
    what follows it, unless white space touches white space. So a text without such places
    is a series of chunks (a separator and a word; the first has no separator) that are
    encoded once each and remembered. Nor does it join an ASCII letter with a symbol after it, so symbols that end a word after
    a letter are a chunk of their own. Any other text is one chunk, encoded whole.
    For the same reason new chunks with a separator are encoded many at a time, end to end, which takes about half the
    time: the tokens that start with a separator are where chunks start, because no chunk has white space further on.
    """

    def __init__(self, path: str, cache_limit: int = CACHE_LIMIT):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.encoder = Tokenizer.from_file(path)
        self.young: dict[bytes, bytes] = {}  # what was asked for lately; the older ones are forgotten together
        self.old: dict[bytes, bytes] = {}
        self.limit = cache_limit
        marks = tuple(piece[0] for piece, _ in self.encoder.pre_tokenizer.pre_tokenize_str(" ") + self.encoder.pre_tokenizer.pre_tokenize_str("\n"))
        vocabulary = self.encoder.get_vocab()
        self.begins = np.zeros(max(vocabulary.values()) + 1, dtype=bool)  # by id: a token that starts with a separator
        self.begins[[i for token, i in vocabulary.items() if token.startswith(marks)]] = True

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.encoder.encode_batch_fast(texts, add_special_tokens=False)]

    def _chunk_ids(self, chunks: list[bytes], parted: list[bool]) -> list[bytes]:
        """Ids of chunks; ``parted`` marks those that are a separator and a word."""
        out: list[bytes] = [b""] * len(chunks)
        many = [i for i, c in enumerate(chunks) if parted[i] and len(c) <= CACHE_BYTES]
        apart = set(many)
        alone = [i for i in range(len(chunks)) if i not in apart]
        for at in range(0, len(many), RUN):
            group = many[at : at + RUN]
            ids = np.array(self._whole([b"".join([chunks[i] for i in group]).decode()])[0], dtype="<u4")
            cuts = np.flatnonzero(self.begins[ids])
            if len(cuts) != len(group):
                alone += group
                continue
            data, bounds = ids.tobytes(), [*(4 * cuts).tolist(), 4 * len(ids)]
            for i, start, end in zip(group, bounds[:-1], bounds[1:], strict=True):
                out[i] = data[start:end]
        for at in range(0, len(alone), RUN):
            group = alone[at : at + RUN]
            for i, ids in zip(group, self._whole([chunks[i].decode() for i in group]), strict=True):
                out[i] = pack(f"<{len(ids)}I", *ids)
        return out

    @staticmethod
    def chunks(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """All texts cut into chunks end to end, and each text's first chunk (one more at the end)."""
        data, bounds = _bytes_of(texts)
        n = len(bounds) - 1
        blank = (data == 32) | (data == 10)
        space = blank | ((data >= 9) & (data <= 13)) | ((data >= 28) & (data <= 31)) | _wide_space(data)
        # A place that keeps its text whole: white space at either end or beside white space, other white space, a special token's mark.
        odd = space & ~blank
        if len(data):
            odd[1:] |= space[1:] & space[:-1]
            odd[1:] |= (data[:-1] == 60) & (data[1:] == 124)
            filled = bounds[1:] > bounds[:-1]
            for edge in (bounds[:-1][filled], bounds[1:][filled] - 1):
                odd[edge] |= space[edge]
        count = np.concatenate([[0], np.cumsum(odd)])
        whole = count[bounds[1:]] > count[bounds[:-1]]
        del count
        begins = np.flatnonzero(blank)
        begins = begins[~whole[np.searchsorted(bounds, begins, side="right") - 1]]
        starts = np.sort(np.concatenate([bounds[:-1][bounds[1:] > bounds[:-1]], begins]))
        ends = np.append(starts[1:], len(data))[: len(starts)]
        last = np.arange(len(data), dtype=np.int32)
        last[SYMBOL[data]] = 0
        last = np.maximum.accumulate(last, out=last)[ends - 1]  # what stands before the symbols at a chunk's end
        tails = last[(last + 1 < ends) & (last >= starts) & LETTER[data[last]]] + 1
        tails = tails[~whole[np.searchsorted(bounds, tails, side="right") - 1]]
        starts = np.sort(np.concatenate([starts, tails]))
        first = np.searchsorted(starts, bounds, side="left")
        offsets = np.append(starts, len(data)).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)]), first

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and where each text's begin (one more at the end)."""
        chunks, first = self.chunks(texts)
        if not len(chunks):
            return np.zeros(0, dtype="<u4"), np.zeros(len(first), dtype=np.int64)
        coded = chunks.dictionary_encode()
        which = coded.indices.to_numpy()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        ids = list(map(self.young.get, distinct))
        missing = [i for i, found in enumerate(ids) if found is None]
        if len(self.young) + len(missing) > self.limit:
            self.young, self.old = {}, self.young
        for i in missing:
            ids[i] = self.old.get(distinct[i])
        new = [i for i in missing if ids[i] is None]
        _, offsets, data = chunks.buffers()
        lead = np.frombuffer(data, dtype=np.uint8)[np.frombuffer(offsets, dtype=np.int32)[:-1]]
        inner = (lead == 32) | (lead == 10)
        inner[first[:-1][first[1:] > first[:-1]]] = False  # a text's first chunk may be the whole text
        parted = np.zeros(len(distinct), dtype=bool)
        parted[which[inner]] = True
        for i, made in zip(new, self._chunk_ids([distinct[i] for i in new], parted[new].tolist()), strict=True):
            ids[i] = made
        for i in missing:
            if len(distinct[i]) <= CACHE_BYTES:
                self.young[distinct[i]] = ids[i]
        sizes = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 4
        joined = np.frombuffer(b"".join(ids), dtype="<u4")
        take = sizes[which]
        ends = np.cumsum(take)
        shift = (np.cumsum(sizes) - sizes)[which] - (ends - take)
        return joined[np.repeat(shift, take) + np.arange(int(ends[-1]))], np.append(0, ends)[first]


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, and where each begins (one more at the end)."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    bounds = np.append(0, np.cumsum(sizes))
    _, offsets, data = texts.buffers()
    if data is None or not bounds[-1]:
        return np.zeros(0, np.uint8), bounds
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    begin = int(np.frombuffer(offsets, dtype=kind)[texts.offset])
    return np.frombuffer(data, dtype=np.uint8)[begin : begin + int(bounds[-1])], bounds


def worker_tokenizer(path: str) -> ChunkTokenizer:
    """One per worker process, so that later tasks of a worker find the chunks of earlier ones."""
    return kept_by_worker(f"packing {path}", lambda: ChunkTokenizer(path))


class LevelPacker:
    """Packs (key, ids) online; ``out`` gets (key, start, ids, total, sequence, offset)."""

    def __init__(self, window: int = WINDOW, first_sequence: int = 0, open_limit: int = OPEN_LIMIT):
        self.window, self.next, self.limit = window, first_sequence, open_limit
        self.levels = np.zeros(window + 1, dtype=np.int64)  # open windows by fill; 0 and full stay 0
        self.open: list[list[list]] = [[] for _ in range(window)]  # by fill: stacks of windows, each a list of pieces
        self.n_open = 0
        self.out: list[tuple] = []

    def _close(self, pieces: list) -> None:
        offset = 0
        for key, start, ids, total in pieces:
            self.out.append((key, start, ids, total, self.next, offset))
            offset += len(ids) // 4
        self.next += 1

    def _level_for(self, size: int) -> int:
        """The fill level (0: a new window) whose choice makes the sum of squares least;
        a fuller window on ties."""
        top = self.window - size
        counts = self.levels
        change = 2 * counts[size : self.window + 1] + 1  # level l -> l + size, for l = 0 .. top
        change[top] = 0  # a full window is no longer partially filled
        change[1:] -= 2 * counts[1 : top + 1] - 1
        change[1:][counts[1 : top + 1] == 0] = np.iinfo(np.int64).max
        return top - int(np.argmin(change[::-1]))

    def add(self, key: int, ids: bytes) -> None:
        total, step = len(ids) // 4, self.window * 4
        at = 0
        while len(ids) - at >= step:
            self._close([(key, at // 4, ids[at : at + step], total)])
            at += step
        if at < len(ids):
            self._place((key, at // 4, ids[at:], total))
            if self.n_open > self.limit:
                self._merge(self.n_open // 2)

    def _place(self, piece: tuple) -> None:
        size = len(piece[2]) // 4
        level = self._level_for(size)
        pieces = []
        if level:
            pieces = self.open[level].pop()
            self.levels[level] -= 1
            self.n_open -= 1
        pieces.append(piece)
        filled = level + size
        if filled == self.window:
            self._close(pieces)
        else:
            self.open[filled].append(pieces)
            self.levels[filled] += 1
            self.n_open += 1

    def _merge(self, most: int | None = None) -> None:
        """Close open windows: cut their pieces end to end into whole windows. With ``most`` so many of
        them, the fullest ones, and what doesn't fill a window is open again; else all of them, and the
        last windows are powers of two."""
        last = most is None
        left_over = self.n_open if last else most
        pieces: list[tuple] = []
        for level in range(self.window - 1, 0, -1):
            stack = self.open[level]
            while stack and left_over:
                pieces += stack.pop()
                self.levels[level] -= 1
                self.n_open -= 1
                left_over -= 1
        left = sum(len(p[2]) for p in pieces) // 4
        row: list[tuple] = []
        room = self._room(left, last)
        for key, start, ids, total in pieces:
            while ids:
                take = min(room, len(ids) // 4)
                row.append((key, start, ids[: take * 4], total))
                start, ids, room, left = start + take, ids[take * 4 :], room - take, left - take
                if room == 0:
                    self._close(row)
                    row, room = [], self._room(left, last)
        if row:
            filled = sum(len(p[2]) for p in row) // 4
            self.open[filled].append(row)
            self.levels[filled] += 1
            self.n_open += 1

    def _room(self, left: int, last: bool) -> int:
        if left >= self.window or not last or left == 0:
            return self.window
        return 1 << (left.bit_length() - 1)

    def finish(self) -> None:
        self._merge()

    def take(self) -> list[tuple]:
        done, self.out = self.out, []
        return done


def pack_documents(docs: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text", window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """One row per piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text is its end id alone. Repeated rows are packed as often as they
    occur. An empty table gives no pieces. Other columns are ignored. ``sequence_id`` is
    unique over all tasks; a task that is run again packs the same rows alike.
    """
    bound_batches(docs)
    kind = docs.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    end = np.asarray([end_id], dtype="<u4").tobytes()

    def pack_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        packer = LevelPacker(window, (task.partitionId() if task else 0) << TASK_BITS)
        encoder = None

        def rows() -> Iterator[pa.RecordBatch]:
            done = packer.take()
            for i in range(0, len(done), 20_000):
                part = done[i : i + 20_000]
                keys, starts, ids, totals, sequences, offsets = zip(*part, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(keys, batch_kind),
                        pa.array(starts, pa.int64()),
                        pa.array([len(x) // 4 for x in ids], pa.int64()),
                        pa.array([zlib.crc32(x) for x in ids], pa.int64()),
                        pa.array(totals, pa.int64()),
                        pa.array(sequences, pa.int64()),
                        pa.array(offsets, pa.int64()),
                    ],
                    names=[key, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
                )

        batch_kind = None
        for batch in batches:
            encoder = encoder or worker_tokenizer(tokenizer_path)
            batch_kind = batch.schema.field(0).type
            for piece in text_pieces(batch, 1, max_bytes=1 << 20, max_rows=4096):
                ids, first = encoder.encode(piece.column(1))
                data, cuts = ids.tobytes(), (4 * first).tolist()
                for k, a, b in zip(piece.column(0).to_pylist(), cuts[:-1], cuts[1:], strict=True):
                    packer.add(k, data[a:b] + end)
                yield from rows()
        packer.finish()
        if batch_kind is not None:
            yield from rows()

    return docs.select(F.col(key), text_or_empty(text).alias(text)).mapInArrow(pack_task, schema)

"""Language-model scoring: a hashed maximum-entropy model with a class-factored softmax.

P(token | context) = P(class | context) * P(slot | class, context) [* P(rare word | slot)].

* A class is a range of word endings that holds as many of the frequent words as any other. P(class | context) is a softmax
  over weights of context features: the last anchor word (a skip feature), the
  word before (bigram) and the two words before (trigram).
* A slot is a frequent word of the class, or its rare words together. P(slot | class, context) is a softmax
  over slot weights and those of the anchor and the word before in that class.
* A rare word's share of its slot is its add-one frequency, with room for one unseen word.

Bigram and trigram features are hashes of whole words, of rare ones too; the rows that they are hashed
to grow with the square root of the training tokens.

Training is iterative scaling in synchronous rounds. Tasks count, for every feature row, which targets stood there; these
counts, summed over the whole corpus, are the observed side of all rounds. The first update starts from weights without
context, whose expectation follows from the priors; every weight moves by the logarithm of observed over expected, damped
where a row was seen rarely, and by a fixed step. Each further round passes over all training texts again, sums
what the model with all its features together expects in every row, and moves every weight by the logarithm of
observed over expected, divided by the number of features that act at once, so that a round doesn't lower the likelihood of
the training texts but for the damping. Both sums are whole numbers (probabilities in 4096ths, rounded up or down by a hash, so
that small ones aren't lost), so the weights don't depend on how texts are dealt to tasks. Passes over texts multiply rows of exponentials
(``Factors``), in numpy batches. Words that aren't among the bounded number of frequent ones get their counts by a join.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER_BYTES, TextBatch, bound_batches, hash_words, kept_by_worker, materialize, mix64, text_or_empty, text_pieces


@dataclass(frozen=True)
class LmConfig:
    #: Class 0 is the end of a text; slots of a class, the last one for its rare words.
    classes: int = 32
    slots: int = 64
    #: Most words whose counts every task holds.
    known: int = 1 << 18
    #: The most frequent words that count as anchors, and how far back one is looked for.
    anchors: int = 62
    reach: int = 8
    #: Rows of a hashed feature: this times the square root of the training tokens, to a power of two. The bounds are
    #: for a task's memory, 512 bytes a row; the upper one is met by 17 billion tokens.
    rows_per_root: int = 8
    least_rows: int = 1 << 10
    most_rows: int = 1 << 20
    #: Expected occurrences that are added to the observed ones of a row.
    damping: float = 30.0
    #: Step of each feature: class by anchor, bigram, trigram; slot by anchor, bigram.
    steps: tuple[float, ...] = (0.6, 0.7, 0.5, 0.6, 0.7)
    #: Rounds after the first update, each a pass over the training texts.
    rounds: int = 0
    #: Distinct tokens a counting task holds before it hands them on.
    flush: int = 500_000

    @property
    def contexts(self) -> int:
        return self.anchors + 2  # none seen, none near

    @property
    def head(self) -> int:
        """Most words with a slot of their own."""
        return (self.classes - 1) * (self.slots - 1)

    def rows(self, tokens: int) -> int:
        wanted = self.rows_per_root * math.isqrt(max(tokens, 1))
        return min(self.most_rows, max(self.least_rows, self.classes, 1 << (wanted.bit_length() - 1)))


#: What ``score_texts`` trains by unless it is told otherwise.
TRAINED = LmConfig(rounds=1)

END = b""
#: Bytes of a word's end that its class is found by.
ENDING = 8


def ending_keys(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The last bytes of words as numbers that sort like the words read backwards."""
    key = np.zeros(len(starts), dtype=np.uint64)
    for j in range(ENDING):
        at = ends - 1 - j
        byte = np.where(at >= starts, data[np.maximum(at, 0)] if len(data) else 0, 0)
        key |= byte.astype(np.uint64) << np.uint64(8 * (ENDING - 1 - j))
    return key


def keys_of(tokens: list[bytes]) -> np.ndarray:
    ends = np.cumsum([len(t) for t in tokens], dtype=np.int64)
    data = np.frombuffer(b"".join(tokens), dtype=np.uint8)
    return ending_keys(data, np.append(0, ends[:-1]), ends) if tokens else np.zeros(0, np.uint64)


def token_counts(docs: DataFrame, text: str, config: LmConfig) -> DataFrame:
    """token (bytes; empty: the end), n: counts over all texts, merged by aggregation."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(found: Counter) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], names=["token", "n"])

        found: Counter = Counter()
        for batch in batches:
            for value in batch.column(0).to_pylist():
                found.update(value.encode().translate(LOWER_BYTES).split())
                if len(found) > config.flush:
                    yield rows(found)
                    found = Counter()
            found[END] += batch.num_rows
        yield rows(found)

    return docs.select(text_or_empty(text).alias(text)).mapInArrow(count, "token binary, n long").where("n > 0").groupBy("token").agg(F.sum("n").alias("c"))


class WordIndex:
    """Rank of a word by its hash: open addressing, all words of a batch at once."""

    def __init__(self, hashes: np.ndarray):
        size = 1 << max(4, int(2 * len(hashes)).bit_length())
        self.mask = np.uint64(size - 1)
        self.keys, self.rank = np.zeros(size, dtype=np.uint64), np.full(size, -1, dtype=np.int32)
        left = np.arange(len(hashes))
        at = (hashes & self.mask).astype(np.int64)
        while len(left):
            free = self.rank[at[left]] < 0
            _, chosen = np.unique(at[left][free], return_index=True)
            put = left[free][chosen]
            self.keys[at[put]], self.rank[at[put]] = hashes[put], put
            done = np.zeros(len(hashes), dtype=bool)
            done[put] = True
            left = left[~done[left]]
            at[left] = (at[left] + 1) & int(self.mask)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Rank, or -1."""
        at = (hashes & self.mask).astype(np.int64)
        out = self.rank[at]
        wrong = np.flatnonzero((out >= 0) & (self.keys[at] != hashes))
        while len(wrong):
            at[wrong] = (at[wrong] + 1) & int(self.mask)
            out[wrong] = self.rank[at[wrong]]
            wrong = wrong[(out[wrong] >= 0) & (self.keys[at[wrong]] != hashes[wrong])]
        return out


@dataclass
class Vocabulary:
    """Bounded part of the vocabulary, most frequent first, and totals over all of it."""

    index: WordIndex
    counts: np.ndarray
    n_head: int
    head_class: np.ndarray  # class and slot of the frequent words
    head_slot: np.ndarray
    bounds: np.ndarray  # ending from which class 2, 3, ... begins
    end_count: int
    total: int
    distinct: int
    rare_total: np.ndarray  # by class: occurrences and number of words without a slot of their own
    rare_distinct: np.ndarray

    def rare_class(self, keys: np.ndarray) -> np.ndarray:
        return 1 + np.searchsorted(self.bounds, keys, side="right")


def class_bounds(keys: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class and slot of each frequent word by its ending, in runs of one length, and where the runs after the first begin."""
    order = np.argsort(keys, kind="stable")
    run = max(1, -(-len(keys) // (classes - 1)))
    cls, slot = np.zeros(len(keys), dtype=np.int32), np.zeros(len(keys), dtype=np.int32)
    cls[order], slot[order] = 1 + np.arange(len(keys)) // run, np.arange(len(keys)) % run
    return cls, slot, keys[order][run::run]


def fit_vocabulary(counts: DataFrame, config: LmConfig) -> tuple[Vocabulary, int]:
    """Vocabulary, and the least count of the words in it. Cut-offs are whole count
    levels, found from a histogram, so that ties never depend on an order."""
    words = counts.where(F.octet_length("token") > 0)
    level = F.when(F.col("c") < 4096, F.col("c")).otherwise(F.floor(F.log2(F.col("c")) * 512))  # 12 * 512 = 6144: exact below, bounded above
    bins = sorted(((r["least"], r["n"]) for r in words.groupBy(level.alias("level")).agg(F.min("c").alias("least"), F.count(F.lit(1)).alias("n")).collect()), reverse=True)

    def least_count(most: int) -> int:
        taken, least = 0, (bins[0][0] + 1 if bins else 1)
        for low, n in bins:
            if taken + n > most:
                break
            taken, least = taken + n, low
        return least

    known_from, head_from = least_count(config.known), least_count(config.head)
    top = words.where(F.col("c") >= known_from).toArrow()
    tokens, c = top.column("token").to_pylist(), top.column("c").to_numpy()
    order = np.lexsort((np.array(tokens, dtype=object), -c)) if len(tokens) else np.zeros(0, np.int64)
    tokens, c = [tokens[i] for i in order], c[order]
    n_head = int((c >= head_from).sum())
    cls, slot, bounds = class_bounds(keys_of(tokens[:n_head]), config.classes)
    overall = counts.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v"), F.sum(F.when(F.octet_length("token") == 0, F.col("c"))).alias("ends")).first()
    hashes = hash_words([t.decode() for t in tokens]) if tokens else np.zeros(0, np.uint64)
    vocabulary = Vocabulary(WordIndex(hashes), c.astype(np.float64), n_head, cls, slot, bounds, overall["ends"] or 0, overall["n"] or 0, overall["v"], np.zeros(config.classes), np.zeros(config.classes))

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = 1 + np.searchsorted(bounds, keys_of(batch.column(0).to_pylist()), side="right")
            n = np.bincount(k, weights=batch.column(1).to_numpy(), minlength=config.classes)
            v = np.bincount(k, minlength=config.classes)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(config.classes)), pa.array(n.astype(np.int64)), pa.array(v.astype(np.int64))], names=["k", "n", "v"])

    for r in words.where(F.col("c") < head_from).select("token", "c").mapInArrow(rare, "k long, n long, v long").groupBy("k").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect():
        vocabulary.rare_total[r["k"]], vocabulary.rare_distinct[r["k"]] = r["n"], r["v"]
    return vocabulary, known_from


@dataclass
class TokenBatch:
    """Tokens of many texts, each text followed by its end."""

    batch: TextBatch
    hashes: np.ndarray  # of words only
    where: np.ndarray  # position of each word among the tokens
    rank: np.ndarray  # -1: end; -2: not among the known words
    cls: np.ndarray
    slot: np.ndarray
    features: list[np.ndarray]  # feature rows: class by anchor, bigram, trigram; slot by anchor, bigram
    first: np.ndarray  # first token of each text (one more at the end)


def token_batch(texts: pa.Array, vocabulary: Vocabulary, config: LmConfig) -> TokenBatch:
    batch = TextBatch(texts)
    hashes = batch.hashes()
    n = len(hashes) + batch.n
    where = np.arange(len(hashes)) + batch.doc()
    first = np.append(0, batch.first[1:] + np.arange(batch.n) + 1)
    found = vocabulary.index.find(hashes)
    head = (found >= 0) & (found < vocabulary.n_head)
    cls, slot = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    rare = np.flatnonzero(~head)
    cls[where[rare]] = vocabulary.rare_class(ending_keys(batch.data, batch.starts[rare], batch.ends[rare]))
    slot[where[rare]] = config.slots - 1
    common = np.flatnonzero(head)
    cls[where[common]], slot[where[common]] = vocabulary.head_class[found[common]], vocabulary.head_slot[found[common]]
    rank = np.full(n, -1, dtype=np.int64)
    rank[where] = np.where(found < 0, -2, found)
    position = np.arange(n)
    begin = np.repeat(first[:-1], np.diff(first))
    anchor = np.where((rank >= 0) & (rank < min(config.anchors, vocabulary.n_head)), position, -1)
    previous = np.append(-1, np.maximum.accumulate(anchor)[:-1])
    near = (previous >= begin) & (position - previous <= config.reach)
    context = np.where(near, rank[np.maximum(previous, 0)], np.where(position == begin, config.anchors, config.anchors + 1))
    word = np.zeros(n, dtype=np.uint64)
    word[where] = hashes
    one, two = np.ones(n, dtype=np.uint64), np.ones(n, dtype=np.uint64)  # 1: before the text
    one[1:] = word[:-1]
    two[2:] = word[:-2]
    one[position == begin] = 1
    two[position <= begin + 1] = 1
    rows = config.rows(vocabulary.total)
    own = rows // config.classes  # rows of each class
    with np.errstate(over="ignore"):
        bigram = mix64(one)
        trigram = mix64(one * np.uint64(0x9E3779B97F4A7C15) + two)
    features = [context, (bigram & np.uint64(rows - 1)).astype(np.int64), (trigram & np.uint64(rows - 1)).astype(np.int64), cls * config.contexts + context, cls * own + ((bigram >> np.uint64(32)) % np.uint64(own)).astype(np.int64)]
    return TokenBatch(batch, hashes, where, rank, cls, slot, features, first)


def table_shapes(rows: int, config: LmConfig) -> list[tuple[int, int]]:
    """Rows and targets of each feature's table."""
    c, s = config.classes, config.slots
    return [(config.contexts, c), (rows, c), (rows, c), (c * config.contexts, s), (rows // c * c, s)]


@dataclass
class MaxEnt:
    """Logarithms of the priors, and a table of weights for each feature (its step is in them)."""

    class_prior: np.ndarray
    slot_prior: np.ndarray  # classes x slots; a slot that isn't used has a very small one
    tables: list[np.ndarray]

    def log_classes(self, t: TokenBatch) -> np.ndarray:
        z = self.tables[0][t.features[0]]
        z += self.tables[1][t.features[1]]
        z += self.tables[2][t.features[2]]
        z += self.class_prior
        return _log_softmax(z)

    def log_slots(self, t: TokenBatch, cls: np.ndarray | None = None) -> np.ndarray:
        z = self.tables[3][t.features[3]]
        z += self.tables[4][t.features[4]]
        z += self.slot_prior[t.cls if cls is None else cls]
        return _log_softmax(z)

    def log_probabilities(self, t: TokenBatch) -> np.ndarray:
        """Of each token's class and slot, natural."""
        at = np.arange(len(t.cls))
        return self.log_classes(t)[at, t.cls].astype(np.float64) + self.log_slots(t)[at, t.slot]


def _log_softmax(z: np.ndarray) -> np.ndarray:
    z -= z.max(axis=1, keepdims=True)
    z -= np.log(np.exp(z).sum(axis=1, keepdims=True))
    return z


UNUSED = -1e9


def priors(vocabulary: Vocabulary, config: LmConfig) -> tuple[np.ndarray, np.ndarray]:
    """Logarithms of P(class) and P(slot | class) without context."""
    mass = np.zeros((config.classes, config.slots))
    mass[vocabulary.head_class, vocabulary.head_slot] = vocabulary.counts[: vocabulary.n_head]
    mass[1:, -1] = (vocabulary.rare_total + vocabulary.rare_distinct + 1)[1:]
    mass[0, 0] = vocabulary.end_count + 1
    with np.errstate(divide="ignore"):
        slot = np.maximum(np.log(mass) - np.log(mass.sum(axis=1, keepdims=True)), UNUSED)
    return np.log(mass.sum(axis=1) / mass.sum()).astype(np.float32), slot.astype(np.float32)


#: Probabilities are summed in this unit, tokens are weighed at once, and a row's sums are handed on from this on.
UNIT, CHUNK, FULL = 1 << 12, 1 << 11, 1 << 30
#: Tables of the class softmax and of the slot softmax.
CLASS_TABLES, SLOT_TABLES = (0, 1, 2), (3, 4)
#: Logarithm of the least factor beside its row's greatest, and the products that 32 bits are trusted with.
LEAST_FACTOR, LEAST_PRODUCT = -80.0, 1e-30


@dataclass
class Factors:
    """A model for passes over texts: its weights as exponentials, a table for each feature, a row's greatest 1,
    the priors in the first table of each softmax. A softmax is a product of rows over its sum, so that no token needs
    an exponential. Slots that aren't used are 0 in their first table. Products that 32 bits don't hold are made again from logarithms."""

    tables: list[np.ndarray]

    @classmethod
    def of(cls, model: MaxEnt) -> Factors:
        slot_prior = np.repeat(model.slot_prior, len(model.tables[3]) // len(model.slot_prior), axis=0)
        out = []
        for k, weights in enumerate(model.tables):
            prior = {0: model.class_prior[None], 3: slot_prior}.get(k)
            z = weights.copy() if prior is None else weights + prior
            z -= z.max(axis=1, keepdims=True)
            np.maximum(z, LEAST_FACTOR, out=z)
            np.exp(z, out=z)
            if prior is not None:
                z *= prior > UNUSED / 2
            out.append(z)
        return cls(out)

    def products(self, features: list[np.ndarray], tables: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers in proportion to each token's probabilities, and their sums."""
        first, *others = tables
        z = self.tables[first].take(features[first], axis=0)
        for k in others:
            z *= self.tables[k].take(features[k], axis=0)
        return z, np.einsum("ij->i", z)  # the same sums as ``z.sum(axis=1)``, faster for short rows

    def logs(self, features: list[np.ndarray], tables: tuple[int, ...], at: np.ndarray) -> np.ndarray:
        """Logarithms of the products of some tokens, their greatest 0."""
        with np.errstate(divide="ignore"):
            z = sum(np.log(self.tables[k][features[k][at]].astype(np.float64)) for k in tables)
        return z - z.max(axis=1, keepdims=True)

    def probabilities(self, features: list[np.ndarray], tables: tuple[int, ...], unit: float = 1.0) -> np.ndarray:
        """Of all targets, times ``unit``."""
        z, total = self.products(features, tables)
        low = np.flatnonzero(total < LEAST_PRODUCT)
        if len(low):
            z[low] = np.exp(self.logs(features, tables, low))
            total[low] = z[low].sum(axis=1)
        z *= (np.float32(unit) / total)[:, None]
        return z

    def log_probabilities(self, t: TokenBatch) -> np.ndarray:
        """Of each token's class and slot, natural."""
        out = np.zeros(len(t.cls))
        for at in range(0, len(out), CHUNK):
            part = slice(at, at + CHUNK)
            features = [f[part] for f in t.features]
            for tables, target in ((CLASS_TABLES, t.cls[part]), (SLOT_TABLES, t.slot[part])):
                z, total = self.products(features, tables)
                own = z[np.arange(len(target)), target].astype(np.float64)
                low = np.flatnonzero(own < LEAST_PRODUCT)
                own[low] = 1.0
                found = np.log(own) - np.log(total, dtype=np.float64, where=total > 0, out=np.zeros(len(total)))
                if len(low):
                    logs = self.logs(features, tables, low)
                    found[low] = logs[np.arange(len(low)), target[low]] - np.log(np.exp(logs).sum(axis=1))
                out[part] += found
        return out


def summed_rows(docs: DataFrame, text: str, total: int, config: LmConfig, tally) -> list[np.ndarray]:
    """A table (rows x targets) for each feature: what ``tally`` adds up over all texts.

    ``tally(pieces, tables, hand_on)`` fills a task's tables of 32-bit whole numbers; ``hand_on(k, rows)`` gives the
    batches that hand on rows of table k. Every task sends its tables, so there are no more tasks than
    cores call for (two each) unless the texts are several times larger than the tables."""
    shapes = table_shapes(config.rows(total), config)
    width = math.gcd(config.classes, config.slots)  # targets in a line that is sent
    lines = [rows * targets // width for rows, targets in shapes]
    names = ["line", *(f"w{i}" for i in range(width))]
    most = max(2 * docs.sparkSession.sparkContext.defaultParallelism, total // sum(rows * targets for rows, targets in shapes))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_by_worker("language model")
        tables = [np.zeros(shape, dtype=np.int32) for shape in shapes]

        def hand_on(k: int, rows: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
            own, a_row = tables[k].reshape(-1, width), shapes[k][1] // width
            held = np.arange(len(own)) if rows is None else (rows[:, None] * a_row + np.arange(a_row)).ravel()
            held = held[own[held].any(axis=1)]
            for at in range(0, len(held), 20_000):
                part = held[at : at + 20_000]
                yield pa.RecordBatch.from_arrays([pa.array((part + sum(lines[:k])).astype(np.int32)), *(pa.array(np.ascontiguousarray(own[part, i])) for i in range(width))], names=names)

        yield from tally((piece.column(0) for batch in batches for piece in text_pieces(batch, 0, max_bytes=1 << 19)), tables, hand_on)
        for k in range(len(tables)):
            yield from hand_on(k)

    gathered = docs.select(text_or_empty(text).alias(text)).coalesce(most).mapInArrow(task, "line int, " + ", ".join(f"w{i} int" for i in range(width)))
    merged = gathered.groupBy("line").agg(*(F.sum(c).cast("float").alias(c) for c in names[1:])).toArrow()
    line = merged.column("line").to_numpy()
    flat = np.zeros((sum(lines), width), dtype=np.float32)
    for i in range(width):
        flat[line, i] = merged.column(f"w{i}").to_numpy()
    ends = np.cumsum(lines)
    return [flat[end - n : end].reshape(shape) for end, n, shape in zip(ends, lines, shapes, strict=True)]


def observed_counts(docs: DataFrame, text: str, shared, config: LmConfig) -> list[np.ndarray]:
    """How often each target stood in each feature row."""

    def tally(pieces, tables, hand_on):
        vocabulary = shared.value
        for texts in pieces:
            t = token_batch(texts, vocabulary, config)
            one = np.ones(len(t.cls), dtype=np.int32)  # of the tables' type, which numpy adds several times as fast as a plain 1
            for k, own in enumerate(tables):
                np.add.at(own.reshape(-1), t.features[k] * own.shape[1] + (t.cls if k < 3 else t.slot), one)
        yield from ()

    return summed_rows(docs, text, shared.value.total, config, tally)


def expected_counts(docs: DataFrame, text: str, shared, config: LmConfig) -> list[np.ndarray]:
    """How often the model expects each target in each feature row, summed over the contexts of all texts."""

    def tally(pieces, tables, hand_on):
        vocabulary, factors = shared.value
        held = [np.zeros(len(own), dtype=np.int32) for own in tables]  # tokens in a row's sums
        # Two sums at once where targets are even in number: no sum reaches the 32nd bit.
        sums = [own.view(np.int64 if own.shape[1] % 2 == 0 else np.int32) for own in tables]
        steps = [np.arange(own.shape[1]) for own in sums]
        for texts in pieces:
            whole = token_batch(texts, vocabulary, config)
            place = np.arange(len(whole.cls)) - np.repeat(whole.first[:-1], np.diff(whole.first))
            drawn = mix64((whole.features[1].astype(np.uint64) << np.uint64(40)) ^ (whole.features[2].astype(np.uint64) << np.uint64(20)) ^ place.astype(np.uint64))
            drawn = (drawn >> np.uint64(40)).astype(np.float32)[:, None] / np.float32(1 << 24)
            for at in range(0, len(place), CHUNK):
                features = [f[at : at + CHUNK] for f in whole.features]
                one = np.ones(len(features[0]), dtype=np.int32)
                parts = []
                for softmax in (CLASS_TABLES, SLOT_TABLES):
                    z = factors.probabilities(features, softmax, UNIT)
                    z += drawn[at : at + CHUNK]
                    parts.append(z.astype(np.int32))
                for k, own in enumerate(tables):
                    places = features[k][:, None] * sums[k].shape[1] + steps[k]
                    np.add.at(sums[k].reshape(-1), places.ravel(), parts[k >= 3].view(sums[k].dtype).ravel())
                    np.add.at(held[k], features[k], one)
                    full = held[k][features[k]] >= FULL // (UNIT + 1)
                    if full.any():
                        rows = np.unique(features[k][full])
                        yield from hand_on(k, rows)
                        own[rows] = 0
                        held[k][rows] = 0

    tables = summed_rows(docs, text, shared.value[0].total, config, tally)
    for own in tables:
        own /= UNIT
    return tables


def train_model(docs: DataFrame, text: str, shared, config: LmConfig) -> MaxEnt:
    """Weights from counts of targets by feature row: the first update, then rounds against what the model expects."""
    vocabulary = shared.value
    observed = observed_counts(docs, text, shared, config)
    class_prior, slot_prior = priors(vocabulary, config)

    def prior_of(k: int) -> np.ndarray:
        return class_prior[None] if k < 3 else np.repeat(slot_prior, len(observed[k]) // config.classes, axis=0)

    model = MaxEnt(class_prior, slot_prior, [step_of(own, prior_of(k), config.damping, config.steps[k]) for k, own in enumerate(observed)])
    for _ in range(config.rounds):
        sent = docs.sparkSession.sparkContext.broadcast((vocabulary, Factors.of(model)))
        expected = expected_counts(docs, text, sent, config)
        for k, weights in enumerate(model.tables):
            weights += scaling(observed[k], expected[k], prior_of(k), config.damping, 3 if k < 3 else 2)
        sent.destroy()
    return model


def scaling(observed: np.ndarray, expected: np.ndarray, log_prior: np.ndarray, damping: float, active: int) -> np.ndarray:
    """What a round adds: log(observed / expected), both damped alike, over the number of features that act at once."""
    added = np.maximum(damping * np.exp(log_prior), 1e-30)
    out = np.log(observed + added)
    out -= np.log(expected + added)
    out *= np.where(log_prior > UNUSED / 2, np.float32(1 / active), np.float32(0))
    return out


def step_of(observed: np.ndarray, log_prior: np.ndarray, damping: float, step: float) -> np.ndarray:
    """Weights after one update from none: the step times log(observed / expected), both damped alike."""
    prior = np.exp(log_prior)
    out = observed + damping * prior
    out /= observed.sum(axis=1, keepdims=True) + damping
    np.log(np.maximum(out, 1e-30), out=out)
    out -= np.maximum(log_prior, math.log(1e-30))
    out *= np.where(log_prior > UNUSED / 2, step, 0)
    return out


def learn(docs: DataFrame, text: str, config: LmConfig) -> tuple[MaxEnt, DataFrame, Vocabulary, int]:
    """The model, the counts, the vocabulary and the least known count."""
    counts = materialize(token_counts(docs, text, config), "counts")
    vocabulary, known_from = fit_vocabulary(counts, config)
    model = train_model(docs, text, docs.sparkSession.sparkContext.broadcast(vocabulary), config)
    return model, counts, vocabulary, known_from


def fit_model(docs: DataFrame, text: str, config: LmConfig):
    """What ``learn`` finds, with the model and the vocabulary broadcast."""
    model, counts, vocabulary, known_from = learn(docs, text, config)
    return docs.sparkSession.sparkContext.broadcast((vocabulary, model)), counts, vocabulary, known_from


def score_texts(docs: DataFrame, trained: Column, key: str = "doc_id", text: str = "text", config: LmConfig | None = None) -> DataFrame:
    """key, n_tokens, n_known, train_tokens, base_score, score, per_token: a row per input row.

    Learns from the rows where ``trained`` holds (null: it doesn't), scores all of them.
    A null or empty text is its end token alone. Repeated rows are scored alike. Without
    training rows the base gives every token log10(1), and an empty table an empty result.
    """
    config = config or TRAINED
    bound_batches(docs)
    kind = docs.schema[key].dataType.simpleString()
    learned, counts, vocabulary, known_from = learn(docs.where(trained), text, config)
    model = docs.sparkSession.sparkContext.broadcast((vocabulary, Factors.of(learned)))
    del learned
    names = ["row", key, "n_tokens", "n_known", "base", "score", "token", "n"]
    kinds = [pa.int64(), None, pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.int64()]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_by_worker("language model")
        vocabulary, factors = model.value
        task = TaskContext.get()
        row = (task.partitionId() if task else 0) << 40
        norm = math.log10(vocabulary.total + vocabulary.distinct + 1)
        base_of = np.append(np.log10(vocabulary.counts + 1) - norm, [0.0, math.log10(vocabulary.end_count + 1) - norm])  # -2: rest, -1: end
        rare = np.log10(vocabulary.rare_total + vocabulary.rare_distinct + 1)
        rare[0] = 0.0
        ln10 = math.log(10)
        for batch in batches:
            for piece in text_pieces(batch, 1, max_bytes=1 << 17):
                t = token_batch(piece.column(1), vocabulary, config)
                value = factors.log_probabilities(t) / ln10
                tail = (t.rank >= vocabulary.n_head) | (t.rank == -2)
                value[tail] -= rare[t.cls[tail]]
                listed = t.rank >= vocabulary.n_head
                value[listed] += np.log10(vocabulary.counts[t.rank[listed]] + 1)
                unknown = t.rank == -2
                starts = t.first[:-1]
                n = np.diff(t.first)
                known = np.add.reduceat((~unknown).astype(np.int64), starts) - (0 if vocabulary.end_count else 1)
                ids = row + np.arange(piece.num_rows)
                row += piece.num_rows
                docs_part = [pa.array(ids), piece.column(0), pa.array(n), pa.array(known), pa.array(np.add.reduceat(base_of[t.rank], starts)), pa.array(np.add.reduceat(value, starts))]
                yield pa.RecordBatch.from_arrays([*docs_part, *(pa.nulls(len(ids), k) for k in kinds[6:])], names=names)
                word = np.flatnonzero(unknown[t.where])
                if not len(word):
                    continue
                doc = t.batch.doc()[word]
                order = np.lexsort((t.hashes[word], doc))
                word, doc, hashes = word[order], doc[order], t.hashes[word][order]
                cuts = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])))
                one = word[cuts]
                data = t.batch.data.tobytes()
                tokens = [data[a:b] for a, b in zip(t.batch.starts[one].tolist(), t.batch.ends[one].tolist(), strict=True)]
                m = len(one)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[doc[cuts]]), pa.nulls(m, piece.schema.field(0).type), *(pa.nulls(m, k) for k in kinds[2:6]), pa.array(tokens, pa.binary()), pa.array(np.diff(np.append(cuts, len(word))))],
                    names=names,
                )

    schema = f"row long, {key} {kind}, n_tokens long, n_known long, base double, score double, token binary, n long"
    parts = materialize(docs.select(F.col(key), text_or_empty(text).alias(text)).mapInArrow(score, schema), "scored")
    whole = parts.where(F.col("n_tokens").isNotNull()).select("row", key, "n_tokens", "n_known", "base", "score")
    seen = counts.where(F.col("c") < known_from).select(F.col("token").alias("_token"), "c")
    rest = parts.where(F.col("token").isNotNull()).select("row", "token", "n").join(seen, F.col("token") == F.col("_token"), "left")
    count = F.coalesce(F.col("c"), F.lit(0))
    norm = math.log10(vocabulary.total + vocabulary.distinct + 1)
    gained = F.log10(count + 1) * F.col("n")
    by_row = rest.groupBy(F.col("row").alias("_row")).agg(F.sum(gained).alias("gain"), F.sum("n").alias("rest"), F.sum(F.when(count > 0, F.col("n")).otherwise(0)).alias("found"))
    joined = whole.join(by_row, F.col("row") == F.col("_row"), "left")
    gain, left = F.coalesce("gain", F.lit(0.0)), F.coalesce("rest", F.lit(0))
    return joined.select(
        key,
        "n_tokens",
        (F.col("n_known") + F.coalesce("found", F.lit(0))).cast("long").alias("n_known"),
        F.lit(vocabulary.total).cast("long").alias("train_tokens"),
        (F.col("base") + gain - left * F.lit(norm)).alias("base_score"),
        (F.col("score") + gain).alias("score"),
        ((F.col("score") + gain) / F.col("n_tokens")).alias("per_token"),
    )

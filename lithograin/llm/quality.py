"""Quality classifier: a linear-chain conditional random field over a document's lines.

Every line is good or bad. Its features are shares of character kinds, word shape
and repetition, of itself and of the lines before and after it. Forward-backward
gives each line's marginal; weighted by line length, the marginals aggregate into
the document's quality, which a monotone logistic map calibrates.

Only documents carry labels. So training starts with every line labelled as its
document and then relabels lines of bad documents by their marginals, the worst one
staying bad.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, TextBatch, bound_batches, kept_by_worker, text_or_empty

#: Kinds of bytes: letters lower, upper, non-ASCII, digits, white space, sentence marks, other marks by group.
KINDS = 10


def _kind_table() -> np.ndarray:
    lut = np.full(256, 9, dtype=np.uint8)
    lut[97:123] = 0
    lut[65:91] = 1
    lut[128:] = 2
    lut[48:58] = 3
    lut[SPACE] = 4
    for kind, marks in ((5, ".,;:'\""), (6, "!?"), (7, "|<>{}[]\\/_=~^"), (8, "#$%&*@+")):
        lut[[ord(c) for c in marks]] = kind
    return lut


KIND = _kind_table()

#: Lines and bytes whose features a worker holds at once, and lines of a chain that advance in one go; they bound its memory.
STRETCH_LINES = 16_384
STRETCH_BYTES = 1 << 18
CHAIN = 2048


@dataclass(frozen=True)
class QualityConfig:
    #: Labelled documents of each class that training reads at most, chosen by a hash of their id.
    max_docs_per_class: int = 3000
    #: Documents with more lines than this are not sampled for training (they are scored whole).
    max_train_lines: int = 1500
    #: Lines of each class that training reads at most; 336 bytes each on the driver.
    max_lines_per_class: int = 100_000
    rounds: int = 3
    steps: int = 80
    rate: float = 0.08
    ridge: float = 1e-3


@dataclass
class LineBatch:
    features: np.ndarray  # lines x features
    weight: np.ndarray  # line length in bytes, 1 at least
    first: np.ndarray  # first line of each document (one more at the end)


def line_features(texts: pa.Array) -> LineBatch:
    """Features of every line; an empty text is one empty line. A line ends at a line break."""
    batch = TextBatch(texts)
    size = len(batch.raw)
    starts = np.sort(np.concatenate([batch.bounds[:-1], np.flatnonzero(batch.raw == 10) + 1]))
    n = len(starts)
    breaks = np.concatenate([[0], np.cumsum(batch.raw == 10, dtype=np.int64)])
    first = np.concatenate([[0], np.cumsum(np.diff(breaks[batch.bounds]) + 1)]).astype(np.int64)
    ends = np.append(starts[1:], size)
    length = ends - starts
    counts = np.zeros((n, KINDS))
    kind = KIND[batch.raw]
    for k in range(KINDS):
        total = np.concatenate([[0], np.cumsum(kind == k, dtype=np.int64)])
        counts[:, k] = total[ends] - total[starts]
    words = np.searchsorted(batch.starts, starts, side="left")
    words = np.append(words, len(batch.starts))
    n_words = np.diff(words)
    hashes = batch.hashes()

    def repeats(gap: int) -> np.ndarray:
        same = np.zeros(len(hashes) + 1, dtype=np.int64)
        if len(hashes) > gap:
            same[gap + 1 :] = np.cumsum(hashes[gap:] == hashes[:-gap])
        low = np.minimum(words[:-1] + gap, words[1:])
        return same[words[1:]] - same[low]

    safe, safe_words = np.maximum(length, 1)[:, None], np.maximum(n_words, 1)
    share = counts / safe
    letters = np.maximum(counts[:, 0] + counts[:, 1] + counts[:, 2], 1)
    one = repeats(1) / safe_words
    few = np.maximum(one, (repeats(2) + repeats(3)) / safe_words)
    per_word = counts[:, 5:9] / safe_words[:, None]
    own = np.column_stack([share, np.sqrt(share[:, 5:]), np.minimum(per_word, 3.0), counts[:, 1] / letters, one, few, np.sqrt(few), np.log1p(length) / 8, np.log1p(n_words) / 6, np.minimum(letters / safe_words, 30) / 10, (length == 0).astype(float)])
    doc = np.repeat(np.arange(batch.n), np.diff(first))
    before, after = np.zeros_like(own), np.zeros_like(own)
    inside = doc[1:] == doc[:-1]
    before[1:][inside] = own[:-1][inside]
    after[:-1][inside] = own[1:][inside]
    edge = np.ones((n, 2))
    edge[1:, 0] = ~inside
    edge[:-1, 1] = ~inside
    return LineBatch(np.column_stack([own, before, after, edge, np.ones(n)]).astype(np.float32), np.maximum(length, 1).astype(np.float64), first)


@dataclass
class Crf:
    """Two states, 0 bad and 1 good. ``weights`` score state 1 against state 0."""

    weights: np.ndarray
    transitions: np.ndarray  # (2, 2) log potentials
    shift: np.ndarray
    scale: np.ndarray

    def emissions(self, features: np.ndarray) -> np.ndarray:
        return np.clip(((features - self.shift) / self.scale) @ self.weights, -30, 30)

    def marginals(self, features: np.ndarray, first: np.ndarray, pairs: bool = False):
        return forward_backward(self.emissions(features), first, self.transitions, pairs)


def forward_backward(score: np.ndarray, first: np.ndarray, transitions: np.ndarray, pairs: bool = False):
    """P(good) of every line; with ``pairs`` also the expected (2, 2) transition counts.

    All documents advance together, the longest first, one line a step; messages are
    normalised at every step."""
    ones = np.ones((len(first) - 1, 2))
    p, total, _, _ = _messages(score, first, transitions, ones, ones, pairs)
    return (p, total) if pairs else p


def _messages(score: np.ndarray, first: np.ndarray, transitions: np.ndarray, enter: np.ndarray, leave: np.ndarray, pairs: bool = False):
    """Marginals of chains that others may go before or after: ``enter`` and ``leave`` are the messages that
    come in at their ends. Also the expected transitions, and the two messages that go out with the logarithm of their scale."""
    counts = np.diff(first)
    order = np.argsort(-counts, kind="stable")
    begin, counts = first[:-1][order], counts[order]
    step = np.exp(transitions - transitions.max())
    good = 1 / (1 + np.exp(-score))
    emit = np.column_stack([1 - good, good])
    longest = int(counts[0]) if len(counts) else 0
    active = np.searchsorted(-counts, -np.arange(longest), side="left")
    forward, backward = np.empty_like(emit), np.empty_like(emit)
    up, down = np.zeros(len(counts)), np.zeros(len(counts))  # logarithms of what was divided out
    for t in range(longest):
        at = begin[: active[t]] + t
        message = emit[at] * (enter[order[: active[t]]] if t == 0 else forward[at - 1] @ step)
        size = message.sum(axis=1, keepdims=True)
        forward[at] = message / size
        up[: active[t]] += np.log(size[:, 0])
    backward[begin + counts - 1] = leave[order]
    total = np.zeros((2, 2))
    for t in range(longest - 1, 0, -1):
        at = begin[: active[t]] + t
        later = emit[at] * backward[at]
        message = later @ step.T
        size = message.sum(axis=1, keepdims=True)
        backward[at - 1] = message / size
        down[: active[t]] += np.log(size[:, 0])
        if pairs:
            joint = forward[at - 1][:, :, None] * step[None] * later[:, None, :]
            total += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
    both = forward * backward
    p = both[:, 1] / both.sum(axis=1)
    back = np.empty(len(order), dtype=np.int64)
    back[order] = np.arange(len(order))
    out_up = (forward[first[1:] - 1], up[back])
    out_down = (emit[first[:-1]] * backward[first[:-1]], down[back])
    return p, total, out_up, out_down


def long_chain_mean(score: np.ndarray, weight: np.ndarray, transitions: np.ndarray, chain: int = CHAIN, at_once: int = 64) -> float:
    """Weighted mean of P(good) over one long document, exact, in chains of ``chain`` lines. What a chain does to the messages that
    come in is a (2, 2) matrix; these matrices carry the messages along the document, and then every chain is summed up for itself."""
    cuts = np.append(np.arange(0, len(score), chain), len(score))
    n = len(cuts) - 1
    step = np.exp(transitions - transitions.max())
    ups, downs = np.empty((n, 2, 2)), np.empty((n, 2, 2))  # chain, state that comes in, state that goes out

    def groups() -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
        for a in range(0, n, at_once):
            b = min(a + at_once, n)
            yield slice(a, b), score[cuts[a] : cuts[b]], cuts[a : b + 1] - cuts[a]

    for part, own, first in groups():
        sides = []
        for state in range(2):
            unit = np.tile(np.eye(2)[state], (len(first) - 1, 1))
            with np.errstate(invalid="ignore"):  # marginals of a chain of one line; they aren't used
                sides.append(_messages(own, first, transitions, unit, unit)[2:])
        for k, kept in enumerate((ups, downs)):
            (zero, low), (one, high) = sides[0][k], sides[1][k]
            top = np.maximum(low, high)
            kept[part, 0], kept[part, 1] = zero * np.exp(low - top)[:, None], one * np.exp(high - top)[:, None]
    enter, leave = np.ones((n, 2)), np.ones((n, 2))
    for k in range(1, n):
        out = enter[k - 1] @ ups[k - 1]
        enter[k] = out / out.sum() @ step
        out = leave[n - k] @ downs[n - k]
        leave[n - k - 1] = out / out.sum() @ step.T
    total = 0.0
    for part, own, first in groups():
        p = _messages(own, first, transitions, enter[part], leave[part])[0]
        total += float(p @ weight[cuts[part.start] : cuts[part.stop]])
    return total / float(weight.sum())


def fit_crf(features: np.ndarray, first: np.ndarray, target: np.ndarray, line_weight: np.ndarray, config: QualityConfig, start: Crf | None = None) -> Crf:
    """Maximum likelihood with a ridge, by Adam on the whole sample. ``line_weight`` balances the classes."""
    shift, scale = features.mean(axis=0), features.std(axis=0)
    shift[-1], scale[scale < 1e-6] = 0.0, 1.0
    crf = start or Crf(np.zeros(features.shape[1]), np.zeros((2, 2)), shift, scale)
    x = (features - crf.shift) / crf.scale
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    inside = doc[1:] == doc[:-1]
    observed = np.zeros((2, 2))
    np.add.at(observed, (target[:-1][inside].astype(int), target[1:][inside].astype(int)), 1.0)
    theta = np.concatenate([crf.weights, crf.transitions.ravel()])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    n, k = max(len(target), 1), len(crf.weights)
    for step in range(1, config.steps + 1):
        p, expected = forward_backward(np.clip(x @ theta[:k], -30, 30), first, theta[k:].reshape(2, 2), True)
        gradient = np.concatenate([((p - target) * line_weight) @ x / n, ((expected - observed) / n).ravel()]) + config.ridge * theta
        m, v = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient**2
        theta = theta - config.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Crf(theta[:k], theta[k:].reshape(2, 2), crf.shift, crf.scale)


def document_means(p: np.ndarray, weight: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Length-weighted mean marginal of each document."""
    return np.add.reduceat(p * weight, first[:-1]) / np.add.reduceat(weight, first[:-1]) if len(first) > 1 else np.zeros(0)


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


@dataclass
class QualityModel:
    crf: Crf
    slope: float
    intercept: float

    def score(self, lines: LineBatch) -> np.ndarray:
        return self._of_mean(document_means(self.crf.marginals(lines.features, lines.first), lines.weight, lines.first))

    def _of_mean(self, mean: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * _logit(mean) + self.intercept)))

    def score_texts(self, texts: pa.Array) -> np.ndarray:
        """Scores of whole texts, some lines at a time."""
        out = np.empty(len(texts))
        for at, to, is_long in line_pieces(texts):
            if is_long:
                score, weight = long_emissions(texts[at].as_py().encode(), self.crf)
                out[at] = self._of_mean(np.array([long_chain_mean(score, weight, self.crf.transitions)]))[0]
            else:
                out[at:to] = self.score(line_features(texts.slice(at, to - at)))
        return out


def line_pieces(texts: pa.Array) -> Iterator[tuple[int, int, bool]]:
    """Ranges of texts with at most about ``STRETCH_LINES`` lines and ``STRETCH_BYTES`` bytes, one text at least, and
    whether it is a single text with more lines or bytes than a stretch."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    lines = pc.fill_null(pc.count_substring(texts, "\n"), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1
    share = lines / STRETCH_LINES + sizes / STRETCH_BYTES
    total = np.concatenate([[0.0], np.cumsum(share)])
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(total, total[at] + 1, side="right")) - 1)
        yield at, to, bool(share[at] > 1 and lines[at] > 1)
        at = to


def long_emissions(data: bytes, crf: Crf) -> tuple[np.ndarray, np.ndarray]:
    """Emission and weight of every line of one text. Features are made for a stretch of lines at a time,
    with the line before and the line after it, so they are those of the whole text."""
    raw = np.frombuffer(data, dtype=np.uint8)
    starts = np.append(0, np.flatnonzero(raw == 10) + 1)
    n, ends = len(starts), np.append(starts, len(raw))[1:]
    score = np.empty(n)
    a = 0
    while a < n:
        b = min(a + STRETCH_LINES, max(a + 1, int(np.searchsorted(ends, starts[a] + STRETCH_BYTES, side="right"))), n)
        low, high = max(a - 1, 0), min(b + 1, n)
        part = line_features(pa.array([data[starts[low] : ends[high - 1]].decode()]))
        score[a:b] = crf.emissions(part.features[a - low : a - low + b - a])
        a = b
    return score, np.maximum(ends - starts, 1).astype(np.float64)


def calibrate(mean: np.ndarray, good: np.ndarray, weight: np.ndarray, steps: int = 60) -> tuple[float, float]:
    """Logistic map of the mean's log-odds, by Newton steps; the slope stays positive."""
    x = np.column_stack([_logit(mean), np.ones(len(mean))])
    beta = np.array([1.0, 0.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (weight * (p - good)) + 1e-2 * (beta - [1.0, 0.0])
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2)
        move = np.linalg.solve(hessian, gradient)
        beta = beta - np.clip(move, -1, 1)
        beta[0] = max(beta[0], 0.05)
    return float(beta[0]), float(beta[1])


def train_quality(sample: list[tuple[LineBatch, int]], totals: dict[int, int], config: QualityConfig) -> QualityModel:
    """``sample``: the lines of one document and its label; ``totals``: labelled documents of each class."""
    if not sample or len({y for _, y in sample}) < 2:
        # Without both classes nothing can be told apart: every document gets the share of good ones.
        width = line_features(pa.array([""])).features.shape[1]
        share = (totals.get(1, 0) + 1) / (sum(totals.values()) + 2)
        return QualityModel(Crf(np.zeros(width), np.zeros((2, 2)), np.zeros(width), np.ones(width)), 1.0, float(_logit(np.array([share]))[0]))
    features = np.concatenate([b.features for b, _ in sample]).astype(np.float64)
    weight = np.concatenate([b.weight for b, _ in sample])
    first = np.concatenate([[0], np.cumsum([len(b.weight) for b, _ in sample])])
    label = np.array([y for _, y in sample], dtype=float)
    per_line = np.repeat(label, np.diff(first))
    target, crf = per_line.copy(), None
    for turn in range(config.rounds):
        balance = np.where(target > 0, 0.5 / max(target.mean(), 1e-3), 0.5 / max(1 - target.mean(), 1e-3))
        crf = fit_crf(features, first, target, balance, config, crf)
        if turn + 1 < config.rounds:
            p = crf.marginals(features, first)
            worst = np.minimum.reduceat(p, first[:-1])
            target = np.where(per_line > 0, 1.0, ((p > 0.5) & (p > np.repeat(worst, np.diff(first)))).astype(float))
    mean = document_means(crf.marginals(features, first), weight, first)
    share = {y: totals[y] / max(int((label == y).sum()), 1) for y in (0, 1)}
    slope, intercept = calibrate(mean, label, np.where(label > 0, share[1], share[0]) / max(share.values()))
    return QualityModel(crf, slope, intercept)


def in_fold(key: str, folds: int, fold: int):
    return (F.crc32(F.col(key).cast("string").cast("binary")) % folds) == fold


def fit_quality(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", config: QualityConfig | None = None) -> QualityModel:
    """Fits on at most ``max_docs_per_class`` documents of each label among the rows of ``labels``."""
    config = config or QualityConfig()
    bound_batches(docs)
    marked = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.max(label).cast("int").alias("_label"))
    totals = {r["_label"]: r["n"] for r in marked.groupBy("_label").agg(F.count(F.lit(1)).alias("n")).collect()}
    chosen = [marked.where(F.col("_label") == y).orderBy(F.xxhash64("_key"), "_key").limit(config.max_docs_per_class) for y in (0, 1)]
    sample = docs.select(key, text).join(F.broadcast(chosen[0].unionByName(chosen[1])), F.col(key) == F.col("_key"))
    sample = sample.select(F.col(key), text_or_empty(text).alias(text), "_label", F.size(F.split(text_or_empty(text), "\n")).alias("_lines")).where(F.col("_lines") <= config.max_train_lines)
    by_hash = Window.partitionBy("_label").orderBy(F.xxhash64(key), key, text)  # of so few rows that one task will do
    sample = sample.withColumn("_lines", F.sum("_lines").over(by_hash)).where(F.col("_lines") <= config.max_lines_per_class)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_by_worker("quality")
        for batch in batches:
            for at, to, _ in line_pieces(batch.column(1)):
                piece = batch.slice(at, to - at)
                lines = line_features(piece.column(1))
                packed = [lines.features[a:b].tobytes() for a, b in zip(lines.first[:-1], lines.first[1:], strict=True)]
                weights = [lines.weight[a:b].tobytes() for a, b in zip(lines.first[:-1], lines.first[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(2), pa.array(packed, pa.binary()), pa.array(weights, pa.binary())], names=["key", "label", "features", "weight"])

    kind = docs.schema[key].dataType.simpleString()
    rows = sample.select(key, text, "_label").mapInArrow(features, f"key {kind}, label int, features binary, weight binary").collect()
    rows.sort(key=lambda r: (r["key"], r["features"]))  # the same model whatever the order of tasks
    width = line_features(pa.array([""])).features.shape[1]
    parts = []
    for r in rows:
        lines = np.frombuffer(r["features"], np.float32).reshape(-1, width)
        parts.append((LineBatch(lines, np.frombuffer(r["weight"], np.float64), np.array([0, len(lines)])), r["label"]))
    return train_quality(parts, totals, config)


def score_quality(docs: DataFrame, model: QualityModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, score: a row per input row, from the text alone. Null and empty texts are one empty line."""
    bound_batches(docs)
    kind = docs.schema[key].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_by_worker("quality")
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score_texts(batch.column(1)))], names=[key, "score"])
            pa.default_memory_pool().release_unused()

    return docs.select(F.col(key), text_or_empty(text).alias(text)).mapInArrow(score, f"{key} {kind}, score double")


def classify_lines(docs: DataFrame, model: QualityModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, line_no, n_bytes, p_good, good: a row per line of every input row."""
    kind = docs.schema[key].dataType.simpleString()

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_by_worker("quality")
        for batch in batches:
            for at, to, is_long in line_pieces(batch.column(1)):
                if is_long:
                    score, weight = long_emissions(batch.column(1)[at].as_py().encode(), model.crf)
                    first = np.array([0, len(score)])
                    p = forward_backward(score, first, model.crf.transitions)
                else:
                    found = line_features(batch.column(1).slice(at, to - at))
                    weight, first = found.weight, found.first
                    p = model.crf.marginals(found.features, first)
                doc = np.repeat(np.arange(to - at), np.diff(first))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc + at)), pa.array(np.arange(len(p)) - first[doc]), pa.array(weight.astype(np.int64)), pa.array(p), pa.array(p >= 0.5)], names=[key, "line_no", "n_bytes", "p_good", "good"])

    return docs.select(F.col(key), text_or_empty(text).alias(text)).mapInArrow(lines, f"{key} {kind}, line_no long, n_bytes long, p_good double, good boolean")


#: A document is taken as good from this score on.
THRESHOLD = 0.3


def quality_scores(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", folds: int = 5, held_out: int = 0, config: QualityConfig | None = None) -> DataFrame:
    """key, held_out, score, predicted: a row per input row.

    Labels of rows with ``crc32(key) mod folds = held_out`` are never read. Scores use the
    text alone. Documents without a label are scored like others; a null label or one that isn't 0
    or 1 is ignored; repeated labels of a key count once. Without labels of both
    classes every score is one constant. An empty table gives an empty result.
    """
    fold = in_fold(key, folds, held_out)
    model = fit_quality(docs, labels.where(~fold), key, text, config=config)
    return score_quality(docs, model, key, text).select(key, F.coalesce(fold, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_quality(docs: DataFrame, model: QualityModel, text: str = "text") -> DataFrame:
    """The rows with a score of ``THRESHOLD`` or more, all their columns, in one pass without a shuffle."""
    bound_batches(docs)
    schema = docs.schema
    at = schema.names.index(text)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_by_worker("quality")
        for batch in batches:
            yield batch.filter(pa.array(model.score_texts(batch.column(at)) >= THRESHOLD))
            pa.default_memory_pool().release_unused()

    return docs.mapInArrow(keep, schema)

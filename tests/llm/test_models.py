"""Quality field and language model: exact inference, probabilities, held-out results."""

import dataclasses
import itertools
import math
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lithograin.llm import lm, quality
from lithograin.llm.common import hash_words


def test_forward_backward_against_enumeration():
    rng = np.random.default_rng(9)
    counts = [1, 4, 0, 2, 6]
    first = np.concatenate([[0], np.cumsum(counts)])
    score, transitions = rng.normal(size=first[-1]) * 2, rng.normal(size=(2, 2))
    p, pairs = quality.forward_backward(score, first, transitions, True)
    want, want_pairs = [], np.zeros((2, 2))
    for a, b in zip(first[:-1], first[1:], strict=True):
        if a == b:
            continue
        total, good, both = 0.0, np.zeros(b - a), np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=b - a):
            weight = math.exp(sum(s for s, k in zip(score[a:b], y, strict=True) if k) + sum(transitions[i, j] for i, j in zip(y, y[1:], strict=False)))
            total += weight
            good += weight * np.array(y)
            for i, j in zip(y, y[1:], strict=False):
                both[i, j] += weight
        want.extend(good / total)
        want_pairs += both / total
    assert np.allclose(p, want) and np.allclose(pairs, want_pairs)


def test_line_features_of_ties_and_empties():
    texts = ["", None, "a\nb", "", "\n", "x"]
    lines = quality.line_features(pa.array(texts))
    assert np.diff(lines.first).tolist() == [1, 1, 2, 1, 2, 1]
    alone = [quality.line_features(pa.array([t], pa.string())).features for t in texts]
    assert np.allclose(np.concatenate(alone), lines.features)


def quality_corpus(rng, n=260):
    rows, labels = [], []
    for i in range(n):
        good = rng.random() < 0.7
        lines = []
        for _ in range(rng.randint(1, 6)):
            words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 8))) for _ in range(rng.randint(3, 12))]
            lines.append(" ".join(words).capitalize() + "." if good or rng.random() < 0.15 else " | ".join(w + "$$$" for w in words))
        rows.append((i, "\n".join(lines)))
        if i % 5:
            labels.append((i, int(good), 0))
    truth = {i: int("|" not in t) for i, t in rows}
    return rows, labels, truth


def test_quality_on_held_out_rows(spark, make, none, clash):
    rows, labels, truth = quality_corpus(random.Random(10))
    labels += [(None, 1, 0), (1, None, 0), (2, 7, 0), (labels[0][0], labels[0][1], 0)]
    marks = clash(spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    docs = clash(make([*rows, (900, None), (901, ""), (902, "y" * 100_000), (903, "line\n" * 3000)]))
    out = quality.quality_scores(docs, marks).collect()
    assert len(out) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out)
    held = [r for r in out if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    judged = [(r.predicted, truth[r.doc_id]) for r in held if r.doc_id in truth]
    assert len(judged) > 30 and sum(a == b for a, b in judged) / len(judged) > 0.95
    # A held-out label changes nothing.
    flipped = marks.withColumn("quality", F.when(quality.in_fold("doc_id", 5, 0), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = {r.doc_id: r.score for r in quality.quality_scores(docs, flipped).collect()}
    assert all(again[r.doc_id] == r.score for r in out)
    model = quality.fit_quality(docs, marks)
    kept = quality.keep_quality(docs, model)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in quality.score_quality(docs, model).collect() if r.score >= 0.3}
    lines = quality.classify_lines(docs, model).where("doc_id = 903").collect()
    assert len(lines) == 3001 and {r.line_no for r in lines} == set(range(3001))
    constant = quality.quality_scores(docs, marks.where("quality = 1")).select("score").distinct().count()
    assert constant == 1
    assert quality.quality_scores(none, marks).collect() == []


CONFIG = lm.LmConfig(classes=8, slots=8, known=90, anchors=6, least_rows=64, damping=10.0)


def lm_corpus(rng, n=300):
    kinds = [[f"{p}{i}{s}" for i in range(60)] for p, s in (("a", "er"), ("b", "os"))]
    rows = []
    for i in range(n):
        words = rng.choice(kinds)
        rows.append((i, " ".join(words[min(59, int(rng.expovariate(0.08)))].upper() if rng.random() < 0.1 else words[min(59, int(rng.expovariate(0.08)))] for _ in range(rng.randint(0, 60)))))
    return rows


def tokens(text):
    return [*(text or "").encode().translate(bytes(c + 32 if 65 <= c < 91 else c for c in range(256))).split(), b""]


def held_out():
    return F.coalesce(quality.in_fold("doc_id", 7, 2), F.lit(False))


def test_scores_against_brute_force(make, none, clash):
    rows = [*lm_corpus(random.Random(11)), (900, None), (901, ""), (902, "never seen words never seen"), (903, "z" * 50_000), (903, "a1er b2os"), (904, "w " * 40_000)]
    docs = clash(make(rows))
    out = lm.score_texts(docs, ~held_out(), config=CONFIG).collect()
    assert len(out) == len(rows)
    counts = Counter(t for i, x in rows if zlib.crc32(str(i).encode()) % 7 != 2 for t in tokens(x))
    total, distinct = sum(counts.values()), len(counts)
    by_key = {}
    for i, x in rows:
        t = tokens(x)
        base = sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in t)
        by_key.setdefault(i, []).append((len(t), sum(counts[w] > 0 for w in t), total, round(base, 6)))
    for r in out:
        assert (r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) in by_key[r.doc_id]
        assert r.score < 0
    test = [r for r in out if zlib.crc32(str(r.doc_id).encode()) % 7 == 2 and r.doc_id < 900]
    assert len(test) > 20 and sum(r.score for r in test) > sum(r.base_score for r in test) * 0.97
    assert lm.score_texts(none, ~held_out(), config=CONFIG).collect() == []


def test_probabilities_sum_to_one(spark, make):
    docs = make(lm_corpus(random.Random(12)))
    model, counts, vocabulary, _ = lm.fit_model(docs, "text", CONFIG)
    vocabulary, weights = model.value
    c = {bytes(r["token"]): r["c"] for r in counts.collect()}
    words = [w for w in c if w]
    rare = vocabulary.rare_total + vocabulary.rare_distinct + 1
    assert 0 < vocabulary.n_head < len(words) and len(weights.tables[1]) == CONFIG.rows(vocabulary.total)
    for context in ("", "a1er", "a1er b2os unseen", "b1os b2os"):
        texts = pa.array([f"{context} {w.decode()}" for w in words] + [context])
        t = lm.token_batch(texts, vocabulary, CONFIG)
        p = np.exp(weights.log_probabilities(t))
        last = np.append(t.first[1:-1] - 2, t.first[-1] - 1)  # each text's last word; of the last text its end
        total = 0.0
        for at, w in zip(last, [*words, None], strict=True):
            tail = w is not None and not 0 <= t.rank[at] < vocabulary.n_head
            total += p[at] * ((c[w] + 1) / rare[t.cls[at]] if tail else 1.0)
        # Each class keeps room for one unseen word.
        word = lm.TokenBatch(t.batch, t.hashes, t.where, t.rank, t.cls, t.slot, [f[last[-1:]] for f in t.features], t.first)
        log_class = weights.log_classes(word)[0]
        for k in range(1, CONFIG.classes):
            own = CONFIG.rows(vocabulary.total) // CONFIG.classes
            word.features[3] = np.array([k * CONFIG.contexts + t.features[0][last[-1]]])
            word.features[4] = np.array([k * own + t.features[4][last[-1]] % own])
            total += np.exp(log_class[k] + weights.log_slots(word, np.array([k]))[0, -1]) / rare[k]
        assert abs(total - 1) < 1e-3


def test_scores_do_not_depend_on_partitions(make):
    rows = lm_corpus(random.Random(13))
    first, second = ({r.doc_id: r for r in lm.score_texts(make(rows, n), ~held_out(), config=CONFIG).collect()} for n in (1, 7))
    assert first.keys() == second.keys()
    for k, r in first.items():
        assert abs(r.score - second[k].score) < 1e-9 and abs(r.base_score - second[k].base_score) < 1e-9


def test_update_against_a_plain_version(make):
    rows = lm_corpus(random.Random(14), 80)
    model, *_ = lm.fit_model(make(rows), "text", CONFIG)
    vocabulary, weights = model.value
    t = lm.token_batch(pa.array([x for _, x in rows]), vocabulary, CONFIG)
    for k, (n, targets) in enumerate(lm.table_shapes(CONFIG.rows(vocabulary.total), CONFIG)):
        seen = Counter(zip(t.features[k].tolist(), (t.cls if k < 3 else t.slot).tolist(), strict=True))
        of_row = Counter(t.features[k].tolist())
        for row, n_row in list(of_row.items())[:40]:
            prior = np.exp(weights.class_prior if k < 3 else weights.slot_prior[row * CONFIG.classes // n])
            for j in range(targets):
                if prior[j] > 0:
                    want = CONFIG.steps[k] * math.log((seen[row, j] + CONFIG.damping * prior[j]) / ((n_row + CONFIG.damping) * prior[j]))
                    assert abs(weights.tables[k][row, j] - want) < 1e-3


def test_rounds_weigh_what_the_whole_model_expects(make, monkeypatch):
    rows = lm_corpus(random.Random(15), 80)
    texts = pa.array([x for _, x in rows])
    monkeypatch.setattr(lm, "FULL", 1 << 14)  # rows are handed on again and again
    before, after = (lm.fit_model(make(rows), "text", dataclasses.replace(CONFIG, rounds=n))[0].value[1] for n in (0, 1))
    vocabulary = lm.fit_model(make(rows), "text", CONFIG)[0].value[0]
    t = lm.token_batch(texts, vocabulary, CONFIG)
    parts = [np.exp(before.log_classes(t).astype(float)), np.exp(before.log_slots(t).astype(float))]
    for k, (n, targets) in enumerate(lm.table_shapes(CONFIG.rows(vocabulary.total), CONFIG)):
        observed, expected = np.zeros((n, targets)), np.zeros((n, targets))
        np.add.at(observed, (t.features[k], t.cls if k < 3 else t.slot), 1)
        np.add.at(expected, t.features[k], parts[k >= 3])
        prior = np.exp(before.class_prior[None] if k < 3 else np.repeat(before.slot_prior, n // CONFIG.classes, axis=0)) + np.zeros((n, 1))
        want = np.log(np.maximum(observed + CONFIG.damping * prior, 1e-30) / np.maximum(expected + CONFIG.damping * prior, 1e-30)) / (3 if k < 3 else 2)
        moved, used = after.tables[k] - before.tables[k], prior > 1e-3
        assert np.abs(moved).max() > 0.01
        assert np.abs(moved - want)[used].max() < 0.05


def test_rounds_raise_the_likelihood_and_do_not_depend_on_partitions(make):
    rows = lm_corpus(random.Random(16), 120)
    scored = {}
    for n, parts in ((0, 3), (1, 3), (3, 3), (3, 7)):
        scored[n, parts] = {r.doc_id: r.score for r in lm.score_texts(make(rows, parts), F.lit(True), config=dataclasses.replace(CONFIG, rounds=n)).collect()}
    total = [sum(scored[k].values()) for k in ((0, 3), (1, 3), (3, 3))]
    assert total[0] < total[1] < total[2]
    assert max(abs(x - scored[3, 7][i]) for i, x in scored[3, 3].items()) < 1e-9
    assert lm.TRAINED.rounds >= 1


def lm_parts(rows, rng, spread):
    """Vocabulary, tokens and a model of any weights, without Spark."""
    found = Counter(t for _, x in rows for t in tokens(x) if t)
    words = sorted(found, key=lambda w: (-found[w], w))
    n_head, index = 40, lm.WordIndex(hash_words([w.decode() for w in words]))
    cls, slot, bounds = lm.class_bounds(lm.keys_of(words[:n_head]), CONFIG.classes)
    rare = np.bincount(1 + np.searchsorted(bounds, lm.keys_of(words[n_head:]), side="right"), minlength=CONFIG.classes).astype(float)
    vocabulary = lm.Vocabulary(index, np.array([found[w] for w in words], float), n_head, cls, slot, bounds, len(rows), sum(found.values()) + len(rows), len(words), rare, rare)
    class_prior, slot_prior = lm.priors(vocabulary, CONFIG)
    tables = [rng.normal(0, spread, shape).astype(np.float32) for shape in lm.table_shapes(CONFIG.rows(vocabulary.total), CONFIG)]
    return vocabulary, lm.token_batch(pa.array([x for _, x in rows]), vocabulary, CONFIG), lm.MaxEnt(class_prior, slot_prior, tables)


@pytest.mark.parametrize("spread", [0.5, 20.0])  # at 20 rows contradict each other by more than 32-bit products hold
def test_factors_against_logarithms(spread):
    vocabulary, t, model = lm_parts(lm_corpus(random.Random(17), 200), np.random.default_rng(3), spread)
    factors = lm.Factors.of(model)
    at, low = np.arange(len(t.cls)), 0
    want = np.zeros(len(at))
    for tables, target, prior in ((lm.CLASS_TABLES, t.cls, model.class_prior[None]), (lm.SLOT_TABLES, t.slot, model.slot_prior[t.cls])):
        # In 64 bits; a factor is no less than the least one beside its row's greatest.
        full = {0: model.tables[0] + model.class_prior, 3: model.tables[3] + np.repeat(model.slot_prior, CONFIG.contexts, axis=0)}
        z = np.zeros((len(at), len(prior[0])))
        for k in tables:
            own = full.get(k, model.tables[k]).astype(float)
            own = np.maximum(own - own.max(axis=1, keepdims=True), lm.LEAST_FACTOR)
            z += own[t.features[k]]
        z = np.where(prior > lm.UNUSED / 2, z, -np.inf)
        z -= np.log(np.exp(z - z.max(axis=1, keepdims=True)).sum(axis=1, keepdims=True)) + z.max(axis=1, keepdims=True)
        assert np.abs(factors.probabilities(t.features, tables) - np.exp(z)).max() < 1e-4
        own, total = factors.products(t.features, tables)
        low += (own[at, target] < lm.LEAST_PRODUCT).sum()
        want += z[at, target]
    got = factors.log_probabilities(t)
    assert np.isfinite(got).all() and np.abs(got - want).max() < 1e-3
    assert (low > 0) == (spread > 1)
    if spread < 1:
        assert np.abs(got - model.log_probabilities(t)).max() < 1e-4


def test_scoring_takes_no_exponential_for_a_token(monkeypatch):
    _, t, model = lm_parts(lm_corpus(random.Random(18)), np.random.default_rng(4), 0.5)
    factors, taken = lm.Factors.of(model), []
    exp = np.exp
    monkeypatch.setattr(lm.np, "exp", lambda x, *a, **k: taken.append(np.size(x)) or exp(x, *a, **k))
    factors.log_probabilities(t)
    factors.probabilities(t.features, lm.CLASS_TABLES)
    assert not taken and len(t.cls) > 1000


def test_feature_rows_grow_with_the_corpus():
    config = lm.LmConfig()
    sizes = [config.rows(n) for n in (0, 10**6, 10**7, 10**8, 10**9, 10**10)]
    assert sizes == sorted(sizes) and len(set(sizes)) == 6 and all(x & (x - 1) == 0 for x in sizes)


def test_contexts_help_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = lm.score_texts(docs, ~held_out()).where("crc32(cast(cast(doc_id as string) as binary)) % 7 = 2").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert out[0] / out[2] > out[1] / out[2] + 0.15  # log10 a token


def test_word_index():
    words = [f"w{i}" for i in range(3000)]
    hashes = hash_words(words)
    index = lm.WordIndex(hashes)
    assert index.find(hashes).tolist() == list(range(3000))
    assert (index.find(hash_words([f"v{i}" for i in range(500)])) == -1).all()
    assert (lm.WordIndex(np.zeros(0, np.uint64)).find(hashes) == -1).all()


def test_classes_are_ranges_of_endings():
    words = [w.encode() for w in ["a", "ab", "élan", "ñ", "xyz文", "#", "9.", "b" * 20, "c" + "b" * 20, "ba"]]
    keys = lm.keys_of(words)
    assert keys.tolist() == [int.from_bytes(w[::-1][:8].ljust(8, b"\0")) for w in words]
    cls, slot, bounds = lm.class_bounds(keys, 4)
    assert sorted(cls.tolist()) == [1] * 4 + [2] * 4 + [3] * 2 and len(bounds) == 2
    assert len({(c, j) for c, j in zip(cls.tolist(), slot.tolist(), strict=True)}) == len(words)
    assert (1 + np.searchsorted(bounds, keys, side="right") >= cls).all()
    assert lm.class_bounds(lm.keys_of([]), 4)[2].tolist() == []


def plain_features(text):
    """The features of every line, written out one by one."""

    def kind(byte):
        c = chr(byte)
        groups = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "", "0123456789", " \t\n\x0b\x0c\r", ".,;:'\"", "!?", "|<>{}[]\\/_=~^", "#$%&*@+"]
        return 2 if byte >= 128 else next((k for k, g in enumerate(groups) if c in g), 9)

    lines = (text or "").split("\n")
    own, weights = [], []
    for i, line in enumerate(lines):
        data = (line + ("\n" if i + 1 < len(lines) else "")).encode()
        n = [sum(kind(b) == k for b in data) for k in range(10)]
        size = max(len(data), 1)
        words = [w.lower() for w in re.findall(rb"[^\x20\x09-\x0D]+", data)]
        m = max(len(words), 1)
        letters = max(n[0] + n[1] + n[2], 1)
        again = [sum(words[j] == words[j - gap] for j in range(gap, len(words))) / m for gap in (1, 2, 3)]
        few = max(again[0], again[1] + again[2])
        share = [x / size for x in n]
        own.append([*share, *(math.sqrt(x) for x in share[5:]), *(min(x / m, 3) for x in n[5:9]), n[1] / letters, again[0], few, math.sqrt(few), math.log1p(len(data)) / 8, math.log1p(len(words)) / 6, min(letters / m, 30) / 10, float(not data)])
        weights.append(size)
    none = [0.0] * len(own[0])
    last = len(lines) - 1
    return [[*x, *(own[i - 1] if i else none), *(own[i + 1] if i < last else none), float(i == 0), float(i == last), 1.0] for i, x in enumerate(own)], weights


def plain_score(model, text):
    """Marginals by summing over messages line by line, their weighted mean, and the logistic map."""
    features, weights = plain_features(text)
    crf = model.crf
    score = np.clip((np.array(features) - crf.shift) / crf.scale @ crf.weights, -30, 30)
    emit = [(1 / (1 + math.exp(s)), 1 / (1 + math.exp(-s))) for s in score]
    step = np.exp(crf.transitions)
    up, down = [np.array(emit[0])], [np.ones(2)]
    for e in emit[1:]:
        up.append(np.array(e) * (up[-1] @ step))
        up[-1] /= up[-1].sum()
    for e in emit[:0:-1]:
        down.append(step @ (np.array(e) * down[-1]))
        down[-1] /= down[-1].sum()
    p = [a[1] * b[1] / (a @ b) for a, b in zip(up, down[::-1], strict=True)]
    mean = min(max(float(np.dot(p, weights) / sum(weights)), 1e-6), 1 - 1e-6)
    return 1 / (1 + math.exp(-(model.slope * math.log(mean / (1 - mean)) + model.intercept)))


QUALITY_TEXTS = [None, "", "\n", "\n\n\n", "one line", "A b, c! a b a b\nxx 12 {}|\n\nend.", "é É ß\n日本 日本 語", "ends with a break\n", " \t\r\n x", "w " * 300 + "\n" + "z" * 500, "\n".join(f"line {i} has {i % 7} words #{i}" for i in range(60))]


def random_model(rng):
    width = quality.line_features(pa.array([""])).features.shape[1]
    return quality.QualityModel(quality.Crf(rng.normal(size=width) / 3, rng.normal(size=(2, 2)), rng.normal(size=width) / 5, rng.uniform(0.5, 2, size=width)), 1.3, -0.2)


@pytest.mark.parametrize("lines, size", [(16_384, 1 << 18), (4, 1 << 18), (1, 40), (16_384, 60)])
def test_quality_scores_against_a_plain_version(monkeypatch, lines, size):
    rng = np.random.default_rng(3)
    monkeypatch.setattr(quality, "STRETCH_LINES", lines)
    monkeypatch.setattr(quality, "STRETCH_BYTES", size)
    texts = pa.array(["left out", *QUALITY_TEXTS], pa.string()).slice(1)
    found = quality.line_features(texts)
    want = [plain_features(t) for t in QUALITY_TEXTS]
    assert np.allclose(found.features, np.concatenate([f for f, _ in want]), atol=1e-5)
    assert found.weight.tolist() == [w for _, ws in want for w in ws]
    model = random_model(rng)
    assert np.allclose(model.score_texts(texts), [plain_score(model, t) for t in QUALITY_TEXTS], atol=1e-4)


@pytest.mark.parametrize("n", [1, 2, 6, 7, 100])
def test_chains_join_exactly(n):
    rng = np.random.default_rng(n)
    score, weight, transitions = rng.normal(size=n) * 3, rng.uniform(1, 9, size=n), rng.normal(size=(2, 2)) * 2
    p = quality.forward_backward(score, np.array([0, n]), transitions)
    for chain, at_once in ((1, 1), (3, 2), (1000, 64)):
        assert np.isclose(quality.long_chain_mean(score, weight, transitions, chain, at_once), p @ weight / weight.sum())


def test_a_text_of_line_breaks_is_scored_in_stretches():
    model = random_model(np.random.default_rng(4))
    tracemalloc.start()
    (score,) = model.score_texts(pa.array(["\n" * 1_000_000 + "the end"]))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert 0 <= score <= 1 and most < 150e6


def test_training_lines_are_bounded(spark, make):
    docs = make([f"good text number {i}\nmore of it" if i % 2 else f"###{i}###\n$$$\n!!" for i in range(60)])
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    seen = []
    train = quality.train_quality

    def spy(sample, totals, config):
        seen.append({y: sum(len(b.weight) for b, label in sample if label == y) for y in (0, 1)})
        return train(sample, totals, config)

    quality.train_quality = spy
    try:
        quality.fit_quality(docs, labels, config=quality.QualityConfig(max_lines_per_class=20, steps=5))
    finally:
        quality.train_quality = train
    assert seen == [{0: 18, 1: 20}]

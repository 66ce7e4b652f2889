"""Words and hashes of batches, URL filter, license scan, line dedup, packing: brute force and odd input."""

import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lithograin.llm import license_scan, line_dedup, packing, url_filter
from lithograin.llm.common import NON_ALNUM, SPACE, TextBatch, hash_words, text_pieces
from tests.llm.conftest import ODD

LOWER = {c: c + 32 for c in range(65, 91)}
BLANKS = " \t\n\x0b\x0c\r"
TEXT = st.text(alphabet="abAB09 \n\t.- é文<|", max_size=30)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXT), max_size=8))
def test_words_of_a_batch(texts):
    array = pa.array([None, "skipped", *texts], pa.string()).slice(2)
    for rule, separators in ((r"[^\x20\x09-\x0D]+", SPACE), (r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", NON_ALNUM)):
        batch = TextBatch(array, separators)
        want = [re.findall(rule, (t or "").translate(LOWER)) for t in texts]
        data = batch.data.tobytes()
        got = [data[a:b].decode() for a, b in zip(batch.starts, batch.ends, strict=True)]
        assert got == [w for ws in want for w in ws]
        assert list(batch.counts) == [len(w) for w in want]
        if got:
            assert (batch.hashes() == hash_words(got, separators)).all()


def test_hashes_do_not_depend_on_blocks(monkeypatch):
    text = " ".join(f"word{i}" for i in range(5000))
    whole = TextBatch(pa.array([text])).hashes()
    monkeypatch.setattr("lithograin.llm.common.BLOCK_BYTES", 100)
    monkeypatch.setattr("lithograin.llm.common._tables", [])
    assert (TextBatch(pa.array([text])).hashes() == whole).all()
    assert len(np.unique(whole)) == 5000


def test_pieces_keep_all_rows():
    batch = pa.RecordBatch.from_arrays([pa.array(["a" * n for n in (0, 10, 500, 3, 0)] + [None])], names=["t"])
    parts = list(text_pieces(batch, 0, max_bytes=100))
    assert sum(p.num_rows for p in parts) == 6 and len(parts) > 1


def test_url_filter(spark, clash):
    urls = [
        (1, "http://casino.example.com/en/1"), (2, "http://a.example.com/win-bonus"), (3, "http://a.example.com/win"), (4, "http://a.example.com/winter-bonuses"),
        (5, "https://X.Example.NET/en/casino"), (6, "https://x.example.net/fr/"), (7, "http://www.example.com/de/x"), (8, "http://a.org/fr/porn"), (9, "http://b.org/en/?q=porn#x"),
        (10, None), (11, ""), (12, "no scheme casino"), (13, "http://notexample.com/de/"), (14, "http://y.net"), (15, "http://y.net?x=/"), (16, "http://win.bonus.com/win/bonus"), (16, "http://win.bonus.com/win/bonus"),
    ]
    df = clash(spark.createDataFrame(urls, "page_id long, url string"))
    got = {r.page_id: r for r in url_filter.filter_urls(df).collect()}
    assert url_filter.filter_urls(df).count() == len(urls)
    blocked = {i for i, r in got.items() if r.verdict == "block"}
    assert blocked == {1, 2, 6, 7, 9, 12, 16}
    assert {i: r.rule for i, r in got.items() if r.rule} == {5: "example.net/en/", 6: "net/", 7: "example.com/de/", 8: "org/fr/"}
    assert (got[5].host, got[5].path) == ("x.example.net", "/en/casino") and (got[15].host, got[15].path) == ("y.net", "")
    assert (got[10].host, got[10].path, got[12].host) == ("", "", "") and (got[2].n_soft, got[2].terms) == (2, "bonus,win")
    assert url_filter.filter_urls(df.where("false")).collect() == []


def test_policy_of_thousands_of_terms(spark):
    rng = random.Random(21)
    letters = "abcdefgh"
    terms = {"".join(rng.choices(letters, k=rng.randint(2, 5))): rng.random() < 0.1 for _ in range(5000)}
    rows = [*((t.upper() if rng.random() < 0.2 else t, s) for t, s in terms.items()), (None, True), ("", True), ("ab", None)]
    policy = url_filter.policy_of(spark.createDataFrame(rows, "term string, strict boolean"))
    strict, soft = {t for t, s in terms.items() if s}, {*(t for t, s in terms.items() if not s), *(["ab"] if not terms.get("ab") else [])}
    assert set(policy.strict) == strict and set(policy.soft) == soft
    urls = [(i, "http://" + "".join(rng.choice(["/", "-", ".", "", "7"]) + "".join(rng.choices(letters + "xyz", k=rng.randint(1, 5))) for _ in range(rng.randint(1, 6)))) for i in range(400)]
    for r in url_filter.filter_urls(spark.createDataFrame(urls, "page_id long, url string"), policy=policy).collect():
        parts = set(re.findall(r"[a-z0-9]+", dict(urls)[r.page_id]))
        assert (r.n_strict, r.n_soft) == (len(parts & strict), len(parts & soft))
        assert r.verdict == ("block" if parts & strict or len(parts & soft) >= 2 else "allow")
    with pytest.raises(ValueError):
        url_filter.policy_of(spark.createDataFrame(rows, "term string, strict boolean"), most_terms=10)


def brute_license(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    at, labels, score = [], set(), 0.0
    for phrase, label in license_scan.PHRASES:
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                at.append(i)
                labels.add(label)
                score = 1.0
    base = ",".join(sorted(labels))
    for line in (text or "").translate(LOWER).split("\n"):
        own = set(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", line))
        for label, t in license_scan.template_words():
            if len(own & set(t)) >= 0.8 * len(t) - 1e-9:
                labels.add(label)
                score = max(score, len(own & set(t)) / len(t))
    wrapped = brute_wrapped(text)
    labels, score = labels | set(wrapped), max([score, *wrapped.values()])
    return (len(words), len(at), min(at, default=None), max(at, default=None), base, ",".join(sorted(labels)), round(score, 9))


def test_license_scan_against_brute_force(make, none, clash):
    rng = random.Random(3)
    texts = list(ODD)
    lines = [t for _, t in license_scan.TEMPLATES] + ["Some words that are not a license.", "the MIT\nLicense", "cc by cc by-nc", "under the license version 2"]
    for _ in range(80):
        picked = []
        for line in rng.choices(lines, k=rng.randint(1, 4)):
            words = line.split()
            for _ in range(rng.randint(0, 3)):
                words[rng.randrange(len(words))] = rng.choice(["x", "the", "license"])
            picked.append(" ".join(words).upper() if rng.random() < 0.2 else " ".join(words))
        texts.append("\n".join(picked))
    rows = license_scan.scan_licenses(clash(make(texts))).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, round(r.score, 9)) == brute_license(texts[r.doc_id]), texts[r.doc_id][:200]
    assert license_scan.scan_licenses(none).collect() == []


def brute_wrapped(text):
    """Labels of templates that some window of words over a line break holds enough of, and the largest share."""
    words, lines = [], []
    for i, line in enumerate((text or "").translate(LOWER).split("\n")):
        found = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", line)
        words += found
        lines += [i] * len(found)
    labels = {}
    for (label, distinct), (_, notice) in zip(license_scan.template_words(), license_scan.TEMPLATES, strict=True):
        span = math.ceil(len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", notice.translate(LOWER))) / 0.8)
        for i in range(len(words)):
            at = [k for k in range(i, min(len(words), i + span)) if words[k] in distinct]
            if at and at[0] == i and lines[at[-1]] != lines[i] and len({words[k] for k in at}) >= 0.8 * len(distinct) - 1e-9:
                labels[label] = max(labels.get(label, 0), len({words[k] for k in at}) / len(distinct))
    return labels


def test_license_scan_of_wrapped_notices(make):
    rng = random.Random(7)
    texts, whole = list(ODD), {}
    for label, notice in license_scan.TEMPLATES:
        words = notice.split()
        for width in (3, 6, 11):
            if width < len(words):
                whole[len(texts)] = label
                texts.append("Some text before it.\n * " + "\n * ".join(" ".join(words[i : i + width]) for i in range(0, len(words), width)) + "\nand after")
    for _ in range(60):
        words = [w for _ in range(3) for w in rng.choice(license_scan.TEMPLATES)[1].split()]
        for _ in range(rng.randint(0, 8)):
            words[rng.randrange(len(words))] = rng.choice(["x", "the", "license"])
        texts.append("".join(w + ("\n" if rng.random() < 0.15 else " ") for w in words))
    rows = {r.doc_id: r for r in license_scan.scan_licenses(make(texts)).collect()}
    assert len(rows) == len(texts)
    for i, r in rows.items():
        assert {b.label for b in r.wrapped} == set(brute_wrapped(texts[i])), texts[i][:200]
        assert (r.labels, round(r.score, 9)) == brute_license(texts[i])[5:]
        assert all(0 <= b.first_word and b.first_word + b.n_words <= r.n_words and b.containment >= 0.8 - 1e-9 for b in r.wrapped)
    assert len(whole) > 20 and all(label in rows[i].labels.split(",") for i, label in whole.items())


def test_line_dedup_against_brute_force(make, none, clash):
    rng = random.Random(4)
    common = [f"boilerplate line {i}" for i in range(6)]
    rows = []
    for i in range(200):
        lines = [f"own line {i} {k}" for k in range(rng.randint(0, 3))] + rng.choices(common[: 1 + i % 6], k=rng.randint(0, 3)) + [""] * (i % 2)
        rng.shuffle(lines)
        site = f"site{rng.randint(0, 3 + i % 12)}" if i % 17 else None
        rows.append((i, "\n".join(rng.choice([" {} ", "{}\r", "\t{}", "{}", "{}", "{}"]).format(x) for x in lines), site))
    rows += [(300, None, "site1"), (301, "boilerplate line 0", "site2"), (301, "boilerplate line 0", "site2"), (None, "boilerplate line 0\nx", "site3")]
    sites, keeper = defaultdict(set), {}
    for key, text, site in rows:
        for line in {x.strip(BLANKS) for x in (text or "").split("\n")} - {""}:
            sites[line].add(site or "")
            if key is not None:
                keeper[line] = min(keeper.get(line, key), key)
    for least, held in ((3, 10**6), (8, 10**6), (3, 0)):  # the lines in every task, or joined
        df = clash(make(rows))
        out = line_dedup.dedup_lines(df, min_sites=least, broadcast_lines=held)
        assert set(out.columns) == {*df.columns, "n_lines", "n_removed"}
        want = []
        for key, text, _ in rows:
            lines = (text or "").split("\n")
            left = [x for x in lines if x.strip(BLANKS) == "" or len(sites[x.strip(BLANKS)]) < least or keeper[x.strip(BLANKS)] == key]
            want.append((key, "\n".join(left), len(lines), len(lines) - len(left)))
        assert sorted(((r.doc_id, r.text, r.n_lines, r.n_removed) for r in out.collect()), key=repr) == sorted(want, key=repr)
    assert line_dedup.dedup_lines(none).collect() == []


def test_long_lines_go_from_two_documents_on(make, clash):
    long, other, short = (" ".join(f"{p}{i}" for i in range(n)) for p, n in (("w", 51), ("v", 60), ("u", 50)))
    rows = [(1, f"{long}\nown 1", "hot"), (2, f"own 2\n  {long} ", "hot"), (3, f"{long}\n{short}", "b"), (4, f"{other}\n{other}", "b"), (5, f"{short}\nown 5", "hot"), (None, f"{other}\nx", "c")]
    rows += [(6, "y", "hot"), (6, "y", "hot")]
    out = {r.doc_id: (r.text, r.n_removed) for r in line_dedup.dedup_lines(clash(make(rows))).collect()}
    assert out == {1: (f"{long}\nown 1", 0), 2: ("own 2", 1), 3: (short, 1), 4: (f"{other}\n{other}", 0), 5: (f"{short}\nown 5", 0), None: ("x", 1), 6: ("y", 0)}
    kept = line_dedup.dedup_lines(make(rows), long_words=None).collect()
    assert all(r.n_removed == 0 for r in kept)
    for held in (10**6, 0):  # rows with null or repeated keys, each for itself
        odd = [(None, "many\na", f"s{i}") for i in range(9)] + [(7, f"all\nb{i}", f"s{i}") for i in range(9)]
        out = line_dedup.dedup_lines(make(odd), broadcast_lines=held).collect()
        assert sorted((str(r.doc_id), r.text) for r in out) == sorted([("None", "many\na")] * 9 + [("7", f"all\nb{i}") for i in range(9)])


def test_sites_that_share_registers_still_count(make):
    def register(site):
        return xxhash.xxh64_intdigest(site.encode(), xxhash.xxh64_intdigest(b"site", 42)) % 256

    for filled in (3, 5):  # the estimate is about this number
        sites = [s for s in (f"site{i}" for i in range(3000)) if register(s) < filled][:8]
        assert len({register(s) for s in sites}) <= filled and len(sites) == 8
        out = line_dedup.dedup_lines(make([(i, f"common line\nown {i}", s) for i, s in enumerate(sites)])).collect()
        assert sorted(r.n_removed for r in out) == [0] + [1] * 7
    low, high = line_dedup.near_band(8)
    assert 2 < low < 3 and high > 8


def test_site_sketch_estimates(spark):
    from pyspark.sql import functions as F

    rows = spark.range(20_000).select((F.col("id") % 2).alias("line"), (F.col("id") / 2).cast("int").cast("string").alias("site"), F.col("id").alias("key"))
    found = line_dedup.site_spread(rows, 8).collect()
    assert len(found) == 2 and all(8000 < r.estimate < 12_000 for r in found)


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_chunks_give_the_tokenizers_ids(tokenizer):
    rng = random.Random(5)
    texts = [None, *(t for t in ODD if len(t or "") < 60_000), "a \x00b c", "\x00", "\x00 \x00"]
    pieces = ["word", "Été", "a.b", "it's", "  ", "\n", "\n\n", " \n", "\t", " ", "　", "文字", "123", "<|endoftext|>", "<|", "​", "\x00", "\x1c", "\x1d", "\x1e", "\x1f", "\x85", "\u2028", "\u2029", "\xa0", "!?", "\r\n", "'ll", "😀"]
    texts += ["".join(rng.choice(pieces) + rng.choice([" ", "", " "]) for _ in range(rng.randint(1, 12))) for _ in range(800)]
    # Code points of every kind, between letters, after a blank, before a blank and beside a line break.
    points = [*range(0x3100), *(c for c in rng.sample(range(0x3100, 0x110000), 1500) if not 0xD800 <= c < 0xE000)]
    texts += [form.format(chr(c)) for c in points for form in ("x {0}y z{0} w{0}v", "q{0}\nr {0}")]
    chunked = packing.ChunkTokenizer(public_tokenizers.path("byte_bpe_50k.json"), cache_limit=500)
    want = [e.ids for e in tokenizer.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]
    for size in (37, 1500):
        for i in range(0, len(texts), size):
            ids, first = chunked.encode(pa.array(texts[i : i + size], pa.string()).slice(0))
            assert [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:], strict=True)] == want[i : i + size]
    middle = pa.array(["left out", "a b", "c  d"]).slice(1)
    ids, first = chunked.encode(middle)
    assert ids[: first[1]].tolist() == tokenizer.encode("a b").ids and ids[first[1] :].tolist() == tokenizer.encode("c  d").ids


def test_symbols_at_a_words_end_are_chunks_of_their_own(tokenizer):
    rng = random.Random(7)
    stems = sorted({"".join(rng.choice("abcdeimnorstuéß") for _ in range(rng.randint(3, 9))) + "x" for _ in range(300)})
    tails = ["", ".", ",", "&&&", ".)", "***", "_", "'", "'s."]
    text = "start " + " ".join(stem + tail for stem in stems for tail in tails)
    chunked, given = packing.ChunkTokenizer(public_tokenizers.path("byte_bpe_50k.json")), []
    whole = chunked._whole
    chunked._whole = lambda texts: given.extend(texts) or whole(texts)
    ids, first = chunked.encode(pa.array([text]))
    assert ids.tolist() == tokenizer.encode(text).ids and first.tolist() == [0, len(ids)]
    # Each stem is encoded once, with an apostrophe twice more; nothing stands between chunks.
    assert "\n" not in "".join(given) and len("".join(given)) < 3 * sum(len(x) + 2 for x in stems) + 50
    # Letters, symbols, apostrophes and digits in any order.
    letters = "asdtlmrveSé1'.,;!-_|<>&\"`~"
    texts = ["".join("".join(rng.choice(letters) for _ in range(rng.randint(0, 7))) + rng.choice(" \n ") for _ in range(rng.randint(1, 30))) for _ in range(3000)]
    texts += [t.strip() for t in texts]
    ids, first = chunked.encode(pa.array(texts))
    want = [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    assert [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:], strict=True)] == want


def test_sum_of_squares_choice():
    packer = packing.LevelPacker(window=10)
    for counts, size in (({}, 3), ({4: 1, 7: 3}, 3), ({4: 2, 6: 1}, 4), ({5: 4, 2: 1}, 3), ({9: 2}, 1)):
        packer.levels[:] = 0
        for level, n in counts.items():
            packer.levels[level] = n

        def cost(level, packer=packer, size=size):
            after = packer.levels.copy()
            if level:
                after[level] -= 1
            if level + size < 10:
                after[level + size] += 1
            return int((after**2).sum())

        options = [x for x in range(10 - size + 1) if x == 0 or packer.levels[x]]
        assert packer._level_for(size) == min(options, key=lambda x: (cost(x), -x))


@pytest.mark.parametrize("limit", [3, 10_000])
def test_packer_keeps_every_id(limit):
    rng = random.Random(6)
    packer = packing.LevelPacker(window=64, open_limit=limit)
    docs = {k: np.array([rng.randint(0, 9) for _ in range(rng.choice([1, 5, 63, 64, 65, 300]))], "<u4").tobytes() for k in range(200)}
    for k, ids in docs.items():
        packer.add(k, ids)
    packer.finish()
    found, fills = defaultdict(list), defaultdict(list)
    for key, start, ids, total, sequence, offset in packer.take():
        assert total == len(docs[key]) // 4
        found[key].append((start, ids))
        fills[sequence].append((offset, len(ids) // 4))
    assert {k: b"".join(i for _, i in sorted(v)) for k, v in found.items()} == docs
    for pieces in fills.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 64 and at & (at - 1) == 0  # whole, or a power of two: no padding


def test_packing_round_trip(make, odd, none, clash, tokenizer):
    docs = clash(make([f"document {i} " + "some words " * (i * 7 % 400) for i in range(60)])).unionByName(clash(odd))
    rows = packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json")).collect()
    want = defaultdict(list)
    for r in docs.collect():
        want[r.doc_id].append([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0])
    fills = defaultdict(list)
    for r in rows:
        fills[r.sequence_id].append((r.offset, r.length))
        pieces = [np.array(ids[r.start : r.start + r.length], "<u4").tobytes() for ids in want[r.doc_id] if len(ids) == r.doc_tokens]
        assert r.ids_crc32 in [zlib.crc32(p) for p in pieces]
    assert sum(r.length for r in rows) == sum(len(ids) for v in want.values() for ids in v)
    for pieces in fills.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 1024 and at & (at - 1) == 0
    assert packing.pack_documents(none, public_tokenizers.path("byte_bpe_50k.json")).collect() == []

"""The pipeline's stages, each on its own input, and the registered queries."""

import math
import re
import zlib
from collections import defaultdict

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__
from lithograin.llm import decontam, line_dedup, minhash, quality
from tests.compare import assert_same, connect
from tests.llm.test_minhash import brute
from tests.llm.test_models import plain_score


@pytest.fixture(scope="module")
def documents(spark, data_dir):
    return spark.read.parquet(f"{data_dir}/documents.parquet")


def test_stages_keep_the_columns(spark, documents, data_dir):
    docs = documents
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, data_dir)
        assert out.columns == documents.columns, name
        out = out.cache()
        keys = {r.doc_id for r in out.select("doc_id").collect()}
        assert keys and keys <= {r.doc_id for r in docs.select("doc_id").collect()}
        docs = out
    pieces = corpus_pipeline.packing_stage(spark, docs, data_dir)
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == keys


def test_quality_stage(spark, documents, data_dir):
    labels = spark.read.parquet(f"{data_dir}/labels.parquet").where(~quality.in_fold("doc_id", 5, 0))
    scores = quality.score_quality(documents, quality.fit_quality(documents, labels))
    want = {r.doc_id for r in scores.where(F.col("score") >= quality.THRESHOLD).collect()}
    assert {r.doc_id for r in corpus_pipeline.quality_stage(spark, documents, data_dir).collect()} == want


def test_line_stage(spark, documents, data_dir):
    out = {r.doc_id: r for r in corpus_pipeline.line_dedup_stage(spark, documents, data_dir).collect()}
    cleaned = {r.doc_id: r.text for r in line_dedup.dedup_lines(documents).collect()}
    for r in documents.collect():
        if r.doc_id in out:
            assert out[r.doc_id].text == cleaned[r.doc_id] and out[r.doc_id].n_chars == len(out[r.doc_id].text)
        else:
            assert not cleaned[r.doc_id].strip() and r.text.strip()


def test_near_stage(spark, documents, data_dir):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    want = {k for k, _, _, kept in brute(rows) if kept}
    assert {r.doc_id for r in corpus_pipeline.near_dedup_stage(spark, documents, data_dir).collect()} == want
    assert minhash.near_duplicates(documents).count() == len(rows)


def test_decontamination_stage(spark, documents, data_dir):
    bench = spark.read.parquet(f"{data_dir}/benchmark.parquet")
    items = [" ".join(r.text.lower().split()) for r in bench.collect()]
    whole = {r.doc_id for r in documents.collect() if any(i in " ".join(r.text.lower().split()) for i in items)}
    kept = {r.doc_id for r in corpus_pipeline.decontamination_stage(spark, documents, data_dir).collect()}
    dirty = {r.doc_id for r in decontam.contamination(documents, bench).collect()}
    assert not whole & kept and kept == {r.doc_id for r in documents.collect()} - dirty


BLANKS = " \t\n\x0b\x0c\r"


def plain_lines(rows):
    """(doc_id, text) after line dedup, by the rules as they are written; documents that lose everything go."""
    sites, holders = defaultdict(set), defaultdict(set)
    for key, text, site in rows:
        for line in {x.strip(BLANKS) for x in text.split("\n")} - {""}:
            sites[line].add(site or "")
            holders[line].add(key)
    bad = {x for x in sites if len(sites[x]) >= 8 or (len(x.split()) > 50 and len(holders[x]) > 1)}
    out = []
    for key, text, _ in rows:
        lines = text.split("\n")
        left = [x for x in lines if not (x.strip(BLANKS) in bad and min(holders[x.strip(BLANKS)]) != key)]
        if len(left) == len(lines) or "".join(left).strip(BLANKS):
            out.append((key, "\n".join(left)))
    return out


def plain_overlap(text, item):
    """Whether some window of 20 words (or the whole item) on some diagonal has 80 % equal words."""
    rule = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    words, own = (re.findall(rule, x.lower()) for x in (text, item))
    size = min(20, len(own))
    need, diagonals = math.ceil(0.8 * size - 1e-9), defaultdict(set)
    places = defaultdict(list)
    for i, w in enumerate(words):
        places[w].append(i)
    for k, w in enumerate(own):
        for i in places[w]:
            diagonals[i - k].add(k)
    return any(sum(s <= k < s + size for k in found) >= need for found in diagonals.values() if len(found) >= need for s in range(len(own) - size + 1))


def test_run_against_a_plain_version(spark, documents, data_dir):
    labels = spark.read.parquet(f"{data_dir}/labels.parquet").where(~quality.in_fold("doc_id", 5, 0))
    model = quality.fit_quality(documents, labels)
    rows = [(r.doc_id, r.text, r.source) for r in documents.collect()]
    scored = [r for r in rows if plain_score(model, r[1]) >= quality.THRESHOLD]
    lines = plain_lines(scored)
    apart = {k for k, _, _, kept in brute(lines) if kept}
    items = [r.text for r in spark.read.parquet(f"{data_dir}/benchmark.parquet").collect()]
    want = {k: text for k, text in lines if k in apart and not any(plain_overlap(text, x) for x in items)}
    assert len(rows) > len(scored) > len(apart) > len(want) > 0
    df = corpus_pipeline.run(spark, data_dir)
    assert df.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in df.collect():
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert pieces.keys() == want.keys()
    encoder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for k, own in pieces.items():
        ids, at = np.array([*encoder.encode(want[k], add_special_tokens=False).ids, 0], "<u4"), 0
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024 and at & (at - 1) == 0


@pytest.fixture(scope="module")
def odd_dir(spark, data_dir, tmp_path_factory):
    """Tables beside the odd documents: labels and benchmark with nulls and repeated rows, and both without rows."""
    base = tmp_path_factory.mktemp("odd")
    for name, empty in (("some", False), ("none", True)):
        for t in ("labels", "benchmark"):
            df = spark.read.parquet(f"{data_dir}/{t}.parquet")
            nulls = spark.createDataFrame([tuple([None] * len(df.columns))], df.schema)
            (df.where("false") if empty else df.unionByName(nulls).unionByName(df.limit(3))).write.parquet(f"file://{base}/{name}/{t}.parquet")
    return f"file://{base}"


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_stand_odd_rows(spark, odd, none, clash, odd_dir, name, stage):
    nulls = spark.createDataFrame([(None, None, None, None, None)] * 2, odd.schema)
    docs = clash(odd.unionByName(nulls)).cache()
    for beside in ("some", "none"):
        out = stage(spark, docs, f"{odd_dir}/{beside}")
        keys = {r.doc_id for r in out.select("doc_id").collect()}
        assert keys <= {r.doc_id for r in docs.select("doc_id").collect()} and None in keys
        if name != "packing":
            assert set(corpus_pipeline.COLUMNS) <= set(out.columns)
            # Rows with an empty text stay in every filtering stage but the classifier's, which judges them like others.
            assert name == "quality" or {0, 1, 2, 3} <= keys
        assert stage(spark, none, f"{odd_dir}/{beside}").collect() == []


def test_registered_queries(spark, data_dir):
    names = set(__spark_entry__.queries())
    assert {f"op{n}_" for n in range(1, 11)} == {f"{n.split('_')[0]}_" for n in names if n.startswith("op")} and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= names


@pytest.mark.parametrize("name", ["op2_line_dedup", "op6_exact_dedup", "op7_decontamination", "op8_url_filter", "op10_license_scan"])
def test_sql(spark, data_dir, name):
    assert_same(__spark_entry__.queries()[name](spark, data_dir), connect(data_dir), __spark_entry__.oracle_sql()[name])

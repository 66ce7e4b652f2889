"""Sharding, exact dedup and decontamination: brute force and odd input."""

import hashlib
import math
import random
from itertools import combinations
import struct
import zlib
from collections import defaultdict

import pytest
import xxhash

from lithograin.llm import decontam, exact_dedup, sharding

SPACE = dict.fromkeys(map(ord, " \t\n\x0b\x0c\r"))


def draw(key, shard):
    h = xxhash.xxh64_intdigest(struct.pack("<q", key), 42)
    h = xxhash.xxh64_intdigest(struct.pack("<i", shard), h)
    return -math.log(((h >> 11) + 0.5) / 2**53)


def test_shards_against_brute_force(make, odd, clash):
    docs = clash(make([(i, f"text {i % 7}") for i in range(500)]))
    weights = [1.0] * 23 + [3.0]
    rows = sharding.shard_documents(docs, weights, [*weights, 1.0]).collect()
    slots = defaultdict(list)
    for r in rows:
        assert r.shard == min(range(24), key=lambda s: (draw(r.doc_id, s) / weights[s], s))
        assert r.grown_shard in (r.shard, 24)
        text = f"text {r.doc_id % 7}"
        assert (r.size, r.text_crc32, r.law) == (len(text) + 8, zlib.crc32(text.encode()), "key")
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert 0 < sum(r.grown_shard == 24 for r in rows) < 60
    assert 40 < len(slots[23]) < 110  # three times the weight


def test_shards_of_odd_rows(odd, none):
    rows = sharding.shard_documents(odd, [1.0] * 4, [1.0] * 5).collect()
    assert len(rows) == odd.count() and all(r.size >= 8 for r in rows)
    assert len({(r.shard, r.slot) for r in rows}) == len(rows)
    assert sharding.shard_documents(none, [1.0]).collect() == []
    for bad in ([], [0.0], [1.0, -1.0]):
        with pytest.raises(ValueError):
            sharding.rendezvous(None, bad)


@pytest.mark.parametrize("share", [0.001, 0.2])
def test_exact_dedup_against_brute_force(make, odd, clash, share):
    rng = random.Random(1)
    texts = [" ".join(rng.choices("ab", k=rng.randint(0, 4))) + " " * rng.randint(0, 2) for _ in range(300)] + ["hot  text"] * 150 + ["hot text "] * 20
    docs = clash(make(texts)).unionByName(clash(odd))
    rows = exact_dedup.exact_duplicates(docs, share=share).collect()
    groups = defaultdict(list)
    for r in docs.select("doc_id", "text").collect():
        text = r.text or ""
        groups[text.translate(SPACE)].append((-len(text), r.doc_id is not None, r.doc_id))
    want = []
    for norm, members in groups.items():
        best = min(members)[2]
        want += [(m[2], best, len(members), m[2] == best, hashlib.sha256(norm.encode()).hexdigest()) for m in members]
    assert sorted(map(tuple, rows), key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("share", [0.0, 1.0])
def test_exact_dedup_of_repeated_keys(make, share):
    rows = [(5, "a b", "s"), (5, "a  b", "s"), (6, "ab", "s"), (6, "ab", "s"), (None, "c", "s"), (None, "c ", "s")]
    found = exact_dedup.exact_duplicates(make(rows), share=share).collect()
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept) for r in found) == [("5", "5", 4, False), ("5", "5", 4, True), ("6", "5", 4, False), ("6", "5", 4, False), ("None", "None", 2, False), ("None", "None", 2, True)]


def test_exact_dedup_of_nothing(none):
    assert exact_dedup.exact_duplicates(none).collect() == []


def words(rng, n):
    return [f"w{rng.randint(0, 5000)}" for _ in range(n)]


def test_decontamination(spark, make, none, clash):
    rng = random.Random(2)
    items = [(i, " ".join(words(rng, rng.choice([14, 20, 45])))) for i in range(12)] + [(12, "too short"), (13, None), (14, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs, want = [], set()
    for i in range(60):
        text = words(rng, 120)
        if i % 3 == 0:
            item = i % 12
            copy = items[item][1].split()
            for at in rng.sample(range(len(copy)), len(copy) // 12):  # substituted words
                copy[at] = "other"
            at = rng.randint(0, 100)
            text[at:at] = [w.upper() + "," if k % 2 else w for k, w in enumerate(copy)]
            want.add((i, item))
        if i % 3 == 1:  # half of an item's words in another order: clean
            text[40:40] = rng.sample(items[0][1].split(), 10)
        docs.append((i, " ".join(text)))
    docs += [(100, items[2][1]), (101, None), (102, ""), (103, items[3][1]), (103, items[3][1])]
    want |= {(100, 2), (103, 3)}
    df = clash(make(docs))
    for limit in (10**6, 0):  # broadcast, and by shuffle
        found = decontam.contamination(df, bench, broadcast_seeds=limit).collect()
        assert {(r.doc_id, r.item_id) for r in found} == want
        assert all(r.matched >= 0.8 * r.compared - 1e-9 and r.first_word >= 0 for r in found)
    clean = decontam.remove_contaminated(df, bench)
    assert clean.columns == df.columns
    assert {r.doc_id for r in clean.collect()} == {i for i, _ in docs} - {i for i, _ in want}
    assert decontam.contamination(none, bench).collect() == []
    assert decontam.contamination(df, bench.where("false")).collect() == []


def overlaps(doc, item):
    """(diagonals, first equal token, most equal tokens) of every overlap, by comparing all windows."""
    size = min(20, len(item))
    found, first = {}, []
    for shift in range(-len(item), len(doc)):
        equal = [0 <= k + shift < len(doc) and doc[k + shift] == w for k, w in enumerate(item)]
        counts = {s: sum(equal[s : s + size]) for s in range(len(item) - size + 1)}
        good = [s for s, n in counts.items() if n >= math.ceil(0.8 * size - 1e-9)]
        if good:
            found[shift] = max(counts.values())
            first += [min(k for k in range(s, s + size) if equal[k]) + shift for s in good]
    return len(found), min(first, default=0), max(found.values(), default=0)


def test_masks_find_every_placement():
    for size, masks in enumerate(decontam.masks_for(20, 0.8), 1):
        wrong = size - decontam.needed(size, 0.8)
        assert masks in dict(decontam.MASKS).values()  # none had to be replaced
        for placement in combinations(range(size), wrong):
            assert any(all(at + i not in placement for i, bit in enumerate(mask) if bit == "1") for mask in masks for at in range(size - len(mask) + 1)), (size, placement)
    assert decontam.masks_for(20, 0.5)[-1] == ("1",) and not decontam.covers(("111",), 5, 2) and decontam.covers(("11",), 5, 1)


@pytest.mark.parametrize("share", [0.8, 0.6])
def test_decontamination_finds_every_overlap(spark, make, share):
    rng = random.Random(5)
    items = [[f"i{n}w{k}" for k in range(n)] for n in (*range(1, 21), 33)]
    docs = []
    for item in items:
        size = min(20, len(item))
        for extra in (0, 0, 0, 0, 1):  # as many substitutions as the threshold allows, or one more: clean
            at = rng.randint(0, len(item) - size)
            copy = item[at : at + size]
            for k in rng.sample(range(size), min(size, size - math.ceil(0.8 * size - 1e-9) + extra)):
                copy[k] = "other"
            docs.append([*words(rng, rng.choice([0, 3, 30])), *copy, *words(rng, rng.choice([0, 3, 30]))])
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    frame = make([" ".join(d) for d in docs])
    if share != 0.8:  # a share for which the fixed masks aren't made: nothing is missed either
        some = {(r.doc_id, r.item_id) for r in decontam.contamination(frame, bench).collect()}
        assert some <= {(r.doc_id, r.item_id) for r in decontam.contamination(frame, bench, min_share=share).collect()}
        return
    want = {(d, i, *overlaps(doc, item)) for d, doc in enumerate(docs) for i, item in enumerate(items)}
    for limit in (10**6, 0):
        found = decontam.contamination(frame, bench, broadcast_seeds=limit).collect()
        assert {(r.doc_id, r.item_id, r.n_places, r.first_word, r.matched) for r in found} == {w for w in want if w[2] or w[4]}


def test_decontamination_of_ties_and_null_keys(spark, make):
    passage = " ".join(f"p{k}" for k in range(22))
    bench = spark.createDataFrame([(1, passage), (1, passage), (None, passage), (2, "gone")], "item_id long, text string")
    docs = make([(None, f"a {passage} b {passage}", "s"), (None, f"a {passage} b {passage}", "s"), (7, "x " * 50_000 + passage, "s"), (8, "clean text", "s")])
    for limit in (10**6, 0):
        found = decontam.contamination(docs, bench, broadcast_seeds=limit).collect()
        want = [(k, i, n, at, 20, 20) for k, n, at in ((None, 2, 1), (7, 1, 50_000)) for i in (1, None)]
        assert sorted(map(tuple, found), key=repr) == sorted(want, key=repr)
    assert [r.doc_id for r in decontam.remove_contaminated(docs, bench).collect()] == [8]


def test_native_plans_have_no_python(spark, make):
    docs = make(["a b", "a b", "c"])
    bench = spark.createDataFrame([(1, "a b c d e f g h i j k l m")], "item_id long, text string")
    for df in (sharding.shard_documents(docs, [1.0, 1.0]), exact_dedup.exact_duplicates(docs), decontam.contamination(docs, bench)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan and "Cartesian" not in plan

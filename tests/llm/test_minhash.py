"""Near duplicates and components against brute force."""

import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql.functions import spark_partition_id

from lithograin.llm import minhash
from lithograin.llm.common import TextBatch
from lithograin.llm.components import connected_components
from lithograin.llm.minhash import NearDupConfig

LOWER = {c: c + 32 for c in range(65, 91)}


def brute(rows, percent=75):
    """(doc_id, n_shingles, component, kept) for rows with distinct ids."""
    sets = {}
    for key, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
        sets[key] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    parent = {k: k for k in sets}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            common = len(sets[a] & sets[b])
            if sets[a] and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return sorted((k, len(s), root(k), root(k) == k) for k, s in sets.items())


def corpus(rng, groups=14):
    """Copies with few and many changed words, chains of gradual change, shared passages."""
    rows, key = [], 0
    passage = " ".join(f"p{i}" for i in range(60))
    for g in range(groups):
        words = [f"g{g}w{rng.randint(0, 400)}" for _ in range(rng.choice([3, 8, 40, 120]))]
        for _ in range(rng.randint(1, 14)):
            copy = list(words)
            for _ in range(rng.choice([0, 0, 1, 2, 4, 8])):
                copy[rng.randrange(len(copy))] = f"x{rng.randint(0, 9999)}"
            if rng.random() < 0.3:
                words = copy  # the next copies follow this one
            text = " ".join(copy)
            rows.append((key, text.upper() if rng.random() < 0.3 else text))
            key += 1
    for _ in range(40):
        own = " ".join(f"o{rng.randint(0, 99999)}" for _ in range(rng.randint(10, 90)))
        rows.append((key, f"{passage} {own}"))
        key += 1
    return rows


@pytest.mark.parametrize("config", [NearDupConfig(), NearDupConfig(block=4), NearDupConfig(block_shingles=300), NearDupConfig(block=2, broadcast_ids=0)])
def test_near_duplicates_against_brute_force(make, clash, config):
    rng = random.Random(7)
    rows = corpus(rng) + [(5000, None), (5001, ""), (5002, " \n "), (5003, "a b"), (5004, "A  b"), (5005, "a b c")]
    rng.shuffle(rows)
    found = minhash.near_duplicates(clash(make(rows)), config=config).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in found) == brute(rows)


def test_blocks_of_a_bucket_are_dealt_to_many_tasks(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        n = 60
        members = spark.range(n).selectExpr("id DIV 1000000 AS bucket", "0 AS band", "id", "id AS component", "0L AS top", f"{n - 1}L AS n_out")
        nodes = spark.range(n).selectExpr("id", "5L AS n", "cast(repeat('x', 256) AS binary) AS sig")
        blocks = minhash.blocks_of(members, nodes, NearDupConfig(block=4))
        dealt = minhash.by_block(blocks, 8).applyInPandas(lambda pdf: pdf[["p", "q"]].iloc[:1].assign(rows=len(pdf)), "p int, q int, rows long")
        assert "hashpartitioning(bucket" in dealt._jdf.queryExecution().executedPlan().toString() and "p#" in dealt._jdf.queryExecution().executedPlan().toString().split("FlatMapGroupsInPandas")[1].split("hashpartitioning(")[1].split(")")[0]
        found = dealt.select("*", spark_partition_id().alias("task")).collect()
        assert len({(r.p, r.q) for r in found}) == len(found) > 50 and len({r.task for r in found}) == 8
        assert max(r.rows for r in found) <= 40
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_bands_of_one_row(make):
    # Buckets of documents that are alike but not linked, so blocks have to find the links.
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(words)] + [" ".join([*words[: 40 * k], *(f"x{k}_{i}" for i in range(60)), *words[40 * k + 60 :]]) for k in range(1, 8)]
    rows = [(100 - i, t) for i, t in enumerate(texts)]
    config = NearDupConfig(bands=8, rows=1, percent=55, block=2)
    found = minhash.near_duplicates(make(rows), config=config).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in found) == brute(rows, 55)


def rows_of_id_joins(spark, after):
    """Rows that inner joins by id gave in the queries after this one, and the last query's number."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    store = spark._jsparkSession.sharedState().statusStore()
    total, last, found = 0, after, store.executionsList().iterator()
    while found.hasNext():
        number = found.next().executionId()
        last = max(last, number)
        if number <= after:
            continue
        values, nodes = store.executionMetrics(number), store.planGraph(number).allNodes().iterator()
        while nodes.hasNext():
            node = nodes.next()
            if "Join" in node.name() and re.search(r"\[id#\d+L?\], \[id#\d+L?\], Inner", node.desc()):
                metrics = node.metrics().iterator()
                while metrics.hasNext():
                    m = metrics.next()
                    if m.name() == "number of output rows" and (value := values.get(m.accumulatorId())).isDefined():
                        total += int(value.get().replace(",", ""))
    return total, last


def test_signatures_are_joined_once_for_each_document(spark, make):
    # All share a passage and many buckets, none are linked: every bucket goes to blocks.
    passage = " ".join(f"p{i}" for i in range(100))
    rows = [(k, f"{passage} " + " ".join(f"o{k}_{i}" for i in range(60))) for k in range(40)]
    _, last = rows_of_id_joins(spark, -1)
    found = minhash.near_duplicates(make(rows), config=NearDupConfig(rows=1, block=4)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in found) == brute(rows)
    joined, _ = rows_of_id_joins(spark, last)
    assert 0 < joined <= 4 * len(rows)


def test_odd_rows(odd, none):
    found = minhash.near_duplicates(odd).collect()
    assert len(found) == odd.count()
    by_key = {r.doc_id: r for r in found}
    assert by_key[0].n_shingles == 0 and by_key[0].kept
    assert by_key[10].component_id == 9 and not by_key[10].kept
    assert by_key[None].kept
    kept = minhash.drop_near_duplicates(odd)
    assert kept.columns == odd.columns and kept.where("doc_id is null").count() == 1
    assert minhash.near_duplicates(none).collect() == []


def test_signatures_estimate_similarity():
    config = NearDupConfig()
    words = [f"w{i}" for i in range(1000)]
    texts = [" ".join(words), " ".join(words[150:]), " ".join(words[500:] + [f"z{i}" for i in range(500)])]
    sets, sizes = minhash.shingle_sets(TextBatch(pa.array(texts)), 5)
    sig = minhash.signatures(sets, sizes, config)
    parts = np.split(sets, np.cumsum(sizes)[:-1])
    for i in range(3):
        for j in range(i):
            common = len(np.intersect1d(parts[i], parts[j]))
            true = common / (sizes[i] + sizes[j] - common)
            assert abs((sig[i] == sig[j]).mean() - true) < 0.16


def test_components(spark):
    rng = random.Random(8)
    links = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(150)] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, i) for i in range(2001, 2100)] + [(7, 7)]
    parent = defaultdict(lambda: None)

    def root(k):
        parent[k] = k if parent[k] is None else parent[k]
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in links:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    want = sorted((k, root(k)) for k in {x for a, b in links if a != b for x in (a, b)})
    df = spark.createDataFrame(links, "u long, v long")
    assert sorted(map(tuple, connected_components(df).collect())) == want
    assert connected_components(df.where("false")).collect() == []

"""Near-duplicate detection: MinHash, banding, verification, connected components.

1. One pass makes each document's signature: the minima of 128 universal hash
   functions over its distinct word shingles, 16 bits of each. Documents with equal sets
   share one representative from here on.
2. Representatives that agree in all rows of a band share a bucket. In every bucket
   each is paired with the bucket's smallest one; no other pair is made there.
3. Pairs that pass a length filter and a signature filter are verified on full sets.
   Verified links give components.
4. Only where a bucket still holds several components are its other pairs compared, across
   components. Such buckets first get further leaders, as long as that joins much; then
   blocks compare the rest, each pair in the first band that it shares. A block verifies pairs
   on full sets and returns the links that join components, never its pairs.

Sets hold 64-bit hashes of shingles. With 32 bands of 4 rows a link at similarity 0.75 is
missed with a chance under 6e-6, in buckets of any size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, TextBatch, bound_batches, few, kept_by_worker, materialize, mix64, release, text_or_empty, text_pieces
from .components import connected_components


@dataclass(frozen=True)
class NearDupConfig:
    words: int = 5
    #: A link has ``100 * intersection >= percent * union``.
    percent: int = 75
    bands: int = 32
    rows: int = 4
    seed: int = 20240229
    #: Standard deviations that a signature may lie below the threshold.
    slack: float = 5.7
    #: Members of a block of a bucket, and shingles in their sets; they bound a task's memory.
    block: int = 512
    block_shingles: int = 1 << 20
    #: Members of a bucket's largest component that the members outside it are compared with before all others.
    further: int = 4
    #: Documents whose ids are broadcast to find their texts (16 bytes each); more take a shuffle.
    broadcast_ids: int = BROADCAST_IDS

    @property
    def n_hashes(self) -> int:
        return self.bands * self.rows

    @property
    def least_equal(self) -> int:
        """Equal minima that a linked pair has but for a chance of about 1e-8."""
        j = self.percent / 100
        return int(self.n_hashes * j - self.slack * (self.n_hashes * j * (1 - j)) ** 0.5)


def shingle_sets(batch: TextBatch, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts end to end, and each text's count."""
    h, counts = batch.hashes(), batch.counts
    rng = np.random.default_rng(words)
    factors = rng.integers(1, 1 << 63, size=words, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    with np.errstate(over="ignore"):
        n = max(0, len(h) - words + 1)
        mixed = np.zeros(n, dtype=np.uint64)
        for k in range(words):
            mixed += h[k : k + n] * factors[k]
    mixed = mix64(mixed)
    parts, sizes = [], np.zeros(batch.n, dtype=np.int64)
    for d in range(batch.n):
        first, count = int(batch.first[d]), int(counts[d])
        if count >= words:
            own = np.unique(mixed[first : first + count - words + 1])
        elif count:
            with np.errstate(over="ignore"):
                own = mix64(np.array([(h[first : first + count] * factors[:count]).sum() + np.uint64(count)], dtype=np.uint64))
        else:
            continue
        parts.append(own)
        sizes[d] = len(own)
    return np.concatenate(parts) if parts else np.empty(0, np.uint64), sizes


def signatures(sets: np.ndarray, sizes: np.ndarray, config: NearDupConfig) -> np.ndarray:
    """(texts, hashes) 32-bit minima of multiply-add-shift hashes; rows of empty texts stay 0."""
    rng = np.random.default_rng(config.seed)
    a = rng.integers(0, 1 << 64, size=config.n_hashes, dtype=np.uint64) | np.uint64(1)
    b = rng.integers(0, 1 << 64, size=config.n_hashes, dtype=np.uint64)
    out = np.zeros((len(sizes), config.n_hashes), dtype=np.uint32)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    starts = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
    x = sets >> np.uint64(32)
    value = np.empty_like(x)
    with np.errstate(over="ignore"):
        for k in range(config.n_hashes):
            np.multiply(x, a[k], out=value)
            np.add(value, b[k], out=value)
            out[full, k] = np.minimum.reduceat(value, starts) >> np.uint64(32)
    return out


def sketches(docs: DataFrame, key: str, text: str, config: NearDupConfig) -> DataFrame:
    """key, n_shingles, set_hi, set_lo (a hash of the set), sig (two bytes of each minimum)."""
    kind = docs.schema[key].dataType.simpleString()
    names = [key, "n_shingles", "set_hi", "set_lo", "sig"]

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_by_worker("near duplicates")
        for batch in batches:
            for piece in text_pieces(batch, 1, max_bytes=1 << 19):
                sets, sizes = shingle_sets(TextBatch(piece.column(1)), config.words)
                low = (signatures(sets, sizes, config) & np.uint32(0xFFFF)).astype("<u2")
                with np.errstate(over="ignore"):
                    ends = np.cumsum(sizes)
                    sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(x)]) for x in (mix64(sets), mix64(sets ^ np.uint64(0xA5A5A5A55A5A5A5A)))]
                    hi, lo = (s[ends] - s[ends - sizes] for s in sums)
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(sizes), pa.array(hi.view(np.int64)), pa.array(lo.view(np.int64)), pa.array([r.tobytes() for r in low], pa.binary())], names=names)

    return docs.select(F.col(key), text_or_empty(text).alias(text)).mapInArrow(sketch, f"{key} {kind}, n_shingles long, set_hi long, set_lo long, sig binary")


def full_sets(docs: DataFrame, ids: DataFrame, key: str, text: str, config: NearDupConfig) -> DataFrame:
    """id, shingles: the whole sets of the documents named in ``ids`` (distinct). Texts aren't
    shuffled while the ids are few enough to be broadcast."""
    kind = docs.schema[key].dataType.simpleString()

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_by_worker("near duplicates")
        for batch in batches:
            for piece in text_pieces(batch, 1, max_bytes=1 << 19):
                values, sizes = shingle_sets(TextBatch(piece.column(1)), config.words)
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64)))], names=["id", "shingles"])

    own = docs.select(F.col(key).alias("id"), text_or_empty(text).alias("text"))
    return own.join(few(ids, config.broadcast_ids), "id", "left_semi").mapInArrow(sets, f"id {kind}, shingles array<long>")


def verified_links(sets: DataFrame, pairs: DataFrame, config: NearDupConfig) -> DataFrame:
    """u, v of the distinct pairs whose full sets pass the threshold. (A group by u and v would
    keep a hot v from being split.)"""
    left = sets.select(F.col("id").alias("u"), F.col("shingles").alias("a"))
    right = sets.select(F.col("id").alias("v"), F.col("shingles").alias("b"))
    both = pairs.join(left, "u").join(right, "v")
    common = both.select("u", "v", F.size(F.array_intersect("a", "b")).cast("long").alias("i"), (F.size("a") + F.size("b")).cast("long").alias("total"))
    return common.where(F.col("i") * 100 >= (F.col("total") - F.col("i")) * config.percent).select("u", "v")


def likely_pairs(pairs: DataFrame, nodes: DataFrame, config: NearDupConfig) -> DataFrame:
    """The distinct pairs (u, v) that pass the length and the signature filter."""
    sides = pairs.join(nodes.select(F.col("id").alias("u"), F.col("n").alias("nu"), F.col("sig").alias("su")), "u").join(nodes.select(F.col("id").alias("v"), F.col("n").alias("nv"), F.col("sig").alias("sv")), "v")
    sides = sides.where(F.least("nu", "nv") * 100 >= F.greatest("nu", "nv") * config.percent)
    width, least = config.n_hashes, config.least_equal

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                a, b = (np.frombuffer(b"".join(part.column(k).to_pylist()), "<u2").reshape(-1, width) for k in (2, 3))
                chosen = (a == b).sum(axis=1) >= least
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], names=["u", "v"]).filter(pa.array(chosen))

    kind = nodes.schema["id"].dataType.simpleString()
    return sides.select("u", "v", "su", "sv").mapInArrow(keep, f"u {kind}, v {kind}")


def leader_links(docs: DataFrame, pairs: DataFrame, nodes: DataFrame, key: str, text: str, config: NearDupConfig) -> DataFrame:
    """u, v: the verified ones of distinct pairs; only documents of likely pairs have their sets made."""
    likely = materialize(likely_pairs(pairs, nodes, config), "likely")
    sets = materialize(full_sets(docs, likely.select(F.col("u").alias("id")).unionByName(likely.select(F.col("v").alias("id"))).distinct(), key, text, config), "sets")
    found = materialize(verified_links(sets, likely, config), "verified")
    release(likely, sets)
    return found


def bucket_rows(nodes: DataFrame, config: NearDupConfig) -> DataFrame:
    """bucket, band, id: one row for each band of each node."""
    width = 2 * config.rows
    values = F.array(*(F.substring("sig", width * k + 1, width) for k in range(config.bands)))
    banded = nodes.select("id", F.posexplode(values).alias("band", "value"))
    return banded.select(F.xxhash64("band", "value").alias("bucket"), "band", "id")


def open_members(members: DataFrame, component: DataFrame) -> DataFrame:
    """bucket, band, id, component, top (the component with most members in the bucket), n_out (members
    outside it): the members of buckets that hold several components."""
    labelled = members.join(component.withColumnRenamed("node", "id"), "id", "left").select("bucket", "band", "id", F.coalesce("component", "id").alias("component"))
    counts = labelled.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("n"))
    tops = counts.groupBy("bucket").agg(F.max(F.struct("n", (-F.col("component")).alias("neg"))).alias("most"), F.sum("n").alias("size")).select("bucket", (-F.col("most.neg")).alias("top"), (F.col("size") - F.col("most.n")).alias("n_out")).where("n_out > 0")
    # Written first: joined in the same stage that groups by bucket, a hot bucket couldn't be split.
    return labelled.join(materialize(tops, "tops"), "bucket")


def next_leaders(members: DataFrame, config: NearDupConfig) -> DataFrame:
    """u, v: in every open bucket a few members of its largest component, drawn by a hash, with all members outside it; in
    buckets with more than a block outside, also the smallest member out there with all members of other components."""
    draws = [F.min(F.struct(F.xxhash64(F.lit(k), "id").alias("drawn"), "id")).getField("id") for k in range(config.further)]
    few_inside = members.where("component = top").groupBy("bucket").agg(F.array_distinct(F.array(*draws)).alias("drawn")).select("bucket", F.explode("drawn").alias("leader"))
    outside = members.where("component <> top").select("bucket", "id").join(few_inside, "bucket").select("id", "leader")
    large = members.where(F.col("n_out") > config.block)
    lead = large.where("component <> top").groupBy("bucket").agg(F.min(F.struct("id", "component")).alias("lead")).select("bucket", F.col("lead.id").alias("leader"), F.col("lead.component").alias("own"))
    apart = large.join(lead, "bucket").where("component <> own").select("id", "leader")
    return outside.unionByName(apart).select(F.greatest("id", "leader").alias("u"), F.least("id", "leader").alias("v")).distinct()


def by_document(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """id, component, n, sig, places (bucket, band, top; one for each band at most): what blocks compare, joined once for
    each document and not for each bucket that it is in."""
    places = members.groupBy("id").agg(F.min("component").alias("component"), F.collect_list(F.struct("bucket", "band", "top")).alias("places"))
    return places.join(nodes.select("id", "n", "sig"), "id")


def _placed(gathered: DataFrame, *columns: str) -> DataFrame:
    """A row for each bucket of each document."""
    rows = gathered.select("id", "component", "n", *columns, F.explode("places").alias("place"))
    return rows.select("place.bucket", "place.band", "id", "component", "n", *columns, (F.col("component") != F.col("place.top")).alias("out"))


def bucket_parts(gathered: DataFrame, config: NearDupConfig) -> DataFrame:
    """bucket, outer, inner (numbers of parts), repeated (rows of all its blocks)."""

    def parts(side: str) -> list:
        own = F.when(F.col("out") == F.lit(side == "outer"), F.col("n"))
        return [F.greatest(F.ceil(F.count(own) / config.block), F.ceil(F.sum(own) / config.block_shingles), F.lit(1)).cast("int").alias(side), F.count(own).alias(f"n_{side}")]

    sizes = _placed(gathered).groupBy("bucket").agg(*parts("outer"), *parts("inner"))
    return sizes.select("bucket", "outer", "inner", (F.col("n_outer") * (F.col("outer") + F.col("inner")) + F.col("n_inner") * F.col("outer")).alias("repeated"))


def dealt_to_blocks(gathered: DataFrame, parts: DataFrame) -> DataFrame:
    """Each member once for every block (p, q) that its part is in; see ``blocks_of``."""
    drawn = F.xxhash64(F.lit("block"), "id")
    dealt = _placed(gathered, "sig").join(parts.select("bucket", "outer", "inner"), "bucket").withColumn("part", F.when(F.col("out"), F.pmod(drawn, F.col("outer"))).otherwise(F.col("outer") + F.pmod(drawn, F.col("inner"))).cast("int"))
    spread = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(F.col("out"), F.col("outer") + F.col("inner")).otherwise(F.col("outer")) - 1)))
    return spread.select("bucket", "band", "id", "component", "n", "sig", "part", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"))


def blocks_of(members: DataFrame, nodes: DataFrame, config: NearDupConfig) -> DataFrame:
    """Each member once for every block (p, q) that its part is in. A bucket's members outside its largest
    component make parts of their own, which meet all parts; the parts inside it meet only those. A part has
    about ``block`` members, and fewer where their sets are large. The rows carry
    what a block compares, so that nothing is joined to them once they are repeated."""
    gathered = by_document(members, nodes)
    return dealt_to_blocks(gathered, bucket_parts(gathered, config))


def _likely_in_block(pdf: pd.DataFrame, config: NearDupConfig) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers i, j and equal minima of the block's pairs that pass all filters,
    lie in different components and share no band before the block's own."""
    p, q, band = int(pdf["p"].iloc[0]), int(pdf["q"].iloc[0]), int(pdf["band"].iloc[0])
    part, component, n, ids = (pdf[c].to_numpy() for c in ("part", "component", "n", "id"))
    sig = np.stack([np.frombuffer(x, "<u2") for x in pdf["sig"]])
    left, right = np.flatnonzero(part == p), np.flatnonzero(part == q)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for i in left:
        may = right[(component[right] != component[i]) & (np.minimum(n[right], n[i]) * 100 >= np.maximum(n[right], n[i]) * config.percent)]
        may = may[ids[may] > ids[i]] if p == q else may
        if len(may):
            same = sig[may] == sig[i]
            equal = np.count_nonzero(same, axis=1)
            keep = np.flatnonzero(equal >= config.least_equal)
            if band and len(keep):
                before = same[keep, : band * config.rows].reshape(len(keep), band, config.rows)
                keep = keep[~before.all(axis=2).any(axis=1)]
            if len(keep):
                found.append((np.full(len(keep), i), may[keep], equal[keep]))
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


BLOCK_KEY = ("bucket", "p", "q")
MOST_TASKS = 1 << 14


def by_block(rows: DataFrame, tasks: int):
    """Rows grouped by block and dealt by it: a join by bucket before would else leave all blocks of a bucket in one task."""
    return rows.repartition(tasks, *BLOCK_KEY).groupBy(*BLOCK_KEY)


def joining_links(docs: DataFrame, members: DataFrame, nodes: DataFrame, key: str, text: str, config: NearDupConfig) -> DataFrame:
    """u, v: verified links between components that share a bucket; in each block only those
    that join what the block hasn't joined yet. ``members``: what ``open_members`` gives."""
    kind = nodes.schema["id"].dataType.simpleString()
    gathered = materialize(by_document(members, nodes), "gathered")
    parts = materialize(bucket_parts(gathered, config), "parts")
    blocks = dealt_to_blocks(gathered, few(parts, config.broadcast_ids))
    # About a block a task: its rows are few bytes and much work, so bytes don't tell how many tasks are needed.
    tasks = min(MOST_TASKS, (parts.agg(F.sum("repeated")).first()[0] or 0) // config.block + 1)
    names = ["bucket", "band", "id", "component", "part", "p", "q"]

    def involved(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j, _ = _likely_in_block(pdf, config)
        return pdf.loc[pdf.index[np.union1d(i, j)], names]

    schema = f"bucket long, band int, id {kind}, component {kind}, part int, p int, q int"
    # Most tasks give a few rows: they are put together before they are written.
    asked = materialize(by_block(blocks, tasks).applyInPandas(involved, schema).hint("rebalance"), "asked")
    sets = materialize(full_sets(docs, asked.select("id").distinct(), key, text, config), "block-sets")

    def verify(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j, equal = _likely_in_block(pdf, config)
        ids, component = pdf["id"].to_numpy(), pdf["component"].to_numpy()
        sets = [np.asarray(x) for x in pdf["shingles"]]
        parent = {c: c for c in component.tolist()}

        def root(c):
            while parent[c] != c:
                parent[c] = parent[parent[c]]
                c = parent[c]
            return c

        links = []
        for k in np.argsort(-equal, kind="stable").tolist():
            a, b = int(i[k]), int(j[k])
            x, y = root(component[a]), root(component[b])
            if x == y:
                continue
            common = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
            if common * 100 >= (len(sets[a]) + len(sets[b]) - common) * config.percent:
                links.append((max(ids[a], ids[b]), min(ids[a], ids[b])))
                parent[max(x, y)] = min(x, y)
        return pd.DataFrame(links, columns=["u", "v"]).astype(pdf["id"].dtype)

    # Again once for each document, and then a row for each of its blocks.
    wanted = asked.groupBy("id").agg(F.collect_list(F.struct(*(c for c in names if c != "id"))).alias("blocks"))
    whole = wanted.join(gathered.select("id", "n", "sig"), "id").join(sets, "id").select("id", "n", "sig", "shingles", F.explode("blocks").alias("block")).select("block.*", "id", "n", "sig", "shingles")
    found = materialize(by_block(whole, tasks).applyInPandas(verify, f"u {kind}, v {kind}").hint("rebalance"), "joining")
    release(gathered, parts, asked, sets)
    return found


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", config: NearDupConfig | None = None) -> DataFrame:
    """key, n_shingles, component_id, kept: a row per input row.

    The set of a text: distinct shingles of ``words`` words (white-space separated, A-Z
    lower-cased); with fewer words the whole sequence as one. A null, empty or blank text
    has no set, is linked with nothing and stays, as does a row with a null key. ``component_id`` is the smallest key that
    links reach. Rows that repeat a key are documents of their own with that id; an empty
    table gives an empty result; other columns are ignored. The key must be an integer.
    """
    config = config or NearDupConfig()
    bound_batches(docs)
    sketch = materialize(sketches(docs, key, text, config), "sketches")
    best = F.min(F.struct(F.col(key).alias("id"), F.col("n_shingles").alias("n"), "sig")).alias("best")
    nodes = materialize(sketch.where((F.col("n_shingles") > 0) & F.col(key).isNotNull()).groupBy("set_hi", "set_lo").agg(best).select("set_hi", "set_lo", "best.*"), "nodes")
    rows = bucket_rows(nodes, config)
    leaders = materialize(rows.groupBy("bucket").agg(F.min("id").alias("leader"), F.count(F.lit(1)).alias("size")).where("size > 1"), "leaders")
    members = materialize(rows.join(leaders, "bucket").where("id <> leader"), "members")
    ids = materialize(members.select("id").unionByName(leaders.select(F.col("leader").alias("id"))).distinct(), "ids")
    near = materialize(nodes.select("id", "n", "sig").join(few(ids, config.broadcast_ids), "id", "left_semi"), "near")  # all others share no bucket
    pairs = members.select(F.col("id").alias("u"), F.col("leader").alias("v")).distinct()
    links = leader_links(docs, pairs, near, key, text, config)
    component = connected_components(links)
    # A bucket's leader has met all of its members by now; two others at least make an open pair.
    others = members.where("size > 2").select("bucket", "band", "id")
    met = materialize(open_members(others, component), "open")
    outside = _outside(met)
    while outside:
        more = leader_links(docs, next_leaders(met, config), near, key, text, config)
        if not more.isEmpty():
            component = connected_components(_with_more(component, more))
            release(met)
            met = materialize(open_members(others, component), "open")
        release(more)
        last, outside = outside, _outside(met)
        if outside * 4 > last * 3:
            break  # leaders join little here: the rest is compared in blocks
    more = joining_links(docs, met, near, key, text, config)
    if not more.isEmpty():
        component = connected_components(_with_more(component, more))
    release(leaders, members, ids, near, met, links, more)
    labels = nodes.select("set_hi", "set_lo", "id").join(component.withColumnRenamed("node", "id"), "id", "left").select("set_hi", "set_lo", F.coalesce("component", "id").alias("component_id"))
    found = sketch.select(key, "n_shingles", "set_hi", "set_lo").join(labels, ["set_hi", "set_lo"], "left")
    own = F.when((F.col("n_shingles") > 0) & F.col(key).isNotNull(), F.col("component_id")).otherwise(F.col(key))
    return found.select(key, "n_shingles", own.alias("component_id"), own.eqNullSafe(F.col(key)).alias("kept"))


def _with_more(component: DataFrame, more: DataFrame) -> DataFrame:
    """Links that reach as far as those that made the components and ``more`` together: a flat star for each component
    settles in fewer rounds than its links."""
    return component.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(more)


def _outside(members: DataFrame) -> int:
    """Members outside the largest component of their bucket."""
    return members.where("component <> top").count()


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", config: NearDupConfig | None = None) -> DataFrame:
    """The documents that stay: one of each component, and all without words; all input columns."""
    config = config or NearDupConfig()
    # A null key is never dropped, and one that repeats stays if any of its rows stays.
    dropped = near_duplicates(docs, key, text, config).groupBy(F.col(key).alias("__lithograin_dropped")).agg(F.max("kept").alias("any")).where(~F.col("any")).select("__lithograin_dropped")
    dropped = materialize(dropped, "dropped")
    return docs.join(few(dropped, config.broadcast_ids), F.col(key) == F.col("__lithograin_dropped"), "left_anti")

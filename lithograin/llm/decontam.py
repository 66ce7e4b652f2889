"""Benchmark decontamination by spaced seeds, with DataFrame functions only.

A mask is a fixed pattern of token positions that are compared and others that are ignored.
Test and training tokens are hashed under each mask at every position, and equal hashes
are joined. Around every hit both texts are compared token by token, on the hit's diagonal;
enough equal tokens in some window that holds the hit make it an overlap. Items of each size
have masks of which one agrees at some place however the allowed substitutions lie, so
no overlap is missed.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import few, materialize, text_or_empty

#: Items of so many words or more, and their masks; 1 is a position that is compared, 0 one that is ignored.
MASKS = ((15, ("111011", "101001101")), (10, ("101011", "1000111")), (5, ("10011", "1101")), (4, ("1111",)), (3, ("111",)), (2, ("11",)), (1, ("1",)))
#: Tokens of a verified window, and the share of them that must be equal.
WINDOW = 20
MIN_SHARE = 0.8
#: The test side is broadcast up to this many seeds (about 400 bytes each).
BROADCAST_SEEDS = 200_000
#: Placements of substitutions that are tried out to see whether masks find all of them.
MOST_PLACEMENTS = 200_000


def tokens(text: Column) -> Column:
    """Hashes of the words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the lower-cased text."""
    words = F.array_remove(F.split(F.lower(text), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")
    return F.transform(words, lambda w: F.xxhash64(w))


def needed(size: int, min_share: float) -> int:
    """Equal tokens that make a window of ``size`` tokens an overlap."""
    return max(1, math.ceil(size * min_share - 1e-9))


def covers(masks: tuple[str, ...], size: int, substituted: int) -> bool:
    """Whether some mask agrees at some place of ``size`` tokens wherever ``substituted`` of them differ."""
    if math.comb(size, substituted) > MOST_PLACEMENTS:
        return False
    places = [sum(1 << (i + at) for i, bit in enumerate(mask) if bit == "1") for mask in masks for at in range(size - len(mask) + 1)]
    return all(any(not place & wrong for place in places) for wrong in (sum(1 << i for i in c) for c in combinations(range(size), substituted)))


def masks_for(window: int, min_share: float, masks=MASKS) -> list[tuple[str, ...]]:
    """Masks of items of 1 .. ``window`` words (the last: and more). Where the fixed ones could miss an overlap, for a
    share other than the usual one, it is the longest run of equal tokens that every overlap has."""
    found = []
    for size in range(1, window + 1):
        fixed = next((own for least, own in masks if size >= least), ())
        wrong = size - needed(size, min_share)
        found.append(fixed if fixed and covers(fixed, size, wrong) else ("1" * math.ceil((size - wrong) / (wrong + 1)),))
    return found


def seed(mask: str) -> Column:
    """Hash of the tokens of column ``h`` that the mask compares from ``pos`` on."""
    return F.xxhash64(F.lit(mask), *(F.get("h", F.col("pos") + i) for i, bit in enumerate(mask) if bit == "1"))


def test_seeds(benchmark: DataFrame, item: str, text: str, window: int, min_share: float) -> DataFrame:
    """seed, mask, span, item id, item_pos, base, item (the tokens near the place), n_item, size, need."""
    by_size = masks_for(window, min_share)
    every = sorted({m for own in by_size for m in own})
    rows = benchmark.select(F.col(item).alias("item_id"), tokens(text_or_empty(text)).alias("h")).where(F.size("h") > 0).withColumn("size", F.least(F.lit(window), F.size("h")))
    own = F.get(F.array(*(F.array(*map(F.lit, masks)) for masks in by_size)), F.col("size") - 1)
    need = F.get(F.array(*(F.lit(needed(n, min_share)) for n in range(1, window + 1))), F.col("size") - 1)
    at = rows.withColumn("mask", F.explode(own)).withColumn("pos", F.explode(F.sequence(F.lit(0), F.size("h") - F.length("mask"))))
    base = F.greatest(F.lit(0), F.col("pos") + 1 - window)
    return at.select(
        F.coalesce(*(F.when(F.col("mask") == m, seed(m)) for m in every)).alias("seed"),
        "mask",
        F.length("mask").alias("span"),
        "item_id",
        F.col("pos").alias("item_pos"),
        base.alias("base"),
        F.slice("h", base + 1, F.lit(2 * window)).alias("item"),
        F.size("h").alias("n_item"),
        "size",
        need.alias("need"),
    )


def train_seeds(docs: DataFrame, masks: list[str]) -> DataFrame:
    """Adds pos and seed: a row for each mask and place in column ``h``. (Where a mask reaches over the
    end its seed means nothing, and comparing the tokens says so.)"""
    least = min(map(len, masks))
    at = docs.withColumn("pos", F.explode(F.when(F.size("h") >= least, F.sequence(F.lit(0), F.size("h") - least))))
    return at.withColumn("seed", F.explode(F.array(*map(seed, masks))) if len(masks) > 1 else seed(masks[0]))


def seed_hits(docs: DataFrame, seeds: DataFrame, masks: list[str], window: int, broadcast_seeds: int) -> DataFrame:
    """doc_key, at, h (the tokens near the place), pos (the place in them) and the columns of ``seeds``. While the
    test side is small enough to be broadcast, nothing of the training side is shuffled. Else only
    places and seeds are, and the tokens of documents with hits are joined to them."""
    rows = docs.select(F.col("doc_key"), tokens(F.col("text")).alias("h"))
    train = train_seeds(rows, masks)
    if seeds.count() <= broadcast_seeds:
        hits = train.join(F.broadcast(seeds), "seed")
    else:
        slim = train.select("doc_key", "pos", "seed").join(seeds, "seed")
        again = rows.select(F.col("doc_key").alias("own_key"), "h")
        hits = slim.join(again, F.col("doc_key").eqNullSafe(F.col("own_key")))
    near = F.greatest(F.lit(0), F.col("pos") + 1 - window)
    return hits.select("doc_key", F.col("pos").alias("at"), F.slice("h", near + 1, F.lit(2 * window)).alias("h"), (F.col("pos") - near).alias("pos"), *(c for c in seeds.columns if c != "seed"))


def overlaps(hits: DataFrame) -> DataFrame:
    """doc_key, item_id, diagonal, matched, compared, first: hits with enough equal tokens in a window that holds them."""
    low = F.greatest(F.lit(0), F.col("item_pos") + F.col("span") - F.col("size"))
    high = F.least(F.col("item_pos"), F.col("n_item") - F.col("size"))
    framed = hits.withColumns({"low": low, "high": high}).where("low <= high")

    def equal_at(k: Column) -> Column:
        """1 where token ``k`` of the item equals the one on the hit's diagonal."""
        return F.coalesce((F.get("item", k - F.col("base")) == F.get("h", k + F.col("pos") - F.col("item_pos"))).cast("int"), F.lit(0))

    same = framed.withColumn("same", F.transform(F.sequence(F.col("low"), F.col("high") + F.col("size") - 1), equal_at)).drop("h", "item")
    counts = F.transform(F.sequence(F.lit(1), F.col("high") - F.col("low") + 1), lambda s: F.aggregate(F.slice("same", s, F.col("size")), F.lit(0), lambda total, x: total + x))
    # The first window with enough equal tokens, and the first equal token in it.
    start = F.array_position(F.transform("counts", lambda n: n >= F.col("need")), F.lit(True)).cast("int")
    # A generator keeps the filter where it is: as a condition of the join it would take the join out of generated code,
    # and every place of a text, hit or not, would be a row that holds all of its tokens.
    judged = same.withColumn("counts", counts).withColumn("judged", F.explode_outer(F.array(F.struct(F.array_max("counts").alias("matched"), start.alias("start")))))
    good = judged.where("judged.matched >= need").withColumns({"matched": F.col("judged.matched"), "start": F.col("judged.start")})
    inside = F.array_position(F.slice("same", F.col("start"), F.col("size")), F.lit(1)).cast("int")
    diagonal = F.col("at") - F.col("item_pos")
    return good.select("doc_key", "item_id", diagonal.alias("diagonal"), "matched", F.col("size").alias("compared"), (diagonal + F.col("low") + F.col("start") - 1 + inside - 1).alias("first"))


def contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, min_share: float = MIN_SHARE, broadcast_seeds: int = BROADCAST_SEEDS) -> DataFrame:
    """key, item_id, n_places, first_word, matched, compared: a row per document and
    benchmark item that overlap; documents without overlap have none.

    ``compared`` is ``window`` tokens, or the whole item where it is shorter; ``matched`` of
    them are equal, at least ``min_share``. Every such overlap is found. ``n_places``: distinct
    diagonals. ``first_word``: place in the document of the first equal token of the first
    window that overlaps. Null or empty texts, and an empty benchmark, overlap with nothing; null keys and ids
    are values like others. Repeated rows of a document count once; those
    of an item are one item if the id is the same.
    """
    seeds = materialize(test_seeds(benchmark, item, item_text, window, min_share), "seeds")
    # A mask is hashed only where items of its size are there: at most a few masks a size come to the driver.
    used = sorted(r["mask"] for r in seeds.select("mask").distinct().collect()) or list(masks_for(window, min_share)[-1])
    slim = docs.select(F.col(key).alias("doc_key"), text_or_empty(text).alias("text"))
    found = overlaps(seed_hits(slim, seeds.drop("mask"), used, window, broadcast_seeds))
    by_diagonal = found.groupBy("doc_key", "item_id", "diagonal").agg(F.min("first").alias("first"), F.max("matched").alias("matched"), F.max("compared").alias("compared"))
    return by_diagonal.groupBy("doc_key", "item_id").agg(F.count(F.lit(1)).alias("n_places"), F.min("first").cast("long").alias("first_word"), F.max("matched").cast("long").alias("matched"), F.max("compared").cast("long").alias("compared")).withColumnRenamed("doc_key", key)


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents that overlap with no benchmark item, with all their columns. Without benchmark rows all stay."""
    dirty = materialize(contamination(docs, benchmark, key, text, **options).select(F.col(key).alias("__lithograin_dirty")).distinct(), "dirty")
    return docs.join(few(dirty), F.col(key).eqNullSafe(F.col("__lithograin_dirty")), "left_anti")

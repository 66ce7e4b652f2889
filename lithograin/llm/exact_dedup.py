"""Exact deduplication with a heavy-hitter split, with DataFrame functions only.

A Misra-Gries summary (Spark's frequent-items sketch, a merging variant of it) over
the digests names every digest that may hold more than a bounded share of the rows.
Exact counts verify these; the verified winners, at most ``tracked`` of them, are
broadcast and their rows never enter the shuffle by digest. All other digests are
too rare to skew it and are resolved by one ordinary shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ASCII_SPACE, materialize, text_or_empty

#: Digests the summary tracks. Its map has 8,192 places then, its error is at most 3.5 / 8,192 of the
#: rows, and it surely names a digest that has twice that share (0.085 %). One that it doesn't name
#: takes the shuffle like any other, so results don't depend on it.
TRACKED = 4096
#: A winner has at least this share of the rows.
HEAVY_SHARE = 0.001


def normalised(text: Column) -> Column:
    return F.translate(text, ASCII_SPACE, "")


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, code points of the original text, SHA-256 of the normalised text."""
    body = text_or_empty(text)
    return docs.select(F.col(key), F.char_length(body).cast("long").alias("n_points"), F.unhex(F.sha2(normalised(body), 256)).alias("digest"))


def heavy_digests(rows: DataFrame, least: int, tracked: int = TRACKED) -> DataFrame:
    """Candidate digests of the summary: at most ``tracked`` rows, each possibly frequent."""
    top = rows.agg(F.expr(f"approx_top_k(hex(digest), {tracked}, {tracked})").alias("top"))
    found = top.select(F.explode("top").alias("t")).select(F.unhex("t.item").alias("digest"), F.col("t.count").alias("about"))
    return found.where(F.col("about") >= least).select("digest")


def best_row(key: str) -> Column:
    """Most code points first, then the smallest key."""
    return F.min(F.struct((-F.col("n_points")).alias("neg"), F.col(key).alias("id")))


def exact_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", tracked: int = TRACKED, share: float = HEAVY_SHARE) -> DataFrame:
    """One row per input row: key, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical without ASCII white space; null counts as empty, and
    all empty texts form one group. Of equal texts the one with most code points stays,
    then the smallest key (a null key before all others). Rows that repeat a key and a text count in group_size
    and share ``kept``; of rows that repeat a key with texts of other lengths only those of the longest are kept. An empty table gives an empty result.
    """
    rows = materialize(digests(docs, key, text), "digests")
    least = max(2, int(rows.count() * share))
    candidates = heavy_digests(rows, least, tracked)
    stats = rows.join(F.broadcast(candidates), "digest", "left_semi").groupBy("digest").agg(best_row(key).alias("best"), F.count(F.lit(1)).alias("group_size"))
    winners = materialize(stats.where(F.col("group_size") >= least), "winners")  # at most `tracked` rows, whatever the input
    heavy = rows.join(F.broadcast(winners), "digest").select(key, "n_points", "best", "group_size", "digest")
    group = Window.partitionBy("digest")
    light = (
        rows.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
        .select(key, "n_points", best_row(key).over(group).alias("best"), F.count(F.lit(1)).over(group).alias("group_size"), "digest")
    )
    kept = F.col("best.id").eqNullSafe(F.col(key)) & (F.col("best.neg") == -F.col("n_points"))
    return heavy.unionByName(light).select(key, F.col("best.id").alias("keep_id"), F.col("group_size").cast("long"), kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))

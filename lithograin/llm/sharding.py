"""Sharding by weighted rendezvous hashing, with DataFrame functions only.

Every shard draws a number from (record key, shard) and the record goes to the
shard with the best draw. A draw depends on nothing else, so a shard that is added
only takes records into itself, and a weight changes only who gives or takes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, text_or_empty

#: Sub-buckets of a shard for the slot numbers; a bound, not a data size.
SLOT_BUCKETS = 512


def rendezvous(key: Column, weights: list[float]) -> Column:
    """The shard (0 .. len(weights)-1) with the smallest ``-ln(u) / weight``, where
    ``u`` in (0, 1) comes from ``xxhash64(key, shard)``. A shard of weight 0 gets
    nothing; ties go to the smaller shard. A null key is hashed like any value."""
    if not weights or min(weights) < 0 or max(weights) <= 0:
        raise ValueError("weights must be non-negative, one of them positive")

    def draw(shard: int, weight: float) -> Column:
        u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
        return F.struct((-F.log(u) / F.lit(float(weight))).alias("cost"), F.lit(shard).alias("shard"))

    draws = [draw(s, w) for s, w in enumerate(weights) if w > 0]
    return (F.least(*draws) if len(draws) > 1 else draws[0])["shard"]


def slots(df: DataFrame, shard: str, order: list[str], shards: int, buckets: int = SLOT_BUCKETS) -> DataFrame:
    """Adds ``slot``: gapless from 0 in each shard, in the order of a hash bucket of
    ``order`` and then ``order``. A shard is numbered in ``buckets`` pieces, each by
    its own task; the piece sizes (at most shards x buckets rows, broadcast if these are few) give the offsets.
    """
    part = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    sizes = part.groupBy(shard, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(shard).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(F.col(shard).alias("_shard"), F.col("_bucket").alias("_b"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy(shard, "_bucket").orderBy(*order))
    numbered = part.withColumn("_rn", within)
    joined = numbered.join(F.broadcast(offsets) if shards * buckets <= BROADCAST_IDS else offsets, (F.col(shard) == F.col("_shard")) & (F.col("_bucket") == F.col("_b")))
    return joined.withColumn("slot", (F.col("_before") + F.col("_rn") - 1).cast("long")).drop("_bucket", "_rn", "_shard", "_b", "_before")


def shard_documents(docs: DataFrame, weights: list[float], grown: list[float] | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: key, size, text_crc32, law, shard, slot, grown_shard.

    ``size`` is the UTF-8 length plus 8; a null or empty text counts 8. Repeated rows
    go to one shard with slots of their own. A null key is one key. An empty table
    gives an empty result. Other input columns are ignored.
    """
    body = text_or_empty(text)
    rows = docs.select(
        F.col(key),
        (F.octet_length(body) + 8).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        rendezvous(F.col(key), weights).cast("int").alias("shard"),
        (rendezvous(F.col(key), grown) if grown else F.lit(None)).cast("int").alias("grown_shard"),
    )
    return slots(rows, "shard", [key, "text_crc32", "size"], len(weights)).select(key, "size", "text_crc32", "law", "shard", "slot", "grown_shard")

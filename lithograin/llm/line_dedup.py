"""Line deduplication by the number of distinct sites a line stands on.

A HyperLogLog sketch per line hash is kept as rows (line, register, rank): a sketch
merges by an ordinary ``max`` aggregation, partly before the shuffle, and a line
that stands everywhere is spread over its registers. Lines whose estimate is near
the threshold get an exact distinct count; the others are settled by the sketch.

Long lines don't repeat by chance: they are boilerplate from two documents on, of
whatever site. For that, the smallest and the largest key of a line are enough.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ASCII_SPACE, bound_batches, kept_by_worker, materialize, release, text_or_empty

#: A line on this many sites is boilerplate.
MIN_SITES = 8
#: A line of more words than this is boilerplate in two documents.
LONG_WORDS = 50
#: Registers of a sketch are 2**PRECISION; the standard error is 1.04 / sqrt of that.
PRECISION = 8
#: A line on the threshold is lost by the sketch with this chance at most.
COLLIDE = 1e-12
#: Boilerplate lines that every task holds (16 bytes each); more are joined.
BROADCAST_LINES = 1 << 21
#: Names of columns that stand beside the caller's for a while.
ROW, OWNER, DROPPED, HASHES = "__lithograin_row", "__lithograin_owner", "__lithograin_dropped", "__lithograin_hashes"


def lines_of(text: Column) -> Column:
    return F.split(text, "\n")


def trimmed(line: Column) -> Column:
    """Without ASCII white space at its ends, so that line breaks of two characters make no difference."""
    return F.btrim(line, F.lit(ASCII_SPACE))


def line_hash(line: Column) -> Column:
    """Null for a blank line."""
    return F.when(trimmed(line) != "", F.xxhash64(trimmed(line)))


def line_hashes(text: Column) -> Column:
    return F.transform(lines_of(text), line_hash)


def site_spread(occurrences: DataFrame, min_sites: int, precision: int = PRECISION) -> DataFrame:
    """line, estimate, keeper of every line whose estimate isn't clearly below ``min_sites``.

    ``occurrences``: line (hash), site, key. ``keeper`` is the smallest key that has the line.
    """
    m = 1 << precision
    drawn = F.xxhash64(F.lit("site"), F.col("site"))
    sketch = (
        occurrences.select("line", "key", F.pmod(drawn, F.lit(m)).alias("register"), F.shiftrightunsigned(drawn, precision).alias("rest"))
        .withColumn("rank", (F.lit(64 - precision + 1) - F.length(F.bin("rest"))).cast("int"))
        .groupBy("line", "register")
        .agg(F.max("rank").alias("rank"), F.min("key").alias("keeper"))
    )
    merged = sketch.groupBy("line").agg(F.sum(F.pow(F.lit(2.0), -F.col("rank"))).alias("inverse"), F.count(F.lit(1)).alias("used"), F.min("keeper").alias("keeper"))
    alpha = 0.7213 / (1 + 1.079 / m)
    raw = F.lit(alpha * m * m) / (F.col("inverse") + (F.lit(m) - F.col("used")))
    few = F.lit(float(m)) * F.log(F.lit(float(m)) / (F.lit(m) - F.col("used")))
    estimate = F.when((raw <= 2.5 * m) & (F.col("used") < m), few).otherwise(raw)
    low, _ = near_band(min_sites, precision)
    return merged.select("line", estimate.alias("estimate"), "keeper").where(F.col("estimate") >= low)


def near_band(min_sites: int, precision: int = PRECISION) -> tuple[float, float]:
    """Estimates in this band leave open on which side of the threshold a line is. Below it is
    what ``min_sites`` sites give only if they collide in their registers with a chance under ``COLLIDE``."""
    off = 5 * max(1.04 / math.sqrt(1 << precision), 1 / min_sites**0.5 / 8)
    low, high = min_sites * (1 - min(off, 0.75)), min_sites * (1 + off)
    m = 1 << precision
    if min_sites <= m:  # sites that fill at most half of the registers or so: the estimate follows their number
        filled = max(1, least_filled(min_sites, m))
        low = min(low, m * math.log(m / (m - filled)) - 0.5) if filled < m else low
    return low, high


def least_filled(sites: int, m: int) -> int:
    """The least number of ``m`` registers that ``sites`` sites fill with a chance over ``COLLIDE``, counting all below."""
    chance = [1.0]
    for _ in range(sites):
        stay = [c * k / m for k, c in enumerate(chance)] + [0.0]
        for k, c in enumerate(chance):
            stay[k + 1] += c * (m - k) / m
        chance = stay
    below = 0.0
    for k, c in enumerate(chance):
        below += c
        if below > COLLIDE:
            return k
    return sites


def boilerplate_lines(docs: DataFrame, key: str, text: str, site: str, min_sites: int, precision: int = PRECISION) -> DataFrame:
    """line, keeper: the hash of every line on ``min_sites`` sites or more. Empty lines never count."""
    lines = F.explode(F.array_distinct(line_hashes(text_or_empty(text)))).alias("line")
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(site).cast("string"), F.lit("")).alias("site"), lines).where(F.col("line").isNotNull())
    spread = materialize(site_spread(rows, min_sites, precision), "spread")
    _, high = near_band(min_sites, precision)
    near = spread.where(F.col("estimate") <= high).select("line")
    exact = rows.join(near, "line", "left_semi").groupBy("line", "site").agg(F.lit(1).alias("one")).groupBy("line").agg(F.count(F.lit(1)).alias("sites")).where(F.col("sites") >= min_sites).select("line")
    settled = spread.where(F.col("estimate") > high).select("line", "keeper")
    found = materialize(settled.unionByName(spread.join(exact, "line", "left_semi").select("line", "keeper")), "lines")
    release(spread)
    return found


def repeated_long_lines(docs: DataFrame, key: str, text: str, long_words: int) -> DataFrame:
    """line, keeper: the hash of every line of more than ``long_words`` words in two documents or more."""

    def is_long(line: Column) -> Column:
        return (F.length(line) > 2 * long_words) & (F.size(F.array_remove(F.split(line, r"[\x20\x09-\x0D]+"), "")) > long_words)

    hashes = F.array_distinct(F.transform(F.filter(lines_of(text_or_empty(text)), is_long), line_hash))
    rows = docs.select(F.col(key).alias("key"), F.explode(hashes).alias("line"))
    spread = rows.groupBy("line").agg(F.min("key").alias("keeper"), F.max("key").alias("last"), F.max(F.col("key").isNull()).alias("keyless"))
    return spread.where((F.col("keeper") != F.col("last")) | (F.col("keyless") & F.col("keeper").isNotNull())).select("line", "keeper")


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", site: str = "source", min_sites: int = MIN_SITES, precision: int = PRECISION, long_words: int | None = LONG_WORDS, broadcast_lines: int = BROADCAST_LINES) -> DataFrame:
    """All input columns with ``text`` cleaned, plus n_lines and n_removed, a row per input row.

    A line (without white space at its ends) on ``min_sites`` sites or more, or one of more than
    ``long_words`` words (None: no such rule) in two documents or more, is removed
    from every document but the one with the smallest key that has it. A null site is a
    site of its own; a null text becomes empty; blank lines stay. Rows that repeat a key are one document
    to the rules and are cleaned each for itself; a null key is the one that keeps a line only where no row with a key has it. An empty table gives an empty result.
    Columns named n_lines or n_removed are replaced.
    """
    bad = wide = boilerplate_lines(docs, key, text, site, min_sites, precision)
    if long_words is not None:
        bad = bad.unionByName(repeated_long_lines(docs, key, text, long_words)).dropDuplicates(["line"])
    found = materialize(bad, "boilerplate")
    release(wide)
    rows = docs.drop("n_lines", "n_removed").withColumn(text, text_or_empty(text))
    if found.count() <= broadcast_lines:
        cleaned = _clean_in_place(rows, found, key, text)
        release(found)
        return cleaned
    return _clean_by_join(rows, found, key, text)


def _clean_in_place(rows: DataFrame, found: DataFrame, key: str, text: str) -> DataFrame:
    """One pass without a shuffle: every task holds the boilerplate lines, which have been counted."""
    bound_batches(rows)
    table = found.orderBy("line").toArrow()
    shared = rows.sparkSession.sparkContext.broadcast((table.column("line").to_numpy(), table.column("keeper").combine_chunks()))
    names = rows.columns
    at, own = names.index(text), names.index(key)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_by_worker("line dedup")
        bad, keepers = shared.value
        for batch in batches:
            hashes = batch.column(len(names))
            flat = hashes.flatten()
            n_lines = np.diff(hashes.offsets.to_numpy())
            doc = np.repeat(np.arange(batch.num_rows), n_lines)
            values = pc.fill_null(flat, 0).to_numpy()
            place = np.minimum(np.searchsorted(bad, values), max(len(bad) - 1, 0))
            hit = np.flatnonzero((bad[place] == values) & pc.is_valid(flat).to_numpy(zero_copy_only=False)) if len(bad) else np.zeros(0, np.int64)
            keys = batch.column(own).take(pa.array(doc[hit]))
            keeper = keepers.take(pa.array(place[hit])).cast(keys.type)
            other = pc.and_not(pc.fill_null(pc.not_equal(keeper, keys), True), pc.and_(pc.is_null(keeper), pc.is_null(keys)))
            gone = hit[other.to_numpy(zero_copy_only=False)]
            n_removed = np.bincount(doc[gone], minlength=batch.num_rows)
            texts = batch.column(at)
            changed = n_removed > 0
            if changed.any():
                stays = np.ones(len(doc), dtype=bool)
                stays[gone] = False
                first = np.concatenate([[0], np.cumsum(n_lines)])
                new = []
                for d in np.flatnonzero(changed):
                    lines = texts[int(d)].as_py().split("\n")
                    new.append("\n".join(x for x, stay in zip(lines, stays[first[d] : first[d + 1]], strict=True) if stay))
                texts = pc.replace_with_mask(texts, pa.array(changed), pa.array(new, texts.type))
            columns = [texts if i == at else batch.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n_lines.astype(np.int64)), pa.array(n_removed.astype(np.int64))], names=[*names, "n_lines", "n_removed"])

    schema = T.StructType([*rows.schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_removed", T.LongType())])
    return rows.withColumn(HASHES, line_hashes(F.col(text))).mapInArrow(clean, schema)


def _clean_by_join(rows: DataFrame, found: DataFrame, key: str, text: str) -> DataFrame:
    """For more lines than a task should hold: rows get numbers that last, and a row's lines meet the
    boilerplate lines by a join."""
    numbered = materialize(rows.withColumn(ROW, F.monotonically_increasing_id()), "numbered")
    pairs = numbered.select(F.col(ROW).alias(OWNER), F.col(key).alias("key"), F.explode(F.array_distinct(line_hashes(F.col(text)))).alias("line"))
    drops = pairs.join(found, "line").where(~F.col("keeper").eqNullSafe(F.col("key"))).groupBy(OWNER).agg(F.collect_set("line").alias(DROPPED))
    joined = numbered.join(drops, F.col(ROW) == F.col(OWNER), "left")
    lines = lines_of(F.col(text))
    left = F.when(F.col(DROPPED).isNull(), lines).otherwise(F.filter(lines, lambda x: ~F.coalesce(F.array_contains(DROPPED, line_hash(x)), F.lit(False))))
    out = joined.withColumn(HASHES, left)
    cleaned = F.when(F.col(DROPPED).isNull(), F.col(text)).otherwise(F.array_join(HASHES, "\n"))
    return out.withColumns({"n_lines": F.size(lines).cast("long"), "n_removed": (F.size(lines) - F.size(HASHES)).cast("long")}).withColumn(text, cleaned).drop(HASHES, DROPPED, OWNER, ROW)

"""A corpus pipeline of five stages over ``documents``.

Every stage takes what its predecessor kept. Between stages the rows are written as
Parquet in the shared folder and read again. All stages but the last return the
columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lithograin.llm import decontam, line_dedup, minhash, packing, quality
from lithograin.llm.common import materialize, table
from lithograin.llm.queries import TOKENIZER

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject. It learns from labels as op1 does.

    A null text is scored as an empty one; repeated rows are judged alike, each for itself; other nulls don't matter. Without
    labels of both classes every document gets one score, 0.5 for none at all, and stays. An empty table stays empty.
    """
    labels = table(spark, sf_dir, "labels").where(~quality.in_fold("doc_id", 5, 0))
    return quality.keep_quality(docs, quality.fit_quality(docs, labels))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without cross-site boilerplate lines and repeated long lines. A document of which nothing is left goes;
    one that was empty before stays.

    A null text becomes an empty one, a null source is a site of its own, n_chars is counted anew. Repeated rows are one
    document to the rules, and each is cleaned. An empty table stays empty.
    """
    cleaned = line_dedup.dedup_lines(docs)
    emptied = (F.col("n_removed") > 0) & (line_dedup.trimmed(F.col("text")) == "")
    return cleaned.where(~emptied).withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id.

    Texts without words stay, also null ones, and so do rows with a null id. Repeated rows stay or go together.
    An empty table stays empty.
    """
    return minhash.drop_near_duplicates(docs).select(*COLUMNS)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap with no benchmark item.

    Null and empty texts overlap with nothing; with an empty benchmark all documents stay. Rows of one id, also of the null
    one, go together. An empty table stays empty.
    """
    return decontam.remove_contaminated(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences.

    A null or empty text is its end token alone; repeated rows are packed as often as they occur. An empty table has no pieces.
    """
    return packing.pack_documents(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: SQL can't express a trained field, signatures or a tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

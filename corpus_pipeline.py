"""The training-data pipeline: documents that are toxic, boilerplate lines, near copies and benchmark
passages go; what is left is packed into sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from schemaloom.llm import decontamination, line_dedup, packing, simhash, toxicity
from schemaloom.llm.common import free_name, table
from schemaloom.llm.queries import BYTE_BPE
from schemaloom.runtime import materialise


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; null and empty texts are scored like any other, repeated rows alike."""
    column = free_name(docs, "score")
    scored = toxicity.with_scores(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")), column)
    return scored.where(F.col(column) < toxicity.THRESHOLD).drop(column)


def drop_boilerplate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many of a site's pages share go; n_chars, if there, is that of the new text."""
    cut = line_dedup.drop_boilerplate(docs, line_dedup.MAX_RATIO, line_dedup.MIN_PAGES).select(*docs.columns)
    return cut.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else cut


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that SimHash links (three-word shingles, 3 bits) the document with the smallest doc_id stays.

    Null and empty texts are one group; of repeated rows, and of a group without any doc_id, one row stays.
    """
    return simhash.drop_near_copies(docs, simhash.SHINGLE, simhash.RADIUS)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go; null and empty texts contain none and stay."""
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in sequences, one row per piece of a document; a null or empty text is its end token alone."""
    return packing.pack(docs, BYTE_BPE)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_boilerplate_lines),
    ("simhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_benchmark_passages),
    ("packing", pack_sequences),
]

#: Tokenizers, a fitted classifier and fingerprints cannot be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the whole documents table, each written and read again by the next; no documents give no rows."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir))
    return docs

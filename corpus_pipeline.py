"""The corpus pipeline: each stage calls one training-data operator on what its predecessor kept.

quality (6) drops documents that the classifier rejects; near_duplicates (5) keeps the smallest id of each group linked at
five-word Jaccard 0.8; pii (3) redacts personal data in the texts; mixing (8) takes each source's share; packing (1) packs
what is left into sequences.  Between stages the documents are written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caselode.llm import mixing, ngram_join, packing, pii, quality
from caselode.llm.common import ship, table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Cluster SQL cannot express the kernels, trees and seeded orders of these stages; the tests check them by brute force.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    ship(spark)
    return quality.quality_scores(docs, table(spark, sf_dir, "labels")).filter("keep").select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the one of the smallest id, once; ids may be null or shared."""
    return ngram_join.survivors(docs.select(*COLUMNS), n=5, num=4, den=5)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; ``n_chars`` follows the new text."""
    return pii.redact(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture's documents; a document that two epochs take appears twice."""
    return mixing.mix(docs.select(*COLUMNS), mixing.tree(docs), 0.8, mixing.WEIGHTS).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the mixture's documents and where they lie in 4096-token sequences."""
    import public_tokenizers

    return packing.pack_documents(docs.select(*COLUMNS), public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", quality_stage), ("near_duplicates", near_duplicate_stage), ("pii", pii_stage), ("mixing", mixing_stage), ("packing", packing_stage)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

"""A training corpus from the documents table: quality, toxicity, near-duplicates, mix, pieces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tideboard.llm import copies, fm, kneser, pieces, raking, simhash
from tideboard.llm.common import table
from tideboard.session import cut_lineage


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the factorisation machine scores under one half."""
    return fm.keep_good(docs, fm.train(docs, table(spark, sf_dir, "labels")))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the Kneser-Ney models score at one half or more."""
    return kneser.keep_ordinary(docs, kneser.train(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8 or more) the document with the least doc_id
    stays. SimHash fingerprints find the first of them; as two bits miss many edited copies, the sets that share a rare
    shingle are compared too, where fingerprints haven't linked them already."""
    return simhash.keep_one(docs, copies.near_copies)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample in the target ratios of sources, languages and topics."""
    return raking.sample_documents(docs)


def segmentations(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled segmentations of every document that is left, as ids."""
    return pieces.sample_pieces(docs)


STAGES = [
    ("quality classifier", quality),
    ("toxicity", toxicity),
    ("SimHash near-dedup", near_duplicates),
    ("mixing sources to target weights", mixture),
    ("SentencePiece encoding and decoding", segmentations),
]

#: Models and sampled paths can't be said in SQL; tests/llm compares the stages with plain versions of them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs

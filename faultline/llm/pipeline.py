"""A corpus pipeline: each stage works on all that the one before it kept.

toxicity drops the documents that score at least 0.7; dedup keeps one document of each near-duplicate group (five-word
shingles, similarity 0.8); decontaminate drops documents with a benchmark passage (similarity 0.8); pii masks personal data;
encode returns token ids.

In every stage: null and empty texts pass as they are (encode gives them no ids); a null doc_id is a document; of rows alike in
doc_id and text dedup keeps one, of a group the one with the smallest doc_id; texts of any length are read whole; columns beside
doc_id and text are carried through whatever their names (n_chars follows the masked text); an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import hyperminhash, pair_index_bpe, simhash_decontam, toxicity_gru, weak_pii
from .common import table, written


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that a model of the table of labels scores below 0.7. Without labels of both classes all stay."""
    return toxicity_gru.without_toxic(docs, toxicity_gru.trained(docs, table(spark, sf_dir, "labels")))


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group; documents without an id or without words all stay."""
    return hyperminhash.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no passage of the benchmark table. Items without words match nothing."""
    return simhash_decontam.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, spans of personal data in their texts replaced by their kind."""
    return weak_pii.masked(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit) and the digests of ids and decoded text."""
    return pair_index_bpe.encoded_with_digests(docs, pair_index_bpe.default_path())


STAGES = [("toxicity", toxicity), ("dedup", dedup), ("decontaminate", decontaminate), ("pii", pii), ("encode", encode)]

#: Trained models, sketches and tokenizers are beyond SQL; tests/llm/test_pipeline.py holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

"""A corpus made ready for training: good documents, one of each group of near duplicates and of reworded copies,
without secrets, mixed by source, as tokens.

Every stage judges its own input: all rows that the stage before it kept, read again from Parquet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mlwatch.llm import bpe, mixing, quality, reworded, secret_scan, simhash
from mlwatch.llm.rows import table
from mlwatch.sources.shared import discard, written


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality.good_documents(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: fingerprints within four bits; of what is left, one of each
    group whose five-word shingles have a similarity of 0.8 or more, which fingerprints alone don't find."""
    return reworded.without_copies(written(simhash.one_of_each_group(docs), "fingerprints-apart"))


def no_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets give way to marks; every document stays."""
    return secret_scan.without_secrets(docs, words=secret_scan.corpus_words(docs))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the order of a mixture by target weights: files are ranges of it; every document stays."""
    return mixing.in_mixed_order(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document (little-endian unsigned 32-bit integers), its place in the mixture, and whether the
    ids decode to the bytes of its text (``whole``).

    The order by ``place`` is the mixture's; places are unique and have gaps.
    """
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    key = F.struct("doc_id", mixing.written_place().alias("place"), digest.alias("digest"))
    found = bpe.encode(docs.select(key.alias("id"), "text"), id_col="id", decoded=True)
    whole = F.sha2("decoded", 256) == F.col("id.digest")
    return found.select("id.doc_id", "id.place", "n_tokens", "ids", whole.alias("whole"))


STAGES = [
    ("quality", good_quality),
    ("near_duplicates", near_duplicates),
    ("secrets", no_secrets),
    ("mixing", mixed_sources),
    ("tokens", tokens),
]

# No stage can be stated in SQL: tests/llm compare each with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each on the written result of the one before."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, sf_dir), name)
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)

"""A corpus pipeline of training-data operators: language ID, near-dedup, decontamination, secrets, packing.

Each stage takes (spark, docs, sf_dir), works on all its predecessor kept, and returns the columns of documents;
the last returns packed pieces. run() writes each stage's rows to the shared folder and reads them again.

Defined cases, in every stage: an empty table gives an empty one; columns beyond doc_id, text and lang (learned from) are
carried along, whatever their names, and may be null. What a stage does with null and empty texts, null ids and repeated
rows is said in its docstring.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausemill.llm import decontaminate, langid, packing, secrets, simhash
from clausemill.session import discard, shared_folder


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages that the labelled documents have; others go.

    Rejected are texts without a letter, null ones among them, and texts of some length that need far more phrases per
    character than the language does that needs fewest: gibberish, or a language that no label names. Without any label
    nothing is learned, and all go. Repeated rows and rows with a null id are each judged by their text.
    """
    samples = langid.learn(docs)
    return langid.accept(docs, samples, langid.limits(samples))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of copies.

    Copies are linked by fingerprints of three-word shingles at 2 or fewer differing bits, as in op2_, and beyond that by
    similarity 0.8 of their five-word shingles. Rows with the same id and text stay once. Texts without words, null ones
    among them, and rows with a null id all stay.
    """
    groups = simhash.copy_groups(docs, radius=2, near_words=3, similarity=0.8, similar_words=5)
    return simhash.keep_first(simhash.once(docs), groups)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark window of 10 words. Null and empty texts stay; repeated rows stay or go together."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.remove_documents(docs, benchmark, window=10)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts masked; n_chars, if there is such a column and it isn't null, follows the text.

    Null texts stay null; repeated rows are each masked.
    """
    masked = secrets.redact(docs)
    if "n_chars" not in docs.columns:
        return masked
    kind = docs.schema["n_chars"].dataType
    return masked.withColumn("n_chars", F.when(F.col("n_chars").isNotNull() & F.col("text").isNotNull(), F.length("text").cast(kind)).otherwise(F.col("n_chars")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces in sequences of at most 1024 tokens. A null text is an empty one, which is the end id alone."""
    pieces = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), length=1024, end_id=0)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "placement")


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("packing", pack),
]

#: A suffix-automaton vote, near-duplicate groups and a tokenizer can't be put in SQL; tests/llm compares by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. A stage's folder is deleted once its successor's is written."""
    at, before = shared_folder(spark), None
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (name, stage) in enumerate(STAGES):
        here = f"{at}/{n}_{name}"
        stage(spark, docs, sf_dir).write.parquet(here)
        docs = spark.read.parquet(here)
        if before:
            discard(spark, before)
        before = here
    return docs

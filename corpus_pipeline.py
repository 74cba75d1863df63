"""A corpus from raw documents to packed sequences: each stage works on all that the one before kept.

Stages take any documents table with doc_id and text (the first also lang); further columns, whatever
their names, are handed on by all but the last. Rows are told apart by doc_id and text, so rows that
share a doc_id are judged each, and of rows that repeat both one stays from the second stage on. A null text counts as empty; a
null doc_id stays null and comes after all ids where one of several rows stays. An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.llm.common import scratch_path
from rowloom.llm.exact_dedup import drop_copies
from rowloom.llm.langid import keep_identified, train
from rowloom.llm.packing import pack
from rowloom.llm.pii import redact
from rowloom.llm.queries import tokenizer
from rowloom.llm.simhash import drop_near_copies

#: A document stays when its language scores this at least.
LEAST_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; those without a letter (null and empty texts too), or whose best language is doubtful, go.

    Repeated rows are judged alike. Labels are learned from the table itself; without any, every document goes.
    """
    return keep_identified(docs, train(docs, tokenizer("piece_bpe_32k.model")), LEAST_SCORE)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal normalised texts: the longest original, then the smallest doc_id, then by text hash."""
    return drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group that SimHash links: the smallest doc_id, then by text hash; a null doc_id only where no other is."""
    return drop_near_copies(docs)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind; n_chars follows where it is there. Every row stays, null texts stay null."""
    masked = docs.withColumn("text", redact(F.col("text")))
    return masked.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else masked


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces and their places in sequences of 4096 tokens. A null or empty text is its end token alone."""
    return pack(docs, tokenizer("word_bpe_49k.json"))


STAGES = [("language ID", language), ("exact dedup", exact), ("SimHash near-dedup", near), ("PII", private), ("best-fit packing", packed)]

#: Language ID and the tokenizer can't be written in SQL; the tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet in the shared folder and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, "stage-" + name.split()[0].lower())
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)

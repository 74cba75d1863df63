"""The registered queries over the tables of a folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .oracles import ORACLES

__all__ = ["ORACLES", "QUERIES"]

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import simhash_groups

    return simhash_groups(_documents(spark, sf_dir))


def op2_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The queries are the whole texts of every document whose id is divisible by 100."""
    from pyspark.sql import functions as F

    from .bm25 import top_k

    docs = _documents(spark, sf_dir)
    return top_k(docs, docs.where(F.col("doc_id") % 100 == 0).select(F.col("doc_id").alias("query_id"), "text"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tokens import token_counts

    return token_counts(_documents(spark, sf_dir), tokenizer("word_bpe_49k.json"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pieces import encoding_report

    return encoding_report(_documents(spark, sf_dir), tokenizer("piece_bpe_32k.model"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import identify, train

    docs = _documents(spark, sf_dir)
    return identify(docs, train(docs, tokenizer("piece_bpe_32k.model")))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import pii_report

    return pii_report(_documents(spark, sf_dir))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substrings import drop_repeated_words

    return drop_repeated_words(_documents(spark, sf_dir), digest=True)


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substrings import drop_repeated_bytes

    return drop_repeated_bytes(_documents(spark, sf_dir), digest=True)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(_documents(spark, sf_dir), tokenizer("word_bpe_49k.json"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_groups

    return exact_groups(_documents(spark, sf_dir))


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_simhash, op2_bm25, op3_token_counts, op4_sentencepiece, op5_language_id, op6_pii, op7_substring_dedup, op8_suffix_dedup, op9_packing, op10_exact_dedup)}

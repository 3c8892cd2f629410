"""The queries of this subpackage: one for each operator, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as c


def tokenizer_file(name: str) -> str:
    """Place of a public tokenizer's file on the driver; it is broadcast from there."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_lm import score

    return score(c.table(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string")) % 10 != 0)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import document_paths, scan_licenses

    return scan_licenses(document_paths(c.table(spark, sf_dir, "documents")))


def op3_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import encode_decode

    found = encode_decode(c.table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))
    return found.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import identify, train

    docs = c.table(spark, sf_dir, "documents")
    remainder = lambda: F.crc32(F.col("doc_id").cast("string")) % 5
    found = identify(docs, train(docs, remainder() != 0))
    return found.select("doc_id", (remainder() == 0).alias("held_out"), "lang_pred", "score")


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contamination

    return contamination(c.table(spark, sf_dir, "documents"), c.table(spark, sf_dir, "benchmark"))


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .media import digests, media_columns

    return digests(media_columns(c.table(spark, sf_dir, "documents")))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import LIMIT, count_tokens

    return count_tokens(c.table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json")).withColumn("over_limit", F.col("n_tokens") > LIMIT)


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import similarity_join

    return similarity_join(c.table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import THRESHOLD, toxicity, train

    docs, labels = c.table(spark, sf_dir, "documents"), c.table(spark, sf_dir, "labels")
    remainder = lambda: F.crc32(F.col("doc_id").cast("string")) % 3
    found = toxicity(docs, train(docs, labels, remainder() != 1))
    return found.select("doc_id", (remainder() == 1).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).cast("int").alias("predicted"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import digests, find_pii

    return digests(find_pii(c.table(spark, sf_dir, "documents").select("doc_id", "text")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_lm_scoring": op1_lm_scoring,
        "op2_license_scan": op2_license_scan,
        "op3_bpe_encode_decode": op3_bpe_encode_decode,
        "op4_language_id": op4_language_id,
        "op5_benchmark_decontamination": op5_benchmark_decontamination,
        "op6_media_columns": op6_media_columns,
        "op7_token_counts": op7_token_counts,
        "op8_ngram_jaccard_join": op8_ngram_jaccard_join,
        "op9_toxicity": op9_toxicity,
        "op10_pii": op10_pii,
    }


def oracle_sql() -> dict[str, str]:
    from . import oracles

    return oracles.oracle_sql()

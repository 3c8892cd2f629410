"""Corpus pipeline: five stages over documents, each written as Parquet and read again as the next one's input.

toxicity         rows that the toxicity operator rejects (score of THRESHOLD or more) go
near_duplicates  of each group of linked documents one row stays: that of the smallest doc_id (then of the first text); rows without words stay
benchmark        rows with words inside an occurring benchmark window go
personal_data    spans of personal data are replaced by their kind, n_chars follows the new text
tokens           token ids (packed) of what is left, and the text they decode to

Rows are judged one by one, by their text: a null or recurring doc_id plays no part but in the choice of the row that stays of a group
(a null id counts as the largest).  Null and empty texts pass all stages and have no tokens.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.llm import bpe, common, decontaminate, jaccard, pii, toxicity
from wardline.llm.queries import tokenizer_file

#: No stage but the personal-data one can be said in SQL; tests/llm holds run() against a plain version.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = common.table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels, F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
    return toxicity.without_toxic(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.without_copies(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.without_contaminated(docs, common.table(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = pii.redact(pii.find_pii(docs))
    return clean.withColumn("n_chars", F.when(F.size("pii") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(docs, tokenizer_file("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("benchmark", drop_contaminated),
    ("personal_data", redact_personal_data),
    ("tokens", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows doc_id, n_tokens, ids, decoded of the documents that stay; each stage's own tables go once its output is written."""
    docs, previous = common.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        since = common.mark()
        docs = common.settle(stage(spark, docs, sf_dir), name, since)
        if previous is not None:
            common.discard(spark, previous, previous + 1)
        previous = common.mark() - 1
    return docs

"""Sinks: logs, stage outputs, manifests, caches, and the layout of their paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import known_source
from ..operators.canonical import quarantine

# Kinds of folders of one source, and of folders that all sources share.
SOURCE_KINDS = ["raw", "samples", "inspection", "converted", "rendered", "ocr", "redacted", "augmented", "weak", "verified"]
SHARED_KINDS = ["review/queue", "review/human_overrides", "review/api_labels", "final", "manifests", "eval"]
#: Names of the files of stages within a source's folder.
STAGE_FILES = {"converted": "source_canonical.jsonl", "ocr": "ocr.jsonl", "redacted": "redacted.jsonl", "augmented": "augmented.jsonl", "weak": "weak_labeled.jsonl"}


def source_dir(root: str, kind: str, slug: str) -> str:
    if kind not in SOURCE_KINDS:
        raise ValueError(f"unknown kind {kind!r}; there are {', '.join(SOURCE_KINDS)}")
    return f"{root}/{kind}/{known_source(slug)}"


def shared_dir(root: str, kind: str, name: str = "") -> str:
    if kind not in SHARED_KINDS:
        raise ValueError(f"unknown kind {kind!r}; there are {', '.join(SHARED_KINDS)}")
    return f"{root}/{kind}" + (f"/{name}" if name else "")


def stage_file(root: str, stage: str, slug: str) -> str:
    """A stage's rows of a source."""
    return f"{source_dir(root, stage, slug)}/{STAGE_FILES[stage]}"


def review_file(root: str, kind: str, slug: str) -> str:
    """Queue or overrides of a source."""
    return f"{shared_dir(root, f'review/{kind}')}/{known_source(slug)}.jsonl"


def stage_path(root: str, stage: str, slug: str) -> str:
    """Where a stage's rows of a source lie in a partitioned table; stage and slug are partition values, so that readers prune by them."""
    if stage not in (*SOURCE_KINDS, *SHARED_KINDS):
        raise ValueError(f"unknown stage {stage!r}; there are {', '.join((*SOURCE_KINDS, *SHARED_KINDS))}")
    return f"{root}/stage={stage.replace('/', '_')}/slug={known_source(slug)}"


def run_id(at: Column | None = None) -> Column:
    """Id of a run by its time in UTC: 20240131T235959Z."""
    return F.date_format(F.to_utc_timestamp(F.current_timestamp() if at is None else at, F.current_timezone()), "yyyyMMdd'T'HHmmss'Z'")


def write_metrics(document: DataFrame, root: str, pipeline: str, run: str) -> str:
    """metrics.json of a run (one row) under root/pipeline/run; an earlier one is replaced."""
    path = f"{root}/{pipeline}/{run}/metrics.json"
    document.coalesce(1).write.mode("overwrite").json(path)
    return path


def request_record(rows: DataFrame, kind: str, with_text: bool = False) -> DataFrame:
    """Records of served requests (id, at, user_id, text, action): the text only if asked for, its length always."""
    text = F.col("text") if with_text else F.lit(None).cast("string")
    return rows.select("id", F.lit(kind).alias("kind"), F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("at"), "user_id", F.length("text").alias("text_length"), text.alias("text"), "action")


def clear_log(spark: SparkSession, path: str, schema: str) -> None:
    """Leaves an empty log."""
    spark.createDataFrame([], schema).write.mode("overwrite").json(path)


def prediction_log(rows: DataFrame, run_id: str, pipeline: str, language: str = "vi", threshold: float = 0.0, with_text: bool = False, with_values: bool = True) -> DataFrame:
    """Prediction records, version 2: source text only if asked for, detected text unless refused."""
    text = F.col("text") if with_text else F.lit(None).cast("string")
    spans = F.transform("spans", lambda s: F.struct(s["entity_type"].alias("entity_type"), s["start"].alias("start"), s["end"].alias("end"), (s["text"] if with_values else F.lit(None).cast("string")).alias("text"), s["score"].alias("score"), s["pattern"].alias("pattern")))
    return rows.select(F.lit(2).alias("record_version"), F.lit(run_id).alias("run_id"), F.lit(pipeline).alias("pipeline_name"), F.col("input_id").cast("string").alias("input_id"), F.lit(language).alias("language"), F.lit(threshold).alias("score_threshold"), text.alias("source_text"), spans.alias("results"), "anonymized_text")


def audit_markdown(log: DataFrame) -> DataFrame:
    """One readable block of text for each prediction record."""
    lines = F.transform("results", lambda s: F.concat(F.lit("- "), s["entity_type"], F.lit(" ["), s["start"].cast("string"), F.lit(", "), s["end"].cast("string"), F.lit(") "), F.coalesce(s["text"], F.lit("")), F.lit(" "), s["score"].cast("string")))
    return log.select(F.concat_ws("\n", F.concat(F.lit("## "), F.col("input_id")), F.array_join(lines, "\n"), F.coalesce("anonymized_text", F.lit(""))).alias("value"))


def decision_log(rows: DataFrame, run_id: str, detector: str) -> DataFrame:
    """Decision records, version 1."""
    truth = F.struct(F.col("label").cast("int").alias("label"), (F.col("label") == 1).alias("is_injection"), F.col("expected_action").alias("expected_action"))
    said = F.struct("is_injection", "score", "action", "matched_rules", "categories", "evidence")
    return rows.select(F.lit(1).alias("record_version"), F.lit(run_id).alias("run_id"), F.lit(detector).alias("detector_name"), "input_id", "source", "language", "category", F.col("text").alias("source_text"), truth.alias("ground_truth"), said.alias("prediction"))


def append_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def replace_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def write_stage(rows: DataFrame, path: str, rejected_path: str) -> int:
    """Writes valid canonical rows, and invalid ones with their errors elsewhere; returns the number of the latter."""
    valid, invalid = quarantine(rows)
    valid.write.mode("overwrite").json(path)
    invalid.write.mode("overwrite").json(rejected_path)
    return rows.sparkSession.read.json(rejected_path).count() if invalid.take(1) else 0


def write_manifest(ids: DataFrame, path: str, dataset: str, split: str, size: int, seed: int, created_at: str) -> None:
    """One manifest document; refuses to overwrite.  The ids of a manifest are few by its own size."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("place", "input_id"))), lambda x: x["input_id"])
    doc = ids.agg(listed.alias("input_ids")).select(F.lit(dataset).alias("dataset"), F.lit(split).alias("split"), F.lit(size).alias("sample_size"), F.size("input_ids").alias("actual_size"), F.lit(seed).alias("random_state"), F.lit(created_at).alias("created_at"), "input_ids")
    doc.coalesce(1).write.mode("errorifexists").json(path)


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A log's records; malformed lines are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def upsert_cache(old: DataFrame, new: DataFrame) -> DataFrame:
    """A key-value cache with new entries over old ones."""
    return old.join(new.select("key"), "key", "left_anti").unionByName(new)

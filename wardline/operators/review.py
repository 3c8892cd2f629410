"""Review queue, label layers and overrides, router input and output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .canonical import ACTIONS, LABELS, RISKS
from .spans import anonymize_right

VISUAL = ["sexual", "violence", "blood_gore"]


def selection_reasons(has_images: bool | Column = False) -> Column:
    """array<struct<rank, reason>> of a canonical row, rank 1 the most urgent; empty: not queued."""
    images = F.lit(has_images) if isinstance(has_images, bool) else has_images
    label = lambda k: F.col(f"labels.{k}")
    some = lambda k: F.size(F.coalesce(F.col(f"detections.{k}"), F.array())) > 0
    risky = F.filter(F.array(*[F.when(label(k), F.lit(k)) for k in RISKS]), lambda x: x.isNotNull())
    found = [
        (1, some("pii_spans") & ~F.coalesce(label("pii_visible"), F.lit(False)), F.lit("pii_spans detected but pii_visible is not true")),
        (1, some("prompt_injection_spans") & ~F.coalesce(label("prompt_injection"), F.lit(False)), F.lit("prompt_injection_spans detected but prompt_injection is not true")),
        (1, (label("action") == "safe") & (F.size(risky) > 0), F.concat(F.lit("action=safe but risk labels true: "), F.array_join(risky, ", "))),
        (2, label("action").isNull(), F.lit("action is null")),
        (3, images & (label("action") == "reject") & F.coalesce(*[label(k).cast("string") for k in VISUAL]).isNull(), F.lit("image rejected but all visual axes are null")),
        (4, some("redaction_metadata"), F.lit("redaction_metadata present (PII detected in image text)")),
        (5, (label("prompt_injection") == F.lit(False)) & some("prompt_injection_spans"), F.lit("prompt-injection hard negative (span detected, label false)")),
    ]
    return F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(r).alias("rank"), t.alias("reason"))) for r, c, t in found]), lambda x: x.isNotNull())


def review_queue(rows: DataFrame, has_images: bool = False, most: int | None = None) -> DataFrame:
    """Queued rows by rank and id with notes 'auto-queued P1: a; b'; `most` caps the report."""
    queued = rows.withColumn("reasons", selection_reasons(has_images)).where(F.size("reasons") > 0)
    rank = F.array_min(F.transform("reasons", lambda r: r["rank"]))
    texts = F.array_join(F.transform("reasons", lambda r: r["reason"]), "; ")
    queued = queued.withColumn("rank", rank).withColumn("notes", F.concat(F.lit("auto-queued P"), F.col("rank").cast("string"), F.lit(": "), texts)).orderBy("rank", "input_id")
    return queued.limit(most) if most is not None else queued


def queue_stats(rows: DataFrame, has_images: bool = False) -> DataFrame:
    """Rows (reason, n) with the reasons 'total' and 'queued' for all rows."""
    r = rows.withColumn("reasons", selection_reasons(has_images))
    names = F.concat(F.array(F.lit("total")), F.when(F.size("reasons") > 0, F.array(F.lit("queued"))).otherwise(F.array().cast("array<string>")), F.transform("reasons", lambda x: F.concat(F.lit("P"), x["rank"].cast("string"))))
    return r.select(F.explode(names).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def latest(records: DataFrame, id_col: str = "input_id", seq: str = "seq") -> DataFrame:
    """Of each id's records the last: a grouped maximum, combined before the shuffle."""
    rest = [c for c in records.columns if c != id_col]
    return records.groupBy(id_col).agg(F.max_by(F.struct(*rest), seq).alias("_r")).select(id_col, "_r.*")


def layered(rows: DataFrame, api: DataFrame, human: DataFrame) -> DataFrame:
    """Rows with labels and sources overridden by the latest API record, then by the latest human one.

    Non-null values overwrite, and their source follows; a human record's review replaces the row's.  api and human have
    input_id, labels, seq (and human: review).
    """
    layers = rows
    for name, records in (("api", api), ("human", human)):
        own = latest(records).select("input_id", *[F.col(c).alias(f"_{name}_{c}") for c in records.columns if c in ("labels", "review")])
        layers = layers.join(own, "input_id", "left")
    value = lambda k: F.coalesce(F.col(f"_human_labels.{k}"), F.col(f"_api_labels.{k}"), F.col(f"labels.{k}")).alias(k)
    source = lambda k: F.when(F.col(f"_human_labels.{k}").isNotNull(), "human").when(F.col(f"_api_labels.{k}").isNotNull(), "api").otherwise(F.col(f"label_source.{k}")).alias(k)
    review = F.coalesce("_human_review", "review") if "review" in human.columns else F.col("review")
    out = layers.withColumn("label_source", F.struct(*[source(k) for k in LABELS])).withColumn("labels", F.struct(*[value(k) for k in LABELS])).withColumn("review", review)
    return out.drop(*[c for c in out.columns if c.startswith(("_api_", "_human_"))])


def edit_spans(spans: Column, deleted: Column, added: Column) -> Column:
    """Spans without those deleted (by start, end and type), with the added ones behind."""
    same = lambda s, d: (s["start"] == d["start"]) & (s["end"] == d["end"]) & (s["entity_type"] == d["entity_type"])
    return F.concat(F.filter(spans, lambda s: ~F.exists(deleted, lambda d: same(s, d))), added)


def edited(text: Column, spans: Column, deleted: Column, added: Column, sanitized: Column) -> Column:
    """struct<spans, sanitized, errors>: spans after edits; the text is sanitized anew where they changed.

    An added span has to lie in the text (0 <= start < end <= length) and have a type; one that doesn't is left out and named in errors.
    """
    good = lambda s: F.coalesce((s["start"] >= 0) & (s["start"] < s["end"]) & (s["end"] <= F.length(text)) & (F.coalesce(s["entity_type"], F.lit("")) != ""), F.lit(False))
    after = edit_spans(spans, deleted, F.filter(added, good))
    errors = F.transform(F.filter(added, lambda s: ~good(s)), lambda s: F.format_string("bad span %s [%d, %d)", F.coalesce(s["entity_type"], F.lit("none")), s["start"], s["end"]))
    changed = (F.size(deleted) > 0) | (F.size(F.filter(added, good)) > 0)
    return F.struct(after.alias("spans"), F.when(changed, anonymize_right(text, after)).otherwise(sanitized).alias("sanitized"), errors.alias("errors"))


def is_pii_gap() -> Column:
    """Spans of personal data without the label saying so."""
    return (F.size("detections.pii_spans") > 0) & ~F.coalesce(F.col("labels.pii_visible"), F.lit(False))


def clear_pii_gap(rows: DataFrame, overrides: DataFrame) -> DataFrame:
    """Override records (input_id, field, value) that the rows of the gap still lack: running it again adds none."""
    have = overrides.where(F.col("field") == "pii_visible").select("input_id")
    return rows.where(is_pii_gap()).select("input_id").distinct().join(have, "input_id", "left_anti").select("input_id", F.lit("pii_visible").alias("field"), F.lit(True).alias("value"))


# ---------------------------------------------------------------- router

_FLAGS = ",".join(f"{r}:boolean" for r in RISKS)


def router_json(content: Column) -> Column:
    """JSON object text within a model's answer: the whole, a fenced block, or from the first brace to the last."""
    t = F.trim(content)
    fenced = F.regexp_extract(t, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    braces = F.regexp_extract(t, r"(?s)(\{.*\})", 1)
    ok = lambda x: F.when((x != "") & F.schema_of_variant(F.try_parse_json(x)).startswith("OBJECT"), x)
    return F.coalesce(ok(t), ok(fenced), ok(braces))


def parse_router(content: Column) -> Column:
    """struct<action, flags, valid, error>: any missing or non-boolean flag or a bad action makes the answer 'unsure'."""
    text = router_json(content)
    v = F.try_parse_json(text)
    kind = lambda k: F.schema_of_variant(F.try_variant_get(v, f"$.{k}", "variant"))
    flag = lambda k: F.when(kind(k) == "BOOLEAN", F.try_variant_get(v, f"$.{k}", "boolean"))
    action = F.when(kind("action") == "STRING", F.try_variant_get(v, "$.action", "string"))
    errors = F.filter(F.array(*[F.when(flag(k).isNull(), F.lit(f"{k} missing or not boolean")) for k in RISKS], F.when(~F.coalesce(action.isin(ACTIONS), F.lit(False)), F.lit("action is not allowed"))), lambda x: x.isNotNull())
    error = F.when(text.isNull(), "no JSON object found").otherwise(F.when(F.size(errors) > 0, F.array_join(errors, "; ")))
    return F.struct(F.when(error.isNull(), action).otherwise("unsure").alias("action"), F.struct(*[flag(k).alias(k) for k in RISKS]).alias("flags"), error.isNull().alias("valid"), error.alias("error"))


def router_input() -> Column:
    """What a router is told of a canonical row: the redacted image and sanitized texts where there are any."""
    c = lambda k: F.nullif(F.col(f"content.{k}"), F.lit(""))
    return F.struct(
        F.col("input_id"), F.coalesce(c("redacted_image_path"), c("original_image_path")).alias("image"), F.coalesce(c("sanitized_text"), c("input_text")).alias("text"), F.coalesce(c("sanitized_ocr_text"), c("ocr_text")).alias("ocr_text"),
        F.transform("detections.pii_spans", lambda s: s["entity_type"]).alias("pii"), F.transform("detections.prompt_injection_spans", lambda s: s["attack_type"]).alias("attacks"), F.size("detections.redaction_metadata").alias("redactions"),
    )


def render_router_text(package: Column, modality: Column) -> Column:
    """The package as lines of text."""
    kinds = F.filter(F.array(*[F.when(modality[f"has_{k}"], F.lit(k)) for k in ("image", "text", "ocr")]), lambda x: x.isNotNull())
    line = lambda name, value: F.concat(F.lit(f"{name}: "), F.coalesce(value, F.lit("none")))
    listed = lambda a: F.when(F.size(a) > 0, F.array_join(a, ", "))
    return F.concat_ws("\n", line("input_id", package["input_id"]), F.concat(F.lit("modalities: "), F.array_join(kinds, ", ")), line("text", package["text"]), line("ocr_text", package["ocr_text"]), line("pii_spans", listed(package["pii"])), line("prompt_injection_spans", listed(package["attacks"])), line("redactions", package["redactions"].cast("string")))


# States, names and words of errors that may pass.
RETRY_STATUS = (429, 500, 502, 503, 504)
RETRY_NAMES = ("RateLimitError", "InternalServerError", "APITimeoutError")
RETRY_WORDS = ("rate limit", "resource_exhausted", "overloaded", "unavailable", "high demand", "try again", "timeout", "timed out")


def may_pass(error: Exception) -> bool:
    """Whether an error of a service is worth another try."""
    status = getattr(error, "status_code", None) or getattr(error, "code", None)
    text = str(error).lower()
    return type(error).__name__ in RETRY_NAMES or status in RETRY_STATUS or any(str(s) in text for s in RETRY_STATUS) or any(w in text for w in RETRY_WORDS)


def route(rows: DataFrame, call, text_col: str = "payload", retries: int = 5, sleep=None, fallback=None) -> DataFrame:
    """Adds router_answer by an injected callable (text -> text) in Arrow batches; failures give null.

    Errors that may pass are tried again (after 8, 16, 32 seconds and so on, 60 at most), then the fallback once; other errors give
    null at once.
    """
    import time

    import pyarrow as pa

    pause = sleep or time.sleep

    def ask(text: str) -> str | None:
        for k in range(retries):
            try:
                return call(text)
            except Exception as error:  # noqa: BLE001  of the callable
                if not may_pass(error):
                    return None
                if k + 1 < retries:
                    pause(min(60, 8 * 2**k))
        try:
            return fallback(text) if fallback else None
        except Exception:  # noqa: BLE001
            return None

    def run(batches):
        for b in batches:
            yield b.append_column("router_answer", pa.array([ask(t) if t is not None else None for t in b.column(b.schema.get_field_index(text_col)).to_pylist()], pa.string()))

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, ddl + ", router_answer string")


def router_records(rows: DataFrame, answer: str = "router_answer") -> DataFrame:
    """API label records and queue reasons of routed rows."""
    parsed = rows.withColumn("r", parse_router(F.coalesce(F.col(answer), F.lit(""))))
    labels = F.struct(F.col("r.action").alias("action"), *[F.col(f"r.flags.{k}").alias(k) for k in RISKS])
    return parsed.select("input_id", labels.alias("labels"), F.col("r.valid").alias("valid"), F.col("r.error").alias("error"), F.when(F.col("r.action") == "unsure", "router_unsure").alias("queue_reason"))

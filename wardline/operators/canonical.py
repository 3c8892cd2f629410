"""Canonical rows: schema, builders, validation, and converters from raw records of the sources.

Labels are tri-state: null is unknown and never becomes false, but in model_target().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.language import is_allowed
from .spans import anonymize, label_spans, numbered_ids

LABELS = ["action", "pii_visible", "prompt_injection", "sexual", "violence", "blood_gore", "political", "religious"]
RISKS = LABELS[1:]
ACTIONS = ["safe", "reject", "unsure"]
REVIEW_STATUSES = ["unreviewed", "human_reviewed", "needs_review", "skipped"]
_LABEL_DDL = "struct<action:string," + ",".join(f"{r}:boolean" for r in RISKS) + ">"
_SOURCE_DDL = "struct<" + ",".join(f"{x}:string" for x in LABELS) + ">"
_OCR = "array<struct<box_id:string,text:string,start:int,end:int,box:array<double>,confidence:double>>"
_BOXES = "array<struct<box_id:string,source_key:string,entity_type:string,text:string,box:array<double>,visible:boolean,clipped:boolean,element_type:string,detector:string>>"
_PII = "array<struct<span_id:string,entity_type:string,start:int,end:int,text:string,score:double,box_ids:array<string>,detector:string,source_box_id:string,source_key:string,source_text:string>>"
_PI = "array<struct<span_id:string,attack_type:string,start:int,end:int,text:string,score:double,box_ids:array<string>,detector:string,field:string,rule:string>>"
_RED = "array<struct<redaction_id:string,reason:string,source_span_ids:array<string>,box_ids:array<string>,merged_box:array<double>,method:string>>"
CONTENT = ["original_image_path", "redacted_image_path", "input_text", "sanitized_text", "ocr_text", "sanitized_ocr_text"]
CANONICAL = {
    "input_id": "string", "source": "struct<name:string,split:string,source_sample_id:string,license_status:string>", "modality": "struct<has_image:boolean,has_text:boolean,has_ocr:boolean>",
    "content": "struct<" + ",".join(f"{x}:string" for x in CONTENT) + ">", "geometry": f"struct<ocr_boxes:{_OCR},source_pii_boxes:{_BOXES}>",
    "detections": f"struct<pii_spans:{_PII},prompt_injection_spans:{_PI},redaction_metadata:{_RED}>", "labels": _LABEL_DDL, "label_source": _SOURCE_DDL, "source_labels": "map<string,string>",
    "review": "struct<status:string,reviewer:string,notes:string>",
}
DDL = ", ".join(f"{k} {v}" for k, v in CANONICAL.items())


def labels_struct(values: dict[str, Column | bool | str | None]) -> Column:
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(*[as_col(values.get(k)).cast("string" if k == "action" else "boolean").alias(k) for k in LABELS])


def sources_struct(values: dict[str, Column | str | None]) -> Column:
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(*[as_col(values.get(k)).cast("string").alias(k) for k in LABELS])


def new_rows(
    rows: DataFrame, input_id: Column, name: str, split: Column, sample_id: Column, license_status: str, *, labels: Column, label_source: Column, content: dict[str, Column] | None = None,
    ocr_boxes: Column | None = None, source_boxes: Column | None = None, pii_spans: Column | None = None, pi_spans: Column | None = None, source_labels: Column | None = None, has_image: bool = False,
) -> DataFrame:
    """Canonical rows with empty geometry and detections where none are given, and status 'unreviewed'."""
    content = content or {}
    filled = lambda k: F.length(F.trim(F.coalesce(content[k], F.lit("")))) > 0 if k in content else F.lit(False)
    empty = lambda kind: F.array().cast(kind)
    cast = lambda c, kind: c.cast(kind) if c is not None else empty(kind)
    return rows.select(
        input_id.alias("input_id"),
        F.struct(F.lit(name).alias("name"), split.alias("split"), sample_id.cast("string").alias("source_sample_id"), F.lit(license_status).alias("license_status")).alias("source"),
        F.struct(F.lit(has_image).alias("has_image"), filled("input_text").alias("has_text"), filled("ocr_text").alias("has_ocr")).alias("modality"),
        F.struct(*[(content.get(k) if content.get(k) is not None else F.lit(None)).cast("string").alias(k) for k in CONTENT]).alias("content"),
        F.struct(cast(ocr_boxes, _OCR).alias("ocr_boxes"), cast(source_boxes, _BOXES).alias("source_pii_boxes")).alias("geometry"),
        F.struct(cast(pii_spans, _PII).alias("pii_spans"), cast(pi_spans, _PI).alias("prompt_injection_spans"), empty(_RED).alias("redaction_metadata")).alias("detections"),
        labels.cast(_LABEL_DDL).alias("labels"), label_source.cast(_SOURCE_DDL).alias("label_source"),
        (source_labels if source_labels is not None else F.create_map()).cast("map<string,string>").alias("source_labels"),
        F.struct(F.lit("unreviewed").alias("status"), F.lit(None).cast("string").alias("reviewer"), F.lit(None).cast("string").alias("notes")).alias("review"),
    )


def label_mask(labels: Column) -> Column:
    """1 for each known label."""
    return F.struct(*[labels[k].isNotNull().cast("int").alias(k) for k in LABELS])


def model_target(labels: Column) -> Column:
    """What a model is trained on: an unknown action is 'unsure', unknown risks are false."""
    return F.struct(F.coalesce(labels["action"], F.lit("unsure")).alias("action"), *[F.coalesce(labels[k], F.lit(False)).alias(k) for k in RISKS])


def validate(row: str = "") -> Column:
    """array<string> of a canonical row's errors, empty if it is valid."""
    col = lambda name: F.col(f"{row}.{name}" if row else name)
    geometry, detections, labels = col("geometry"), col("detections"), col("labels")
    boxes = F.concat(F.coalesce(F.transform(geometry["ocr_boxes"], lambda b: F.struct(b["box_id"].alias("id"), b["box"].alias("box"))), F.array().cast("array<struct<id:string,box:array<double>>>")), F.coalesce(F.transform(geometry["source_pii_boxes"], lambda b: F.struct(b["box_id"].alias("id"), b["box"].alias("box"))), F.array().cast("array<struct<id:string,box:array<double>>>")))
    spans = F.concat(*[F.coalesce(F.transform(detections[k], lambda s: F.struct(s["span_id"].alias("id"), s["box_ids"].alias("refs"))), F.array().cast("array<struct<id:string,refs:array<string>>>")) for k in ("pii_spans", "prompt_injection_spans")])
    redactions = F.coalesce(detections["redaction_metadata"], F.array().cast(_RED))
    ids = lambda items: F.filter(F.transform(items, lambda x: x["id"]), lambda x: F.coalesce(x, F.lit("")) != "")
    box_ids, span_ids = ids(boxes), ids(spans)
    red_ids = F.filter(F.transform(redactions, lambda r: r["redaction_id"]), lambda x: F.coalesce(x, F.lit("")) != "")
    four = lambda b: b.isNotNull() & (F.size(b) == 4) & F.forall(F.coalesce(b, F.array().cast("array<double>")), lambda x: x.isNotNull())
    repeated = lambda found: F.filter(F.array_distinct(found), lambda x: F.size(F.filter(found, lambda y: y == x)) > 1)
    each = lambda found, text: F.transform(found, lambda x: F.concat(F.lit(text), x))
    refs = lambda found: F.flatten(F.transform(found, lambda s: F.coalesce(s["refs"], F.array().cast("array<string>"))))
    when = lambda cond, text: F.when(cond, F.array(F.lit(text))).otherwise(F.array().cast("array<string>"))
    red = lambda field: F.flatten(F.transform(redactions, lambda r: F.coalesce(r[field], F.array().cast("array<string>"))))
    parts = [
        when(F.coalesce(col("input_id"), F.lit("")) == "", "input_id is empty"),
        when(labels.isNull(), "labels is not a dict"),
        when(labels["action"].isNotNull() & ~labels["action"].isin(ACTIONS), "labels.action is not allowed"),
        when(col("label_source").isNull(), "label_source is not a dict"),
        when(F.size(box_ids) < F.size(boxes), "box without box_id"),
        each(repeated(box_ids), "duplicate box_id: "),
        when(F.exists(boxes, lambda b: ~four(b["box"])), "box is not 4 numbers"),
        when(F.size(span_ids) < F.size(spans), "span without span_id"),
        each(repeated(span_ids), "duplicate span_id: "),
        each(F.array_except(refs(spans), box_ids), "span references unknown box_id "),
        when(F.size(red_ids) < F.size(redactions), "redaction without redaction_id"),
        each(repeated(red_ids), "duplicate redaction_id: "),
        each(F.array_except(red("source_span_ids"), span_ids), "redaction references unknown span_id "),
        each(F.array_except(red("box_ids"), box_ids), "redaction references unknown box_id "),
        when(F.exists(redactions, lambda r: r["merged_box"].isNotNull() & ~four(r["merged_box"])), "merged_box is not 4 numbers"),
        when(~F.coalesce(col("review")["status"].isin(REVIEW_STATUSES), F.lit(False)), "review.status is not allowed"),
    ]
    return F.concat(*parts)


def quarantine(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid rows, and invalid ones with their errors."""
    checked = rows.withColumn("errors", validate())
    return checked.where(F.size("errors") == 0).drop("errors"), checked.where(F.size("errors") > 0)


# ---------------------------------------------------------------- converters

TEXT_ONLY = {"pii_visible": False, "sexual": False, "violence": False, "blood_gore": False}
_ASSUMED = {k: "source_assumption" for k in ("action", *TEXT_ONLY)}
_SAFE = {k: False for k in RISKS}


def _whole(text: Column, prefix: str, attack: Column, condition: Column, field: str = "input_text") -> Column:
    span = F.array(F.struct(F.lit(f"{prefix}_0001").alias("span_id"), attack.alias("attack_type"), F.lit(0).alias("start"), F.length(text).alias("end"), text.alias("text"), F.lit(1.0).alias("score"), F.array().cast("array<string>").alias("box_ids"), F.lit("source_gold").alias("detector"), F.lit(field).alias("field"), F.lit(None).cast("string").alias("rule"))).cast(_PI)
    return F.when(condition & (F.length(text) > 0), span).otherwise(F.array().cast(_PI))


def convert_pii_corpus(rows: DataFrame, slug: str, labels: Column) -> DataFrame:
    """Rows source_text, privacy_mask, split, index: gold spans of known labels, and the anonymized text."""
    gold = F.filter(label_spans(F.coalesce("privacy_mask", F.array().cast("array<struct<start:int,end:int,label:string,value:string>>")), labels), lambda s: (s["start"] >= 0) & (s["start"] < s["end"]) & (s["end"] <= F.length("source_text")))
    rows = rows.withColumn("_gold", gold)
    ids = numbered_ids(F.col("_gold"), "pii_")
    spans = F.zip_with("_gold", ids, lambda s, i: F.struct(i.alias("span_id"), s["entity_type"].alias("entity_type"), s["start"].alias("start"), s["end"].alias("end"), T.slice_text(F.col("source_text"), s["start"], s["end"]).alias("text"), F.lit(1.0).alias("score"), F.array().cast("array<string>").alias("box_ids"), F.lit("source_gold").alias("detector"), F.lit(None).cast("string").alias("source_box_id"), s["label"].alias("source_key"), F.lit(None).cast("string").alias("source_text")))
    return new_rows(
        rows, T.input_id(slug, F.col("index")), slug, F.col("split"), F.col("index"), "private", labels=labels_struct({"action": "safe", **_SAFE}), label_source=sources_struct({k: "source_assumption" for k in LABELS}),
        content={"input_text": F.col("source_text"), "sanitized_text": anonymize(F.col("source_text"), F.col("_gold"))}, pii_spans=spans,
    )


def convert_prompts(rows: DataFrame, slug: str, license_status: str, attack_type: Column | None = None) -> DataFrame:
    """Rows text, label (1: attack), split, index: attacks are rejected and spanned whole; topic axes stay unknown."""
    attack = F.col("label") == 1
    return new_rows(
        rows, T.input_id(slug, F.col("index")), slug, F.col("split"), F.col("index"), license_status,
        labels=labels_struct({**TEXT_ONLY, "action": F.when(attack, "reject").otherwise("safe"), "prompt_injection": attack}), label_source=sources_struct({**_ASSUMED, "prompt_injection": "source_gold"}),
        content={"input_text": F.col("text")}, pi_spans=_whole(F.col("text"), "pi_gold", attack_type if attack_type is not None else F.lit("prompt_injection"), attack),
    )


def convert_emails(rows: DataFrame, slug: str = "llmail_inject_challenge") -> DataFrame:
    """Rows RowKey, subject, body, scenario, objectives, phase, index: all are attacks; mostly Latin texts only."""
    rows = rows.withColumn("_text", T.email_text(F.col("subject"), F.col("body"))).where(T.is_mostly_latin(F.col("_text")))
    goals = F.coalesce(F.from_json("objectives", "map<string,string>"), F.create_map().cast("map<string,string>"))
    return new_rows(
        rows, T.input_id(slug, F.col("index")), slug, F.when(F.col("phase") == "Phase1", "train").when(F.col("phase") == "Phase2", "test"), F.col("RowKey"), "mit",
        labels=labels_struct({**TEXT_ONLY, "action": "reject", "prompt_injection": True}), label_source=sources_struct({**_ASSUMED, "prompt_injection": "source_gold"}),
        content={"input_text": F.col("_text")}, pi_spans=_whole(F.col("_text"), "pi_gold", F.col("scenario"), F.lit(True)), source_labels=goals,
    )


def convert_visual_prompts(rows: DataFrame, slug: str = "cyberseceval3_visual_prompt_injection") -> DataFrame:
    """Rows id, user_input_text, image_text, injection_type, index: the image's text is OCR text and spanned whole."""
    return new_rows(
        rows, T.input_id(slug, F.col("index")), slug, F.lit("test"), F.col("id"), "mit", has_image=True, labels=labels_struct({"action": "reject", "prompt_injection": True}),
        label_source=sources_struct({"action": "source_assumption", "prompt_injection": "source_gold"}), content={"input_text": F.col("user_input_text"), "ocr_text": F.col("image_text")},
        pi_spans=_whole(F.col("image_text"), "pi_gold", F.col("injection_type"), F.lit(True), "ocr_text"),
    )


def convert_hate_speech(rows: DataFrame, slug: str = "vihsd_topic_safety") -> DataFrame:
    """Rows free_text, label_id, split, index: personal data and injections are assumed absent, all else is unknown."""
    name = F.when(F.col("label_id") == 0, "CLEAN").when(F.col("label_id") == 1, "OFFENSIVE").when(F.col("label_id") == 2, "HATE")
    return new_rows(
        rows, T.input_id(slug, F.col("index")), slug, F.col("split"), F.col("index"), "research", labels=labels_struct({"pii_visible": False, "prompt_injection": False}),
        label_source=sources_struct({"pii_visible": "source_assumption", "prompt_injection": "source_assumption"}), content={"input_text": F.col("free_text")}, source_labels=F.create_map(F.lit("label"), name),
    )


def convert_image_instructions(rows: DataFrame, slug: str = "vlguard") -> DataFrame:
    """Rows id, image, safe, harmful_subcategory, pairs, split: one row for each instruction of a record.

    pairs: array<struct<instruction, safe_instruction, unsafe_instruction, response>>.
    """
    kinds = [("instruction", "unsafe_image_instruction"), ("safe_instruction", "safe_instruction"), ("unsafe_instruction", "unsafe_instruction")]
    options = F.flatten(F.transform("pairs", lambda p, i: F.filter(F.array(*[F.struct(F.lit(k).alias("kind"), p[f].alias("text"), i.alias("i")) for f, k in kinds]), lambda x: x["text"].isNotNull())))
    e = rows.select("*", F.posexplode(options).alias("place", "p"))
    safe = F.coalesce("safe", F.lit(False))
    sub = F.lower(F.trim(F.coalesce("harmful_subcategory", F.lit(""))))
    axis = {"sexual": "sexually explicit", "violence": "violence", "political": "political", "pii_visible": "personal data"}
    value = {k: F.when(safe, F.lit(False)).when(sub == v, F.lit(True)) for k, v in axis.items()} | {"blood_gore": F.when(safe, F.lit(False))}
    kind = F.col("p.kind")
    action = F.when(kind == "safe_instruction", "safe").when(~safe | (kind == "unsafe_instruction"), "reject").otherwise("safe")
    gold = {k: F.when(v.isNotNull(), "source_gold") for k, v in value.items()}
    return new_rows(
        e, F.concat_ws(":", F.lit(slug), "split", F.col("id").cast("string"), F.col("p.i").cast("string"), kind), slug, F.col("split"), F.concat_ws(":", "split", F.col("id").cast("string"), F.col("p.i").cast("string"), kind), "mit_gated",
        has_image=True, labels=labels_struct({**value, "action": action, "prompt_injection": False}), label_source=sources_struct({**gold, "action": "source_gold", "prompt_injection": "source_assumption"}),
        content={"original_image_path": F.col("image"), "input_text": F.col("p.text")},
    )


# Categories that are rejected, and the axis that a category asserts.
BENCH_REJECT = ["Sex", "Physical_Harm", "Illegal_Activitiy", "Malware_Generation", "Fraud", "EconomicHarm", "HateSpeech", "Privacy_Violence"]
BENCH_AXIS = {"sexual": ["Sex"], "violence": ["Physical_Harm"], "political": ["Political_Lobbying", "Gov_Decision"]}
# Action and axes that a category of unsafe images asserts; axes that aren't named stay unknown.
UNSAFE_CATEGORIES = {
    "hate": ("reject", {}),
    "harassment": ("reject", {}),
    "violence": ("reject", {"sexual": False, "violence": True, "political": False, "religious": False}),
    "self-harm": ("reject", {}),
    "sexual": ("reject", {"sexual": True, "violence": False, "blood_gore": False, "political": False, "religious": False}),
    "shocking": ("reject", {}),
    "illegal activity": ("reject", {}),
    "deception": ("reject", {}),
    "political": (None, {"sexual": False, "violence": False, "blood_gore": False, "political": True, "religious": False}),
    "public and personal health": (None, {"sexual": False, "violence": False, "blood_gore": False, "political": False, "religious": False}),
    "spam": (None, {"sexual": False, "violence": False, "blood_gore": False, "political": False, "religious": False}),
}
AXES = ["sexual", "violence", "blood_gore", "political", "religious"]


def bench_labels(category: Column) -> tuple[Column, Column]:
    """Labels of a multimodal benchmark category: action and axis where the category says it, else unknown."""
    action = F.when(category.isin(BENCH_REJECT), "reject")
    axis = {k: F.when(category.isin(v), F.lit(True)) for k, v in BENCH_AXIS.items()}
    return labels_struct({"action": action, **axis}), sources_struct({"action": F.when(action.isNotNull(), "source_derived"), **{k: F.when(v.isNotNull(), "source_gold") for k, v in axis.items()}})


def unsafe_image_labels(safety: Column, category: Column) -> tuple[Column, Column]:
    """Labels of an image-safety record: safe means all false, unsafe goes by category, anything else is unknown."""
    safety, category = F.lower(F.trim(F.coalesce(safety, F.lit("")))), F.lower(F.trim(F.coalesce(category, F.lit(""))))
    safe, unsafe = safety == "safe", safety == "unsafe"
    action = F.when(safe, "safe").when(unsafe & category.isin([k for k, (a, _) in UNSAFE_CATEGORIES.items() if a]), "reject")

    def axis(name: str) -> Column:
        found = F.when(safe, F.lit(False))
        for k, (_, values) in UNSAFE_CATEGORIES.items():
            if name in values:
                found = found.when(unsafe & (category == k), F.lit(values[name]))
        return found

    axes = {k: axis(k) for k in AXES}
    assumed = F.when(safe, F.lit(False))
    labels = labels_struct({"action": action, "pii_visible": assumed, "prompt_injection": assumed, **axes})
    source = sources_struct({"action": F.when(action.isNotNull(), "source_gold"), **{k: F.when(safe, "source_assumption") for k in ("pii_visible", "prompt_injection")}, **{k: F.when(v.isNotNull(), "source_gold") for k, v in axes.items()}})
    return labels, source


def convert_bench_questions(rows: DataFrame, slug: str = "mm_safetybench") -> DataFrame:
    """Rows category, id, question, index: text-only questions of a multimodal benchmark, all held out; injections stay unknown."""
    labels, source = bench_labels(F.col("category"))
    question = F.coalesce("question", F.lit(""))
    facts = F.create_map(F.lit("category"), F.col("category"), F.lit("id"), F.col("id").cast("string"), F.lit("split"), F.lit("Text_only"), F.lit("original_question"), question)
    return new_rows(
        rows, T.input_id(slug, F.col("index")), slug, F.lit("test"), F.concat_ws(":", "category", F.col("id").cast("string"), F.lit("Text_only")), "cc_by_nc_4.0", labels=labels, label_source=source,
        content={"input_text": question, "sanitized_text": question}, source_labels=facts,
    )


def convert_unsafe_images(rows: DataFrame, images_root: str, slug: str = "unsafebench") -> DataFrame:
    """Rows safety_label, category, source, text, split, row (0-based), index: images by id; the caption is kept for audits only."""
    labels, source = unsafe_image_labels(F.col("safety_label"), F.col("category"))
    ident = T.input_id(slug, F.col("index"))
    facts = F.create_map(
        F.lit("safety_label"), F.col("safety_label"), F.lit("category"), F.col("category"), F.lit("source"), F.col("source"), F.lit("text"), F.coalesce("text", F.lit("")),
        F.lit("parquet_row"), F.col("row").cast("string"), F.lit("split"), F.col("split"),
    )
    return new_rows(
        rows, ident, slug, F.col("split"), F.concat_ws(":", "split", F.col("row").cast("string")), "dua_research", has_image=True, labels=labels, label_source=source,
        content={"original_image_path": F.concat(F.lit(images_root + "/"), ident, F.lit(".jpg")), "input_text": F.lit(""), "sanitized_text": F.lit("")}, source_labels=facts,
    )


def convert_allowed_prompts(rows: DataFrame, slug: str, license_status: str, language: str = "language", keep_undetectable: bool = False) -> DataFrame:
    """convert_prompts() of the rows in an allowed language (a column that functions.language.with_language() adds)."""
    return convert_prompts(rows.where(is_allowed(F.col(language), keep_undetectable=keep_undetectable)), slug, license_status)


def dropout_variants(rows: DataFrame, rates: list[float], seed: int = 42) -> DataFrame:
    """Variants of rows with personal-data spans over OCR text that leave some of them visible, one for each rate.

    A span stays visible if the hash of seed, row, variant and span falls under the rate (0: none, 1: all).  The variant's sanitized
    text, its redacted box ids and its label pii_visible (whether any span is visible) follow from that; its split is its source's.
    """
    variant = F.posexplode(F.array(*map(F.lit, rates))).alias("variant_index", "rate")
    own = rows.where(F.size("detections.pii_spans") > 0).select("*", variant)
    roll = lambda s: F.pmod(F.xxhash64(F.lit(seed), F.col("input_id"), F.col("variant_index"), s["span_id"]), F.lit(1 << 30)) / (1 << 30)
    own = own.withColumn("_hidden", F.filter("detections.pii_spans", lambda s: roll(s) >= F.col("rate"))).withColumn("_shown", F.filter("detections.pii_spans", lambda s: roll(s) < F.col("rate")))
    ids = lambda k: F.array_distinct(F.flatten(F.transform(k, lambda s: s["box_ids"])))
    made = F.struct(
        F.lit("pii_dropout").alias("kind"), F.col("input_id").alias("source_input_id"), F.col("variant_index"), F.col("rate").alias("pii_drop_out"),
        ids("_shown").alias("kept_visible_box_ids"), F.array_except(ids("_hidden"), ids("_shown")).alias("redacted_box_ids"), F.lit(seed).alias("seed"),
    )
    text = anonymize(F.coalesce("content.ocr_text", F.lit("")), F.col("_hidden"), guarded=True)
    own = own.withColumn("augmentation", made).withColumn("content", F.col("content").withField("sanitized_ocr_text", text))
    own = own.withColumn("labels", F.col("labels").withField("pii_visible", F.size("_shown") > 0)).withColumn("label_source", F.col("label_source").withField("pii_visible", F.lit("augmentation_derived")))
    own = own.withColumn("input_id", F.format_string("%s_aug%02d", "input_id", "variant_index"))
    return own.drop("variant_index", "rate", "_hidden", "_shown")


def web_key_type(key: Column) -> Column:
    """Entity type of a web form's element key; null where the key names no personal data."""
    key = F.upper(F.coalesce(key, F.lit("")))
    base = F.when(key == "PII_CARD_LAST4", key).otherwise(F.regexp_replace(key, r"\d+$", ""))
    full = lambda rx: key.rlike(f"^(?:{rx})$")
    return (
        F.when(key.isin("PII_CARD_IMAGE", "PII_AVATAR"), F.lit(None).cast("string"))
        .when(full(r"PII_(GIFT_)?(FIRSTNAME|LASTNAME|FULLNAME)(?:_DERIVED)?\d*") | (base == "PII_NAME_FULL_DERIVED"), "PERSON")
        .when(full(r"PII_(GIFT_)?EMAIL\d*"), "EMAIL_ADDRESS").when(key.startswith("PII_PHONE"), "PHONE_NUMBER")
        .when(
            base.isin("PII_ADDRESS", "PII_STREET", "PII_CITY", "PII_STATE", "PII_STATE_ABBR") | base.rlike("^PII_(POSTCODE|COUNTRY|CITY_STATE)")
            | full(r"PII_LOCATION\d+_(STREET|CITY|STATE|STATE_ABBR|POSTCODE|POSTCODE_EXT|POSTCODE_FULL|CITY_STATE|CITY_STATE_ZIP)"), "LOCATION",
        )
        .when(base == "PII_COMPANY", "ORGANIZATION").when(base.rlike("^PII_(DOB|CARD_EXPIRY)"), "DATE_TIME").when(base.isin("PII_CARD_NUMBER", "PII_CARD_LAST4", "PII_CARD_CVV", "PII_SECURITY_CODE"), "CREDIT_CARD")
        .when(base == "PII_LOGIN_USERNAME", "USERNAME").when(base.isin("PII_LOGIN_PASSWORD", "PII_LOGIN_PASSWORD_CONFIRM"), "CREDENTIAL").when(base.isin("PII_DELIVERY_INSTRUCTIONS", "PII_GIFT_MESSAGE"), "MISC")
    )


WEB_ELEMENT = "array<struct<key:string,value:string,visible:boolean,clipped:boolean,element_type:string,bbox_x:double,bbox_y:double,bbox_width:double,bbox_height:double>>"


def web_boxes(elements_json: Column) -> Column:
    """Source boxes of visible, filled, mapped elements of positive size; ids src_0001 and on."""
    elements = F.coalesce(F.from_json(elements_json, WEB_ELEMENT), F.array().cast(WEB_ELEMENT))
    seen = F.filter(elements, lambda e: (F.coalesce(e["value"], F.lit("")) != "") & F.coalesce(e["visible"], F.lit(False)) & (e["bbox_width"] > 0) & (e["bbox_height"] > 0) & e["bbox_x"].isNotNull() & e["bbox_y"].isNotNull())
    typed = F.filter(F.transform(seen, lambda e: F.struct(e.alias("e"), web_key_type(e["key"]).alias("t"))), lambda x: x["t"].isNotNull())
    return F.transform(typed, lambda x, i: F.struct(
        F.concat(F.lit("src_"), F.lpad((i + 1).cast("string"), 4, "0")).alias("box_id"), x["e"]["key"].alias("source_key"), x["t"].alias("entity_type"), x["e"]["value"].alias("text"),
        F.array(x["e"]["bbox_x"], x["e"]["bbox_y"], x["e"]["bbox_x"] + x["e"]["bbox_width"], x["e"]["bbox_y"] + x["e"]["bbox_height"]).alias("box"),
        x["e"]["visible"].alias("visible"), x["e"]["clipped"].alias("clipped"), x["e"]["element_type"].alias("element_type"), F.lit("source").alias("detector"),
    )).cast(_BOXES)


def convert_web_pages(rows: DataFrame, slug: str = "webpii") -> DataFrame:
    """Rows image_path, pii_elements_json, split, index: visible personal data with boxes; other axes as the source allows."""
    rows = rows.withColumn("_boxes", web_boxes(F.col("pii_elements_json")))
    assumed = {"prompt_injection": "source_assumption", "political": "source_assumption", "religious": "source_assumption"}
    return new_rows(
        rows, T.input_id(slug, F.col("index")), slug, F.col("split"), F.col("index"), "research", has_image=True, labels=labels_struct({"pii_visible": F.size("_boxes") > 0, "prompt_injection": False, "political": False, "religious": False}),
        label_source=sources_struct({"pii_visible": "source", **assumed}), content={"original_image_path": F.col("image_path")}, source_boxes=F.col("_boxes"),
    )


def translation_twins(rows: DataFrame, translations: DataFrame, model: str, src: str = "en", tgt: str = "vi") -> DataFrame:
    """Twins of canonical rows whose text a cache has translated: id suffix _vi, provenance _translated, gold span renewed.

    Cache rows are (key, value) with the key model|src|tgt|sha256(text).  Rows with personal-data spans get no twin.
    """
    key = F.concat_ws("|", F.lit(model), F.lit(src), F.lit(tgt), F.sha2(F.col("content.input_text").cast("binary"), 256))
    own = rows.where((F.size("detections.pii_spans") == 0) & ~F.col("input_id").endswith("_vi")).withColumn("key", key).join(translations, "key")
    text = F.col("value")
    renamed = F.struct(*[F.when(F.col(f"label_source.{k}").isNotNull(), F.concat(F.col(f"label_source.{k}"), F.lit("_translated"))).alias(k) for k in LABELS])
    attack = F.get(F.col("detections.prompt_injection_spans"), F.lit(0))["attack_type"]
    return (
        own.withColumn("detections", F.col("detections").withField("prompt_injection_spans", _whole(text, "pi_gold", F.coalesce(attack, F.lit("prompt_injection")), F.coalesce(F.col("labels.prompt_injection"), F.lit(False)))))
        .withColumn("augmentation", F.struct(F.lit("translation").alias("type"), F.lit(f"{src}-{tgt}").alias("direction"), F.lit(model).alias("model"), F.col("input_id").alias("source_input_id")))
        .withColumn("input_id", F.concat("input_id", F.lit(f"_{tgt}"))).withColumn("content", F.col("content").withField("input_text", text)).withColumn("label_source", renamed).drop("key", "value")
    )

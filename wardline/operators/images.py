"""Images and their text: sizes, OCR output, and the stages that read, align, detect and redact.

OCR engines are injected (path -> an engine's raw answer).  Pixels aren't changed, as no imaging library is at hand: redactions are boxes.
Everything between is expressions over one row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import slice_text
from . import geometry, spans
from .canonical import CANONICAL

#: An engine's answer as lines of text: the older layout gives a quad of points, the newer one a polygon or a box.
OCR_LINES = "array<struct<text:string,quad:array<array<double>>,box:array<double>,confidence:double>>"


def ocr_lines(raw) -> list[tuple]:
    """Lines (text, quad, box, confidence) of an OCR engine's raw answer, in reading order; lines without text are left out.

    Two layouts: a list of pages of [quad, (text, confidence)], of which the first page counts, or a mapping with rec_texts,
    rec_scores and rec_polys (rec_boxes where those are missing).  Entries of any other shape are left out.
    """
    if raw is None or len(raw) == 0:
        return []
    page = raw[0] if isinstance(raw, (list, tuple)) else raw
    if hasattr(page, "keys"):
        listed = lambda k: list(page.get(k)) if page.get(k) is not None and len(page.get(k)) else []
        texts = listed("rec_texts")
        scores, places = listed("rec_scores") or [None] * len(texts), listed("rec_polys") or listed("rec_boxes")
        entries = list(zip(texts, places, scores, strict=False))
    else:
        entries = []
        for entry in page or ():
            try:
                quad, (text, score) = entry[0], entry[1]
            except (TypeError, ValueError, IndexError):
                continue
            entries.append((text, quad, score))
    out = []
    for text, place, score in entries:
        if not text:
            continue
        numbers = [x.tolist() if hasattr(x, "tolist") else x for x in place]
        flat = not any(isinstance(x, (list, tuple)) for x in numbers)
        quad, box = (None, [float(x) for x in numbers]) if flat else ([[float(v) for v in p] for p in numbers], None)
        out.append((str(text), quad, box, None if score is None else float(score)))
    return out


def read_text(rows: DataFrame, make_engine: Callable, path: str = "content.original_image_path", out: str = "ocr") -> DataFrame:
    """Adds the lines of each image's text (OCR_LINES) by an engine made once for each batch stream; rows without a path get none."""
    import pyarrow as pa

    line = pa.struct([("text", pa.string()), ("quad", pa.list_(pa.list_(pa.float64()))), ("box", pa.list_(pa.float64())), ("confidence", pa.float64())])
    asked = rows.withColumn("_path", F.col(path))

    def run(batches):
        engine = make_engine()
        for b in batches:
            found = [ocr_lines(engine(p)) if p else [] for p in b.column(b.schema.get_field_index("_path")).to_pylist()]
            listed = [[dict(zip(("text", "quad", "box", "confidence"), x, strict=True)) for x in own] for own in found]
            yield b.append_column(out, pa.array(listed, pa.list_(line)))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in asked.schema.fields)
    return asked.mapInArrow(run, f"{fields}, {out} {OCR_LINES}").drop("_path")


def segments_of(lines: Column) -> tuple[Column, Column]:
    """The lines' text joined, and OCR boxes box_0001 and on with offsets into it."""
    boxed = F.transform(lines, lambda x: F.struct(x["text"].alias("text"), F.when(x["quad"].isNotNull(), geometry.quad_to_box(x["quad"])).otherwise(x["box"]).alias("box")))
    text, laid = geometry.full_text(boxed)
    boxes = F.zip_with(laid, lines, lambda s, x: F.struct(s["text"].alias("text"), s["start"].alias("start"), s["end"].alias("end"), s["box"].alias("box"), x["confidence"].alias("confidence")))
    numbered = F.transform(boxes, lambda s, i: F.struct(F.concat(F.lit("box_"), F.lpad((i + 1).cast("string"), 4, "0")).alias("box_id"), s["text"].alias("text"), s["start"].alias("start"), s["end"].alias("end"), s["box"].alias("box"), s["confidence"].alias("confidence")))
    return text, numbered


_PII = CANONICAL["detections"].split("prompt_injection_spans")[0].removeprefix("struct<pii_spans:").rstrip(",")


def _aligned(rows: DataFrame) -> DataFrame:
    """Spans of source boxes over the OCR text renewed; spans of other detectors stay."""
    existing = F.transform("detections.pii_spans", lambda s: F.struct(s["span_id"].alias("span_id"), s["entity_type"].alias("entity_type"), s["start"].alias("start"), s["end"].alias("end"), s["box_ids"].alias("box_ids"), s["detector"].alias("detector")))
    found = geometry.align_source_boxes(F.col("geometry.source_pii_boxes"), F.col("geometry.ocr_boxes"), F.coalesce("content.ocr_text", F.lit("")), existing)
    kept = F.filter("detections.pii_spans", lambda s: s["detector"] != "source_box")
    new = F.filter(found, lambda s: s["detector"] == "source_box")
    none = F.lit(None).cast("string")
    full = F.transform(new, lambda s: F.struct(
        s["span_id"].alias("span_id"), s["entity_type"].alias("entity_type"), s["start"].alias("start"), s["end"].alias("end"), slice_text(F.col("content.ocr_text"), s["start"], s["end"]).alias("text"),
        F.lit(1.0).alias("score"), s["box_ids"].alias("box_ids"), s["detector"].alias("detector"), none.alias("source_box_id"), none.alias("source_key"), none.alias("source_text"),
    )).cast(_PII)
    return rows.withColumn("detections", F.col("detections").withField("pii_spans", F.concat(kept, full)))


def ocr_rows(rows: DataFrame, lines: str = "ocr", align: bool = True) -> DataFrame:
    """Canonical rows with OCR boxes, OCR text and has_ocr from their lines; spans of source boxes aligned with them.

    Rows without an image or a path stay as they are.
    """
    text, boxes = segments_of(F.col(lines))
    has = F.coalesce(F.col("modality.has_image"), F.lit(False)) & F.col("content.original_image_path").isNotNull()
    kind = CANONICAL["geometry"]
    done = rows.withColumn("_boxes", boxes).withColumn("_text", text).withColumn("_has", has)
    done = done.withColumn("geometry", F.when(F.col("_has"), F.col("geometry").withField("ocr_boxes", F.col("_boxes"))).otherwise(F.col("geometry")).cast(kind))
    done = done.withColumn("content", F.when(F.col("_has"), F.col("content").withField("ocr_text", F.col("_text"))).otherwise(F.col("content")))
    done = done.withColumn("modality", F.when(F.col("_has"), F.col("modality").withField("has_ocr", F.size("_boxes") > 0)).otherwise(F.col("modality")))
    if align:
        renewed = _aligned(done).select(F.col("detections").alias("_d"), *done.columns)
        done = renewed.withColumn("detections", F.when(F.col("_has"), F.col("_d")).otherwise(F.col("detections"))).drop("_d")
    return done.drop("_boxes", "_text", "_has", lines)


def realigned(rows: DataFrame) -> DataFrame:
    """Rows whose OCR is done, with the spans of source boxes aligned anew."""
    return _aligned(rows)


def redact_rows(rows: DataFrame, found: str = "spans", padding: float = 3.0, method: str = "blur", width: Column | None = None, height: Column | None = None) -> DataFrame:
    """Canonical rows with OCR text: detected spans (a column over the OCR text) as pii_0001 and on behind existing ones, redactions of
    all of them, and the sanitized OCR text.  Rows without OCR text, and rows without any span, stay as they are.

    Of detected spans with one place the best counts.  Where there were spans before, overlapping ones are skipped from the left;
    otherwise of overlapping ones the better is shown.
    """
    text = F.coalesce("content.ocr_text", F.lit(""))
    own, none = spans.dedupe_exact(F.col(found)), F.lit(None).cast("string")
    numbered = F.transform(own, lambda s, i: F.struct(
        F.concat(F.lit("pii_"), F.lpad((i + 1).cast("string"), 4, "0")).alias("span_id"), s["entity_type"].alias("entity_type"), s["start"].alias("start"), s["end"].alias("end"), slice_text(text, s["start"], s["end"]).alias("text"),
        F.round(s["score"], 4).alias("score"), F.array().cast("array<string>").alias("box_ids"), F.lit("presidio").alias("detector"), none.alias("source_box_id"), none.alias("source_key"), none.alias("source_text"),
    )).cast(_PII)
    live = F.coalesce(F.col("modality.has_ocr"), F.lit(False)) & (F.trim(text) != "") & ((F.size(found) > 0) | (F.size("detections.pii_spans") > 0))
    done = rows.withColumn("_live", live).withColumn("_new", numbered).withColumn("_all", F.concat("detections.pii_spans", "_new"))
    made = geometry.redactions(F.col("_all"), F.col("geometry.ocr_boxes"), F.col("geometry.source_pii_boxes"), padding, width, height)
    listed = F.transform(made, lambda r: F.struct(
        r["redaction_id"].alias("redaction_id"), F.lit("pii").alias("reason"), F.when(r["source"].isNotNull(), F.array(r["source"])).otherwise(F.array().cast("array<string>")).alias("source_span_ids"),
        r["box_ids"].alias("box_ids"), r["box"].alias("merged_box"), F.lit(method).alias("method"),
    ))
    boxed = F.transform("_all", lambda s: s.withField("box_ids", F.coalesce(F.transform(geometry.span_to_box(s, F.col("geometry.ocr_boxes"), padding)["segments"], lambda i: F.get(F.col("geometry.ocr_boxes"), i)["box_id"]), s["box_ids"])))
    typed = F.transform("_new", lambda s: F.struct(s["entity_type"].alias("entity_type"), s["start"].alias("start"), s["end"].alias("end"), s["score"].alias("score")))
    merged = spans.anonymize(text, spans.merge_overlaps(typed, "struct<entity_type:string,start:int,end:int,score:double>"))
    shown = F.when(F.size("detections.pii_spans") > 0, spans.anonymize(text, F.col("_all"), guarded=True)).otherwise(merged)
    done = done.withColumn("_shown", shown).withColumn("_red", listed).withColumn("_boxed", boxed)
    filled = F.col("detections").withField("pii_spans", F.col("_boxed").cast(_PII)).withField("redaction_metadata", F.col("_red"))
    done = done.withColumn("detections", F.when(F.col("_live"), filled).otherwise(F.col("detections")).cast(CANONICAL["detections"]))
    done = done.withColumn("content", F.when(F.col("_live"), F.col("content").withField("sanitized_ocr_text", F.col("_shown"))).otherwise(F.col("content")))
    return done.drop("_live", "_new", "_all", "_shown", "_red", "_boxed", found)


def screen_uploads(uploads: DataFrame, make_engine: Callable, detect: Callable[[DataFrame, str], DataFrame], pipeline: str) -> DataFrame:
    """The whole way of uploaded images (upload_id, image_path, input_text): read, detect, redact; canonical rows demo_<id>.

    detect adds `spans` over a text column.
    """
    from .canonical import labels_struct, new_rows, sources_struct

    rows = new_rows(
        uploads, F.concat(F.lit("demo_"), F.col("upload_id").cast("string")), f"webdemo_upload/{pipeline}", F.lit(None).cast("string"), F.col("upload_id"), "unknown", has_image=True, labels=labels_struct({}),
        label_source=sources_struct({}), content={"original_image_path": F.col("image_path"), "input_text": F.col("input_text")},
    )
    read = ocr_rows(read_text(rows, make_engine), align=False)
    found = detect(read.withColumn("_text", F.coalesce("content.ocr_text", F.lit(""))), "_text").drop("_text")
    return redact_rows(found)


def image_size(data: bytes | None) -> tuple[int, int] | None:
    """Width and height from the header of a PNG, GIF or JPEG file; None for anything else."""
    if not data:
        return None
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
        return int.from_bytes(data[16:20], "big"), int.from_bytes(data[20:24], "big")
    if data[:6] in (b"GIF87a", b"GIF89a") and len(data) >= 10:
        return int.from_bytes(data[6:8], "little"), int.from_bytes(data[8:10], "little")
    if data[:2] != b"\xff\xd8":
        return None
    at = 2
    while at + 9 <= len(data):
        if data[at] != 0xFF:
            return None
        marker = data[at + 1]
        if marker == 0xFF:  # filling
            at += 1
        elif 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            return int.from_bytes(data[at + 7 : at + 9], "big"), int.from_bytes(data[at + 5 : at + 7], "big")
        else:
            at += 2 if marker in (0x01, *range(0xD0, 0xD8)) else 2 + int.from_bytes(data[at + 2 : at + 4], "big")
    return None


def with_image_size(rows: DataFrame, content: str = "image_bytes") -> DataFrame:
    """Adds width and height (null where the header doesn't tell)."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            sizes = [image_size(x) for x in b.column(b.schema.get_field_index(content)).to_pylist()]
            b = b.append_column("width", pa.array([s and s[0] for s in sizes], pa.int32()))
            yield b.append_column("height", pa.array([s and s[1] for s in sizes], pa.int32()))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{fields}, width int, height int")


def data_url(path: Column, content: Column) -> Column:
    """data:image/<kind>;base64,... of an image file; jpg counts as jpeg, a path without a suffix as png."""
    suffix = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    kind = F.when(suffix.isin("jpg", "jpeg"), "jpeg").when(suffix == "", "png").otherwise(suffix)
    return F.concat(F.lit("data:image/"), kind, F.lit(";base64,"), F.regexp_replace(F.base64(content), r"\s", ""))

"""Summaries of sources, stages and runs, composed of the counts and percentiles of `profile`.

Each gives long rows (name, key, n) or a wide row; nothing is collected.  Rows of one summary come from one or few grouped passes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import profile


def _facts(rows: DataFrame, /, **aggregates: Column) -> DataFrame:
    """One pass of aggregates as rows (name, key, value)."""
    one = rows.agg(*[a.cast("double").alias(k) for k, a in aggregates.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("name"), F.lit(None).cast("string").alias("key"), F.col(k).alias("value")) for k in aggregates])).alias("f")).select("f.*")


def _counted(rows: DataFrame, name: str, key: Column) -> DataFrame:
    return rows.groupBy(key.cast("string").alias("key")).agg(F.count("*").cast("double").alias("value")).select(F.lit(name).alias("name"), "key", "value")


def _numbers(rows: DataFrame, name: str, column: str) -> DataFrame:
    wide = profile.number_summary(rows, column)
    parts = [F.struct(F.lit(name).alias("name"), F.lit(k).alias("key"), F.col(f"`{k}`").cast("double").alias("value")) for k in wide.columns]
    return wide.select(F.explode(F.array(*parts)).alias("f")).select("f.*")


def _buckets(rows: DataFrame, name: str, column: str) -> DataFrame:
    wide = profile.length_buckets(rows, column)
    parts = [F.struct(F.lit(name).alias("name"), F.lit(k).alias("key"), F.col(f"`{k}`").cast("double").alias("value")) for k in ("min", "p50", "p90", "max")]
    return wide.select(F.explode(F.array(*parts)).alias("f")).select("f.*")


def _stacked(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionAll, parts)


def _blank(column: str) -> Column:
    return F.trim(F.coalesce(F.col(column).cast("string"), F.lit(""))) == ""


def dataset_stats(rows: DataFrame, mapping: DataFrame) -> DataFrame:
    """Rows (name, key, value) for evaluation rows (source_text, split, privacy_mask) under a map (label, entity_type).

    Spans total, mapped, unmapped and the mapped share (4 places); rows without a mapped span; number summaries of spans and mapped
    spans a row and of text lengths; counts by type, by native label, and of unmapped labels; mapped labels with 0 where absent.
    """
    known = mapping.agg(F.map_from_entries(F.collect_list(F.struct("label", "entity_type"))).alias("_map"))  # a taxonomy: a few hundred rows
    own = rows.crossJoin(F.broadcast(known)).select(
        "split", F.length("source_text").alias("chars"), F.transform("privacy_mask", lambda m: F.struct(m["label"].alias("label"), F.col("_map")[m["label"]].alias("entity_type"))).alias("spans")
    )
    own = own.withColumn("n", F.size("spans")).withColumn("mapped", F.size(F.filter("spans", lambda s: s["entity_type"].isNotNull())))
    spans = own.select(F.explode("spans").alias("s")).select("s.*")
    total, mapped = F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("mapped"), F.lit(0))
    labels = spans.groupBy("label").agg(F.count("*").cast("double").alias("value"))
    breakdown = mapping.join(labels, "label", "left").select(F.lit("label_breakdown").alias("name"), F.concat_ws("/", "label", "entity_type").alias("key"), F.coalesce("value", F.lit(0.0)).alias("value"))
    return _stacked([
        _facts(own, rows=F.count("*"), spans_total=total, spans_mapped=mapped, spans_unmapped=total - mapped, mapped_share=F.when(total > 0, F.round(mapped / total, 4)).otherwise(0.0), rows_without_mapped_span=F.count(F.when(F.col("mapped") == 0, 1))),
        _facts(spans, distinct_native_labels=F.countDistinct("label")),
        _numbers(own, "spans_per_row", "n"), _numbers(own, "mapped_spans_per_row", "mapped"), _numbers(own, "text_length_chars", "chars"),
        _counted(own, "split", F.col("split")), _counted(spans.where("entity_type is not null"), "type", F.col("entity_type")),
        _counted(spans, "native_label", F.col("label")), _counted(spans.where("entity_type is null"), "unmapped_label", F.col("label")), breakdown,
    ])


def sanity(rows: DataFrame, mapping: DataFrame) -> DataFrame:
    """Rows (check, n): rows, entities, invalid spans (0 <= start < end <= length fails or is null), unmapped labels, empty texts."""
    own = rows.select(F.length(F.coalesce("source_text", F.lit(""))).alias("size"), F.explode_outer("privacy_mask").alias("m"))
    known = mapping.select("label", F.lit(True).alias("known"))
    spans = own.where("m is not null").select("size", "m.start", "m.end", "m.label").join(known, "label", "left")
    bad = ~F.coalesce((F.col("start") >= 0) & (F.col("start") < F.col("end")) & (F.col("end") <= F.col("size")), F.lit(False))
    by_span = spans.agg(F.count("*").alias("entities"), F.count(F.when(bad, 1)).alias("invalid_spans"), F.count(F.when(F.col("known").isNull(), 1)).alias("unmapped_labels"))
    by_row = rows.agg(F.count("*").alias("rows"), F.count(F.when(F.coalesce(F.length("source_text"), F.lit(0)) == 0, 1)).alias("empty_text_rows"))
    names = ("rows", "entities", "invalid_spans", "unmapped_labels", "empty_text_rows")
    return by_row.crossJoin(by_span).select(F.explode(F.array(*[F.struct(F.lit(k).alias("check"), F.col(k).alias("n")) for k in names])).alias("c")).select("c.*")


def image_source(rows: DataFrame, labels: tuple[str, str] = ("category", "safety_label"), text: str = "text", size: tuple[str, str] | None = ("width", "height")) -> DataFrame:
    """Rows (name, key, value) of an image corpus: counts by label, jointly (a::b), missing values by column, text lengths, image sizes."""
    a, b = labels
    columns = [c for c in (b, a, "source", text) if c in rows.columns]
    missing = _facts(rows, **{f"missing_{c}": F.count(F.when(_blank(c), 1)) for c in columns})
    lengths = rows.where(F.col(text).isNotNull()).select(F.length(text).alias("n"))
    parts = [
        _facts(rows, rows=F.count("*"), empty_text=F.count(F.when(F.coalesce(F.length(text), F.lit(0)) == 0, 1))), missing,
        _counted(rows, a, F.col(a)), _counted(rows, b, F.col(b)), _counted(rows, "joint", F.concat_ws("::", F.coalesce(a, F.lit("None")), F.coalesce(b, F.lit("None")))),
        _buckets(lengths, "text_length", "n"),
    ]
    if "source" in rows.columns:
        parts.append(_counted(rows, "source", F.col("source")))
    if size:
        known = rows.where(F.col(size[0]).isNotNull() & F.col(size[1]).isNotNull())
        parts += [_facts(known, sized_rows=F.count("*")), _buckets(known, "width", size[0]), _buckets(known, "height", size[1])]
    return _stacked(parts)


def instruction_source(rows: DataFrame) -> DataFrame:
    """Rows (split, name, key, value) of image instructions (split, safe, harmful_category, harmful_subcategory, pairs)."""
    safe = F.coalesce("safe", F.lit(False))
    unsafe = rows.where(~safe)
    by = lambda frame, name, key: frame.groupBy("split", key.cast("string").alias("key")).agg(F.count("*").alias("value")).select("split", F.lit(name).alias("name"), "key", "value")
    return _stacked([
        by(rows, "safe", F.when(safe, "safe").otherwise("unsafe")), by(unsafe, "harmful_category", F.col("harmful_category")),
        by(unsafe, "harmful_subcategory", F.concat_ws("/", F.coalesce("harmful_category", F.lit("None")), F.coalesce("harmful_subcategory", F.lit("None")))),
        by(rows, "pairs", F.size(F.coalesce("pairs", F.array()))),
    ])


def question_source(rows: DataFrame, category: str = "category", question: str = "question") -> DataFrame:
    """Rows, and least, largest and mean length (1 place) of questions by category."""
    size = F.length(question)
    return rows.groupBy(category).agg(F.count("*").alias("rows"), F.min(size).alias("chars_min"), F.max(size).alias("chars_max"), F.round(F.avg(size), 1).alias("chars_mean"))


def prompt_source(rows: DataFrame, text: str, keys: tuple[str, ...], lists: tuple[str, ...] = ()) -> DataFrame:
    """Rows (name, key, value) of a prompt corpus: counts by the keys and by the elements of list columns, blank and mostly non-Latin
    texts (which a converter would drop), texts with a non-ASCII character, and text lengths."""
    from ..functions.text import is_mostly_latin

    value = F.coalesce(F.col(text), F.lit(""))
    parts = [
        _facts(rows, rows=F.count("*"), empty_text=F.count(F.when(F.trim(value) == "", 1)), would_drop=F.count(F.when(~is_mostly_latin(value), 1)), non_ascii=F.count(F.when(value.rlike("[^\\x00-\\x7F]"), 1))),
        _buckets(rows.select(F.length(value).alias("n")), "text_length", "n"), *[_counted(rows, k, F.col(k)) for k in keys],
        *[_counted(rows.select(F.explode(k).alias("x")), k, F.col("x")) for k in lists],
    ]
    return _stacked(parts)


def bucket_counts(rows: DataFrame, bucket: str, label: str) -> DataFrame:
    """Rows and positives by bucket of an evaluation set."""
    return rows.groupBy(bucket).agg(F.count("*").alias("n"), F.count(F.when(F.col(label), 1)).alias("positive"))


def review_stats(rows: DataFrame, status: str = "review.status", routed: str = "routed") -> DataFrame:
    """One row: total, reviewed by a person, remaining, routed by the API."""
    done = F.count(F.when(F.col(status) == "human_reviewed", 1))
    return rows.agg(F.count("*").alias("total"), done.alias("reviewed"), (F.count("*") - done).alias("remaining"), F.count(F.when(F.col(routed), 1)).alias("routed"))


def router_counts(records: DataFrame) -> DataFrame:
    """One row of a run's records (labels.action, valid, queue_reason): routed, safe, reject, unsure, invalid, queued."""
    said = lambda a: F.count(F.when(F.col("labels.action") == a, 1)).alias(a)
    return records.agg(F.count("*").alias("routed"), *map(said, ("safe", "reject", "unsure")), F.count(F.when(~F.col("valid"), 1)).alias("invalid"), F.count("queue_reason").alias("queued"))


def prefixed(metrics: DataFrame, prefix: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Metric columns renamed prefix_name."""
    return metrics.select(*keep, *[F.col(f"`{c}`").alias(f"{prefix}_{c}") for c in metrics.columns if c not in keep])


def compared(runs: dict[str, DataFrame]) -> DataFrame:
    """One row for each named run's overall metrics."""
    return _stacked([m.select(F.lit(name).alias("pipeline"), *[f"`{c}`" for c in m.columns]) for name, m in runs.items()])


def metrics_document(overall: DataFrame, per_entity: DataFrame, per_label: DataFrame | None, **facts: str | int | None) -> DataFrame:
    """One row: a run's facts with overall metrics and arrays of the metrics by entity type and label (a taxonomy's size)."""
    arrays = {"per_entity": per_entity} | ({"per_label": per_label} if per_label is not None else {})
    doc = overall.select(F.struct("*").alias("overall"))
    for name, frame in arrays.items():
        doc = doc.crossJoin(frame.agg(F.array_sort(F.collect_list(F.struct(*frame.columns))).alias(name)))
    return doc.select(*[F.lit(v).alias(k) for k, v in facts.items()], "overall", *arrays)

"""Queries of languages, summaries, samples, sources and sinks over the driver's tables, with computed oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import language
from ..functions import text as T
from ..operators import canonical, evaluation, images, metrics, pipelines, profile, review, spans, summaries
from ..sources import readers, writers
from ..sources.places import scratch
from .tables import _HASH, EMAIL, EMAILS, documents, read

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


# ------------------------------------------------------------ languages

_LISTS = {k: "(" + ", ".join(f"'{w}'" for w in v) + ")" for k, v in language.COMMON.items()}
_SCORE = {k: f"len(list_filter(w, lambda x: x IN {_LISTS[k]}" + (f" OR regexp_matches(x, '[{language.VIETNAMESE}]')" if k == "vi" else "") + "))" for k in _LISTS}
_DETECTED = (
    "SELECT doc_id, CASE WHEN list_max(s) > 0 THEN (" + str(list(language.COMMON)) + ")[list_position(s, list_max(s))] END AS language FROM (SELECT doc_id, ["
    + ", ".join(_SCORE.values()) + "] AS s FROM (SELECT doc_id, regexp_extract_all(lower(text), '\\p{L}+') AS w FROM documents))"
)


@query(_DETECTED)
def lang_detected(spark, sf):
    return language.with_language(documents(spark, sf)).select("doc_id", "language")


@query(f"SELECT count(*) FILTER (WHERE coalesce(language IN ('en', 'vi'), FALSE)) AS kept, count(*) FILTER (WHERE NOT coalesce(language IN ('en', 'vi'), FALSE)) AS dropped FROM ({_DETECTED})")
def lang_allowed_counts(spark, sf):
    rows = language.with_language(documents(spark, sf))
    return language.filtered(rows, language.is_allowed(F.col("language")))[1]


@query(f"SELECT doc_id FROM ({_DETECTED}) WHERE language IN ('en', 'vi') OR language IS NULL")
def lang_allowed_rows(spark, sf):
    rows = language.with_language(documents(spark, sf))
    return language.filtered(rows, language.is_allowed(F.col("language"), keep_undetectable=True))[0].select("doc_id")


@query("SELECT doc_id, CASE WHEN trim(text) <> '' THEN 'x' || (length(text) % 3) END AS language FROM documents")
def lang_injected(spark, sf):
    """An injected detector."""
    return language.with_language(documents(spark, sf), detector=lambda t: f"x{len(t) % 3}").select("doc_id", "language")


@query(f"SELECT format('safety_v0_deepset_prompt_injections_{{:06d}}', doc_id) AS input_id, CASE WHEN toxic = 1 THEN 'reject' ELSE 'safe' END AS action FROM ({_DETECTED}) d JOIN labels USING (doc_id) WHERE language IN ('en', 'vi')")
def convert_allowed_prompts(spark, sf):
    """Prompts of allowed languages only."""
    rows = language.with_language(documents(spark, sf)).join(read(spark, sf, "labels"), "doc_id")
    rows = rows.select("text", F.col("toxic").alias("label"), F.lit("train").alias("split"), F.col("doc_id").alias("index"), "language")
    return canonical.convert_allowed_prompts(rows, "deepset_prompt_injections", "apache_2.0").select("input_id", "labels.action")


# ------------------------------------------------------------ summaries

_LABEL = "CASE WHEN toxic = 1 THEN 'HO_VA_TEN' WHEN quality = 1 THEN 'DIA_CHI_EMAIL' ELSE 'TY_GIA' END"
_MAP = "(VALUES ('HO_VA_TEN', 'PERSON'), ('DIA_CHI_EMAIL', 'EMAIL_ADDRESS'), ('DUONG_DAN_URL', 'URL')) AS m(label, entity_type)"
_EVAL = f"SELECT d.doc_id, text, lang, CASE WHEN l.doc_id IS NULL THEN 0 ELSE 1 + d.doc_id % 3 END AS n, CASE WHEN l.doc_id IS NOT NULL THEN {_LABEL} END AS label FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id"
_EVAL_SPANS = f"SELECT doc_id, length(text) AS size, label, i * 900 AS a, i * 900 + 5 AS b FROM (SELECT *, unnest(range(0, n)) AS i FROM ({_EVAL}))"


def _eval_rows(spark, sf):
    """Evaluation rows: a labelled document has one to three spans of its label, every 900 characters (past the end of short texts)."""
    label = F.when(F.col("toxic") == 1, "HO_VA_TEN").when(F.col("quality") == 1, "DIA_CHI_EMAIL").otherwise("TY_GIA")
    spans_of = F.transform(F.sequence(F.lit(0), (F.col("doc_id") % 3).cast("int")), lambda i: F.struct((i * 900).alias("start"), (i * 900 + 5).alias("end"), F.col("label").alias("label"), F.lit("v").alias("value")))
    rows = documents(spark, sf).join(read(spark, sf, "labels").withColumn("label", label), "doc_id", "left")
    mask = F.when(F.col("label").isNotNull(), spans_of).otherwise(F.array().cast(readers.MASK))
    return rows.select(F.col("doc_id").cast("string").alias("input_id"), F.col("text").alias("source_text"), F.col("lang").alias("split"), mask.cast(readers.MASK).alias("privacy_mask"))


def _mapping(spark):
    return spark.createDataFrame([("HO_VA_TEN", "PERSON"), ("DIA_CHI_EMAIL", "EMAIL_ADDRESS"), ("DUONG_DAN_URL", "URL")], "label string, entity_type string")


def _summary_sql(name: str, column: str, table: str) -> str:
    return f"""SELECT '{name}' AS name, key, value FROM (UNPIVOT (SELECT n::DOUBLE AS count, x[1]::DOUBLE AS min, (x[(n - 1) // 2 + 1] + x[n // 2 + 1]) / 2.0::DOUBLE AS median, round(list_sum(x) / n, 2)::DOUBLE AS mean,
        x[n]::DOUBLE AS max, x[CAST(round_even(0.9 * (n - 1), 0) AS BIGINT) + 1]::DOUBLE AS p90, x[CAST(round_even(0.99 * (n - 1), 0) AS BIGINT) + 1]::DOUBLE AS p99, list_sum(x)::DOUBLE AS total
        FROM (SELECT list_sort(list({column})) AS x, count(*) AS n FROM {table})) ON COLUMNS(*) INTO NAME key VALUE value)"""


def _buckets_sql(name: str, column: str, table: str) -> str:
    return f"""SELECT '{name}' AS name, key, value FROM (UNPIVOT (SELECT x[1]::DOUBLE AS min, x[n // 2 + 1]::DOUBLE AS p50, x[n * 9 // 10 + 1]::DOUBLE AS p90, x[n]::DOUBLE AS max
        FROM (SELECT list_sort(list({column})) AS x, count(*) AS n FROM {table})) ON COLUMNS(*) INTO NAME key VALUE value)"""


def _counts_sql(name: str, key: str, table: str) -> str:
    return f"SELECT '{name}' AS name, {key} AS key, count(*)::DOUBLE AS value FROM {table} GROUP BY 2"


def _fact_sql(name: str, value: str, table: str) -> str:
    return f"SELECT '{name}' AS name, NULL AS key, CAST({value} AS DOUBLE) AS value FROM {table}"


_MAPPED = "CASE WHEN label IN ('HO_VA_TEN', 'DIA_CHI_EMAIL') THEN n ELSE 0 END"


@query(
    f"WITH e AS ({_EVAL}), s AS ({_EVAL_SPANS}) "
    + " UNION ALL ".join([
        _fact_sql("rows", "count(*)", "e"), _fact_sql("spans_total", "sum(n)", "e"), _fact_sql("spans_mapped", f"sum({_MAPPED})", "e"), _fact_sql("spans_unmapped", f"sum(n - ({_MAPPED}))", "e"),
        _fact_sql("mapped_share", f"round(sum({_MAPPED}) / sum(n), 4)", "e"), _fact_sql("rows_without_mapped_span", f"count(*) FILTER (WHERE {_MAPPED} = 0)", "e"), _fact_sql("distinct_native_labels", "count(DISTINCT label)", "s"),
        _summary_sql("spans_per_row", "n", "e"), _summary_sql("mapped_spans_per_row", _MAPPED, "e"), _summary_sql("text_length_chars", "length(text)", "e"), _counts_sql("split", "lang", "e"),
        _counts_sql("type", "CASE label WHEN 'HO_VA_TEN' THEN 'PERSON' ELSE 'EMAIL_ADDRESS' END", "s WHERE label <> 'TY_GIA'"), _counts_sql("native_label", "label", "s"), _counts_sql("unmapped_label", "label", "s WHERE label = 'TY_GIA'"),
        f"SELECT 'label_breakdown' AS name, m.label || '/' || entity_type AS key, count(s.label)::DOUBLE AS value FROM {_MAP} LEFT JOIN s ON s.label = m.label GROUP BY 2",
    ])
)
def dataset_stats(spark, sf):
    return summaries.dataset_stats(_eval_rows(spark, sf), _mapping(spark))


@query(
    f"""WITH e AS ({_EVAL}), s AS ({_EVAL_SPANS}) SELECT 'rows' AS "check", count(*) AS n FROM e UNION ALL SELECT 'entities', count(*) FROM s UNION ALL SELECT 'invalid_spans', count(*) FILTER (WHERE b > size) FROM s
        UNION ALL SELECT 'unmapped_labels', count(*) FILTER (WHERE label = 'TY_GIA') FROM s UNION ALL SELECT 'empty_text_rows', count(*) FILTER (WHERE coalesce(length(text), 0) = 0) FROM e"""
)
def sanity_summary(spark, sf):
    return summaries.sanity(_eval_rows(spark, sf), _mapping(spark))


_IMAGES = "(SELECT CASE WHEN doc_id % 5 > 0 THEN source END AS category, lang AS safety_label, CASE WHEN doc_id % 7 = 0 THEN '' ELSE source END AS source, text, doc_id % 640 AS width, CASE WHEN doc_id % 9 > 0 THEN doc_id % 480 END AS height FROM documents)"


@query(
    " UNION ALL ".join([
        _fact_sql("rows", "count(*)", _IMAGES), _fact_sql("empty_text", "count(*) FILTER (WHERE text IS NULL OR text = '')", _IMAGES), _fact_sql("missing_safety_label", "count(*) FILTER (WHERE safety_label IS NULL)", _IMAGES),
        _fact_sql("missing_category", "count(*) FILTER (WHERE category IS NULL)", _IMAGES), _fact_sql("missing_source", "count(*) FILTER (WHERE source = '')", _IMAGES), _fact_sql("missing_text", "count(*) FILTER (WHERE trim(coalesce(text, '')) = '')", _IMAGES),
        _counts_sql("category", "category", _IMAGES), _counts_sql("safety_label", "safety_label", _IMAGES), _counts_sql("joint", "coalesce(category, 'None') || '::' || coalesce(safety_label, 'None')", _IMAGES),
        _buckets_sql("text_length", "length(text)", f"{_IMAGES} WHERE text IS NOT NULL"), _counts_sql("source", "source", _IMAGES), _fact_sql("sized_rows", "count(*)", f"{_IMAGES} WHERE height IS NOT NULL"),
        _buckets_sql("width", "width", f"{_IMAGES} WHERE height IS NOT NULL"), _buckets_sql("height", "height", f"{_IMAGES} WHERE height IS NOT NULL"),
    ])
)
def image_source_summary(spark, sf):
    d = F.col("doc_id")
    rows = documents(spark, sf).select(
        F.when(d % 5 > 0, F.col("source")).alias("category"), F.col("lang").alias("safety_label"), F.when(d % 7 == 0, "").otherwise(F.col("source")).alias("source"), "text", (d % 640).alias("width"), F.when(d % 9 > 0, d % 480).alias("height")
    )
    return summaries.image_source(rows)


@query("SELECT source AS category, count(*) AS rows, min(length(text)) AS chars_min, max(length(text)) AS chars_max, round(avg(length(text)), 1) AS chars_mean FROM documents GROUP BY 1")
def question_summary(spark, sf):
    out = summaries.question_source(documents(spark, sf).select(F.col("source").alias("category"), F.col("text").alias("question")))
    return out.select("category", "rows", F.col("chars_min").cast("long").alias("chars_min"), F.col("chars_max").cast("long").alias("chars_max"), "chars_mean")


_CONV = "(SELECT role, text, string_split(role || ',all', ',') AS tags FROM conversations)"


@query(
    " UNION ALL ".join([
        _fact_sql("rows", "count(*)", "conversations"), _fact_sql("empty_text", "count(*) FILTER (WHERE trim(text) = '')", "conversations"), _fact_sql("would_drop", "0", "(SELECT 1)"),
        _fact_sql("non_ascii", "count(*) FILTER (WHERE regexp_matches(text, '[^\\x00-\\x7F]'))", "conversations"), _buckets_sql("text_length", "length(text)", "conversations"), _counts_sql("role", "role", "conversations"),
        _counts_sql("tags", "t", "(SELECT unnest(string_split(role || ',all', ',')) AS t FROM conversations)"),
    ])
)
def prompt_summary(spark, sf):
    rows = read(spark, sf, "conversations").select("role", "text", F.array("role", F.lit("all")).alias("tags"))
    return summaries.prompt_source(rows, "text", ("role",), ("tags",))


@query("SELECT CAST(quality AS VARCHAR) AS bucket, count(*) AS n, count(*) FILTER (WHERE toxic = 1) AS positive FROM labels GROUP BY 1")
def eval_bucket_counts(spark, sf):
    rows = read(spark, sf, "labels").select(F.col("quality").cast("string").alias("bucket"), (F.col("toxic") == 1).alias("label"))
    return summaries.bucket_counts(rows, "bucket", "label")


@query("SELECT count(*) AS total, count(*) FILTER (WHERE quality = 1) AS reviewed, count(*) FILTER (WHERE quality IS DISTINCT FROM 1) AS remaining, count(*) FILTER (WHERE toxic = 1) AS routed FROM labels")
def review_stats(spark, sf):
    rows = read(spark, sf, "labels").select(F.struct(F.when(F.col("quality") == 1, "human_reviewed").otherwise("unreviewed").alias("status")).alias("review"), (F.col("toxic") == 1).alias("routed"))
    return summaries.review_stats(rows)


def _routed(spark, sf):
    """Answers of a router: every fifth is cut off, the others say reject for toxic rows and safe for the rest."""
    flags = ", ".join(f'"{r}": false' for r in canonical.RISKS)
    answer = F.when(F.col("doc_id") % 5 == 0, '{"action": ').otherwise(F.concat(F.lit('```json\n{"action": "'), F.when(F.col("toxic") == 1, "reject").otherwise("safe"), F.lit(f'", {flags}}}\n```')))
    return read(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("input_id"), answer.alias("router_answer"))


@query("SELECT count(*) AS routed, count(*) FILTER (WHERE doc_id % 5 > 0 AND toxic = 0) AS safe, count(*) FILTER (WHERE doc_id % 5 > 0 AND toxic = 1) AS reject, count(*) FILTER (WHERE doc_id % 5 = 0) AS unsure, count(*) FILTER (WHERE doc_id % 5 = 0) AS invalid, count(*) FILTER (WHERE doc_id % 5 = 0) AS queued FROM labels")
def router_counts(spark, sf):
    return summaries.router_counts(review.router_records(_routed(spark, sf)))


@query("SELECT CAST(doc_id AS VARCHAR) AS input_id, CASE WHEN doc_id % 5 = 0 THEN 'unsure' WHEN toxic = 1 THEN 'reject' ELSE 'safe' END AS action, doc_id % 5 > 0 AS valid, CASE WHEN doc_id % 5 = 0 THEN 'router_unsure' END AS queue_reason FROM labels")
def router_records(spark, sf):
    return review.router_records(_routed(spark, sf)).select("input_id", "labels.action", "valid", "queue_reason")


@query("SELECT CAST(doc_id AS VARCHAR) AS input_id, 'answer ' || length(text) AS router_answer FROM documents")
def router_calls(spark, sf):
    """An injected router that fails for texts whose length is odd with an error that may pass, and answers by its fallback."""
    rows = documents(spark, sf).select(F.col("doc_id").cast("string").alias("input_id"), F.col("text").alias("payload"))

    def call(text):
        if len(text) % 2:
            raise RuntimeError("503 unavailable")
        return f"answer {len(text)}"

    return review.route(rows, call, retries=2, sleep=lambda s: None, fallback=lambda text: f"answer {len(text)}").select("input_id", "router_answer")


_RUN = "(SELECT '{0}' AS pipeline, tp AS tp, fp, fn, tn FROM (SELECT count(*) FILTER (WHERE toxic = 1 AND {1}) AS tp, count(*) FILTER (WHERE toxic = 0 AND {1}) AS fp, count(*) FILTER (WHERE toxic = 1 AND NOT {1}) AS fn, count(*) FILTER (WHERE toxic = 0 AND NOT {1}) AS tn FROM labels))"


@query(" UNION ALL ".join("SELECT pipeline, tp AS run_tp, fp AS run_fp, fn AS run_fn, tn AS run_tn FROM " + _RUN.format(n, c) for n, c in (("low_quality", "quality = 0"), ("every_third", "doc_id % 3 = 0"))))
def pipeline_comparison(spark, sf):
    rows, hit = read(spark, sf, "labels"), F.col("toxic") == 1
    runs = {"low_quality": metrics.confusion(rows, hit, F.col("quality") == 0), "every_third": metrics.confusion(rows, hit, F.col("doc_id") % 3 == 0)}
    both = summaries.compared(runs).select("pipeline", "tp", "fp", "fn", "tn")
    return summaries.prefixed(both, "run", ("pipeline",))


# ------------------------------------------------------------ samples


@query(f"SELECT tier, CAST(doc_id AS BIGINT) AS doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY {_HASH}, doc_id) AS r FROM documents), (VALUES ('tiny', 7), ('small', 60)) AS t(tier, size) WHERE r <= size")
def sample_tiers(spark, sf):
    return profile.tiered_samples(documents(spark, sf), "doc_id", profile.parse_tiers(["tiny:7", "small: 60"]))


@query("SELECT name, size FROM (VALUES ('train_dev_5k', 5000), ('llm_smoke_50', 50), ('llm_iter_300', 300), ('llm_ab_500', 500), ('llm_final_1000', 1000)) AS t(name, size)")
def sample_tier_sizes(spark, sf):
    return spark.createDataFrame(list(profile.parse_tiers([]).items()), "name string, size int")


@query("SELECT kind, count(*) AS n FROM (SELECT 'documents' AS kind FROM documents UNION ALL SELECT role FROM conversations) GROUP BY 1")
def source_pool(spark, sf):
    sources = {
        "docs": documents(spark, sf).select("text", F.lit("documents").alias("kind")), "chats": read(spark, sf, "conversations").select("text", F.col("role").alias("kind"), "turn"),
        "unused": read(spark, sf, "benchmark").select("text", F.lit("benchmark").alias("kind")),
    }
    return evaluation.pool(sources, "docs, chats").groupBy("kind").agg(F.count("*").alias("n"))


_MIX = f"SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY {_HASH}, doc_id) AS r FROM documents"
_AT = "('0x' || substr(md5('42:' || source), 1, 8))::BIGINT / 4294967296.0"


@query(f"SELECT doc_id, source, CASE WHEN {_AT} < 0.8 THEN 'train' WHEN {_AT} < 0.9 THEN 'val' ELSE 'test' END AS part FROM ({_MIX}) WHERE r <= CASE source WHEN (SELECT min(source) FROM documents) THEN 5 WHEN (SELECT max(source) FROM documents) THEN 9 ELSE 0 END")
def target_mix(spark, sf):
    docs = documents(spark, sf).select("doc_id", "source")
    ends = docs.agg(F.min("source"), F.max("source")).first()
    return profile.capped_mix(docs, "source", "doc_id", {ends[0]: 5, ends[1]: 9}, group="source")


_SPLITS = " UNION ALL ".join(f"SELECT 'docs:{x}:' || doc_id AS input_id, '{x}' AS split, md5(text) AS text_md5, 0 AS n FROM documents WHERE lang = '{x}'" for x in ("en", "fr"))


def _frames(spark, sf):
    rows = documents(spark, sf).select(F.col("doc_id").alias("source_index"), F.col("text").alias("source_text"), F.lit("[]").alias("privacy_mask"), "lang")
    return {x: rows.where(F.col("lang") == x) for x in ("en", "fr")}


@query(_SPLITS)
def source_splits(spark, sf):
    """Two splits one behind the other, masks from JSON text, ids of name, split and place."""
    rows = readers.evaluation_rows(_frames(spark, sf), "docs")
    return rows.select("input_id", "split", F.md5(F.col("source_text").cast("binary")).alias("text_md5"), F.size("privacy_mask").alias("n"))


@query(f"SELECT input_id, split FROM (SELECT *, row_number() OVER (PARTITION BY split ORDER BY md5('42:' || input_id), input_id) AS r FROM ({_SPLITS})) WHERE r <= 20")
def source_splits_limited(spark, sf):
    return readers.evaluation_rows(_frames(spark, sf), "docs", limit=20).select("input_id", "split")


@query("SELECT 'docs:train_val:' || doc_id AS input_id FROM (SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || doc_id), CAST(doc_id AS VARCHAR)) AS r, count(*) OVER () AS n FROM documents WHERE lang = 'en') WHERE r <= greatest(1, round_even(n * 0.1, 0))")
def source_derived_split(spark, sf):
    """The validation part that is derived from a train split."""
    return readers.evaluation_rows({"train": _frames(spark, sf)["en"]}, "docs", split="train_val").select("input_id")


@query("SELECT 'chats:test:' || (conv_id * 100 + turn) AS input_id, CASE role WHEN 'user' THEN 1 ELSE 0 END AS label, 'chats' AS source FROM conversations")
def source_prompt_rows(spark, sf):
    rows = read(spark, sf, "conversations").select("text", F.when(F.col("role") == "user", 1).otherwise(0).alias("label"), (F.col("conv_id") * 100 + F.col("turn")).alias("row_index"))
    return readers.prompt_rows(rows, "chats", "test").select("input_id", "label", "source")


@query("SELECT CAST(doc_id AS VARCHAR) AS input_id FROM (SELECT doc_id FROM documents ORDER BY md5('7:' || doc_id), CAST(doc_id AS VARCHAR) LIMIT 30)")
def source_limited(spark, sf):
    rows = documents(spark, sf).select(F.col("doc_id").cast("string").alias("input_id"), "doc_id")
    return readers.limited(rows, 30, "doc_id", seed=7).select("input_id")


_TWINS = "SELECT CAST(doc_id AS VARCHAR) || '_vi' AS input_id, md5(trim(text)) AS text_md5, toxic AS label, CASE WHEN toxic = 1 THEN 'attack' ELSE 'benign' END AS category FROM documents JOIN labels USING (doc_id) WHERE doc_id % 2 = 0 AND length(trim(text)) > 0 AND toxic IS NOT NULL"


def _twins(spark, sf):
    rows = documents(spark, sf).join(read(spark, sf, "labels"), "doc_id")
    mark = F.when(F.col("doc_id") % 2 == 0, F.struct(F.lit("translation").alias("type")))
    return rows.select(
        F.concat(F.col("doc_id").cast("string"), F.lit("_vi")).alias("input_id"), F.struct(F.col("text").alias("input_text")).alias("content"), mark.alias("augmentation"), F.struct((F.col("toxic") == 1).alias("prompt_injection")).alias("labels"),
        F.struct((F.col("toxic") == 1).alias("label"), F.when(F.col("toxic") == 1, "attack").otherwise("benign").alias("bucket")).alias("eval"),
    )


@query(_TWINS)
def source_twin_prompts(spark, sf):
    return readers.twin_prompts(_twins(spark, sf), "deepset_vi").select("input_id", F.md5(F.col("text").cast("binary")).alias("text_md5"), "label", "category")


@query("SELECT CAST(doc_id AS VARCHAR) || '_vi' AS input_id, toxic AS label, CASE WHEN toxic = 1 THEN 'attack' ELSE 'benign' END AS category FROM documents JOIN labels USING (doc_id)")
def source_eval_prompts(spark, sf):
    return readers.eval_prompts(_twins(spark, sf)).select("input_id", "label", "category")


@query("SELECT split || '/' || bucket AS place, image FROM (SELECT lang AS split, source AS bucket, md5(text) AS image, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS seen FROM documents) WHERE seen = 1")
def unique_images(spark, sf):
    """Of rows that show one image the first."""
    rows = documents(spark, sf).select("doc_id", F.concat_ws("/", "lang", "source").alias("place"), F.md5(F.col("text").cast("binary")).alias("image"))
    return profile.unique_first(rows, "image", "doc_id").select("place", "image")


# ------------------------------------------------------------ sources and sinks: written, read back


@query("SELECT 'docs:test:' || doc_id AS input_id, text AS source_text, 1 AS inline_label_count, length(lang) + 1 AS first_end FROM (SELECT doc_id, 'x' || lang || ' text' AS text, lang FROM documents)")
def source_markup(spark, sf):
    """Inline markup written as JSON lines, read back and taken apart."""
    path = scratch(spark, "markup")
    documents(spark, sf).select(F.col("doc_id").alias("source_index"), F.concat(F.lit("x["), "lang", F.lit("]<lang> text")).alias("output")).write.json(path)
    rows = readers.markup_rows(spark.read.schema("source_index long, output string").json(path), "docs", "test")
    return rows.select("input_id", "source_text", "inline_label_count", F.get("privacy_mask", F.lit(0))["end"].cast("long").alias("first_end"))


@query(f"SELECT CAST(doc_id AS VARCHAR) AS input_id, CAST(r - 1 AS INTEGER) AS place FROM (SELECT doc_id, row_number() OVER (ORDER BY {_HASH}, doc_id) AS r FROM documents) WHERE r <= 25")
def sink_manifest(spark, sf):
    """A manifest of 25 ids in hash order, written and read back; a second writer is refused."""
    path = scratch(spark, "manifest")
    ids = profile.sample_ids(documents(spark, sf), "doc_id", 25).select(F.col("doc_id").cast("string").alias("input_id"))
    ids = readers.positions(ids.withColumn("h", profile.hash_order("input_id", 42)).withColumn("all", F.lit(1)), "all", "h").select("place", "input_id")
    writers.write_manifest(ids, path, "docs", "test", 25, 42, "2024-01-01T00:00:00Z")
    try:
        writers.write_manifest(ids, path, "docs", "test", 25, 42, "2024-01-02T00:00:00Z")
    except Exception as refused:  # noqa: BLE001
        if "PATH_ALREADY_EXISTS" not in str(refused):
            raise
    return readers.manifest_ids(spark, path).select("input_id", "place")


def _predicted(spark, sf):
    rows = documents(spark, sf).select(F.col("doc_id").cast("string").alias("input_id"), "text").withColumn("spans", spans.find_spans("text", [EMAIL]))
    return rows.withColumn("anonymized_text", spans.anonymize(F.col("text"), F.col("spans")))


_LOG = "record_version int, run_id string, pipeline_name string, input_id string, language string, score_threshold double, source_text string, results array<struct<entity_type:string,start:int,end:int,text:string,score:double,pattern:string>>, anonymized_text string"


@query(f"""SELECT CAST(d.doc_id AS VARCHAR) AS input_id, 2 AS record_version, TRUE AS no_source, count(x.doc_id) AS n, coalesce(string_agg(x.text, ' ' ORDER BY x."start"), '') AS found FROM documents d LEFT JOIN ({EMAILS}) x ON x.doc_id = d.doc_id GROUP BY d.doc_id""")
def sink_prediction_log(spark, sf):
    """Prediction records of an address bank, appended as JSON lines and read back: without source texts, with detected ones."""
    path = scratch(spark, "predictions")
    writers.append_json(writers.prediction_log(_predicted(spark, sf), "run", "emails"), path)
    log = writers.read_log(spark, path, _LOG)
    return log.select("input_id", "record_version", F.col("source_text").isNull().alias("no_source"), F.size("results").cast("long").alias("n"), F.array_join(F.transform("results", lambda s: s["text"]), " ").alias("found"))


@query(f"""SELECT '## ' || d.doc_id || chr(10) || coalesce(string_agg('- EMAIL_ADDRESS [' || x."start" || ', ' || x."end" || ') ' || x.text || ' 0.95', chr(10) ORDER BY x."start"), '') || chr(10) AS head FROM documents d LEFT JOIN ({EMAILS}) x ON x.doc_id = d.doc_id GROUP BY d.doc_id""")
def sink_audit_markdown(spark, sf):
    log = writers.prediction_log(_predicted(spark, sf).withColumn("anonymized_text", F.lit("")), "run", "emails")
    return writers.audit_markdown(log).select(F.col("value").alias("head"))


@query("SELECT CAST(conv_id * 100 + turn AS VARCHAR) AS input_id, 1 AS record_version, CASE role WHEN 'user' THEN 1 ELSE 0 END AS label, FALSE AS is_injection, 'allow' AS action FROM conversations")
def sink_decision_log(spark, sf):
    """Decision records of the rule detector, written twice (the second writer replaces the first) and read back."""
    path = scratch(spark, "decisions")
    rows = read(spark, sf, "conversations").select(
        (F.col("conv_id") * 100 + F.col("turn")).cast("string").alias("input_id"), "text", F.when(F.col("role") == "user", 1).otherwise(0).alias("label"), F.lit(None).cast("string").alias("expected_action"),
        F.lit("chats").alias("source"), F.lit("en").alias("language"), F.col("role").alias("category"),
    )
    log = writers.decision_log(evaluation.get_detector("rule_based_prompt_injection").detect(rows), "run", "rule_based_prompt_injection")
    for _ in range(2):
        writers.replace_json(log, path)
    back = spark.read.schema("record_version int, input_id string, ground_truth struct<label:int>, prediction struct<is_injection:boolean,action:string>").json(path)
    return back.select("input_id", "record_version", "ground_truth.label", "prediction.is_injection", "prediction.action")


@query("SELECT pipeline, split, rows, tp, fp, fn, array_to_string(types, ',') AS types FROM (VALUES ('emails', 'all', 3, 2, 2, 1, ['ID', 'LOCATION', 'PERSON', 'PHONE_NUMBER'])) AS t(pipeline, split, rows, tp, fp, fn, types)")
def sink_metrics(spark, sf):
    """metrics.json of a run, written and read back."""
    from .fixtures import _evaluation

    own = _evaluation(spark)
    doc = summaries.metrics_document(metrics.overall(own), metrics.per_entity(own), metrics.per_label(own), run_id="r1", pipeline="emails", split="all", rows=3)
    path = writers.write_metrics(doc, scratch(spark, "metrics"), "emails", "r1")
    back = spark.read.schema("pipeline string, split string, rows int, overall struct<tp:int,fp:int,fn:int>, per_entity array<struct<entity_type:string>>").json(path)
    return back.select("pipeline", "split", "rows", "overall.tp", "overall.fp", "overall.fn", F.array_join(F.transform("per_entity", lambda x: x["entity_type"]), ",").alias("types"))


@query("SELECT CAST(doc_id AS VARCHAR) AS input_id, CASE WHEN doc_id % 4 = 0 THEN 1 ELSE 0 END AS errors FROM documents")
def sink_stage(spark, sf):
    """Canonical rows of a stage: valid ones in its file, those with a bad action and their errors beside it."""
    root = scratch(spark, "stage")
    action = F.when(F.col("doc_id") % 4 == 0, "maybe").otherwise("safe")
    rows = canonical.new_rows(
        documents(spark, sf), F.col("doc_id").cast("string"), "webpii", F.lit("train"), F.col("doc_id"), "research", labels=canonical.labels_struct({"action": action}), label_source=canonical.sources_struct({}),
        content={"input_text": F.col("lang")},
    )
    path, rejected = writers.stage_file(root, "converted", "webpii"), f"{writers.source_dir(root, 'inspection', 'webpii')}/rejected.jsonl"
    writers.write_stage(rows, path, rejected)
    bad = spark.read.schema(canonical.DDL + ", errors array<string>").json(rejected).select("input_id", F.size("errors").alias("errors"))
    return readers.canonical_rows(spark, path).select("input_id", F.lit(0).alias("errors")).unionAll(bad)


@query("SELECT event_id AS id, 'view' AS kind, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS at, length(props) AS text_length, TRUE AS hidden FROM events WHERE event_type = 'view' ORDER BY event_id DESC LIMIT 50")
def sink_request_log(spark, sf):
    """Request records appended in two runs, read back newest first, malformed lines skipped; then the log is cleared."""
    path = scratch(spark, "requests")
    e = read(spark, sf, "events").where("event_type = 'view'").select(F.col("event_id").alias("id"), F.col("ts").alias("at"), "user_id", F.col("props").alias("text"), F.lit("allow").alias("action"))
    for half in (0, 1):
        writers.append_json(writers.request_record(e.where(F.col("id") % 2 == half), "view"), path)
    spark.createDataFrame([("{broken",)], "value string").write.mode("append").text(path)
    schema = "id long, kind string, at string, user_id long, text_length int, text string, action string"
    from ..operators.governance import recent

    newest = recent(writers.read_log(spark, path, schema), 50, "id").select("id", "kind", "at", F.col("text_length").cast("long").alias("text_length"), F.col("text").isNull().alias("hidden"))
    cleared = scratch(spark, "cleared")
    writers.append_json(writers.request_record(e.limit(1), "view"), cleared)
    writers.clear_log(spark, cleared, schema)
    return newest.join(writers.read_log(spark, cleared, schema).select("id"), "id", "left_anti")


@query("SELECT 'k' || doc_id AS key, CASE WHEN doc_id % 3 = 0 THEN 'new' ELSE 'old' END AS value FROM documents")
def sink_translation_cache(spark, sf):
    """A cache with new entries over old ones, written and read back."""
    path = scratch(spark, "cache")
    key = F.concat(F.lit("k"), F.col("doc_id").cast("string")).alias("key")
    old, new = documents(spark, sf).select(key, F.lit("old").alias("value")), documents(spark, sf).where("doc_id % 3 = 0").select(key, F.lit("new").alias("value"))
    writers.replace_json(writers.upsert_cache(old, new), path)
    return spark.read.schema("key string, value string").json(path)


@query("SELECT CAST(user_id AS VARCHAR) AS input_id, arg_max(event_type, event_id) AS status FROM events GROUP BY 1")
def sink_overrides(spark, sf):
    """Override records appended one run after another; of each id's records the last counts."""
    path = scratch(spark, "overrides")
    e = read(spark, sf, "events").select(F.col("user_id").cast("string").alias("input_id"), F.col("event_type").alias("status"), F.col("event_id").alias("seq"))
    for half in (0, 1):
        writers.append_json(e.where(F.col("seq") % 2 == half), path)
    return review.latest(spark.read.schema("input_id string, status string, seq long").json(path)).select("input_id", "status")


@query("SELECT CAST(doc_id AS VARCHAR) AS input_id FROM labels WHERE doc_id % 4 = 0 AND coalesce(toxic <> 1, TRUE) AND doc_id % 5 > 0")
def pii_gap_overrides(spark, sf):
    """Rows with spans of personal data whose label doesn't say so, less those that have an override already."""
    d = F.col("doc_id")
    some = F.when(d % 4 == 0, F.array(F.lit(1))).otherwise(F.array().cast("array<int>"))
    rows = read(spark, sf, "labels").select(d.cast("string").alias("input_id"), F.struct(some.alias("pii_spans")).alias("detections"), F.struct((F.col("toxic") == 1).alias("pii_visible")).alias("labels"))
    have = read(spark, sf, "labels").where("doc_id % 5 = 0").select(d.cast("string").alias("input_id"), F.lit("pii_visible").alias("field"), F.lit(True).alias("value"))
    return review.clear_pii_gap(rows, have).select("input_id")


@query("SELECT CAST(doc_id AS VARCHAR) AS input_id, count(*) FILTER (WHERE doc_id % 3 > 0 AND doc_id % 4 > 0) OVER () AS written, count(*) FILTER (WHERE doc_id % 3 = 0) OVER () AS skipped, count(*) FILTER (WHERE doc_id % 3 > 0 AND doc_id % 4 = 0) OVER () AS missing FROM documents QUALIFY doc_id % 3 > 0 AND doc_id % 4 > 0")
def source_image_cells(spark, sf):
    """Image cells still to be written: every third is there already, every fourth has no bytes."""
    cells = documents(spark, sf).select(F.col("doc_id").cast("string").alias("input_id"), F.struct(F.when(F.col("doc_id") % 4 > 0, F.col("lang").cast("binary")).alias("bytes"), F.lit("p").alias("path")).alias("image"))
    have = documents(spark, sf).where("doc_id % 3 = 0").select(F.col("doc_id").cast("string").alias("input_id"))
    left, counts = readers.extraction_counts(readers.cell_images(cells), have)
    return left.select("input_id").crossJoin(counts)


@query("SELECT page_id, 100 + page_id AS width, 50 + page_id AS height FROM pages")
def source_image_sizes(spark, sf):
    """Sizes from the headers of image files that are written, listed and read back."""
    path = scratch(spark, "images")
    size = lambda n: F.unhex(F.lpad(F.hex((F.col("page_id") + n).cast("long")), 8, "0"))
    head = F.concat(F.unhex(F.lit("89504E470D0A1A0A0000000D49484452")), size(100), size(50), F.unhex(F.lit("0806000000")))
    read(spark, sf, "pages").select("page_id", head.alias("image")).write.parquet(path)
    rows = readers.cell_images(spark.read.parquet(path))
    return images.with_image_size(rows).select("page_id", F.col("width").cast("long").alias("width"), F.col("height").cast("long").alias("height"))


# ------------------------------------------------------------ detectors


@query(
    f"""SELECT entity_type, count(*) AS n FROM (SELECT doc_id, 'EMAIL_ADDRESS' AS entity_type FROM ({EMAILS}) UNION ALL SELECT doc_id, 'PERSON' FROM documents WHERE regexp_matches(text, '^[A-Za-z]+ [A-Za-z]+ [a-z]')) GROUP BY 1"""
)
def pipeline_with_extras(spark, sf):
    """A pipeline of one's own recognizers: an address bank and the first two words of a text as a person."""
    first = lambda text: F.transform(T.match_spans(text, r"\A[A-Za-z]+ [A-Za-z]+(?= [a-z])", None), lambda s: F.struct(F.lit("PERSON").alias("entity_type"), s["start"].alias("start"), s["end"].alias("end"), F.lit(0.6).alias("score"), F.lit("first_words").alias("pattern"), s["text"].alias("text"), F.lit(0).alias("ord")))
    rows = pipelines.predict(documents(spark, sf).select("doc_id", "text"), "hybrid_regex", extras=[first])
    return rows.select(F.explode("spans").alias("s")).where("s.pattern in ('email', 'first_words')").groupBy("s.entity_type").agg(F.count("*").alias("n"))


@query()
def screen_regex_recall(spark, sf):
    """Exactly the recall bank over every document, as the published timing of that pipeline runs it."""
    rows = pipelines.predict(documents(spark, sf).select("doc_id", "text"), "regex_recall")
    listed = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["entity_type"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return rows.select("doc_id", F.size("spans").cast("long").alias("n_spans"), listed.alias("spans"))

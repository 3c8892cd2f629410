"""Queries of the engine's operators over the driver's tables, with their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.patterns import BASE_BANK, Pattern
from ..operators import geometry, governance, injection, metrics, profile, review, spans
from ..sources.readers import missing_only
from ..streaming.screen import screen, window_counts

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "documents")


BANK = {p.name: p for p in BASE_BANK}
EMAIL, IPV4 = BANK["email"], BANK["ipv4"]
CARD = Pattern("card_16", "CREDIT_CARD", 0.8, True, r"(?<!\d)(?P<value>\d{16})(?!\d)")
_EMAIL_SQL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"


def _runs(rx: str, keep: str = "true") -> str:
    """DuckDB: doc_id, start, end and text of a pattern's matches, from the pieces between them."""
    return f"""
      SELECT doc_id, CAST(list_sum([length(x) for x in g[1:i]]) + list_sum([length(x) for x in m[1:i-1]]) AS BIGINT) AS "start",
             CAST(list_sum([length(x) for x in g[1:i]]) + list_sum([length(x) for x in m[1:i]]) AS BIGINT) AS "end", m[i] AS text
      FROM (SELECT doc_id, m, g, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, '{rx}') AS m, string_split_regex(text, '{rx}') AS g FROM documents))
      WHERE {keep.replace('TEXT', 'm[i]')}"""


_DEFAULTED = lambda sql: sql.replace("list_sum([length(x) for x in m[1:i-1]])", "coalesce(list_sum([length(x) for x in m[1:i-1]]), 0)")
EMAILS = _DEFAULTED(_runs(_EMAIL_SQL))
IPS = _DEFAULTED(_runs(r"[0-9.]+", f"regexp_full_match(TEXT, '({_OCTET}\\.){{3}}{_OCTET}')"))
_LUHN = "list_sum([CASE WHEN (length(TEXT) - k) % 2 = 1 THEN CASE WHEN CAST(TEXT[k] AS INT) * 2 > 9 THEN CAST(TEXT[k] AS INT) * 2 - 9 ELSE CAST(TEXT[k] AS INT) * 2 END ELSE CAST(TEXT[k] AS INT) END for k in range(1, 17)]) % 10 = 0"
CARDS = _DEFAULTED(_runs("[0-9]+", f"length(TEXT) = 16 AND {_LUHN}"))


def _exploded(docs: DataFrame, bank: list[Pattern], validators: dict | None = None) -> DataFrame:
    found = docs.select("doc_id", "source", F.explode(spans.find_spans("text", bank, validators)).alias("s"))
    return found.select("doc_id", "source", "s.entity_type", F.col("s.start").cast("long").alias("start"), F.col("s.end").cast("long").alias("end"), "s.text")


@query(f"{EMAILS}")
def pii_email_spans(spark, sf):
    return _exploded(documents(spark, sf), [EMAIL]).select("doc_id", "start", "end", "text")


@query(f"{IPS}")
def pii_ipv4_spans(spark, sf):
    return _exploded(documents(spark, sf), [IPV4]).select("doc_id", "start", "end", "text")


@query(f"{CARDS}")
def pii_card_luhn_spans(spark, sf):
    return _exploded(documents(spark, sf), [CARD], {"card_16": T.luhn_valid}).select("doc_id", "start", "end", "text")


_ALL = f"(SELECT 'EMAIL_ADDRESS' AS entity_type, * FROM ({EMAILS}) UNION ALL SELECT 'IP_ADDRESS', * FROM ({IPS}) UNION ALL SELECT 'CREDIT_CARD', * FROM ({CARDS}))"


def _three(spark, sf):
    return _exploded(documents(spark, sf), [EMAIL, IPV4, CARD], {"card_16": T.luhn_valid})


@query(f"SELECT entity_type, count(*) AS n, count(DISTINCT doc_id) AS docs FROM {_ALL} GROUP BY 1")
def pii_type_counts(spark, sf):
    return _three(spark, sf).groupBy("entity_type").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"))


@query(f"SELECT source, count(DISTINCT x.doc_id) AS docs, count(*) AS n FROM {_ALL} x JOIN documents d ON d.doc_id = x.doc_id GROUP BY 1")
def pii_docs_by_source(spark, sf):
    return _three(spark, sf).groupBy("source").agg(F.countDistinct("doc_id").alias("docs"), F.count("*").alias("n"))


@query(f"SELECT doc_id, md5(regexp_replace(text, '{_EMAIL_SQL}', '<EMAIL_ADDRESS>', 'g')) AS redacted_md5 FROM documents")
def pii_redacted_emails(spark, sf):
    text = F.col("text")
    return documents(spark, sf).select("doc_id", F.md5(spans.anonymize(text, spans.find_spans("text", [EMAIL])).cast("binary")).alias("redacted_md5"))


@query(ORACLES["pii_redacted_emails"])
def pii_redacted_right(spark, sf):
    return documents(spark, sf).select("doc_id", F.md5(spans.anonymize_right(F.col("text"), spans.find_spans("text", [EMAIL])).cast("binary")).alias("redacted_md5"))


@query(f"SELECT doc_id, count(*) AS n FROM (SELECT doc_id FROM ({EMAILS}) UNION ALL SELECT doc_id FROM ({IPS})) GROUP BY 1 HAVING count(*) > 0")
def pii_span_threshold(spark, sf):
    kept = spans.at_least(spans.find_spans("text", [EMAIL, IPV4, CARD]), 0.85)
    return documents(spark, sf).select("doc_id", F.size(kept).cast("long").alias("n")).where("n > 0")


@query()
def screen_documents(spark, sf):
    """Every document with its spans (high-precision bank), redacted text and injection decision."""
    done = screen(documents(spark, sf).select("doc_id", "text"), "doc_id")
    listed = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["entity_type"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return done.select("doc_id", F.size("spans").cast("long").alias("n_spans"), listed.alias("spans"), "redacted", "action", "score")


@query()
def screen_conversations(spark, sf):
    found = injection.detect_rules(read(spark, sf, "conversations"))
    return found.groupBy("role", "action").agg(F.count("*").alias("n"), F.round(F.max("score"), 4).alias("max_score"))


# ------------------------------------------------------------ languages

_RATIO = r"CASE WHEN length(regexp_replace(text, '[^\p{L}]', '', 'g')) > 0 THEN length(regexp_replace(regexp_replace(text, '[^\p{L}]', '', 'g'), '[^\p{Latin}]', '', 'g')) / length(regexp_replace(text, '[^\p{L}]', '', 'g')) ELSE 1.0 END"


@query(f"SELECT doc_id, CAST(round({_RATIO}, 9) AS DOUBLE) AS ratio FROM documents")
def lang_latin_ratio(spark, sf):
    return documents(spark, sf).select("doc_id", F.round(T.latin_letter_ratio(F.col("text")), 9).alias("ratio"))


@query(f"SELECT lang, count(*) FILTER (WHERE {_RATIO} >= 0.5) AS kept, count(*) FILTER (WHERE NOT {_RATIO} >= 0.5) AS dropped FROM documents GROUP BY 1")
def lang_filter_counts(spark, sf):
    latin = T.is_mostly_latin(F.col("text"))
    return documents(spark, sf).groupBy("lang").agg(F.count(F.when(latin, 1)).alias("kept"), F.count(F.when(~latin, 1)).alias("dropped"))


# ------------------------------------------------------------ profiles

_SORTED = "SELECT lang, list_sort(list(n_chars)) AS x, count(*) AS n FROM documents GROUP BY 1"


@query(
    f"""SELECT lang, n AS "count", x[1] AS "min", (x[(n - 1) // 2 + 1] + x[n // 2 + 1]) / 2.0 AS median, round(list_sum(x) / n, 2) AS mean, x[n] AS "max",
        x[CAST(round_even(0.9 * (n - 1), 0) AS BIGINT) + 1] AS p90, x[CAST(round_even(0.99 * (n - 1), 0) AS BIGINT) + 1] AS p99, CAST(list_sum(x) AS BIGINT) AS total FROM ({_SORTED})"""
)
def profile_number_summary(spark, sf):
    return profile.number_summary(documents(spark, sf), "n_chars", ["lang"])


@query(f"""SELECT lang, n AS "count", x[1] AS "min", x[n // 2 + 1] AS p50, x[n * 9 // 10 + 1] AS p90, x[n] AS "max" FROM ({_SORTED})""")
def profile_length_buckets(spark, sf):
    return profile.length_buckets(documents(spark, sf), "n_chars", ["lang"])


@query(
    'SELECT lang, count(n_chars) AS "count", avg(n_chars) AS mean, min(n_chars) AS "min", max(n_chars) AS "max", ' + ", ".join(f"quantile_cont(n_chars, {p}) AS p{round(p * 100)}" for p in (0.25, 0.5, 0.75, 0.9, 0.95, 0.99)) + " FROM documents GROUP BY 1"
)
def profile_percentiles(spark, sf):
    return profile.describe(documents(spark, sf), "n_chars", ["lang"])


@query("SELECT source, " + ", ".join(f"count(*) FILTER (WHERE lang = '{x}') AS {x}" for x in ("en", "fr", "de", "es")) + ", count(*) FILTER (WHERE lang IN ('en', 'fr', 'de', 'es')) AS total FROM documents GROUP BY 1")
def profile_crosstab(spark, sf):
    return profile.crosstab(documents(spark, sf), "source", "lang", ["en", "fr", "de", "es"])


@query("SELECT lang, count(*) AS n, round(count(*) / (SELECT count(*) FROM documents), 4) AS share FROM documents GROUP BY 1")
def profile_value_share(spark, sf):
    return profile.value_share(documents(spark, sf), "lang")


@query("SELECT source, count(*) AS n FROM documents GROUP BY 1 ORDER BY n DESC, min(doc_id) LIMIT 5")
def profile_most_common(spark, sf):
    return profile.most_common(documents(spark, sf), "source", 5, "doc_id")


_SPANS_OF_LABELS = "SELECT doc_id, CASE WHEN toxic = 1 THEN 'HO_VA_TEN' WHEN quality = 1 THEN 'DIA_CHI_EMAIL' ELSE 'TY_GIA' END AS label FROM labels"
_MAPPING = "(VALUES ('HO_VA_TEN', 'PERSON'), ('DIA_CHI_EMAIL', 'EMAIL_ADDRESS'), ('DUONG_DAN_URL', 'URL')) AS m(label, entity_type)"


def _label_rows(spark, sf):
    return read(spark, sf, "labels").select("doc_id", F.when(F.col("toxic") == 1, "HO_VA_TEN").when(F.col("quality") == 1, "DIA_CHI_EMAIL").otherwise("TY_GIA").alias("label"))


def _mapping(spark):
    return spark.createDataFrame([("HO_VA_TEN", "PERSON"), ("DIA_CHI_EMAIL", "EMAIL_ADDRESS"), ("DUONG_DAN_URL", "URL")], "label string, entity_type string")


@query(f"SELECT coalesce(entity_type, 'UNMAPPED') AS entity_type, count(*) AS n FROM ({_SPANS_OF_LABELS}) s LEFT JOIN {_MAPPING} ON s.label = m.label GROUP BY 1")
def label_mapped_counts(spark, sf):
    return profile.mapped_counts(_label_rows(spark, sf), _mapping(spark))


@query(f"SELECT m.label, m.entity_type, count(s.doc_id) AS n, count(s.doc_id) > 0 AS present FROM {_MAPPING} LEFT JOIN ({_SPANS_OF_LABELS}) s ON s.label = m.label GROUP BY 1, 2")
def label_breakdown(spark, sf):
    return profile.label_breakdown(_label_rows(spark, sf), _mapping(spark))


@query("SELECT k AS key, count(*) FILTER (WHERE v) AS n_true, count(*) AS n FROM (SELECT 'good' AS k, quality = 1 AS v FROM labels UNION ALL SELECT 'toxic', toxic = 1 FROM labels) GROUP BY 1")
def json_true_counts(spark, sf):
    js = F.to_json(F.struct((F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic")))
    return profile.true_counts(read(spark, sf, "labels").select(js.alias("objectives")), "objectives")


# ------------------------------------------------------------ samples

_HASH = "md5('42:' || CAST(doc_id AS VARCHAR))"


@query(f"SELECT doc_id FROM documents ORDER BY {_HASH}, doc_id LIMIT 50")
def sample_manifest(spark, sf):
    return profile.sample_ids(documents(spark, sf), "doc_id", 50)


_PLACE = f"SELECT doc_id, row_number() OVER (ORDER BY {_HASH}, CAST(doc_id AS VARCHAR)) AS r, count(*) OVER () AS n FROM documents"


@query(f"SELECT doc_id, CASE WHEN r <= greatest(1, round_even(n * 0.1, 0)) THEN 'train_val' ELSE 'train_main' END AS part FROM ({_PLACE})")
def split_train_val(spark, sf):
    return profile.split(documents(spark, sf).select("doc_id"), "doc_id", {"train_val": 0.1, "train_main": 0.9})


@query(f"SELECT doc_id, CASE WHEN r <= round_even(n * 0.1, 0) THEN 'test' WHEN r <= 2 * round_even(n * 0.1, 0) THEN 'val' ELSE 'train' END AS part FROM ({_PLACE})")
def split_three_way(spark, sf):
    return profile.split(documents(spark, sf).select("doc_id"), "doc_id", {"test": 0.1, "val": 0.1, "train": 0.8})


@query("SELECT source, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 3")
def n_per_bucket(spark, sf):
    return profile.n_per_group(documents(spark, sf).select("source", "doc_id"), "source", "doc_id", 3)


@query("SELECT lang, doc_id, CAST(t AS INTEGER) AS turn FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS t, min(doc_id) OVER (PARTITION BY lang) AS f FROM documents) ORDER BY t, f LIMIT 25")
def round_robin_pick(spark, sf):
    return profile.round_robin(documents(spark, sf).select("lang", "doc_id"), "lang", "doc_id", 25)


@query(
    f"""WITH g AS (SELECT doc_id, toxic = 1 AS y FROM labels WHERE toxic = 1 OR quality = 0), w AS (SELECT doc_id, FALSE AS y FROM labels WHERE NOT (toxic = 1 OR quality = 0))
       SELECT doc_id, y, TRUE AS gold FROM g UNION ALL (SELECT doc_id, y, FALSE FROM w ORDER BY {_HASH}, doc_id LIMIT greatest(0, (SELECT count(*) FILTER (WHERE y) - count(*) FILTER (WHERE NOT y) FROM g)))"""
)
def balanced_eval(spark, sf):
    """Gold: toxic or of low quality; weak: all others. Every labelled row is in one of the two."""
    lab = read(spark, sf, "labels").select("doc_id", (F.col("toxic") == 1).alias("y"), (F.col("quality") == 0).alias("low"))
    return profile.balanced_set(lab.where("y or low").drop("low"), lab.where("not (y or low)").drop("low"), "doc_id", "y")


@query("SELECT CAST(doc_id AS VARCHAR) AS doc_id, lang, CAST(place AS INTEGER) AS place FROM documents JOIN (VALUES (7, 0), (3, 1), (11, 2)) AS v(i, place) ON doc_id = i")
def manifest_order(spark, sf):
    docs = documents(spark, sf).select(F.col("doc_id").cast("string").alias("doc_id"), "lang")
    return profile.in_manifest_order(docs, "doc_id", ["7", "3", "7", "11", "none"])


@query("SELECT lang, count(*) AS n FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) GROUP BY 1")
def resume_missing(spark, sf):
    return missing_only(documents(spark, sf), read(spark, sf, "labels"), "doc_id").groupBy("lang").agg(F.count("*").alias("n"))


# ------------------------------------------------------------ n-gram naive Bayes

# DuckDB takes minutes over whole texts, so tests hold these against plain Python


def _nb_docs(spark, sf):
    return documents(spark, sf).select("doc_id", "text").join(read(spark, sf, "labels").select("doc_id", F.col("toxic").alias("label")), "doc_id")


@query()
def nb_fit_counts(spark, sf):
    return injection.fit(_nb_docs(spark, sf))


@query()
def nb_predict(spark, sf):
    return injection.fit_predict(_nb_docs(spark, sf), "doc_id").select("doc_id", F.round("score", 4).alias("score"))


@query()
def nb_leave_one_out(spark, sf):
    return injection.predict_leave_one_out(_nb_docs(spark, sf), "doc_id").select("doc_id", "label", F.round("score", 4).alias("score"))


# ------------------------------------------------------------ confusion and sweeps

_CELLS = "count(*) FILTER (WHERE y AND p) AS tp, count(*) FILTER (WHERE NOT y AND p) AS fp, count(*) FILTER (WHERE y AND NOT p) AS fn, count(*) FILTER (WHERE NOT y AND NOT p) AS tn"
_RATES = "round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS \"precision\", round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall, round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1"


@query(f"SELECT CAST(b AS INTEGER) AS bucket, tp, fp, fn, tn, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, {_RATES} FROM (SELECT doc_id % 4 AS b, {_CELLS} FROM (SELECT doc_id, toxic = 1 AS y, quality = 0 AS p FROM labels) GROUP BY 1)")
def pi_confusion(spark, sf):
    rows = read(spark, sf, "labels").withColumn("bucket", (F.col("doc_id") % 4).cast("int"))
    return metrics.confusion(rows, F.col("toxic") == 1, F.col("quality") == 0, ["bucket"])


@query("SELECT round(avg(CASE WHEN toxic = 1 THEN CAST(quality = 0 AS INT) END), 6) AS action_accuracy FROM labels")
def pi_action_accuracy(spark, sf):
    rows = read(spark, sf, "labels").select(F.when(F.col("quality") == 0, "block").otherwise("allow").alias("action"), F.when(F.col("toxic") == 1, "block").alias("expected_action"))
    return metrics.action_accuracy(rows)


_SCORED = "(SELECT (doc_id * 37 % 100003) / 100003.0::DOUBLE AS s, toxic AS y FROM labels)"
_SWEEP = f"""SELECT t AS threshold, tp, fp, fn, tn, {_RATES} FROM (SELECT t, count(*) FILTER (WHERE y = 1 AND s >= t) AS tp, count(*) FILTER (WHERE y = 0 AND s >= t) AS fp, count(*) FILTER (WHERE y = 1 AND s < t) AS fn, count(*) FILTER (WHERE y = 0 AND s < t) AS tn
  FROM (SELECT round(i * 0.06, 4)::DOUBLE AS t FROM range(0, 17) r(i) UNION SELECT round(s, 6) FROM {_SCORED}) ts, {_SCORED} GROUP BY t)"""


def _sweep(spark, sf):
    rows = read(spark, sf, "labels").select((F.col("doc_id") * 37 % 100003 / F.lit(100003.0)).alias("score"), F.col("toxic").alias("label"))
    return metrics.threshold_sweep(rows, 0.06)


@query(_SWEEP)
def pi_threshold_sweep(spark, sf):
    return _sweep(spark, sf)


@query(f"{_SWEEP} ORDER BY f1 DESC, \"precision\" DESC, threshold LIMIT 1")
def pi_best_threshold(spark, sf):
    return metrics.best_threshold(_sweep(spark, sf))


# ------------------------------------------------------------ review, overrides, permissions, windows

_CANON = """SELECT CAST(doc_id AS VARCHAR) AS input_id, CASE WHEN toxic = 1 THEN 'reject' WHEN quality = 1 THEN 'safe' END AS action, CASE WHEN doc_id % 3 = 0 THEN TRUE WHEN doc_id % 3 = 1 THEN FALSE END AS pii_visible,
  CASE WHEN doc_id % 5 = 0 THEN FALSE END AS pi, doc_id % 4 = 0 AS has_pii, doc_id % 7 = 0 AS has_pi, doc_id % 11 = 0 AS has_red FROM labels"""
_REASONS = """list_filter([CASE WHEN has_pii AND pii_visible IS NOT TRUE THEN 'P1a' END, CASE WHEN has_pi THEN 'P1b' END, CASE WHEN action = 'safe' AND pii_visible THEN 'P1c' END, CASE WHEN action IS NULL THEN 'P2' END,
  CASE WHEN action = 'reject' THEN 'P3' END, CASE WHEN has_red THEN 'P4' END, CASE WHEN pi = FALSE AND has_pi THEN 'P5' END], lambda x: x IS NOT NULL)"""


def _canonical(spark, sf):
    d = F.col("doc_id")
    one = lambda cond, kind: F.when(cond, F.array(F.lit(1))).otherwise(F.array().cast("array<int>")).alias(kind)
    null = lambda *names: [F.lit(None).cast("boolean").alias(n) for n in names]
    labels = F.struct(
        F.when(F.col("toxic") == 1, "reject").when(F.col("quality") == 1, "safe").alias("action"), F.when(d % 3 == 0, F.lit(True)).when(d % 3 == 1, F.lit(False)).alias("pii_visible"), F.when(d % 5 == 0, F.lit(False)).alias("prompt_injection"),
        *null("sexual", "violence", "blood_gore", "political", "religious"),
    )
    return read(spark, sf, "labels").select(d.cast("string").alias("input_id"), labels.alias("labels"), F.struct(one(d % 4 == 0, "pii_spans"), one(d % 7 == 0, "prompt_injection_spans"), one(d % 11 == 0, "redaction_metadata")).alias("detections"))


@query(f"SELECT input_id, array_to_string(list_transform({_REASONS}, lambda x: x[1:2]), ',') AS ranks FROM ({_CANON}) WHERE len({_REASONS}) > 0")
def review_reasons(spark, sf):
    rows = _canonical(spark, sf).withColumn("r", review.selection_reasons(True)).where(F.size("r") > 0)
    return rows.select("input_id", F.array_join(F.transform("r", lambda x: F.concat(F.lit("P"), x["rank"].cast("string"))), ",").alias("ranks"))


@query(f"SELECT input_id, CAST(list_min(list_transform({_REASONS}, lambda x: CAST(x[2] AS INT))) AS INTEGER) AS rank FROM ({_CANON}) WHERE len({_REASONS}) > 0 ORDER BY rank, input_id LIMIT 40")
def review_queue_topk(spark, sf):
    return review.review_queue(_canonical(spark, sf), True, 40).select("input_id", "rank")


@query(f"SELECT reason, count(*) AS n FROM (SELECT unnest(list_concat(['total'], CASE WHEN len({_REASONS}) > 0 THEN ['queued'] ELSE [] END, list_transform({_REASONS}, lambda x: x[1:2]))) AS reason FROM ({_CANON})) GROUP BY 1")
def review_queue_stats(spark, sf):
    return review.queue_stats(_canonical(spark, sf), True)


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY 1")
def latest_override(spark, sf):
    return review.latest(read(spark, sf, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id")


@query(
    """SELECT doc_id, coalesce(h.event_type, a.event_type, CASE WHEN toxic = 1 THEN 'reject' END) AS action, CASE WHEN h.event_type IS NOT NULL THEN 'human' WHEN a.event_type IS NOT NULL THEN 'api' WHEN toxic = 1 THEN 'source' END AS source
       FROM labels LEFT JOIN (SELECT user_id, arg_max(event_type, event_id) AS event_type FROM events WHERE event_type NOT IN ('click', 'purchase') GROUP BY 1) a ON a.user_id = doc_id
       LEFT JOIN (SELECT user_id, arg_max(event_type, event_id) AS event_type FROM events WHERE event_type IN ('click', 'purchase') GROUP BY 1) h ON h.user_id = doc_id"""
)
def layer_merge(spark, sf):
    """Events of all ids: clicks and purchases are the human layer, all other types the API's."""
    null = [F.lit(None).cast("boolean").alias(r) for r in review.RISKS]
    action = F.when(F.col("toxic") == 1, "reject")
    source = F.struct(F.when(action.isNotNull(), "source").alias("action"), *[F.lit(None).cast("string").alias(r) for r in review.RISKS])
    rows = read(spark, sf, "labels").select(F.col("doc_id").alias("input_id"), F.struct(action.alias("action"), *null).alias("labels"), source.alias("label_source"), F.lit(None).cast("string").alias("review"))
    human = F.col("event_type").isin("click", "purchase")
    layer = lambda own: read(spark, sf, "events").where(own).select(F.col("user_id").alias("input_id"), F.struct(F.col("event_type").alias("action"), *null).alias("labels"), F.col("event_id").alias("seq"))
    done = review.layered(rows, layer(~human), layer(human))
    return done.select(F.col("input_id").alias("doc_id"), "labels.action", F.col("label_source.action").alias("source"))


@query("SELECT event_id, event_type, user_id FROM events ORDER BY event_id DESC LIMIT 20")
def audit_recent(spark, sf):
    return governance.recent(read(spark, sf, "events").select("event_id", "event_type", "user_id"), 20, "event_id")


_TOOL = "CASE event_id % 5 WHEN 0 THEN 'pii_analyze' WHEN 1 THEN 'data_review' WHEN 2 THEN 'export_data' WHEN 3 THEN 'admin_config' ELSE 'unknown_tool' END"
_ROLE = "CASE user_id % 4 WHEN 0 THEN 'user' WHEN 1 THEN 'reviewer' WHEN 2 THEN 'admin' END"


@query(
    f"""SELECT tool_name, action, allowed, count(*) AS n FROM (SELECT tool_name, CASE WHEN tool_name = 'export_data' THEN 'require_approval' WHEN ok THEN 'allow' ELSE 'deny' END AS action, tool_name <> 'export_data' AND ok AS allowed
        FROM (SELECT tool_name, coalesce(CASE tool_name WHEN 'pii_analyze' THEN role IN ('user', 'admin') WHEN 'data_review' THEN role IN ('reviewer', 'admin') WHEN 'unknown_tool' THEN role = 'user' ELSE role = 'admin' END, FALSE) AS ok
        FROM (SELECT {_TOOL} AS tool_name, {_ROLE} AS role FROM events))) GROUP BY 1, 2, 3"""
)
def permission_decisions(spark, sf):
    requests = read(spark, sf, "events").select(F.expr(_TOOL).alias("tool_name"), F.col("user_id").cast("string").alias("user_id"), F.expr(f"filter(array({_ROLE}), x -> x is not null)").alias("roles"), F.array().cast("array<string>").alias("permissions"))
    return governance.decide(requests, governance.default_permissions(spark)).groupBy("tool_name", "action", "allowed").agg(F.count("*").alias("n"))


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def events_tumbling_actions(spark, sf):
    return window_counts(read(spark, sf, "events"), "ts", "event_type", "1 hour")


# ------------------------------------------------------------ offsets and boxes


@query(
    """SELECT conv_id, CAST(turn AS BIGINT) AS turn, CAST(coalesce(sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "start",
       CAST(sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS BIGINT) AS "end" FROM conversations"""
)
def ocr_text_offsets(spark, sf):
    """Turns of a conversation laid out as segments of one text."""
    c = read(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text", F.array().cast("array<double>").alias("box")))).alias("segments"))
    _, laid = geometry.full_text(F.col("segments"))
    e = c.select("conv_id", "segments", F.posexplode(laid).alias("i", "s"))
    return e.select("conv_id", F.get("segments", F.col("i"))["turn"].cast("long").alias("turn"), F.col("s.start").cast("long").alias("start"), F.col("s.end").cast("long").alias("end"))


_A = "[event_id % 50, event_id % 30, event_id % 50 + 20, event_id % 30 + 10]"
_B = "[event_id % 40 + 5, event_id % 20, event_id % 40 + 15, event_id % 20 + 30]"
_I = "greatest(0, least(event_id % 50 + 20, event_id % 40 + 15) - greatest(event_id % 50, event_id % 40 + 5)) * greatest(0, least(event_id % 30 + 10, event_id % 20 + 30) - greatest(event_id % 30, event_id % 20))"


@query(f"SELECT event_id, CAST(round({_I} / 200.0, 9) AS DOUBLE) AS of_a, CAST(round({_I} / 300.0, 9) AS DOUBLE) AS of_b FROM events")
def box_coverage(spark, sf):
    box = lambda sql: F.expr(f"transform(array{sql.replace('[', '(').replace(']', ')')}, x -> cast(x as double))")
    e = read(spark, sf, "events").select("event_id", box(_A).alias("a"), box(_B).alias("b"))
    return e.select("event_id", F.round(geometry.covered(F.col("a"), F.col("b")), 9).alias("of_a"), F.round(geometry.covered(F.col("b"), F.col("a")), 9).alias("of_b"))


@query(
    """SELECT event_id, CAST(greatest(0, 100 + (event_id % 7) / 10.0 * 200 - 2) AS DOUBLE) AS x0, CAST(least(290, 100 + (event_id % 7 + 3) / 10.0 * 200 + 2) AS DOUBLE) AS x1, CAST(48 AS DOUBLE) AS y0, CAST(72 AS DOUBLE) AS y1 FROM events"""
)
def span_to_box(spark, sf):
    """Spans of 3 characters in a segment of 10 characters and 200 pixels, in an image 290 pixels wide."""
    e = read(spark, sf, "events")
    seg = F.array(F.struct(F.lit("b1").alias("box_id"), F.lit("0123456789").alias("text"), F.lit(0).alias("start"), F.lit(10).alias("end"), F.array(*[F.lit(float(x)) for x in (100, 50, 300, 70)]).alias("box")))
    at = (F.col("event_id") % 7).cast("int")
    e = e.withColumn("span", F.struct(at.alias("start"), (at + 3).alias("end")))
    box = geometry.span_to_box(F.col("span"), seg, 2.0, F.lit(290), F.lit(200))["box"]
    return e.select("event_id", box[0].alias("x0"), box[2].alias("x1"), box[1].alias("y0"), box[3].alias("y1"))

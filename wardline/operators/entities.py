"""Entity taggers: BIO decoding, score calibration, chunking, ensembles, resolving and verifying candidates.

A tagger is an injected callable; what follows it is plain expressions or a batch function.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spans import intersection, merge_overlaps

ENTITY = "struct<entity_type:string,start:int,end:int,score:double>"
# Words to the left that raise a person's score, to the right, terms a name can't hold, weak surroundings.
LEFT_CUES = ["họ và tên", "họ tên", "tên bệnh nhân", "tên ứng viên", "tên nhân viên", "tên trưởng nhóm", "người phụ trách", "người nhận", "người gửi", "người yêu cầu", "người lập báo cáo", "chủ thẻ", "đại diện", "bác sĩ", "cash receiver", "delivered by", "dr a/c name", "signature"]
RIGHT_CUES = ["mã nhân viên", "ngày sinh", "giới tính", "số cccd", "số cmnd", "số điện thoại", "email", "chức vụ", "chức danh"]
BLOCKED = ["mã", "số", "đường", "phường", "xã", "huyện", "quận", "tỉnh", "tp", "thành phố", "ngân hàng", "bệnh viện", "công an", "rosuvastatin", "atorvastatin", "vnd", "usd"]
WEAK = ["mã sân bay", "mã nhân viên", "mã khách hàng", "ngày cấp", "nơi cấp", "địa chỉ", "tọa độ", "số tiền", "tỷ giá", "thuốc", "chẩn đoán", "lĩnh vực công việc"]
# Left contexts of an organization, of a field, of a person's label.
ORG_CONTEXT = r"\b(công\s+ty|cty|doanh\s+nghiệp|tập\s+đoàn|ngân\s+hàng|bệnh\s+viện|trường|đại\s+học|học\s+viện|khoa|phòng|ban|sở|ubnd|ủy\s+ban|cục|chi\s+cục|văn\s+phòng|trung\s+tâm|cơ\s+quan|đơn\s+vị|nhà\s+thuốc|cửa\s+hàng|siêu\s+thị|khách\s+sạn|nhà\s+hàng)\b"
FIELD_CONTEXT = r"\b(mã|số|stk|cccd|cmnd|hộ\s+chiếu|mst|mã\s+số\s+thuế|hợp\s+đồng|hóa\s+đơn|đơn\s+hàng|giao\s+dịch|sản\s+phẩm|thuốc|biển\s+số)\b"
PERSON_CONTEXT = r"\b(họ\s+và\s+tên|họ\s+tên|tên\s+khách\s+hàng|khách\s+hàng|bệnh\s+nhân|người\s+nhận|người\s+gửi|chủ\s+tài\s+khoản|tên\s+nhân\s+viên|nhân\s+viên|chủ\s+sở\s+hữu|người\s+lập|đại\s+diện\s+pháp\s+lý|bác\s+sĩ|dược\s+sĩ|kỹ\s+thuật\s+viên|ông|bà|anh|chị)\b"
# Terms that a person's token can't hold, and words around it that the gate asks for.
GATE_BLOCKED = ["mã", "số", "đường", "phường", "xã", "huyện", "quận", "tỉnh", "tp", "thành phố", "ngân hàng", "bệnh viện", "rosuvastatin", "atorvastatin"]
GATE_CUES = ["họ và tên", "họ tên", "tên bệnh nhân", "tên ứng viên", "tên nhân viên", "tên trưởng nhóm", "người phụ trách", "người nhận", "người gửi", "đại diện", "ông", "bà", "bác sĩ", "chủ thẻ", "ký và ghi rõ họ tên"]
TAGGER_SOURCE = "DeepLearning_UndertheseaNER"


def _any(text: Column, terms: list[str]) -> Column:
    return F.exists(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(text, t))


def calibrate(text: Column, spans: Column, base: float = 0.5, min_score: float = 0.58) -> Column:
    """Scores of persons by their surroundings (60 characters) and shape; spans below min_score go, others round to 3 places."""

    def scored(s):
        value = F.substring(text, s["start"] + 1, s["end"] - s["start"])
        left = F.lower(F.substring(text, F.greatest(s["start"] - 60, F.lit(0)) + 1, F.least(s["start"], F.lit(60))))
        right = F.lower(F.substring(text, s["end"] + 1, F.lit(60)))
        tokens = F.size(F.filter(F.split(value, r"(?U)\s+"), lambda t: t != ""))
        add = lambda cond, by: F.when(cond, F.lit(by)).otherwise(F.lit(0.0))
        raw = (
            F.lit(base) + add(_any(left, LEFT_CUES), 0.25) + add(_any(right, RIGHT_CUES), 0.12) + add((tokens >= 2) & (tokens <= 4), 0.08) + add(tokens >= 5, -0.08) + add(value.rlike("[0-9]"), -0.4)
            + add(_any(F.lower(value), BLOCKED), -0.35) + add(_any(F.concat(left, F.lit(" "), right), WEAK), -0.12) + add(tokens < 2, -0.25)
        )
        person = F.greatest(F.lit(0.0), F.least(F.lit(0.99), raw))
        return F.struct(s["entity_type"].alias("entity_type"), s["start"].alias("start"), s["end"].alias("end"), F.when(s["entity_type"] == "PERSON", person).otherwise(F.lit(base)).alias("score"))

    kept = F.filter(F.transform(spans, scored), lambda s: F.round(s["score"], 9) >= min_score)
    return F.transform(kept, lambda s: F.struct(s["entity_type"].alias("entity_type"), s["start"].alias("start"), s["end"].alias("end"), F.round(s["score"], 3).alias("score")))


def gate(context_required: bool = False, window: int = 45):
    """A test of candidate tokens (text, token, start, end, entity type): persons need two words, no digit and no blocked term, and,
    if asked for, a cue within `window` characters; other types pass."""

    def accepts(text: str, token: str, start: int, end: int, entity: str) -> bool:
        if entity != "PERSON":
            return True
        low = token.lower()
        if len(token.split()) < 2 or any(ch.isdigit() for ch in token) or any(t in low for t in GATE_BLOCKED):
            return False
        around = text[max(0, start - window) : end + window].lower()
        return not context_required or any(cue in around for cue in GATE_CUES)

    return accepts


def map_label(label: str, labels: dict[str, str], targets: frozenset[str] = frozenset()) -> str | None:
    """Entity type of a model's label: B- and I- are taken off; a label that is a target type already stands for itself."""
    plain = label[2:] if label[:2] in ("B-", "I-") else label
    return labels.get(plain) or (plain if plain in targets else None)


def decode_bio(text: str, tagged: list[tuple[str, str]], labels: dict[str, str], score: float = 0.5, gate=None) -> list[dict]:
    """Spans of BIO-tagged tokens, aligned with the text by searching forward (from the start where that fails).

    A token that the gate refuses ends the span before it.
    """
    spans: list[dict] = []
    at, now = 0, None
    for token, tag in tagged:
        start = text.find(token, at)
        start = start if start >= 0 else text.find(token)
        if start < 0:
            continue
        at = start + len(token)
        prefix, _, label = tag.partition("-") if tag and "-" in tag else ("O" if tag in ("", "O", None) else "B", "", tag)
        entity = labels.get(label) if prefix != "O" else None
        if entity is None or (gate is not None and not gate(text, token, start, at, entity)):
            now = None
        elif prefix == "I" and now is not None and now["entity_type"] == entity:
            now["end"] = at
        else:
            now = {"entity_type": entity, "start": start, "end": at, "score": score}
            spans.append(now)
    return spans


def tag(docs: DataFrame, make_tagger, labels: dict[str, str], text_col: str = "text", out: str = "entities", chunk: int | None = None, overlap: int = 40, score: float = 0.5, gate=None) -> DataFrame:
    """Adds spans found by a tagger (made once for each worker's batch stream; text -> [(token, tag)]).

    With `chunk`, texts are cut into overlapping chunks; spans are shifted back and of overlapping ones the better stays.
    """
    import pyarrow as pa

    kind = pa.list_(pa.struct([("entity_type", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches):
        tagger = make_tagger()
        for b in batches:
            rows = []
            for text in b.column(b.schema.get_field_index(text_col)).to_pylist():
                text = text or ""
                step = (chunk - overlap) if chunk else max(1, len(text))
                own = []
                for at in range(0, max(1, len(text)), step):
                    part = text[at : at + (chunk or len(text))]
                    own += [{**s, "start": s["start"] + at, "end": s["end"] + at} for s in decode_bio(part, tagger(part), labels, score, gate)]
                rows.append(own)
            yield b.append_column(out, pa.array(rows, kind))

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    tagged = docs.mapInArrow(run, f"{ddl}, {out} array<{ENTITY}>")
    return tagged.withColumn(out, merge_overlaps(F.col(out), ENTITY)) if chunk else tagged


def ensemble_union(parts: list[Column]) -> Column:
    return merge_overlaps(F.concat(*parts), ENTITY)


def ensemble_intersection(parts: list[Column]) -> Column:
    """Spans of the first model that every other model confirms by an overlapping span of the same type."""
    first, *others = parts
    for o in others:
        first = intersection(first, o)
    return first


def resolve(text: Column, spans: Column, window: int = 36) -> Column:
    """array<struct<candidate, action, reason>>: persons of the tagger are dropped where their left context says so.

    The reasons are fixed values of the audit record.
    """
    def decision(s, i):
        left = F.lower(F.substring(text, F.greatest(s["start"] - window, F.lit(0)) + 1, F.least(s["start"], F.lit(window))))
        hit = lambda rx: left.rlike("(?iuU)" + rx)
        reason = (
            F.when(s["entity_type"] != "PERSON", "not a PERSON candidate").when(F.coalesce(s["recognizer"], F.lit("")) != TAGGER_SOURCE, "not produced by Underthesea PERSON recognizer")
            .when(hit(PERSON_CONTEXT), "left context contains a person label").when(hit(ORG_CONTEXT), "left context indicates an organization")
            .when(hit(FIELD_CONTEXT), "left context indicates a document/code field").otherwise("no suppressing context matched")
        )
        drop = reason.isin("left context indicates an organization", "left context indicates a document/code field")
        return F.struct(i.alias("candidate"), F.when(drop, "drop").otherwise("keep").alias("action"), reason.alias("reason"))

    return F.transform(spans, decision)


def resolved(spans: Column, decisions: Column) -> Column:
    return F.filter(spans, lambda s, i: F.get(decisions, i)["action"] == "keep")


def tag_scored(docs: DataFrame, make_model, labels: dict[str, str], text_col: str = "text", out: str = "entities", chunk: int | None = 512, overlap: int = 40, score: float | None = None, targets: tuple[str, ...] = ()) -> DataFrame:
    """Adds spans of a model that gives [(label, start, end, score)] of a text: token-classification models, or with a fixed `score`
    models that give none.  Texts are cut into overlapping chunks; of overlapping spans the better stays."""
    import pyarrow as pa

    kind = pa.list_(pa.struct([("entity_type", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
    wanted = frozenset(targets)

    def run(batches):
        model = make_model()
        for b in batches:
            rows = []
            for text in b.column(b.schema.get_field_index(text_col)).to_pylist():
                text, own = text or "", []
                step = chunk - overlap if chunk else max(1, len(text))
                for at in range(0, max(1, len(text)), step):
                    for label, start, end, own_score in model(text[at : at + (chunk or len(text))]):
                        entity = map_label(label, labels, wanted)
                        if entity is not None:
                            own.append({"entity_type": entity, "start": start + at, "end": end + at, "score": own_score if score is None else score})
                rows.append(own)
            yield b.append_column(out, pa.array(rows, kind))

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{ddl}, {out} array<{ENTITY}>").withColumn(out, merge_overlaps(F.col(out), ENTITY))


def verifier_candidates(text: Column, spans: Column, source, window: int = 40) -> Column:
    """What a verifier is shown of each span: id, text, type, source, score (2 places), and the text around it in brackets."""

    def shown(s, i):
        own = F.substring(text, s["start"] + 1, s["end"] - s["start"])
        left = F.substring(text, F.greatest(s["start"] - window, F.lit(0)) + 1, F.least(s["start"], F.lit(window)))
        around = F.concat(left, F.lit("⟦"), own, F.lit("⟧"), F.substring(text, s["end"] + 1, F.lit(window)))
        return F.struct(i.alias("id"), own.alias("text"), s["entity_type"].alias("type"), source(s).alias("source"), F.round(s["score"], 2).alias("score"), around.alias("context"))

    return F.transform(spans, shown)


def verify(rows: DataFrame, call, source, text_col: str = "text", spans: str = "spans", strict: bool = False) -> DataFrame:
    """Spans after an injected verifier (JSON payload -> JSON verdict) has seen them.

    Rows without spans aren't shown to it.  An error of the verifier changes nothing, or ends the job if strict.
    """
    import pyarrow as pa

    payload = F.to_json(F.struct(F.col(text_col).alias("source_text"), verifier_candidates(F.col(text_col), F.col(spans), source).alias("candidates")))
    asked = rows.withColumn("_ask", F.when(F.size(spans) > 0, payload))

    def answer(text: str | None) -> str | None:
        if text is None:
            return None
        try:
            return call(text)
        except Exception:
            if strict:
                raise
            return None

    def run(batches):
        for b in batches:
            yield b.append_column("_verdict", pa.array([answer(t) for t in b.column(b.schema.get_field_index("_ask")).to_pylist()], pa.string()))

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in asked.schema.fields)
    judged = asked.mapInArrow(run, f"{ddl}, _verdict string")
    return judged.withColumn(spans, F.when(F.col("_verdict").isNull(), F.col(spans)).otherwise(apply_verdict(F.col(spans), F.col("_verdict")))).drop("_ask", "_verdict")


VERDICT = "struct<drop:array<int>,relabel:array<struct<id:int,entity_type:string>>>"


def apply_verdict(spans: Column, verdict_json: Column) -> Column:
    """Spans under a sparse verdict {drop, relabel}: unmentioned ones stay; an unreadable verdict changes nothing."""
    v = F.from_json(verdict_json, VERDICT)
    drop = F.coalesce(v["drop"], F.array().cast("array<int>"))
    renamed = F.coalesce(v["relabel"], F.array().cast("array<struct<id:int,entity_type:string>>"))
    indexed = F.transform(spans, lambda s, i: F.struct(i.alias("i"), s.alias("s")))
    kept = F.filter(indexed, lambda x: ~F.array_contains(drop, x["i"]))
    new = lambda x: F.get(F.filter(renamed, lambda r: r["id"] == x["i"]), F.lit(0))["entity_type"]
    return F.transform(kept, lambda x: x["s"].withField("entity_type", F.coalesce(new(x), x["s"]["entity_type"])))


def context_boost(text: Column, spans: Column, words: list[str], boost: float = 0.35, floor: float = 0.4, tokens: int = 5) -> Column:
    """Raises a span's score where one of the words is among the tokens before it (at least `floor`, at most 1)."""
    def scored(s):
        before = F.split(F.lower(F.substring(text, F.lit(1), s["start"])), r"(?U)\s+")
        near = F.filter(before, lambda t: t != "")
        near = F.slice(near, F.greatest(F.size(near) - tokens + 1, F.lit(1)), F.lit(tokens))
        hit = F.exists(near, lambda t: F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(t, w)))
        return s.withField("score", F.when(hit, F.least(F.lit(1.0), F.greatest(s["score"] + boost, F.lit(floor)))).otherwise(s["score"]))

    return F.transform(spans, scored)

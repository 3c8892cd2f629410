"""Span algebra over arrays of spans: detection by pattern banks, dedupe, merging, thresholds, anonymizing, matching.

Each operator is a column expression on one row, so none of them shuffles.  Order-dependent ones are folds.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import Pattern
from ..functions.text import SPAN, fold, let, match_spans, piece, pieces_of

EMPTY = f"cast(array() as array<{SPAN}>)"
#: Case-folded literals one of which every match of a pattern holds: a cheap guard before the pattern runs.
ANCHORS = {
    "email": ["@"], "vn_cccd_cmnd": ["cccd", "cmnd", "cmtnd", "căn", "chứng"], "vn_cccd_loose_number": ["cccd"], "vn_tax_id": ["thuế"], "vn_employee_id": ["nhân"], "vn_passport_id": ["chiếu", "passport"],
    "vn_transaction_id": ["giao"], "vn_context_date": ["ngày", "thời"], "vn_context_year": ["năm"], "vn_context_month_duration": ["tháng"], "vn_birth_year": ["sinh"], "vn_birth_month": ["sinh"], "vn_house_number": ["số"],
    "vn_street_like_location": ["đường", "phố", "ngõ", "ấp", "buôn", "bản", "xóm", "thôn"], "vn_ward_location": ["phường", "xã"], "vn_district_location": ["huyện", "quận", "thị", "thành"],
    "vn_province_location": ["tỉnh", "tp."], "country_after_vn_address": ["tỉnh", "tp."], "vn_person_labeled_name": ["họ", "tên", "bệnh", "bác", "người", "nhân"], "vn_person_split_surname": ["họ"],
    "vn_person_split_given_name": ["tên"], "vn_person_honorific_narrative": ["ông", "bà"], "vn_person_honorific_surname": ["ông", "bà"], "vn_person_honorific_given_name": ["ông", "bà"],
    "vn_organization_labeled": ["tên", "đơn", "ngân", "viện", "bank"], "vn_bank_account": ["khoản", "stk", "a/c"], "url": ["http", "www."], "ipv4": ["."], "ipv6": [":"], "mac_address": [":", "-"],
    "crypto_ethereum": ["0x"], "crypto_bitcoin": ["1", "3"], "credit_card_context": ["thẻ", "card"], "card_cvv_context": ["cvv", "cvc", "mật"],
    "recall_date_labeled": ["ngày"], "recall_date_today_clause": ["ngày"], "recall_context_year": ["năm"], "recall_context_month_duration": ["tháng"], "recall_employee_id": ["nhân"], "recall_transaction_id": ["giao"],
    "recall_business_tax_id": ["mã", "đkdn"], "recall_document_number": ["cccd", "căn", "gttt", "hộ", "passport"], "recall_bank_account": ["khoản", "ví"], "recall_country_labeled": ["quốc", "country"],
    "recall_country_after_address": ["tỉnh", "tp.", "phố"], "recall_special_ward": ["khu"], "recall_organization_labeled": ["tên", "chức", "kính", "nhánh", "bên"],
    "recall_person_labeled_roles": ["người", "tên", "nhân", "đại", "bác", "receiver", "delivered", "a/c", "signature"], "vie_pii_company_name": ["ty", "đoàn", "viện", "sạn", "phẩm", "trường", "học", "hàng", "thuốc"],
    "vie_pii_labeled_company_name": ["tên", "name", "hệ"], "vie_pii_international_phone_context": ["số", "phone", "fax", "gọi", "hệ"],
}
#: Patterns that match nothing without a digit.
NEEDS_DIGIT = frozenset(
    """vn_mobile_phone vn_cccd_cmnd vn_cccd_loose_number vn_tax_id vn_employee_id vn_passport_id vn_transaction_id vn_context_date vn_context_year vn_context_month_duration vn_birth_year vn_birth_month
    vn_house_number vn_bank_account ipv4 mac_address credit_card_grouped credit_card_context card_cvv_context recall_date_labeled recall_date_today_clause recall_context_year
    recall_context_month_duration recall_employee_id recall_business_tax_id recall_document_number recall_bank_account vie_pii_labeled_datetime vie_pii_international_phone_context""".split()
)


def folded(text: Column) -> Column:
    """Lower case, with the two letters that case-insensitive patterns take for s and i."""
    return F.translate(F.lower(text), "ſı", "si")


def holds_any(low: Column, literals: list[str]) -> Column:
    cond = F.contains(low, F.lit(literals[0]))
    for x in literals[1:]:
        cond = cond | F.contains(low, F.lit(x))
    return cond




def _tail_as_lookahead(java: str) -> str:
    """Text that a pattern consumes behind its value becomes a look-ahead, so that the value ends the match."""
    tail = r"\s*tháng"
    return java[: -len(tail)] + f"(?={tail})" if java.endswith(tail) else java


def _on_text(check):
    return lambda s: check(s["text"])


def _as_span(p: Pattern, k: int):
    return lambda s: F.struct(
        F.lit(p.entity_type).alias("entity_type"), s["start"].alias("start"), s["end"].alias("end"), F.lit(p.score).alias("score"), F.lit(p.name).alias("pattern"), s["text"].alias("text"), F.lit(k).alias("ord")
    )


def find_spans(text: Column | str, bank: Iterable[Pattern], validators: dict | None = None) -> Column:
    """All spans of a bank's patterns in bank order; validators map a pattern's name to a function of the value."""
    text = F.col(text) if isinstance(text, str) else text
    parts = []
    for k, p in enumerate(bank):
        found = match_spans(text, _tail_as_lookahead(p.java))
        if validators and p.name in validators:
            found = F.filter(found, _on_text(validators[p.name]))
        spans = F.transform(found, _as_span(p, k))
        if p.name in ANCHORS:
            spans = F.when(holds_any(folded(text), ANCHORS[p.name]), spans).otherwise(F.expr(EMPTY))
        if p.name in NEEDS_DIGIT:
            spans = F.when(text.rlike(r"(?U)\d"), spans).otherwise(F.expr(EMPTY))
        parts.append(spans.cast(f"array<{SPAN}>"))
    return F.concat(*parts)


def find_spans_arrow(docs: DataFrame, bank: list[Pattern], text_col: str = "text", out: str = "spans") -> DataFrame:
    """Adds the same spans in one pass of Python's pattern engine over Arrow batches: for whole banks."""
    import re

    import pyarrow as pa

    records = [(p.name, p.entity_type, p.score, p.regex, re.IGNORECASE if p.ignore_case else 0) for p in bank]
    span = pa.struct([("entity_type", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("pattern", pa.string()), ("text", pa.string()), ("ord", pa.int32())])

    literals = sorted({a for n, *_ in records for a in ANCHORS.get(n, ())})
    place = {a: i for i, a in enumerate(literals)}

    def run(batches):
        digit = re.compile(r"\d")
        compiled = [(k, n, e, s, re.compile(rx, flags), [place[a] for a in ANCHORS.get(n, ())], n in NEEDS_DIGIT) for k, (n, e, s, rx, flags) in enumerate(records)]
        for batch in batches:
            found, ends = [], [0]
            for text in batch.column(batch.schema.get_field_index(text_col)).to_pylist():
                if text:
                    low = text.casefold().replace("ı", "i")
                    have = [a in low for a in literals]  # each literal is looked for once
                    digits = digit.search(text) is not None
                    for k, name, entity, score, rx, anchors, needs in compiled:
                        if (needs and not digits) or (anchors and not any(have[i] for i in anchors)):
                            continue
                        for m in rx.finditer(text):
                            a, b = m.span("value")
                            if a < b:
                                found.append((entity, a, b, score, name, text[a:b], k))
                ends.append(len(found))
            columns = list(zip(*found, strict=True)) or [()] * len(span)
            flat = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, span, strict=True)], fields=list(span))
            yield batch.append_column(out, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat))

    from pyspark.sql.types import StructType

    schema = StructType.fromDDL(", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields) + f", {out} array<{SPAN}>")
    return docs.mapInArrow(run, schema)


def at_least(spans: Column, threshold: float) -> Column:
    return F.filter(spans, lambda s: s["score"] >= threshold)


def allowed(spans: Column, values: list[str], regex: bool = False) -> Column:
    """Drops spans whose text is on an allow list (exact, or matching one of the patterns)."""
    if not values:
        return spans
    if regex:
        return F.filter(spans, lambda s: ~s["text"].rlike("|".join(f"^(?:{v})$" for v in values)))
    return F.filter(spans, lambda s: ~s["text"].isin(values))


def _ordered(spans: Column, *keys) -> Column:
    """Spans sorted by key functions; the original place breaks ties."""
    keyed = F.transform(spans, lambda s, i: F.struct(*[k(s).alias(f"k{n}") for n, k in enumerate(keys)], i.alias("at"), s.alias("s")))
    return F.transform(F.array_sort(keyed), lambda x: x["s"])


def remove_contained(spans: Column) -> Column:
    """Drops repeated spans, those of score 0, and those inside a better span of their type.

    Order: score descending, start, length descending, then type and pattern place.  Containment is transitive, so a span goes if any
    better one holds it.  The fold goes by start and falling end and carries the spans that are still open.
    """
    better = (lambda s: -s["score"], lambda s: s["start"], lambda s: s["start"] - s["end"], lambda s: s["entity_type"], lambda s: s["ord"], lambda s: s["pattern"])
    every = _ordered(F.filter(spans, lambda s: s["score"] > 0), *better)
    # repeated spans are neighbours now (array_distinct compares all pairs of structs)
    ranked = let(every, lambda xs: F.filter(xs, lambda s, i: (i == 0) | ~s.eqNullSafe(F.get(xs, i - 1))))
    placed = F.transform(ranked, lambda s, i: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), i.alias("i"), s["end"].alias("end"), s["entity_type"].alias("kind")))
    kind = "array<struct<start:int,back:int,i:int,end:int,kind:string>>"

    def step(a, x):
        held = F.filter(a["at"], lambda y: y["end"] > x["start"])
        inside = F.exists(held, lambda y: (y["kind"] == x["kind"]) & (y["end"] >= x["end"]) & (y["i"] < x["i"]))
        return F.struct(F.concat(held, F.array(x)).alias("at"), F.when(inside, a["out"]).otherwise(F.concat(a["out"], F.array(x["i"]))).alias("out"))

    kept = fold(F.array_sort(placed.cast(kind)), F.array().cast(kind), F.array().cast("array<int>"), step)
    return let(ranked, lambda r: F.transform(F.array_sort(kept), lambda i: F.get(r, i)))


def dedupe_exact(spans: Column) -> Column:
    """Of spans with one start and end the best (the first of equals), by start and end."""
    ordered = _ordered(spans, lambda s: s["start"], lambda s: s["end"], lambda s: -s["score"])
    same = lambda x, y: (x["start"] == y["start"]) & (x["end"] == y["end"])
    return let(ordered, lambda xs: F.filter(xs, lambda s, i: (i == 0) | ~F.coalesce(same(s, F.get(xs, i - 1)), F.lit(False))))


def merge_overlaps(spans: Column, span_type: str = SPAN) -> Column:
    """By start and falling score: a span that overlaps the last kept one replaces it if its score is higher, else it goes."""
    ordered = _ordered(spans, lambda s: s["start"], lambda s: -s["score"]).cast(f"array<{span_type}>")

    def step(a, s):
        last = a["at"]
        apart = last.isNull() | (s["start"] >= last["end"])
        out = F.when(apart & last.isNotNull(), F.concat(a["out"], F.array(last))).otherwise(a["out"])
        return F.struct(F.when(apart | (s["score"] > last["score"]), s).otherwise(last).alias("at"), out.alias("out"))

    empty = F.array().cast(f"array<{span_type}>")
    return fold(ordered, F.lit(None).cast(span_type), empty, step, lambda last, out: F.when(last.isNull(), out).otherwise(F.concat(out, F.array(last))))


def intersection(spans: Column, others: Column) -> Column:
    """Spans that overlap a span of the same type in `others`."""
    return F.filter(spans, lambda a: F.exists(others, lambda b: (a["entity_type"] == b["entity_type"]) & (a["start"] < b["end"]) & (b["start"] < a["end"])))


def anonymize(text: Column, spans: Column, guarded: bool = False) -> Column:
    """Left to right, <TYPE> for each span; a span that begins before the last one's end is skipped.

    guarded: spans that are empty or reach out of the text are skipped too.
    """
    if guarded:
        spans = F.filter(spans, lambda s: (s["start"] >= 0) & (s["start"] < s["end"]) & (s["end"] <= F.length(text)))
    ordered = _ordered(spans, lambda s: s["start"], lambda s: s["end"])

    def put(parts: Column) -> Column:
        def step(a, s):
            shown = F.concat(piece(parts, a["at"], s["start"] - a["at"]), F.lit("<"), s["entity_type"], F.lit(">"))
            return F.when(s["start"] < a["at"], a).otherwise(F.struct(s["end"].alias("at"), F.concat(a["out"], F.array(shown)).alias("out")))

        tail = lambda at: piece(parts, at, F.greatest(F.length(text) - at, F.lit(0)))
        return fold(ordered, F.lit(0), F.array().cast("array<string>"), step, lambda at, out: F.concat(F.array_join(out, ""), tail(at)))

    return F.when(F.size(spans) > 0, let(pieces_of(text), put)).otherwise(text)


def anonymize_right(text: Column, spans: Column, default: str = "MISC") -> Column:
    """Right to left by start (later ones of equal starts first), every span spliced, overlaps too; no type: `default`."""
    ordered = _ordered(spans, lambda s: -s["start"])
    splice = lambda t, s: F.concat(F.substring(t, F.lit(1), s["start"]), F.lit("<"), F.coalesce(s["entity_type"], F.lit(default)), F.lit(">"), F.substring(t, s["end"] + 1, F.length(t)))
    return F.aggregate(ordered, text, splice)


def greedy_match(predicted: Column, gold: Column, typed: bool = True) -> Column:
    """Indices of the gold spans that predictions take, in order of the predictions (-1: none).

    Each prediction takes the first free gold span that overlaps it (and has its type).
    """
    numbered = F.transform(gold, lambda g, i: F.struct(g["start"].alias("start"), g["end"].alias("end"), g["entity_type"].alias("entity_type"), i.alias("i")))

    def step(taken, p):
        fits = lambda g: (p["start"] < g["end"]) & (g["start"] < p["end"]) & ~F.array_contains(taken, g["i"]) & ((g["entity_type"] == p["entity_type"]) if typed else F.lit(True))
        found = F.filter(numbered, fits)
        return F.concat(taken, F.array(F.when(F.size(found) > 0, F.get(found, F.lit(0))["i"]).otherwise(F.lit(-1))))

    return F.aggregate(predicted, F.array().cast("array<int>"), step)


def label_spans(mask: Column, labels: Column) -> Column:
    """Gold spans with the entity type that a label map gives; unmapped ones go."""
    typed = F.transform(mask, lambda m: F.struct(labels[m["label"]].alias("entity_type"), m["start"].alias("start"), m["end"].alias("end"), m["label"].alias("label")))
    return F.filter(typed, lambda m: m["entity_type"].isNotNull())


def numbered_ids(spans: Column, prefix: str) -> Column:
    """Ids prefix_0001, prefix_0002 and so on."""
    return F.transform(spans, lambda s, i: F.concat(F.lit(prefix), F.lpad((i + 1).cast("string"), 4, "0")))


def next_id(prefix: str, existing: Column) -> Column:
    """The smallest free numbered id."""
    candidates = F.transform(F.sequence(F.lit(1), F.size(existing) + 1), lambda i: F.concat(F.lit(prefix), F.lpad(i.cast("string"), 4, "0")))
    return F.get(F.array_except(candidates, existing), F.lit(0))


def parse_markup(text: Column) -> tuple[Column, Column]:
    """Clean text and spans of inline markup [value]<label>."""
    rx = r"\[([^\]]+)\]<([A-Za-z_]+)>"
    clean = F.regexp_replace(text, rx, "$1")
    gaps, values, labels = F.split(text, rx, -1), F.regexp_extract_all(text, F.lit(rx), F.lit(1)), F.regexp_extract_all(text, F.lit(rx), F.lit(2))
    pieces = F.zip_with(F.arrays_zip(F.slice(gaps, 1, F.size(values)).alias("g"), values.alias("v")), labels, lambda x, y: F.struct(x["g"].alias("g"), x["v"].alias("v"), y.alias("label")))
    empty = F.array().cast("array<struct<start:int,end:int,label:string,value:string>>")

    def step(a, x):
        start = a["at"] + F.length(x["g"])
        span = F.struct(start.alias("start"), (start + F.length(x["v"])).alias("end"), x["label"].alias("label"), x["v"].alias("value"))
        return F.struct((start + F.length(x["v"])).alias("at"), F.concat(a["out"], F.array(span)).alias("out"))

    return clean, fold(pieces, F.lit(0), empty, step)

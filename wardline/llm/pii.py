"""Operator 10 (native): personal data by patterns, checksums and nearby words.

Patterns propose spans, validators confirm them (octets of an address, digit counts, Luhn, mod-97), and words near a span raise its
score.  Base kinds (email, ip, card, phone) are kept whenever they validate; the added kinds (iban, ssn, secret) need a
score of MIN_SCORE.  All of it is built-in expressions over one row at a time: no shuffle, no Python.

The Java patterns use possessive quantifiers and start only where a run begins, which gives the same leftmost non-overlapping
matches as the plain patterns in linear time and constant stack.  Positions are code points, the end exclusive.

Null counts as empty: no spans.  Repeated rows give repeated rows, a null id stays null; an empty table gives none.  Further columns stay,
also those whose names differ only in case; a column named pii stays as pii_input.  Spans of equal start go by the order of KINDS.
A text's spans take time about in proportion to their number, as offsets are summed in runs and texts are cut from pieces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as c

MIN_SCORE, BOOST, NEAR = 0.5, 0.35, 40
#: Elements of a run of a fold, and characters of a text's pieces: neither changes a result.
RUN, PIECE = 128, 1024

#: kind, pattern, literal that a match needs, base score, words that raise it; base kinds first, in the order of the digest.
KINDS = [
    ("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.9, "mail|contact|write|kontakt|correo"),
    ("ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", ".", 0.6, "ip|address|host|server|from"),
    ("card", r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,18}+(?![ -]?[0-9])", "", 0.7, "card|credit|visa|payment|karte|carte|tarjeta"),
    ("phone", r"\+[0-9][ ().0-9-]+[0-9]", "+", 0.6, "phone|call|tel|mobile|fax"),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}+(?![A-Za-z0-9])", "", 0.6, "iban|account|bank|konto|compte|cuenta"),
    ("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "-", 0.3, "ssn|social|security|insurance"),
    ("secret", r"(?i)(?<![A-Za-z0-9])(?:token|secret|password|passwd|api[_-]?key)[ \t]*[=:][ \t]*\"[^\"\s]{8,200}\"", "\"", 0.8, "key|login|auth"),
]
BASE = [k[0] for k in KINDS[:4]]
_NONE = "cast(array() as array<struct<kind:string,start:int,end:int,score:double,text:string>>)"


def _digits(v: str) -> str:
    return f"regexp_replace({v}, '[^0-9]', '')"


def _valid(kind: str, v: str) -> str:
    """SQL condition under which a match of the kind is kept."""
    if kind == "ip":
        return f"forall(split({v}, '[.]'), p -> cast(p as double) <= 255)"
    if kind == "card":
        return f"luhn_check({_digits(v)})"
    if kind == "phone":
        return f"length({_digits(v)}) between 8 and 15"
    if kind == "iban":  # letters count from 10; the first four characters go last; the number modulo 97 is 1
        plain = f"replace({v}, ' ', '')"
        turned = f"concat(substring({plain}, 5), substring({plain}, 1, 4))"
        return f"aggregate(split({turned}, ''), 0, (a, ch) -> if(ch = '', a, if(ch rlike '[0-9]', (a * 10 + cast(ch as int)) % 97, (a * 100 + ascii(ch) - 55) % 97))) = 1"
    return "true"


def _let(name: str, value: str, body: str) -> str:
    """SQL of body with the value evaluated once under a name (inside lambdas a plain expression would be evaluated for each element)."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _folded(items: str, empty: str, total: str, merge: str, step: str) -> str:
    """SQL of the concatenated outputs of a fold over an array named `items`, RUN elements at a time.

    Appending to an array copies it, so one fold over n elements would take n * n steps.  Each run starts at what the runs before it
    add up to: `total` is a run's own sum (over elements x from the sum t), `merge` joins two sums t and u.
    """
    sums = f"transform(sequence(0, (size({items}) - 1) div {RUN}), b -> aggregate(slice({items}, b * {RUN} + 1, {RUN}), 0, (t, x) -> {total}))"
    run = f"aggregate(slice({items}, b * {RUN} + 1, {RUN}), named_struct('at', aggregate(slice(sums, 1, b), 0, (t, u) -> {merge}), 'out', {empty}), (a, x) -> {step}, a -> a.out)"
    return _let("sums", sums, f"flatten(transform(sequence(0, size(sums) - 1), b -> {run}))")


def _piece(start: str, length: str) -> str:
    """SQL of a substring (start from 0) by way of the pieces of PIECE characters, as substring() walks from the text's beginning."""
    return f"substring(array_join(slice(_pieces, cast({start} div {PIECE} as int) + 1, cast(({start} + {length}) div {PIECE} - {start} div {PIECE} as int) + 1), ''), {start} % {PIECE} + 1, {length})"


def _spans(kind: str, found: str, gaps: str, score: float, near: str) -> str:
    """SQL of the kind's spans from its matches and the texts between them."""
    span = f"named_struct('kind', '{kind}', 'start', a.at + length(x.g), 'end', a.at + length(x.g) + length(x.m), 'score', cast({score} as double), 'text', x.m)"
    step = f"named_struct('at', a.at + length(x.g) + length(x.m), 'out', concat(a.out, array({span})))"
    fold = _let("found", f"zip_with(slice({gaps}, 1, size({found})), {found}, (g, m) -> named_struct('g', g, 'm', m))", _folded("found", _NONE, "t + length(x.g) + length(x.m)", "t + u", step))
    around = f"lower(concat({_piece(f'greatest(s.start - {NEAR}, 0)', f'least(s.start, {NEAR})')}, ' ', {_piece('s.end', str(NEAR))}))"
    raised = f"least(1.0D, s.score + if({around} rlike '(?:^|[^a-z])(?:{near})', {BOOST}D, 0.0D))"
    scored = f"transform(filter({fold}, s -> {_valid(kind, 's.text')}), s -> named_struct('kind', s.kind, 'start', s.start, 'end', s.end, 'score', {raised}, 'text', s.text))"
    return scored if kind in BASE else f"filter({scored}, s -> s.score >= {MIN_SCORE})"


def _flat(docs: DataFrame, column: str) -> tuple[DataFrame, str]:
    """docs with columns c0, c1 and so on, and which of them is `column` (the exact name first, then one that differs in case)."""
    names = docs.columns
    at = names.index(column) if column in names else [x.lower() for x in names].index(column.lower())
    return docs.toDF(*[f"c{i}" for i in range(len(names))]), f"c{at}"


def _pieces(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))


def find_pii(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds pii: array<struct<kind, start, end, score, text>>, by kind as in KINDS, then by start."""
    names = [f"{x}_input" if x.lower() == "pii" else x for x in docs.columns]
    work, text = _flat(docs, text_col)
    work = work.withColumn("_text", F.coalesce(F.col(text), F.lit("")))
    for kind, pattern, literal, _, _ in KINDS:
        found = F.regexp_extract_all("_text", F.lit(pattern), F.lit(0))
        if literal:
            found = F.when(F.contains("_text", F.lit(literal)), found).otherwise(F.array().cast("array<string>"))
        work = work.withColumn(f"_m_{kind}", found)
    none = F.array().cast("array<string>")
    for kind, pattern, *_ in KINDS:
        work = work.withColumn(f"_g_{kind}", F.when(F.size(f"_m_{kind}") > 0, F.split("_text", pattern, -1)).otherwise(none))
    some = F.greatest(*[F.size(f"_m_{k[0]}") for k in KINDS]) > 0
    work = work.withColumn("_pieces", F.when(some, _pieces(F.col("_text"))).otherwise(none))
    parts = [f"if(size(_m_{k}) > 0, {_spans(k, f'_m_{k}', f'_g_{k}', score, near)}, {_NONE})" for k, _, _, score, near in KINDS]
    work = work.withColumn("pii", F.expr(f"concat({', '.join(parts)})"))
    return work.select(*[f"c{i}" for i in range(len(names))], "pii").toDF(*names, "pii")


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    found = c.distinct_names(found, id_col, "pii")
    count = lambda kind: F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("pii", lambda s: s["kind"].isin(BASE))
    return found.select(F.col(id_col).cast("long").alias("doc_id"), *map(count, BASE), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("pii")).alias("spans"))


def redact(found: DataFrame, text_col: str = "text") -> DataFrame:
    """Puts <KIND> in place of each span of pii; overlapping spans become one, named after the first."""
    names = found.columns
    work, text = _flat(found, text_col)
    spans = f"c{names.index('pii')}"
    some = F.size(spans) > 0
    order = "(x, y) -> case when x.start < y.start then -1 when x.start > y.start then 1 when x.end > y.end then -1 when x.end < y.end then 1 else 0 end"
    work = work.withColumn("_order", F.expr(f"array_sort({spans}, {order})")).withColumn("_pieces", F.when(some, _pieces(F.col(text))))
    put = f"named_struct('at', x.end, 'out', concat(a.out, array({_piece('a.at', 'x.start - a.at')}, concat('<', upper(x.kind), '>'))))"
    step = f"if(x.start < a.at, named_struct('at', greatest(a.at, x.end), 'out', a.out), {put})"
    shown = _folded("_order", "cast(array() as array<string>)", "greatest(t, x.end)", "greatest(t, u)", step)
    last = f"array_max(transform({spans}, x -> x.end))"
    out = F.expr(f"array_join(concat({shown}, array({_piece(last, f'length({text}) - {last}')})), '')")
    work = work.withColumn(text, F.when(some, out).otherwise(F.col(text)))
    return work.select(*[f"c{i}" for i in range(len(names))]).toDF(*names)

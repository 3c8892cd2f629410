"""Column functions over text: pattern spans with offsets, scripts, n-grams.

Offsets are code points, half-open and 0-based.  Everything here is built-in expressions.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements of a run of a fold, and characters of a text's pieces: neither changes a result.
RUN, PIECE = 128, 1024


def let(value: Column, body) -> Column:
    """body(value) with the value evaluated once (inside lambdas a plain expression would be evaluated for each element)."""
    return F.transform(F.array(value), body)[0]


def fold(items: Column, start: Column, empty: Column, step, finish=None) -> Column:
    """A fold that carries a state and puts out elements: step(a, x) gives struct(at: the state, out: the elements so far).

    Appending to an array copies it, so elements are folded in runs of RUN, whose outputs are joined at the end: time goes with the
    number of elements, not with its square.  finish(state, elements) gives the result; by default the elements.
    """

    def runs_of(xs: Column) -> Column:
        last = F.greatest(F.floor((F.size(xs) - 1) / RUN).cast("int"), F.lit(0))
        return F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(xs, b * RUN + 1, RUN))

    def one_run(a, run):
        inner = F.aggregate(run, F.struct(a["at"].alias("at"), empty.alias("out")), step)
        return let(inner, lambda r: F.struct(r["at"].alias("at"), F.concat(a["out"], F.array(r["out"])).alias("out")))

    done = finish or (lambda at, out: out)
    begin = F.struct(start.alias("at"), F.array(empty).alias("out"))
    return let(items, lambda xs: F.aggregate(runs_of(xs), begin, one_run, lambda a: done(a["at"], F.flatten(a["out"]))))


def pieces_of(text: Column) -> Column:
    """The text in pieces of PIECE characters, for piece(): substring() walks from the text's beginning each time."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))


def piece(pieces: Column, start: Column, length: Column) -> Column:
    """Substring (start from 0) of a text given in pieces."""
    first = F.floor(start / PIECE).cast("int")
    parts = F.slice(pieces, first + 1, F.greatest(F.floor((start + length) / PIECE).cast("int") - first, F.lit(0)) + 1)
    return F.substring(F.array_join(parts, ""), start - first * PIECE + 1, length)


SPAN = "struct<entity_type:string,start:int,end:int,score:double,pattern:string,text:string,ord:int>"


def group_index(java: str, name: str = "value") -> int:
    """Number of a named group in a Java pattern."""
    at, n, i, in_class = java.find(f"(?<{name}>"), 0, 0, False
    if at < 0:
        return 0
    while i <= at:
        ch = java[i]
        if ch == "\\":
            i += 1
        elif ch == "[":
            in_class = True
        elif ch == "]":
            in_class = False
        elif ch == "(" and not in_class and (java[i + 1] != "?" or (java[i + 2] == "<" and java[i + 3] not in "=!")):
            n += 1
        i += 1
    return n


def match_spans(text: Column | str, java: str, group: str | None = "value") -> Column:
    """array<struct<start,end,text>> of all matches of a pattern (or of its named group, which must end the match or be
    followed by a fixed tail that the pattern holds in a look-ahead).

    Match i begins after the i-th piece between matches and all earlier matches; a group that ends its match begins at the
    match's end less its own length.
    """
    text = F.col(text) if isinstance(text, str) else text
    index = group_index(java, group) if group else 0
    found, gaps = F.regexp_extract_all(text, F.lit(java), F.lit(0)), F.split(text, java, -1)
    values = F.regexp_extract_all(text, F.lit(java), F.lit(index)) if index else found
    pieces = F.zip_with(F.arrays_zip(gaps.alias("g"), found.alias("m")), values, lambda x, v: F.struct(F.length(x["g"]).alias("gap"), F.length(x["m"]).alias("len"), v.alias("v")))
    pieces = F.filter(pieces, lambda x: x["v"].isNotNull() & x["len"].isNotNull())
    empty = F.array().cast("array<struct<start:int,end:int,text:string>>")


    def step(a, x):
        end = a["at"] + x["gap"] + x["len"]
        span = F.struct((end - F.length(x["v"])).alias("start"), end.alias("end"), x["v"].alias("text"))
        return F.struct(end.alias("at"), F.concat(a["out"], F.array(span)).alias("out"))

    spans = F.when(F.size(found) > 0, fold(pieces, F.lit(0), empty, step))
    return F.coalesce(F.filter(spans, lambda s: s["start"] < s["end"]), empty)


def slice_text(text: Column, start: Column, end: Column) -> Column:
    return F.substring(text, start + 1, end - start)


def latin_letter_ratio(text: Column) -> Column:
    """Share of Latin letters among letters; 1.0 where there is none."""
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]", ""))
    latin = F.length(F.regexp_replace(text, r"[^\p{IsLatin}&&\p{L}]", ""))
    return F.when(letters > 0, latin / letters).otherwise(F.lit(1.0))


def is_mostly_latin(text: Column, cutoff: float = 0.5) -> Column:
    return latin_letter_ratio(text) >= cutoff


def normalized(text: Column) -> Column:
    """Lower-cased, white space runs as one blank, one blank at each side."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), r"(?U)\s+", " ")), F.lit(" "))


def char_ngrams(text: Column, low: int = 3, high: int = 5) -> Column:
    """All character n-grams of the normalized text, with repetition."""
    empty = F.array().cast("array<string>")

    def of(chars: Column, n: int) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(chars) - n, F.lit(0)))
        return F.when(F.size(chars) >= n, F.transform(starts, lambda i: F.concat(*[F.get(chars, i + k) for k in range(n)]))).otherwise(empty)

    # bound as a lambda's variable, the text is normalized and taken apart once and not for each n-gram
    held = F.transform(F.array(F.split(F.coalesce(normalized(text), F.lit("")), "")), lambda chars: F.concat(*[of(chars, n) for n in range(low, high + 1)]))
    return held[0]


def luhn_valid(value: Column) -> Column:
    """Whether the digits of a value number 12 at least and pass the Luhn check."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    return (F.length(digits) >= 12) & F.call_function("luhn_check", digits)


def coerce_label(value: Column) -> Column:
    """Tri-state label of loose text: null, empty and 'null' are unknown."""
    v = F.lower(F.trim(value))
    return F.when(v.isin("true", "1", "yes"), F.lit(True)).when(v.isin("false", "0", "no"), F.lit(False))


#: Source registry: slug to whether it has images.
SOURCES = {
    "existing_repo_pii": False, "webpii": True, "local_vi_prompt_injection": False, "llmail_inject_challenge": False, "deepset_prompt_injections": False,
    "cyberseceval3_visual_prompt_injection": True, "vihsd_topic_safety": False, "vlguard": True, "mm_safetybench": True, "unsafebench": True, "meddies_pii": False,
}


def known_source(slug: str) -> str:
    if slug not in SOURCES:
        raise ValueError(f"unknown source {slug!r}; there are {', '.join(sorted(SOURCES))}")
    return slug


def input_id(slug: str, index: Column) -> Column:
    """safety_v0_<slug>_000001 and on; an unknown slug is an error."""
    known_source(slug)
    return F.format_string(f"safety_v0_{slug}_%06d", index)


def email_text(subject: Column, body: Column) -> Column:
    has_subject, has_body = F.length(F.coalesce(F.trim(subject), F.lit(""))) > 0, F.length(F.coalesce(F.trim(body), F.lit(""))) > 0
    return F.when(has_subject & has_body, F.concat(F.lit("Subject: "), F.trim(subject), F.lit("\n\n"), F.trim(body))).when(has_subject, F.concat(F.lit("Subject: "), F.trim(subject))).otherwise(F.coalesce(F.trim(body), F.lit("")))

"""Language of a text: a default detector over frequent words and letters, injected detectors, and filters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import let

ALLOWED = ("en", "vi")
#: Frequent words of each language, and letters that only Vietnamese writes; ties go to the language named first.
COMMON = {
    "en": ["the", "and", "of", "to", "is", "that", "you", "was", "for", "with", "are", "this", "have", "not", "from"],
    "vi": ["và", "của", "là", "không", "có", "được", "cho", "người", "những", "với", "này", "một", "các", "trong", "bạn"],
    "fr": ["le", "la", "les", "et", "des", "est", "une", "que", "dans", "pour", "pas", "qui", "sur", "avec", "vous"],
    "de": ["der", "die", "das", "und", "ist", "nicht", "ein", "eine", "den", "mit", "von", "sich", "auf", "für", "dem"],
    "es": ["el", "los", "las", "y", "que", "una", "por", "con", "para", "es", "del", "se", "como", "pero", "su"],
}
VIETNAMESE = "ăđơưạảấầẩẫậắằẳẵặẹẻẽếềểễệỉịọỏốồổỗộớờởỡợụủứừửữựỳỵỷỹ"
#: One match for each word with such letters: from its first one to its end.  The bounds are looked at before the letters.
_LETTERED = f"[{min(VIETNAMESE)}-{max(VIETNAMESE)}&&[{VIETNAMESE}]]\\p{{L}}*"
_PLAIN = {k: [w for w in v if not (k == "vi" and set(w) & set(VIETNAMESE))] for k, v in COMMON.items()}


def word_scores(text: Column) -> Column:
    """array<int>, in the order of COMMON: how many words of the text are frequent ones of a language, or hold its letters.

    The text is folded and cut into words once; only the frequent words among them are looked at for each language.
    """
    known = sorted({w for v in _PLAIN.values() for w in v})

    def among(words: Column, these: list[str]) -> Column:
        return F.filter(words, lambda w: w.isin(these))

    def counts(low: Column, hits: Column) -> Column:
        size = {k: F.size(among(hits, v)) for k, v in _PLAIN.items()}
        size["vi"] = size["vi"] + F.size(F.regexp_extract_all(low, F.lit(_LETTERED), F.lit(0)))
        return F.array(*size.values())

    def found(low: Column) -> Column:
        words = F.regexp_extract_all(low, F.lit(r"\p{L}+"), F.lit(0))
        return let(among(words, known), lambda hits: counts(low, hits))

    return let(F.lower(text), found)


def detect_language(text: Column) -> Column:
    """The language with the most of its words; null for blank text and where no language has any."""
    names = F.array(*map(F.lit, COMMON))
    first = lambda s: F.element_at(names, F.array_position(s, F.array_max(s)).cast("int"))
    return let(word_scores(F.coalesce(text, F.lit(""))), lambda s: F.when(F.array_max(s) > 0, first(s)))


def with_language(docs: DataFrame, text_col: str = "text", out: str = "language", detector: Callable[[str], str | None] | None = None) -> DataFrame:
    """Adds the language of each text; an injected detector (text -> code or None) runs over Arrow batches, never on blank text."""
    if detector is None:
        return docs.withColumn(out, detect_language(F.col(text_col)))
    import pyarrow as pa

    def run(batches):
        for b in batches:
            texts = b.column(b.schema.get_field_index(text_col)).to_pylist()
            yield b.append_column(out, pa.array([detector(t) if t and t.strip() else None for t in texts], pa.string()))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{fields}, `{out}` string")


def is_allowed(language: Column, allowed: tuple[str, ...] = ALLOWED, keep_undetectable: bool = False) -> Column:
    # a filter takes the column's whole expression in, so it is named once
    return let(language, lambda x: F.when(x.isNull(), F.lit(keep_undetectable)).otherwise(x.isin(*allowed)))


def filtered(rows: DataFrame, keep: Column) -> tuple[DataFrame, DataFrame]:
    """The rows that stay, and one row (kept, dropped)."""
    keep = F.coalesce(keep, F.lit(False))
    kept = rows.select(keep.alias("kept")).agg(F.count_if("kept").alias("kept"), F.count(F.lit(1)).alias("all"))
    return rows.where(keep), kept.select("kept", (F.col("all") - F.col("kept")).alias("dropped"))

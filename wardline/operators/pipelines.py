"""Named detection pipelines: pattern banks, an optional tagger bridged in, and an optional resolver.

A tagger is injected (text -> [(token, tag)]); without one, pipelines that use a tagger raise an error when they run.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import BASE_BANK, RECALL_BANK, VIE_BANK, Pattern
from ..functions.text import SPAN, slice_text
from . import entities, spans

#: Types of the tagger's labels (fixed values).
TAGGER_LABELS = {"PER": "PERSON", "ORG": "ORGANIZATION", "LOC": "LOCATION"}
RECOGNIZER = "CustomPatternRecognizer"


class Tagger(Protocol):
    """What a tagger is: called with a text, it gives tokens with BIO tags."""

    def __call__(self, text: str) -> list[tuple[str, str]]: ...


class Recognizer(Protocol):
    """What a recognizer of one's own is: from a text column an array of spans (functions.text.SPAN)."""

    def __call__(self, text: Column) -> Column: ...


@dataclass(frozen=True)
class Pipeline:
    name: str
    bank: tuple[Pattern, ...] = ()
    tagger: bool = False
    resolve: bool = False
    extras: bool = False  # takes recognizers of one's own


_BASE, _RECALL, _VIE = tuple(BASE_BANK), tuple(RECALL_BANK), tuple(VIE_BANK)
REGISTRY = {
    p.name: p
    for p in (
        Pipeline("baseline_presidio"),
        Pipeline("regex_only", _BASE),
        Pipeline("regex_recall", _BASE + _RECALL),
        Pipeline("regex_recall_vie_pii", _BASE + _RECALL + _VIE),
        Pipeline("underthesea_ner", tagger=True),
        Pipeline("underthesea_regex", _BASE, tagger=True),
        Pipeline("underthesea_regex_recall", _BASE + _RECALL, tagger=True),
        Pipeline("underthesea_regex_recall_resolved", _BASE + _RECALL, tagger=True, resolve=True),
        Pipeline("hybrid_regex", _BASE, extras=True),
    )
}


def pipeline_names() -> list[str]:
    return sorted(REGISTRY)


def get_pipeline(name: str) -> Pipeline:
    if name not in REGISTRY:
        raise ValueError(f"unknown pipeline {name!r}; there are {', '.join(pipeline_names())}")
    return REGISTRY[name]


def bridged(text: Column, found: Column, requested: list[str], wrapper: str) -> Column:
    """A tagger's entities as spans: requested types only, score to 2 places, named DeepLearning_<wrapper>."""
    own = F.filter(found, lambda e: e["entity_type"].isin(requested))
    as_span = lambda e: F.struct(
        e["entity_type"].alias("entity_type"), e["start"].alias("start"), e["end"].alias("end"), F.round(e["score"], 2).alias("score"),
        F.lit(f"DeepLearning_{wrapper}").alias("pattern"), slice_text(text, e["start"], e["end"]).alias("text"), F.lit(10_000).alias("ord"),
    )
    return F.transform(own, as_span).cast(f"array<{SPAN}>")


def source_of(span: Column, recognizer: str = "recognizer", explained: str = "explained_by") -> Column:
    """Who found a span: its recognizer, else the one its explanation names, else 'unknown'; empty names count as none."""
    name = lambda k: F.nullif(span[k], F.lit(""))
    return F.coalesce(name(recognizer), name(explained), F.lit("unknown"))


def recognizer_of(span: Column) -> Column:
    """The recognizer of a span by its pattern: taggers put their own name there."""
    return F.when(span["pattern"].startswith("DeepLearning_"), span["pattern"]).otherwise(F.lit(RECOGNIZER))


def predict(
    docs: DataFrame, name: str, text_col: str = "text", tagger: Callable[[], Tagger] | None = None, extras: list[Recognizer] | None = None, threshold: float = 0.0,
    context_required: bool = False,
) -> DataFrame:
    """Adds spans (and, with a resolver, decisions: one for each candidate) of a named pipeline.

    Spans are deduplicated, then resolved, then cut off at the threshold.
    """
    p = get_pipeline(name)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = spans.find_spans_arrow(docs, list(p.bank), text_col) if p.bank else docs.withColumn("spans", F.expr(spans.EMPTY))
    if extras:
        if not p.extras:
            raise ValueError(f"{name} takes no recognizers of one's own")
        rows = rows.withColumn("spans", F.concat("spans", *[r(text).cast(f"array<{SPAN}>") for r in extras]))
    if p.tagger:
        if tagger is None:
            raise ValueError(f"{name} needs a tagger")
        rows = entities.tag(rows, tagger, TAGGER_LABELS, text_col, "_entities", gate=entities.gate(context_required))
        scored = entities.calibrate(text, F.col("_entities"))
        rows = rows.withColumn("spans", F.concat("spans", bridged(text, scored, list(TAGGER_LABELS.values()), "UndertheseaNER"))).drop("_entities")
    rows = rows.withColumn("spans", spans.remove_contained(F.col("spans")))
    if p.resolve:
        named = F.transform("spans", lambda s: F.struct(s["entity_type"].alias("entity_type"), s["start"].alias("start"), s["end"].alias("end"), recognizer_of(s).alias("recognizer")))
        rows = rows.withColumn("decisions", entities.resolve(text, named)).withColumn("spans", entities.resolved(F.col("spans"), F.col("decisions")))
    return rows.withColumn("spans", spans.at_least(F.col("spans"), threshold))


def validated(found: Column, check: Callable[[Column], Column]) -> Column:
    """Scores after a validation hook over a span's text: true gives 1.0, false 0.0, null keeps the score."""

    def scored(s: Column) -> Column:
        ok = check(s["text"])
        return s.withField("score", F.when(ok, F.lit(1.0)).when(~ok, F.lit(0.0)).otherwise(s["score"]))

    return F.transform(found, scored)


def digit_sum_check(value: Column) -> Column:
    """Whether the ninth digit of nine is the sum of the first eight modulo 10; null for anything else."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    total = F.aggregate(F.filter(F.split(F.substring(digits, 1, 8), ""), lambda d: d != ""), F.lit(0), lambda a, d: a + d.cast("int"))
    return F.when(F.length(digits) == 9, total % 10 == F.substring(digits, 9, 1).cast("int"))


def anonymize_default(text: Column, found: Column) -> Column:
    """<TYPE> in place of each span after conflicts are merged: of overlapping spans the better one counts."""
    return spans.anonymize(text, spans.merge_overlaps(found))

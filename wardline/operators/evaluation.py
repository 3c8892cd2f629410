"""Prompt-injection detectors as estimators, their registry, and evaluation under three training strategies.

none: the detector as it is; leave_one_out: each row under a model of all other rows; external: fitted once on other rows (several
pools of sources are united first).
"""

from __future__ import annotations

from functools import reduce
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import injection, metrics


class Detector(Protocol):
    """detect() adds score, action, is_injection, matched_rules and categories to rows with an id and a text column."""

    trains: bool

    def fit(self, examples: DataFrame) -> Detector: ...

    def detect(self, rows: DataFrame) -> DataFrame: ...


class RuleDetector:
    trains = False

    def fit(self, examples: DataFrame) -> RuleDetector:
        raise ValueError("rule_based_prompt_injection does not learn")

    def detect(self, rows: DataFrame) -> DataFrame:
        return injection.detect_rules(rows)


class NgramDetector:
    """Character n-gram naive Bayes; of the strongest grams the first three become rules char_ngram:<gram>, category model_based."""

    trains = True

    def __init__(self, id_col: str = "input_id", top_rules: int = 3):
        self.id_col, self.top_rules, self.model, self.facts = id_col, top_rules, None, None

    def fit(self, examples: DataFrame) -> NgramDetector:
        self.model = injection.fit(examples)
        self.facts = injection.class_facts(examples, self.model)
        return self

    def detect(self, rows: DataFrame) -> DataFrame:
        if self.model is None:
            raise ValueError("char_ngram_prompt_injection has to be fitted first")
        said = injection.predict(rows, self.model, self.facts, self.id_col)
        return rows.join(said, self.id_col).join(self._rules(rows), self.id_col, "left").select(*rows.columns, "score", "action", "is_injection", *self._named())

    def _rules(self, rows: DataFrame) -> DataFrame:
        grams = injection.evidence_grams(rows, self.model, self.facts, self.id_col).where(F.col("place") <= self.top_rules)
        first = F.transform(F.array_sort(F.collect_list(F.struct("place", "gram"))), lambda x: F.concat(F.lit("char_ngram:"), x["gram"]))
        return grams.groupBy(self.id_col).agg(first.alias("_rules"))

    @staticmethod
    def _named() -> list:
        none = F.array().cast("array<string>")
        hit = F.col("is_injection") & F.col("_rules").isNotNull()
        return [F.when(hit, F.col("_rules")).otherwise(none).alias("matched_rules"), F.when(F.col("is_injection"), F.array(F.lit("model_based"))).otherwise(none).alias("categories")]


DETECTORS = {"rule_based_prompt_injection": RuleDetector, "char_ngram_prompt_injection": NgramDetector}


def detector_names() -> list[str]:
    return sorted(DETECTORS)


def get_detector(name: str, **options) -> Detector:
    if name not in DETECTORS:
        raise ValueError(f"unknown detector {name!r}; there are {', '.join(detector_names())}")
    return DETECTORS[name](**options)


def pool(sources: dict[str, DataFrame], names: str) -> DataFrame:
    """Rows of several named sources (a comma-separated list), one behind the other."""
    wanted = [n.strip() for n in names.split(",") if n.strip()]
    unknown = [n for n in wanted if n not in sources]
    if unknown or not wanted:
        raise ValueError(f"unknown sources {unknown}; there are {', '.join(sorted(sources))}")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (sources[n] for n in wanted))


def decisions(rows: DataFrame, detector: str, strategy: str = "none", examples: DataFrame | None = None) -> DataFrame:
    """Rows (input_id, label, expected_action if there, score, action, is_injection) of a detector over rows input_id, text, label."""
    keep = [c for c in ("input_id", "label", "expected_action") if c in rows.columns]
    own = get_detector(detector)
    if strategy == "none":
        return own.detect(rows).select(*keep, "score", "action", "is_injection")
    if strategy not in ("leave_one_out", "external"):
        raise ValueError(f"unknown strategy {strategy!r}; there are none, leave_one_out, external")
    if not own.trains:
        raise ValueError(f"{detector} does not learn")
    if strategy == "external":
        if examples is None:
            raise ValueError("the external strategy needs examples")
        return own.fit(examples).detect(rows).select(*keep, "score", "action", "is_injection")
    scored = injection.predict_leave_one_out(rows, "input_id").drop("label")
    said = rows.select(*keep).join(scored, "input_id")
    return said.withColumn("action", injection.action_of(F.col("score"), 0.5, 0.85)).withColumn("is_injection", F.col("score") >= 0.5)


def evaluate(said: DataFrame) -> DataFrame:
    """One row of confusion counts, rates and the action accuracy of decisions."""
    rates = metrics.confusion(said, F.col("label") == 1, F.col("is_injection"))
    if "expected_action" in said.columns:
        return rates.crossJoin(metrics.action_accuracy(said))
    return rates.withColumn("action_accuracy", F.lit(None).cast("double"))

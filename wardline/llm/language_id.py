"""Operator 4: language identification.

A sparse multinomial logistic regression over TF-IDF weights of hashed character n-grams (1 to 3 characters of the lower-cased
text, white space runs as one blank), trained by follow-the-regularised-leader with elastic-net penalties; the
temperature that calibrates its probabilities is fitted on training rows held back for that.

The regression is fitted on about PER_LANGUAGE labelled rows of each language and SAMPLE in all, chosen by a hash of id and text, so rare
languages are whole and frequent ones bounded; they reach the driver as vectors of DIMS places at most, never as texts.  Document
frequencies come from all rows that may be learned from.  The number of languages has no limit; each takes DIMS weights.  Every row is
predicted from its whole text and nothing else.  A text without letters, or null, is `und` with score 0; so is every text where nothing
could be learned.  Of equally likely languages the first by name wins.  Repeated rows give equal rows, a null id stays null; an empty
table gives none; further columns are ignored, also those whose names differ only in case.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as c
from .features import Ftrl, softmax, temperature_of

DIMS, ORDERS = 1 << 15, (1, 2, 3)
#: Bounds of the training sample: rows of a language, and rows in all (fewer of each where there are many languages).
PER_LANGUAGE, SAMPLE = 600, 60_000
EPOCHS, HELD_BACK = 6, 5
#: Characters of a text that are turned into features at a time.
STEP = 1 << 18
SCHEMA = "doc_id long, lang_pred string, score double"
_LETTER = regex.compile(r"\p{L}")
_MUL = [np.uint32(x) for x in (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35)]


def counts(text: str) -> np.ndarray:
    """How often each hashed n-gram occurs in the whole text."""
    text = " " + " ".join(text.lower().split()) + " "
    out = np.zeros(DIMS, np.int64)
    for at in range(0, len(text), STEP):
        u = np.frombuffer(text[at : at + STEP + max(ORDERS) - 1].encode("utf-32-le", "surrogatepass"), np.uint32)
        own = min(STEP, len(text) - at)
        for n in ORDERS:
            m = min(own, len(u) - n + 1)
            if m <= 0:
                continue
            h = np.full(m, np.uint32(n))
            for j in range(n):
                h = (h ^ u[j : j + m]) * _MUL[j]
            h ^= h >> np.uint32(15)
            out += np.bincount((h * _MUL[0]) >> np.uint32(17), minlength=DIMS)
    return out


class Model:
    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray, str]], df: np.ndarray, n_docs: int):
        """rows: places and counts of a text's n-grams, and its language; df: texts that have each n-gram, of n_docs."""
        self.langs = sorted({lang for _, _, lang in rows})
        self.idf = np.log((1 + n_docs) / (1 + df)) + 1
        examples = [self.weigh(at, n) for at, n, _ in rows]
        place = {lang: k for k, lang in enumerate(self.langs)}
        labels = np.array([place[lang] for _, _, lang in rows], np.int64)
        held = np.array([i % HELD_BACK == 0 for i in range(len(rows))], bool)
        self.weights, self.bias, self.temperature = np.zeros((DIMS, len(self.langs))), np.zeros(len(self.langs)), 1.0
        if len(self.langs) > 1:
            fitted = Ftrl(DIMS, len(self.langs)).fit([e for e, h in zip(examples, held, strict=True) if not h], labels[~held], EPOCHS)
            self.weights, self.bias = fitted.weights(), fitted.bias
            scores = np.array([x @ self.weights[at] + self.bias for (at, x), h in zip(examples, held, strict=True) if h]).reshape(-1, len(self.langs))
            self.temperature = temperature_of(scores, labels[held])

    def vector(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(v)
        return self.weigh(at, v[at])

    def weigh(self, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = (1 + np.log(n)) * self.idf[at]
        return at, x / np.sqrt((x * x).sum())

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.langs or not _LETTER.search(text):
            return "und", 0.0
        at, x = self.vector(counts(text))
        p = softmax((x @ self.weights[at] + self.bias)[None, :], self.temperature)[0]
        k = int(p.argmax())
        return self.langs[k], float(p[k])


def _document_frequencies(batch: pa.RecordBatch) -> np.ndarray:
    """Texts of a batch that have each n-gram; in the last place the number of texts with letters."""
    out = np.zeros(DIMS + 1, np.int64)
    for t in batch.column("text").to_pylist():
        if _LETTER.search(t):
            out[:-1] += counts(t) > 0
            out[-1] += 1
    return out


def _vectors(batches):
    for batch in batches:
        rows = [(lang, counts(t)) for t, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True) if _LETTER.search(t)]
        at = [np.flatnonzero(v) for _, v in rows]
        columns = [[lang for lang, _ in rows], [c.pack(x.astype(np.int32)) for x in at], [c.pack(v[x]) for (_, v), x in zip(rows, at, strict=True)]]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.string(), pa.binary(), pa.binary()), strict=True)], ["lang", "at", "n"])


def train(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model of about PER_LANGUAGE rows of each language among those where `learn` holds."""
    own = c.distinct_names(docs, id_col, text_col, lang_col).where(learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    own = own.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    sizes = {r["lang"]: r["count"] for r in own.groupBy("lang").count().collect()}
    if not sizes:
        return Model([], np.zeros(DIMS, np.int64), 0)
    most = max(1, min(PER_LANGUAGE, SAMPLE // len(sizes)))
    chance = F.pmod(F.xxhash64(F.lit("sample"), "doc_id", "text"), F.lit(1 << 30)) / (1 << 30)
    size = F.create_map(*[F.lit(x) for kv in sizes.items() for x in kv])[F.col("lang")]
    # repeated rows have one place in the sample
    sample = own.where(chance * size < most).groupBy("doc_id", "lang", F.md5("text").alias("th")).agg(F.first("text").alias("text"))
    rows = sample.mapInArrow(_vectors, "lang string, at binary, n binary").collect()
    df = c.summed_counts(own.select("text"), _document_frequencies, DIMS + 1)
    return Model(sorted_examples(rows), df[:-1], int(df[-1]))


def sorted_examples(rows) -> list[tuple[np.ndarray, np.ndarray, str]]:
    """The sampled rows in an order that doesn't depend on how they arrived."""
    keyed = sorted((bytes(r["at"]), bytes(r["n"]), r["lang"]) for r in rows)
    order = np.random.default_rng(3).permutation(len(keyed))
    return [(np.frombuffer(keyed[i][0], np.int32), np.frombuffer(keyed[i][1], np.int64), keyed[i][2]) for i in order]


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of SCHEMA."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        own = held.value
        for batch in batches:
            found = [own.predict(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    return c.id_and_text(docs, id_col, text_col).mapInArrow(run, SCHEMA)

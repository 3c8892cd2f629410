"""Operator 9: toxicity by noisy-channel deobfuscation.

A token that may be disguised (letters mixed with digits or symbols, a letter three times in a row, letters set apart by blanks or
points) becomes a lattice: each character may stand for itself, for the letters it imitates, or for nothing; repeated letters
may be one.  A Viterbi search finds the reading of the highest probability under a character language model and
the channel's costs.  The restored text is scored: a logistic regression (follow-the-regularised-leader, elastic net) over the
presence of words and word beginnings, calibrated by a temperature; a single word that is strong
enough by itself counts with a lower bound of its log-odds.

The character model counts the words of all texts that may be learned from (hashed to a table of fixed size).  Vocabulary and weights
are fitted on about PER_CLASS labelled rows of each class at most, chosen by a hash of the id; they reach the driver as distinct tokens.
Features are words and beginnings that at least MIN_ROWS toxic rows of the sample hold, and hold more often than clean ones.
Every row is scored by its whole text and nothing else; tokens of any length are read, and the search keeps all states.  Of equally
probable readings the one found first wins: a character that stands for itself, then for nothing, then for letters in the order of LOOKS.

Empty texts and null have no features and get the score of the intercept; without labelled rows every score is 0.  A label with a null
id is no label; of several texts with one labelled id the first in order is learned.  Repeated rows give equal rows, a null id stays null;
an empty table gives none; further columns are ignored, also those whose names differ only in case.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as c
from .features import Ftrl, softmax, temperature_of

PER_CLASS = (4000, 2000)
MIN_ROWS, MIN_RATIO, PREFIX = 3, 3.0, range(3, 9)
EPOCHS, HELD_BACK, CACHED = 8, 5, 100_000
THRESHOLD = 0.7
SCHEMA = "doc_id long, score double"
#: Letters that a character imitates (fixed values).
LOOKS = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "(": "c", "¡": "i", "*": "aeiou"}
#: Natural logarithms of the channel: imitation, a dropped imitator, another dropped symbol, a dropped second and a dropped
#: later repetition of a letter, a symbol that stays.
IMITATE, LOSE, DROP, DOUBLE, REPEAT, STAY = -1.0, -7.0, -0.7, -3.5, -0.5, -9.0
_WORD = re.compile(r"[^\W\d_]+")
_EDGE = "".join(chr(i) for i in range(33, 127) if not chr(i).isalnum()) + "…«»“”‘’–—¿¡"
_THRICE = re.compile(r"(.)\1\1")


#: Places of the counts of character trigrams and their contexts, bigrams and theirs, single characters; grams are hashed to them.
TRIGRAMS, BIGRAMS, SINGLES = 1 << 18, 1 << 16, 1 << 12
_PARTS = np.cumsum([0, TRIGRAMS, BIGRAMS, BIGRAMS, SINGLES, SINGLES])
_BEGIN, _END = ord("^"), ord("$")
_tables: list[np.ndarray] = []


def _place(places: int, *chars):
    """Place of a gram of code points (integers or arrays of 64-bit ones)."""
    h = 0
    for x in chars:
        h = ((h ^ x) * 0x9E3779B1) & 0xFFFFFFFF
        h = h ^ (h >> 15)
    return h & (places - 1)


def gram_counts(texts: list[str]) -> np.ndarray:
    """Hashed counts of the character trigrams of all words that are letters only, in lower case."""
    if not _tables:
        _tables.append(np.array([chr(i).isspace() for i in range(0x110000)]))
        _tables.append(np.array([chr(i).isalpha() for i in range(0x110000)]))
    u = np.frombuffer((" " + " ".join(texts).lower() + " ").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    space = _tables[0][u]
    start, end = np.flatnonzero(space[:-1] & ~space[1:]) + 1, np.flatnonzero(~space[:-1] & space[1:]) + 1
    letters = np.concatenate([[0], np.cumsum(_tables[1][u])])
    plain = letters[end] - letters[start] == end - start
    start, end = start[plain], end[plain]
    size = end - start
    at = c.ragged(start, size)
    pos = at - np.repeat(start, size)
    last = np.concatenate([u[at], np.full(len(start), _END)])
    one = np.concatenate([np.where(pos >= 1, u[at - 1], _BEGIN), u[end - 1]])
    two = np.concatenate([np.where(pos >= 2, u[at - 2], _BEGIN), np.where(size >= 2, u[end - 2], _BEGIN)])
    places = (_place(TRIGRAMS, two, one, last), _place(BIGRAMS, two, one), _place(BIGRAMS, one, last), _place(SINGLES, one), _place(SINGLES, last))
    return np.concatenate([np.bincount(x, minlength=n) for x, n in zip(places, np.diff(_PARTS), strict=True)])


class CharModel:
    """Interpolated character trigrams over words, from hashed counts; any character may follow any other."""

    def __init__(self, counts: np.ndarray):
        self.tri, self.tri_ctx, self.bi, self.bi_ctx, self.uni = np.split(counts, _PARTS[1:-1])
        self.total = int(self.uni.sum())
        self.known: dict[str, float] = {}

    def log(self, gram: str) -> float:
        """log p(gram[2] | gram[:2])"""
        p = self.known.get(gram)
        if p is None:
            x, y, z = map(ord, gram)
            u = (int(self.uni[_place(SINGLES, z)]) + 0.5) / (self.total + 200)
            b = (int(self.bi[_place(BIGRAMS, y, z)]) + 5 * u) / (int(self.bi_ctx[_place(SINGLES, y)]) + 5)
            p = math.log((int(self.tri[_place(TRIGRAMS, x, y, z)]) + 5 * b) / (int(self.tri_ctx[_place(BIGRAMS, x, y)]) + 5))
            if len(self.known) < CACHED:
                self.known[gram] = p
        return p

    def restore(self, token: str) -> str:
        """The most probable reading of a disguised token (Viterbi; a state is the last two letters)."""
        best: dict[str, tuple[float, str | None, str]] = {"^^": (0.0, None, "")}
        trail = [best]
        last = before_last = ""
        for ch in token:
            options = [(ch, 0.0)] if ch.isalpha() else [(ch, STAY), ("", LOSE if ch in LOOKS else DROP)]
            options += [(x, IMITATE) for x in LOOKS.get(ch, "")]
            if ch == last:
                options.append(("", REPEAT if ch == before_last else DOUBLE))
            step: dict[str, tuple[float, str | None, str]] = {}
            for state, (score, _, _) in best.items():
                for out, cost in options:
                    to = state[1] + out if out else state
                    s = score + cost + (self.log(state + out) if out else 0.0)
                    if to not in step or s > step[to][0]:
                        step[to] = (s, state, out)
            best, last, before_last = step, ch, last
            trail.append(step)
        state = max(best, key=lambda x: best[x][0] + self.log(x + "$"))
        out = []
        for step in reversed(trail[1:]):
            _, before, letter = step[state]
            out.append(letter)
            state = before
        return "".join(reversed(out))


def disguised(token: str) -> bool:
    """Whether a lower-cased token, stripped of symbols at its ends, has letters and something that may hide one."""
    return not token.isdigit() and any(ch.isalpha() for ch in token) and (not token.isalpha() or _THRICE.search(token) is not None)


class Readings:
    """Restored words of tokens and texts."""

    def __init__(self, model: CharModel):
        self.model = model

    def token(self, token: str) -> list[str]:
        low = token.lower()
        core = low.strip(_EDGE)
        if core.isalpha() and not _THRICE.search(core):
            return [core]
        words = _WORD.findall(core)
        # symbols at the ends may stand for letters too: both readings count
        for form in {core, low.rstrip(".,;:?\"'")}:
            if disguised(form):
                words += _WORD.findall(self.model.restore(form))
        return words


def reduced(text: str | None) -> tuple[list[str], list[str]]:
    """What scoring needs of a text: its distinct tokens, and its runs of three or more letters that stand alone (perhaps with
    separators between them)."""
    tokens, runs, run = (text or "").split(), [], []
    for t in [*tokens, ""]:
        core = t.strip(".,-_*")
        if len(core) == 1 and (core.isalpha() or core in LOOKS):
            run.append(core.lower())
            continue
        if t and not core:
            continue
        if len(run) >= 3:
            runs.append("".join(run))
        run = []
    return sorted(set(tokens)), runs


def _lists(text) -> tuple[list[str], list[str]]:
    return tuple(x.split(" ") if x else [] for x in text) if isinstance(text[0], str) else text


def beginnings(word: str) -> list[str]:
    return [word, *["^" + word[:k] for k in PREFIX if k <= len(word)]]


class Model:
    def __init__(self, rows: list[tuple[tuple[list[str], list[str]], int]], chars: np.ndarray, odds: float | None = None):
        """rows: a text as reduced() gives it (or with each list as a string, its elements between blanks), and its label; chars: gram_counts() of the corpus; odds: logarithm of the odds of
        label 1 where the rows were sampled from."""
        self.readings = Readings(CharModel(chars))
        self.index: dict[str, int] = {}
        self.lengths: list[int] = []
        self.weights, self.alone, self.bias, self.temperature = np.zeros(0), np.zeros(0), -50.0, 1.0
        self.table = c.Recent(self._of_token, CACHED)
        labels = np.array([y for _, y in rows], np.int64)
        if len(set(labels.tolist())) < 2:
            return
        held_by = [np.fromiter(map(hash, {f for w in self._words(t) for f in beginnings(w)}), np.int64) for t, _ in rows]  # hashes: the strings would fill the driver
        n = np.bincount(labels, minlength=2)
        shift = 0.0 if odds is None else odds - math.log(n[1] / n[0])
        odds = math.log(n[1] / n[0]) + shift
        none = np.zeros(0, np.int64)
        keys, toxic = c.uniques_counts(np.concatenate([none, *(h for h, y in zip(held_by, labels, strict=True) if y == 1)]))
        keys, toxic = keys[toxic >= MIN_ROWS], toxic[toxic >= MIN_ROWS]
        clean = np.zeros(len(keys), np.int64)
        for h in (h for h, y in zip(held_by, labels, strict=True) if y == 0 and len(keys)):
            at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            clean[at[keys[at] == h]] += 1
        del held_by
        good = ((toxic + 0.5) / n[1]) / ((clean + 0.5) / n[0]) >= MIN_RATIO
        facts = dict(zip(keys[good].tolist(), zip(toxic[good].tolist(), clean[good].tolist(), strict=True), strict=True))
        found = {f for t, y in rows if y == 1 for w in self._words(t) for f in beginnings(w) if hash(f) in facts}
        self.index = {f: i for i, f in enumerate(sorted(found))}
        self.lengths = sorted({len(f) for f in found if f[0] != "^" and len(f) >= 3})
        self.table = c.Recent(self._of_token, CACHED)
        examples = [self.features(t) for t, _ in rows]
        held = np.arange(len(rows)) % HELD_BACK == 0
        fitted = Ftrl(len(self.index) + 1, 2, alpha=0.3, l1=0.05, l2=0.05).fit([(at, np.ones(len(at))) for at, h in zip(examples, held, strict=True) if not h], labels[~held], EPOCHS)
        w = fitted.weights()
        self.weights, self.bias = w[:, 1] - w[:, 0], float(fitted.bias[1] - fitted.bias[0]) + shift
        alone = {}
        for f in self.index:
            if f[0] != "^":
                k1, k0 = facts[hash(f)]
                alone[f] = math.log((k1 + 0.5) / n[1]) - math.log((k0 + 0.5) / n[0]) - 2 * math.sqrt(1 / (k1 + 0.5) + 1 / (k0 + 0.5)) + odds
        self.alone = np.array([alone.get(f, -50.0) for f in self.index] + [-50.0])
        raw = np.array([self.raw(at) for at, h in zip(examples, held, strict=True) if h])
        self.temperature = max(1.0, temperature_of(np.stack([np.zeros(len(raw)), raw], axis=1), labels[held]))

    def _of_token(self, token: str) -> tuple[int, ...]:
        """Features of a token."""
        return tuple(self.index[f] for w in self.readings.token(token) for f in beginnings(w) if f in self.index)

    def _words(self, text: tuple[list[str], list[str]] | tuple[str, str]) -> set[str]:
        tokens, runs = _lists(text)
        return {w for t in tokens for w in self.readings.token(t)} | {self.readings.model.restore(r) for r in runs}

    def features(self, text: tuple[list[str], list[str]] | tuple[str, str]) -> np.ndarray:
        tokens, runs = _lists(text)
        found = set().union(*map(self.table.__getitem__, tokens))
        for word in map(self.readings.model.restore, runs):  # a run may hold several words
            found.update(self.index[word[i : i + n]] for n in self.lengths for i in range(len(word) - n + 1) if word[i : i + n] in self.index)
        return np.array(sorted(found), np.int64)

    def raw(self, at: np.ndarray) -> float:
        """Log-odds by the regression, or by the strongest single word if that says more (its log-odds less two standard errors)."""
        return max(float(self.weights[at].sum()) + self.bias, float(self.alone[at].max()) if len(at) else -50.0)

    def score(self, text: str | None) -> float:
        if not len(self.weights):
            return 0.0
        return float(softmax(np.array([[0.0, self.raw(self.features(reduced(text)))]]), self.temperature)[0, 1])


def _reduce(batches):
    for batch in batches:
        found = [reduced(t) for t in batch.column("text").to_pylist()]
        lists = [pa.array([" ".join(x[k]) for x in found], pa.string()) for k in (0, 1)]  # no element holds a blank
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), *lists], ["doc_id", "y", "tokens", "runs"])


def train(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """A model of about PER_CLASS labelled rows of each class; `learn` selects, by id alone, rows of labels and the rows of docs whose
    characters count."""
    labels = c.distinct_names(labels, id_col, label_col).where(learn & F.col(label_col).isin(0, 1))
    own = labels.groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.max(label_col).cast("int").alias("y")).where("doc_id is not null")
    sizes = {r["y"]: r["count"] for r in own.groupBy("y").count().collect()}
    chance = F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 30)) / (1 << 30)
    most = F.when(F.col("y") == 1, PER_CLASS[1] / max(1, sizes.get(1, 0))).otherwise(PER_CLASS[0] / max(1, sizes.get(0, 0)))
    sample = F.broadcast(own.where(chance < most))  # about PER_CLASS rows of two numbers
    texts = c.id_and_text(docs, id_col, text_col).join(sample, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y"))
    rows = texts.mapInArrow(_reduce, "doc_id long, y int, tokens string, runs string").collect()
    corpus = c.distinct_names(docs, id_col, text_col).where(learn).select(F.coalesce(text_col, F.lit("")).alias("text"))
    chars = c.summed_counts(corpus, lambda batch: sum(gram_counts(part.column("text").to_pylist()) for part in c.slices(batch, most=1 << 19)), int(_PARTS[-1]))
    odds = math.log(sizes[1] / sizes[0]) if sizes.get(0) and sizes.get(1) else None
    return Model([((r["tokens"], r["runs"]), r["y"]) for r in sorted(rows, key=lambda r: r["doc_id"])], chars, odds)


def toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of SCHEMA."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        own = held.value
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([own.score(t) for t in batch.column("text").to_pylist()], pa.float64())], ["doc_id", "score"])

    return c.id_and_text(docs, id_col, text_col).mapInArrow(run, SCHEMA)


def without_toxic(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns as they are, that score less than the threshold; ids play no part."""
    held, names = docs.sparkSession.sparkContext.broadcast(model), docs.columns
    flat, text = docs.toDF(*[f"c{i}" for i in range(len(names))]), names.index(text_col)

    def run(batches):
        own = held.value
        for batch in batches:
            for part in c.slices(batch, batch.schema.names[text], 1 << 20):  # small batches: Spark keeps the buffers of the largest
                yield part.filter(pa.array([own.score(t) < threshold for t in part.column(text).to_pylist()], pa.bool_()))

    return flat.mapInArrow(run, flat.schema).toDF(*names)

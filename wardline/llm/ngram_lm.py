"""Operator 1: n-gram language model scoring with an Elias-Fano trie in memory-mapped levels.

The model is a bigram model with absolute discounting, interpolated with an add-0.1 unigram base:
p(w | v) = max(c(v w) - D, 0) / c(v) + D T(v) / c(v) * p0(w), where T(v) counts the words seen after v; a context that was
never seen backs off to p0.  Texts are read in blocks (hash ranges of their rows), the model lives in shards:

1. Each block asks the unigram shards for the exact counts of its distinct words, and brings its own counts along.
2. Each block asks the bigram shards for its distinct word pairs, again with its own counts.  A shard builds its part of the
   trie: a level of contexts with monotone pointers to a level of successors, both Elias-Fano coded in a memory-mapped
   file, with 8-bit codes of the smoothed probabilities and back-off weights.  A successor is stored relative to
   its context (context rank, then word key), so one successor search within the context's range finds it.
3. The answers, again packed, go back to the blocks, which sum the scores.

No step holds more than a block or a shard, whose number grows with the input; a word that is a context of many tokens is
dealt over several shards by its successors.  Each successor is in one shard, so the shards' own counts sum to the exact T(v),
which goes back to the blocks.  Nothing is collected or broadcast but three sums and these T(v), one number for HOT_CONTEXT tokens at most.

A block sends a message only to the shards that its pairs fall into, so the number of messages is at most the number of distinct pairs
of all blocks, whatever the number of shards.  Words are known by 64-bit hashes; a successor's key is its word's number, which is exact.

A null text counts as empty: it has only the end token.  Rows with equal ids and texts give equal rows, a null id stays null.  Without
training rows every token has c = 0 and N = V = 0.  An empty table gives no rows.  Further columns are ignored, also those whose names
differ only in case.
"""

from __future__ import annotations

import math
import os
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as c
from .eliasfano import EliasFano

#: Pseudo-count of the unigram base; discount of seen pairs.
BASE, DISCOUNT = 0.1, 0.75
#: Tokens of a context beyond which its successors are dealt over several shards.
HOT_CONTEXT = 1 << 20
BLOCK_BYTES = 12 << 20
#: Smoothed probabilities are stored as codes 1 to 255, evenly spaced in the logarithm over DECADES decades, or more where
#: the number of tokens asks for them; 0: absent.
DECADES = 9.0
_U = np.uint64
END, START = _U(0x454E44), _U(0x535441)

MESSAGE = "kind int, shard int, block int, data binary, more binary, tokens long, types long"
_FIELDS = [("kind", pa.int32()), ("shard", pa.int32()), ("block", pa.int32()), ("data", pa.binary()), ("more", pa.binary()), ("tokens", pa.int64()), ("types", pa.int64())]


def _messages(rows: list[tuple]) -> pa.Table:
    return pa.table({n: pa.array([r[i] for r in rows], t) for i, (n, t) in enumerate(_FIELDS)})


def decades_of(n_tokens: int) -> float:
    """Decades that hold the smallest probability, of a pair seen once after a context of all tokens."""
    return max(DECADES, math.ceil(math.log10(max(1, n_tokens) / (1 - DISCOUNT))))


def quantise(p: np.ndarray, decades: float = DECADES) -> np.ndarray:
    return np.clip(np.rint(255 + np.log10(np.maximum(p, 1e-300)) * (254 / decades)), 1, 255).astype(np.uint8)


def decode(decades: float = DECADES) -> np.ndarray:
    """Probability of each code."""
    return np.concatenate([[0.0], 10.0 ** ((np.arange(1, 256) - 255) * (decades / 254))])


def _tokens(left: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of all texts with an end token after each, the texts' offsets, and which texts are for training."""
    buf, off = c.text_buffers(left["text"])
    h, _, _, wo = c.words(buf, off, c.NOT_SPACE)
    n = len(off) - 1
    return np.insert(h, wo[1:], END), wo + np.arange(n + 1), np.array(left["train"].to_pylist(), bool)


def _unigrams(h: np.ndarray, to: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct words of a block, and their counts in its training texts; START counts the training texts."""
    learn = np.repeat(train, np.diff(to))
    words = c.uniques(np.concatenate([h, [START]]))
    seen, n = c.uniques_counts(np.concatenate([h[learn], np.full(int(train.sum()), START)]))
    counts = np.zeros(len(words), np.int64)
    counts[np.searchsorted(words, seen)] = n
    return words, counts


def _ask_unigrams(shards: int):
    def ask(left: pa.Table) -> pa.Table:
        words, counts = _unigrams(*_tokens(left))
        counts, block = counts.astype(np.uint32), left["block"][0].as_py()
        shard = (words % _U(shards)).astype(np.int32)
        return _messages([(1, s, block, c.pack(words[own]), c.pack(counts[own]), None, None) for s, own in c.by_shard(shard)])

    return ask


def _answer_unigrams(group: pa.Table) -> pa.Table:
    keys = [np.frombuffer(x, _U) for x in group["data"].to_pylist()]
    every = np.concatenate(keys)
    words = c.uniques(every)
    total = np.zeros(len(words), np.int64)
    for k, n in zip(keys, group["more"].to_pylist(), strict=True):
        total[np.searchsorted(words, k)] += np.frombuffer(n, np.uint32)
    real = total[(words != START) & (total > 0)]
    shard = group["shard"][0].as_py()
    rows = []
    for b, k in zip(group["block"].to_pylist(), keys, strict=True):
        at = np.searchsorted(words, k)  # a word's place in its shard is its number there
        rows.append((1, shard, b, c.pack(total[at]), c.pack(at.astype(np.uint32)), None, None))
    return _messages([*rows, (2, shard, None, None, None, int(real.sum()), len(real))])


class _Block:
    """Distinct words and word pairs of a block, in an order that asking and finishing share."""

    def __init__(self, left: pa.Table, answers: pa.Table, shards: int, hot: int):
        h, self.to, self.train = _tokens(left)
        self.words, self.own = _unigrams(h, self.to, self.train)
        shard = (self.words % _U(shards)).astype(np.int32)
        self.counts, self.ids = np.zeros(len(self.words), np.int64), np.zeros(len(self.words), _U)
        own = dict(c.by_shard(shard))
        for s, x, at in zip(*(answers[k].to_pylist() for k in ("shard", "data", "more")), strict=True):
            self.counts[own[s]] = np.frombuffer(x, np.int64)
            self.ids[own[s]] = np.frombuffer(at, np.uint32).astype(_U) * _U(shards) + _U(s)
        self.word = np.searchsorted(self.words, h)
        before = np.empty_like(self.word)
        before[1:] = self.word[:-1]
        before[self.to[:-1]] = np.searchsorted(self.words, START)
        self.pair = before.astype(_U) << _U(32) | self.word.astype(_U)
        self.pairs = c.uniques(self.pair)
        self.first, self.second = (self.pairs >> _U(32)).astype(np.int64), (self.pairs & _U(0xFFFFFFFF)).astype(np.int64)
        parts = 1 + self.counts[self.first] // hot
        self.hot = parts > 1
        v, w = self.words[self.first], self.words[self.second]
        self.shard = (c.mix(v + c.mix(w) % parts.astype(_U)) % _U(shards)).astype(np.int32)


def _small(n: np.ndarray) -> bytes:
    """Counts as bytes, 255 and more in a list behind."""
    big = n >= 255
    return c.pack(np.minimum(n, 255).astype(np.uint8)) + c.pack(n[big].astype(np.uint32))


def _unsmall(x: bytes, n: int) -> np.ndarray:
    out = np.frombuffer(x, np.uint8, n).astype(np.int64)
    big = out == 255
    out[big] = np.frombuffer(x, np.uint32, int(big.sum()), n)
    return out


def _ask_pairs(shards: int, hot: int):
    def ask(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _messages([])
        b = _Block(left, right, shards, hot)
        learn = np.repeat(b.train, np.diff(b.to))
        seen, n = c.uniques_counts(b.pair[learn])
        own = np.zeros(len(b.pairs), np.int64)
        own[np.searchsorted(b.pairs, seen)] = n
        rows, block = [], left["block"][0].as_py()
        for s, at in c.by_shard(b.shard):
            first = b.first[at]
            start = np.flatnonzero(np.concatenate([[True], first[1:] != first[:-1]]))
            ctx, hot_ = first[start], b.hot[at[start]]
            succ = np.diff(np.append(start, len(at)))
            key = b.ids[b.second[at]]
            parts = [np.array([len(ctx), len(at), hot_.sum()], np.int64), b.words[ctx], b.counts[ctx[hot_]], hot_.astype(np.uint8), key.astype(np.uint32), (key >> _U(32)).astype(np.uint8)]
            rows.append((1, s, block, b"".join(map(c.pack, parts)), _small(succ) + _small(own[at]), None, None))
        return _messages(rows)

    return ask


def _unpack(data: bytes, more: bytes) -> tuple[np.ndarray, ...]:
    """Contexts, their counts (of hot ones; 0 of others), which are hot, their numbers of successors, successors' keys and own counts."""
    n_ctx, n, n_hot = np.frombuffer(data, np.int64, 3).tolist()
    at, out = 24, []
    for kind, size in ((_U, n_ctx), (np.int64, n_hot), (np.uint8, n_ctx), (np.uint32, n), (np.uint8, n)):
        out.append(np.frombuffer(data, kind, size, at))
        at += size * np.dtype(kind).itemsize
    ctx, told, hot, low, high = out
    count = np.zeros(n_ctx, np.int64)
    count[hot > 0] = told
    succ = _unsmall(more, n_ctx)
    own = _unsmall(more[n_ctx + 4 * int((succ >= 255).sum()) :], n)
    return ctx, count, hot, succ, low.astype(_U) | high.astype(_U) << _U(32), own


class Trie:
    """Two levels in one memory-mapped file: contexts with pointers and back-off codes; successors with probability codes."""

    def __init__(self, path: str, ctx: np.ndarray, gamma: np.ndarray, pointers: np.ndarray, successors: np.ndarray, alpha: np.ndarray):
        rank_bits = max(1, int(len(ctx)).bit_length())
        n = max(1, len(successors))
        levels = [EliasFano.build(ctx, 64), EliasFano.build(pointers, n.bit_length()), EliasFano.build(successors, 40 + rank_bits)]
        arrays = [a for e in levels for a in e.arrays()] + [gamma, alpha]
        with open(path, "wb") as f:
            for a in arrays:
                f.write(c.pack(a) + bytes(-a.nbytes % 8))
        whole, at, mapped = np.memmap(path, np.uint8, "r"), 0, []
        for a in arrays:
            mapped.append(whole[at : at + a.nbytes].view(a.dtype))
            at += a.nbytes + -a.nbytes % 8
        self.bytes = at
        self.contexts, self.pointers, self.successors = (EliasFano(e.n, e.low_bits, *mapped[3 * i : 3 * i + 3]) for i, e in enumerate(levels))
        self.gamma, self.alpha = mapped[9:]

    def context(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each context (of any, where it is absent) and whether the trie has it."""
        at = self.contexts.successor(v)
        known = at < self.contexts.n
        at = np.where(known, at, 0)
        return at, known & (self.contexts.get(at) == v) if self.contexts.n else known

    def codes(self, rank: np.ndarray, known: np.ndarray, key: np.ndarray) -> np.ndarray:
        """Probability code of the successor `key` of each context rank, 0 where it isn't stored."""
        out = np.zeros(len(key), np.uint8)
        ask = np.flatnonzero(known)
        if not len(ask):
            return out
        x = rank[ask].astype(_U) << _U(40) | key[ask]
        at = self.successors.successor(x)
        inside = at < self.pointers.get(rank[ask] + 1).astype(np.int64)  # beyond the pointer another context's range begins
        ask, at, x = ask[inside], at[inside], x[inside]
        hit = self.successors.get(at) == x
        out[ask[hit]] = self.alpha[at[hit]]
        return out


def build_trie(path: str, ctx: np.ndarray, total: np.ndarray, rank: np.ndarray, key: np.ndarray, n: np.ndarray, decades: float = DECADES) -> tuple[Trie, np.ndarray]:
    """The trie and each context's number of successors in it, from contexts (sorted; their token counts) and pair counts (context rank, word key, count)."""
    x = rank.astype(_U) << _U(40) | key
    order = np.argsort(x)
    x, n = x[order], n[order]
    at = np.flatnonzero(np.concatenate([np.ones(min(1, len(x)), bool), x[1:] != x[:-1]]))
    x, n = x[at], np.add.reduceat(n, at) if len(at) else n
    r = (x >> _U(40)).astype(np.int64)
    types = np.bincount(r, minlength=len(ctx))
    pointers = np.concatenate([[0], np.cumsum(types)])
    gamma = np.where(total > 0, np.minimum(1.0, DISCOUNT * types / np.maximum(total, 1)), 1.0)
    return Trie(path, ctx, quantise(gamma, decades), pointers, x, quantise((n - DISCOUNT) / np.maximum(total[r], 1), decades)), types


def _answer_pairs(decades: float):
    def answer(group: pa.Table) -> pa.Table:
        asked = [_unpack(d, m) for d, m in zip(group["data"].to_pylist(), group["more"].to_pylist(), strict=True)]
        every = np.concatenate([a[0] for a in asked])
        order = np.argsort(every)
        at = np.flatnonzero(np.concatenate([[True], every[order][1:] != every[order][:-1]]))
        ctx = every[order][at]
        total, hot = (np.concatenate([a[i] for a in asked])[order][at] for i in (1, 2))
        rank = np.searchsorted(ctx, np.concatenate([np.repeat(a[0], a[3]) for a in asked]))
        key, n = np.concatenate([a[4] for a in asked]), np.concatenate([a[5] for a in asked])
        learnt = n > 0
        handle, path = tempfile.mkstemp(prefix="trie-")
        os.close(handle)
        try:
            # all successors of a context that isn't hot are here, so its count is theirs
            total = np.where(hot > 0, total, np.bincount(rank[learnt], n[learnt], len(ctx)))
            trie, types = build_trie(path, ctx, total, rank[learnt], key[learnt], n[learnt], decades)
            del every, order, rank, key, n
            shard = group["shard"][0].as_py()
            rows = [(4, shard, None, None, None, v, t) for v, t in zip(ctx[hot > 0].view(np.int64).tolist(), types[hot > 0].tolist(), strict=True)]
            for b, a in zip(group["block"].to_pylist(), asked, strict=True):
                r, known = trie.context(a[0])
                codes = trie.codes(np.repeat(r, a[3]), np.repeat(known, a[3]), a[4])
                rows.append((3, shard, b, c.pack(codes), c.pack(np.where(known, trie.gamma[r], np.uint8(255))), None, None))
            return _messages(rows)
        finally:
            os.unlink(path)

    return answer


def _finish(shards: int, hot: int, n_tokens: int, n_types: int, hot_types: dict[int, int]):
    """hot_types: T(v) of the contexts dealt over several shards."""
    z = n_tokens + BASE * (n_types + 1)
    value = decode(decades_of(n_tokens))
    hot_words = np.sort(np.fromiter(hot_types, np.int64, len(hot_types)).view(_U))
    hot_counts = np.array([hot_types[v] for v in hot_words.view(np.int64).tolist()], np.float64)

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table({k: pa.array([], t) for k, t in (("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()))})
        kind = np.array(right["kind"].to_pylist())
        b = _Block(left, right.take(pa.array(np.flatnonzero(kind == 1))), shards, hot)
        alpha, gamma = np.zeros(len(b.pairs), np.uint8), np.full(len(b.pairs), 255, np.uint8)
        answers = right.take(pa.array(np.flatnonzero(kind == 3)))
        own = dict(c.by_shard(b.shard))
        for s, x, g in zip(answers["shard"].to_pylist(), answers["data"].to_pylist(), answers["more"].to_pylist(), strict=True):
            at = own[s]
            alpha[at] = np.frombuffer(x, np.uint8)
            first = b.first[at]
            start = np.concatenate([[True], first[1:] != first[:-1]])
            gamma[at] = np.frombuffer(g, np.uint8)[np.cumsum(start) - 1]
        base = np.log10((b.counts + BASE) / z)
        backoff = value[gamma]
        v = b.first[b.hot]
        if len(v):
            backoff[b.hot] = np.minimum(1.0, DISCOUNT * hot_counts[np.searchsorted(hot_words, b.words[v])] / b.counts[v])
        log = np.log10(value[alpha] + backoff * 10.0 ** base[b.second])
        add = lambda x: np.add.reduceat(x, b.to[:-1])  # noqa: E731  each text has one token at least
        return pa.table({
            "doc_id": left["doc_id"], "held_out": pa.array(~b.train), "n_tokens": pa.array(np.diff(b.to), pa.int64()), "n_known": pa.array(add((b.counts[b.word] > 0).astype(np.int64)), pa.int64()),
            "train_tokens": pa.array(np.full(left.num_rows, n_tokens), pa.int64()), "base_score": pa.array(add(base[b.word])), "score": pa.array(add(log[np.searchsorted(b.pairs, b.pair)])),
        })

    return finish


def score(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scores every row of docs under a model of the rows where `train` holds.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.
    """
    since = c.mark()
    docs = c.distinct_names(docs, id_col, text_col).select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    blocks = c.blocks_of(docs, "text", BLOCK_BYTES)
    shards = 2 * blocks
    placed = docs.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int")).groupBy("block")
    one = c.materialize(placed.applyInArrow(_ask_unigrams(shards), MESSAGE).groupBy("shard").applyInArrow(_answer_unigrams, MESSAGE), "unigrams")
    n_tokens, n_types = (int(x or 0) for x in one.where("kind = 2").agg(F.sum("tokens"), F.sum("types")).first())
    one = one.where("kind = 1")
    asked = placed.cogroup(one.groupBy("block")).applyInArrow(_ask_pairs(shards, HOT_CONTEXT), MESSAGE)
    two = c.materialize(asked.groupBy("shard").applyInArrow(_answer_pairs(decades_of(n_tokens)), MESSAGE), "pairs")
    hot_types = {r["tokens"]: r["types"] for r in two.where("kind = 4").groupBy("tokens").agg(F.sum("types").alias("types")).collect()}
    kind = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    scored = placed.cogroup(one.unionAll(two.where("kind = 3")).groupBy("block")).applyInArrow(_finish(shards, HOT_CONTEXT, n_tokens, n_types, hot_types), kind)
    return c.settle(scored, "scores", since)

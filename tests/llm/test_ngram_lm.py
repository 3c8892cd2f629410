import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardline.llm import ngram_lm as lm
from wardline.llm.eliasfano import EliasFano

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(t):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW)), None]


def brute(rows):
    train = [tokens(t) for i, t in rows if zlib.crc32(str(i).encode()) % 10]
    c1, c2, succ = Counter(w for t in train for w in t), Counter(), defaultdict(set)
    ctx = Counter()
    for t in train:
        for v, w in zip(["<s>", *t], t, strict=False):
            c2[v, w] += 1
            ctx[v] += 1
            succ[v].add(w)
    n, v_ = sum(c1.values()), len(c1)
    out = {}
    for i, t in rows:
        t = tokens(t)
        p0 = {w: (c1[w] + 0.1) / (n + 0.1 * (v_ + 1)) for w in t}
        s = 0.0
        for v, w in zip(["<s>", *t], t, strict=False):
            p = p0[w] if not ctx[v] else max(c2[v, w] - 0.75, 0) / ctx[v] + 0.75 * len(succ[v]) / ctx[v] * p0[w]
            s += math.log10(p)
        out[i] = (len(t), sum(c1[w] > 0 for w in t), n, sum(math.log10(p0[w]) for w in t), s)
    return out


@pytest.mark.parametrize("block_bytes", [12 << 20, 2000])
def test_against_brute_force(spark, monkeypatch, block_bytes):
    monkeypatch.setattr(lm, "BLOCK_BYTES", block_bytes)
    rnd = random.Random(3)
    vocab = [f"w{i}" for i in range(40)] + ["The", "THE", "été", "a,b"]
    rows = [(i, " ".join(rnd.choices(vocab, weights=[1 / (k + 1) for k in range(len(vocab))], k=rnd.randrange(0, 80)))) for i in range(150)]
    rows += [(900, None), (901, ""), (902, " \t\n"), (903, "unseen words only here"), (904, "w1 " * 3000), (None, "w1 w2")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as block", "0 as TEXT")
    have = {r.doc_id: r for r in lm.score(df, F.crc32(F.col("doc_id").cast("string")) % 10 != 0).collect()}
    assert have.pop(None).held_out and len(have) == len(rows) - 1
    rows = rows[:-1]
    for i, (n, known, total, base, full) in brute(rows).items():
        r = have[i]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (n, known, total, zlib.crc32(str(i).encode()) % 10 == 0)
        assert r.base_score == pytest.approx(base, rel=1e-9)
        assert abs(r.score - full) <= 0.019 * n


def test_no_training_rows_and_no_rows(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b")], "doc_id long, text string")
    rows = lm.score(df, F.lit(False)).collect()
    assert len(rows) == 2 and rows[0] == rows[1]
    assert (rows[0].n_known, rows[0].train_tokens, rows[0].base_score) == (0, 0, pytest.approx(0.0))
    assert lm.score(df.limit(0), F.lit(True)).collect() == []


@pytest.mark.parametrize("n,bits", [(0, 64), (1, 64), (7, 5), (5000, 64), (5000, 12), (3000, 52)])
def test_elias_fano(n, bits):
    rng = np.random.default_rng(n)
    v = np.sort(rng.integers(0, 2**bits - 1, n, dtype=np.uint64, endpoint=True))
    e = EliasFano.build(v, bits)
    q = np.concatenate([v, rng.integers(0, 2**bits - 1, 99, dtype=np.uint64, endpoint=True)])
    assert (e.get(np.arange(n)) == v).all() and (e.successor(q) == np.searchsorted(v, q)).all()


@pytest.mark.parametrize("hot", [5, 60])
def test_many_hot_contexts(spark, monkeypatch, hot):
    monkeypatch.setattr(lm, "BLOCK_BYTES", 2000)
    monkeypatch.setattr(lm, "HOT_CONTEXT", hot)
    rnd = random.Random(4)
    vocab = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(rnd.choices(vocab, weights=[1 / (k + 1) for k in range(40)], k=rnd.randrange(1, 80)))) for i in range(150)]
    have = {r.doc_id: r for r in lm.score(spark.createDataFrame(rows, "doc_id long, text string"), F.crc32(F.col("doc_id").cast("string")) % 10 != 0).collect()}
    assert max(abs(have[i].score - full) / n for i, (n, _, _, _, full) in brute(rows).items()) <= 0.02


def test_successors_of_a_hot_context(spark, monkeypatch):
    monkeypatch.setattr(lm, "BLOCK_BYTES", 2 << 20)
    train, held = ([i for i in range(60) if (zlib.crc32(str(i).encode()) % 10 == 0) == h] for h in (False, True))
    rows = [(train[0], "a b a c a d " * (lm.HOT_CONTEXT // 3 + 9)), (train[1], "e f"), (held[0], "a zzz"), (held[1], "a yyy"), (held[2], "a xxx")]
    have = {r.doc_id: r.score for r in lm.score(spark.createDataFrame(rows, "doc_id long, text string"), F.crc32(F.col("doc_id").cast("string")) % 10 != 0).collect()}
    want = brute(rows)
    for i in held[:3]:
        assert abs(have[i] - want[i][4]) <= 0.05


def test_codes_widen_with_the_tokens():
    for n in (0, 10, 10**8, 10**10, 10**12):
        p = np.array([0.25 / max(1, n), 1.0])
        assert np.allclose(np.log10(lm.decode(lm.decades_of(n))[lm.quantise(p, lm.decades_of(n))]), np.log10(p), atol=0.03)
    assert lm.decades_of(10**8) == lm.DECADES

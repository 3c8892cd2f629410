import math
import os
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardline.llm import common, language_id
from wardline.llm.features import Ftrl

SF = "/root/testdata/sf0.01"


def test_small_tables(spark):
    rows = [(i, "the cat and the dog" if i % 2 else "der hund und die katze", "en" if i % 2 else "de") for i in range(40)]
    rows += [(100, None, "en"), (101, "", None), (102, "12 34 !!", "de"), (103, "the dog", None), (103, "the dog", None), (104, "und die " * 40000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 as score", "2 as LANG", "3 as Text")
    model = language_id.train(df, F.col("doc_id") < 40)
    have = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(df, model).collect()}
    assert have[100] == have[101] == have[102] == ("und", 0.0)
    assert have[103][0] == "en" and have[104][0] == "de" and have[1][0] == "en" and have[2][0] == "de"
    assert all(0 <= s <= 1 for _, s in have.values())
    empty = language_id.train(df, F.lit(False))
    assert {r.lang_pred for r in language_id.identify(df, empty).collect()} == {"und"}
    assert language_id.identify(df.limit(0), model).collect() == []


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_id.train(docs, F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    gold = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    have = [r for r in language_id.identify(docs, model).collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert sum(r.lang_pred == gold[r.doc_id] for r in have) >= 0.97 * len(have)


def test_many_languages(spark, monkeypatch):
    """More languages than the sample has rows for: one row of each at least, none is refused."""
    monkeypatch.setattr(language_id, "SAMPLE", 100)
    rows = [(i, f"{chr(97 + i % 26)}{chr(97 + i // 26)} " * 9, f"l{i}") for i in range(150)]
    model = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True))
    assert len(model.langs) == 150


def plain_ftrl(examples, labels, dims, classes, epochs, alpha=0.5, beta=1.0, l1=1e-3, l2=1e-4, seed=7):
    """Follow-the-regularised-leader as published, one coordinate at a time."""
    z, n, bias, bias_n = {}, {}, [0.0] * classes, [0.0] * classes
    weight = lambda k: 0.0 if abs(z.get(k, 0.0)) <= l1 else -(z[k] - math.copysign(l1, z[k])) / ((beta + math.sqrt(n[k])) / alpha + l2)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for e in rng.permutation(len(examples)):
            at, x = examples[e]
            s = [sum(v * weight((i, c)) for i, v in zip(at, x)) + bias[c] for c in range(classes)]
            p = [math.exp(v - max(s)) for v in s]
            for c in range(classes):
                g = p[c] / sum(p) - (labels[e] == c)
                old = {i: weight((i, c)) for i in at}
                bias_n[c] += g * g
                bias[c] -= alpha * g / (beta + math.sqrt(bias_n[c]))
                for i, v in zip(at, x):
                    k, d = (i, c), g * v
                    sigma = (math.sqrt(n.get(k, 0.0) + d * d) - math.sqrt(n.get(k, 0.0))) / alpha
                    z[k] = z.get(k, 0.0) + d - sigma * old[i]
                    n[k] = n.get(k, 0.0) + d * d
    return [[weight((i, c)) if (i, c) in z else 0.0 for c in range(classes)] for i in range(dims)], bias


def test_training_against_a_plain_version():
    rng = np.random.default_rng(1)
    examples = [(np.sort(rng.choice(12, 4, replace=False)), rng.random(4)) for _ in range(40)]
    labels = rng.integers(0, 3, 40)
    fitted = Ftrl(12, 3).fit(examples, labels, 3)
    weights, bias = plain_ftrl([(a.tolist(), x.tolist()) for a, x in examples], labels.tolist(), 12, 3, 3)
    assert np.allclose(fitted.weights(), weights) and np.allclose(fitted.bias, bias)


def test_document_frequencies_come_from_all_rows(spark):
    texts = ["ab", "a b", "", "12", "ba ab"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts * 40)], "doc_id long, text string").repartition(7)
    total = common.summed_counts(df.select("text"), language_id._document_frequencies, language_id.DIMS + 1)
    want = sum((language_id.counts(t) > 0).astype(int) for t in texts if t not in ("", "12")) * 40
    assert (total[:-1] == want).all() and total[-1] == 120

import itertools
import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from wardline.llm import toxicity

SF = "/root/testdata/sf0.1"


def model_rows():
    clean = ["the garden and the river were calm today", "a letter from the harbour arrived", "reading is a quiet joy in winter"]
    bad = ["you are an idiot and a moron", "what a stupid moron you are", "pathetic idiot go away", "such a stupid idiot"]
    return [(i, f"{clean[i % 3]} number {'abc'[i % 3]}", 0) for i in range(60)] + [(100 + i, f"{bad[i % 4]} {clean[i % 3]}", 1) for i in range(40)]


def fit(rows, odds=None):
    return toxicity.Model([(toxicity.reduced(t), y) for _, t, y in rows], toxicity.gram_counts([t for _, t, _ in rows]), odds)


def test_disguises_are_read():
    model = fit(model_rows())
    assert model.readings.token("st*pid")[-1] == "stupid" and model.readings.token("m0r0n!")[-1] == "moron" and model.readings.token("iiidiot")[-1] == "idiot"
    assert toxicity.reduced("x i d i o t y")[1] == ["xidioty"] and model.score("the i d i o t of harbour") > 0.7
    for t in ("st*pid", "stuuupid", "m.o.r.o.n", "1d10t", "M O R O N"):
        assert model.score(f"the river and {t} today") > 0.5 > model.score("the river and garden today"), t


def test_small_tables(spark):
    labels = spark.createDataFrame([(i, y) for i, _, y in model_rows()] + [(900, None), (901, 1)], "doc_id long, toxic int").selectExpr("*", "'x' as text")
    docs = spark.createDataFrame([r[:2] for r in model_rows()] + [(200, None), (201, ""), (202, "stupid idiot"), (202, "stupid idiot"), (203, "! " * 90000)], "doc_id long, text string").selectExpr("*", "1 as toxic", "0 as DOC_ID")
    model = toxicity.train(docs, labels, F.lit(True))
    have = toxicity.toxicity(docs, model).collect()
    assert len(have) == docs.count() and all(0 <= r.score <= 1 for r in have)
    by = {r.doc_id: r.score for r in have}
    assert by[200] == by[201] == by[203] < 0.5 and by[202] > 0.7 and by[1] < 0.5 < by[101]
    nothing = toxicity.train(docs, labels.limit(0), F.lit(True))
    assert {r.score for r in toxicity.toxicity(docs, nothing).collect()} == {0.0}
    assert toxicity.toxicity(docs.limit(0), model).collect() == []


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_held_out_accuracy(spark):
    from wardline.llm.queries import op9_toxicity

    gold = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    held = [(r.predicted, gold[r.doc_id]) for r in op9_toxicity(spark, SF).collect() if r.held_out and r.doc_id in gold]
    hit, said, real = held.count((1, 1)), sum(p for p, _ in held), sum(g for _, g in held)
    assert hit >= 0.98 * said and hit >= 0.8 * real


def test_spaced_disguises_are_read():
    long = "incomprehensiblenitwit"
    rows = model_rows() + [(200 + i, f"what an {long} in the harbour", 1) for i in range(5)]
    model = fit(rows)
    calm = model.score("the river and garden today")
    for t in ("i. d. i. o. t.", "i - d - i - o - t", "m_ o_ r_ o_ n_"):
        assert model.score(f"the river and {t} today") > 0.5 > calm, t
    assert model.index[long] in model.features(toxicity.reduced(" ".join(long)))
    assert toxicity.reduced("- - i - b")[1] == []


def test_reading_is_the_most_probable():
    model = fit(model_rows()).readings.model

    def score(outs, costs):
        word = "".join(outs)
        return sum(costs) + sum(model.log(f"^^{word}$"[i : i + 3]) for i in range(len(word) + 1))

    def options(token):
        last = before = ""
        for ch in token:
            own = [(ch, 0.0)] if ch.isalpha() else [(ch, toxicity.STAY), ("", toxicity.LOSE if ch in toxicity.LOOKS else toxicity.DROP)]
            own += [(x, toxicity.IMITATE) for x in toxicity.LOOKS.get(ch, "")]
            yield own + ([("", toxicity.REPEAT if ch == before else toxicity.DOUBLE)] if ch == last else [])
            last, before = ch, last

    for token in ("*1*(*", "m*|*n", "1d1*t", "**!*0"):
        best = max(score(*zip(*way, strict=True)) for way in itertools.product(*options(token)))
        have = model.restore(token)
        ways = [score(*zip(*way, strict=True)) for way in itertools.product(*options(token)) if "".join(x for x, _ in way) == have]
        assert max(ways) == pytest.approx(best), token


def test_long_disguises_are_read():
    model = fit(model_rows())
    for t in ("$tup!d", "$tup!d" + "!" * 60, "$tup!d" + "!" * 5000, "..$tup!d" + "." * 500):
        assert "stupid" in model.readings.token(t), t[:20]


def plain_counts(texts):
    tri, ctx = Counter(), Counter()
    for w in " ".join(texts).lower().split():
        if w.isalpha():
            s = "^^" + w + "$"
            for i in range(2, len(s)):
                tri[s[i - 2 : i + 1]] += 1
                ctx[s[i - 2 : i]] += 1
    return tri, ctx


def test_character_counts():
    texts = ["Some words, of any Kind", "été straße x1 ab", "a", "", "日本 語\u2003z"]
    have = toxicity.CharModel(toxicity.gram_counts(texts))
    tri, ctx = plain_counts(texts)
    assert have.tri.sum() == sum(tri.values()) == have.total
    for g, n in tri.items():
        assert have.tri[toxicity._place(toxicity.TRIGRAMS, *map(ord, g))] >= n and have.tri_ctx[toxicity._place(toxicity.BIGRAMS, *map(ord, g[:2]))] >= ctx[g[:2]]


def all_readings(token):
    """Every reading of the lattice with the channel's cost, by trying all options of all characters."""
    t, options = toxicity, []
    for i, ch in enumerate(token):
        own = [(ch, 0.0)] if ch.isalpha() else [(ch, t.STAY), ("", t.LOSE if ch in t.LOOKS else t.DROP)]
        own += [(x, t.IMITATE) for x in t.LOOKS.get(ch, "")]
        if i and ch == token[i - 1]:
            own.append(("", t.REPEAT if i > 1 and ch == token[i - 2] else t.DOUBLE))
        options.append(own)
    for path in itertools.product(*options):
        yield "".join(x for x, _ in path), sum(cost for _, cost in path)


@pytest.mark.parametrize("token", ["1d10t", "m0r0n", "st*p!d", "aaab", "!!", "s$s-u", "l|1!", "(00l", "@@@", "x-*-y"])
def test_search_against_all_readings(token):
    chars = fit(model_rows()).readings.model
    probability = lambda r: sum(chars.log(("^^" + r + "$")[i - 2 : i + 1]) for i in range(2, len(r) + 3))
    total = {}
    for reading, cost in all_readings(token):
        total[reading] = max(total.get(reading, -1e9), cost + probability(reading))
    assert total[chars.restore(token)] == pytest.approx(max(total.values()))


def test_rows_that_stay(spark):
    model = fit(model_rows())
    rows = [(None, "stupid idiot moron", 1), (1, "the river and garden today", 2), (1, None, 3), (None, "the harbour", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    left = toxicity.without_toxic(docs, model)
    assert left.columns == docs.columns and sorted(r.score for r in left.collect()) == [2, 3, 4]

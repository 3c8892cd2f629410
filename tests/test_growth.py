"""What queries move and evaluate doesn't grow faster than their input."""

import math
import random
import unicodedata
from collections import Counter

import pytest

from wardline.functions import language
from wardline.operators import injection
from wardline.plans import stages, tables

from .test_whole import grams, posterior


@pytest.fixture(scope="module")
def many(spark, tmp_path_factory):
    """600 texts of 80 words out of few, so they share almost all of their grams."""
    sf, rnd = str(tmp_path_factory.mktemp("many")), random.Random(3)
    words = "the river idiot garden were calm today von mit vous letter moron stupid winter".split()
    texts = [" ".join(rnd.choices(words, k=80)) for _ in range(600)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(i, 1, i % 2) for i in range(600)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    return sf, {i: grams(t) for i, t in enumerate(texts)}


def shuffled(spark) -> int:
    """Records that all stages of the session have shuffled."""
    gateway = spark.sparkContext._gateway
    none = gateway.jvm.java.util.ArrayList()
    stages_run = spark.sparkContext._jsc.sc().statusStore().stageList(none, False, False, gateway.new_array(gateway.jvm.double, 0), none)
    return sum(stages_run.apply(i).shuffleWriteRecords() for i in range(stages_run.size()))


def moved(spark, run) -> int:
    before = shuffled(spark)
    run().collect()
    return shuffled(spark) - before


def test_leave_one_out_moves_grams_of_blocks(spark, many):
    sf, own = many
    pairs = sum(map(len, own.values()))
    assert moved(spark, lambda: tables.QUERIES["nb_leave_one_out"](spark, sf)) < pairs / 5


def test_prediction_moves_grams_of_blocks(spark, many):
    sf, own = many
    pairs = sum(map(len, own.values()))
    assert moved(spark, lambda: tables.QUERIES["nb_predict"](spark, sf)) < pairs / 5


def test_recurring_and_missing_ids_have_scores_of_their_own(spark):
    texts = [(1, "you are an idiot", 1), (1, "a calm garden", 0), (None, "such a moron", 1), (None, "", 0), (2, None, 1), (3, "a quiet joy", 0)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, label int")
    own = [(grams(t or ""), y) for _, t, y in texts]
    for leave, have in ((True, injection.predict_leave_one_out(docs, "doc_id")), (False, injection.fit_predict(docs, "doc_id"))):
        want = [(i, posterior(own[k][0], [x for j, x in enumerate(own) if not leave or j != k])) for k, (i, _, _) in enumerate(texts)]
        order = lambda r: (r[0] is None, r[0] or 0, r[1])
        for a, b in zip(sorted(((r.doc_id, r.score) for r in have.collect()), key=order), sorted(want, key=order), strict=True):
            assert a[0] == b[0] and a[1] == pytest.approx(b[1], abs=1e-5)


def test_prediction_with_another_model(spark):
    seen = [("abab abab", 1), ("xyz xyz", 0)]
    model_docs = spark.createDataFrame(seen, "text string, label int")
    model = injection.fit(model_docs)
    texts = {"a": "abab", "b": "xyz", "c": "quite new", "d": ""}
    have = {r.id: r.score for r in injection.predict(spark.createDataFrame(list(texts.items()), "id string, text string"), model, injection.class_facts(model_docs, model), "id").collect()}
    want = {i: posterior(grams(t), [(grams(x), y) for x, y in seen]) for i, t in texts.items()}
    assert have == {i: pytest.approx(p, abs=1e-5) for i, p in want.items()}


def test_fit_counts_in_blocks(spark, many):
    """Python returns a block's distinct grams, not those of each text."""
    sf, own = many
    df = tables.QUERIES["nb_fit_counts"](spark, sf)
    df.collect()

    def nodes(plan):
        inner = {"AdaptiveSparkPlanExec": "finalPhysicalPlan", "ShuffleQueryStageExec": "plan"}.get(plan.getClass().getSimpleName())
        kids = plan.children()
        yield plan
        for k in [getattr(plan, inner)()] if inner else [kids.apply(i) for i in range(kids.size())]:
            yield from nodes(k)

    rows = [n.metrics().apply("pythonNumRowsReceived").value() for n in nodes(df._jdf.queryExecution().executedPlan()) if n.getClass().getSimpleName().startswith("MapInArrow")]
    assert rows and sum(rows) < sum(map(len, own.values())) / 5


@pytest.mark.parametrize("letters", ["ab c", "abcdefgh é🙂\x00 ", "".join(map(chr, range(0x4E00, 0x4E00 + 6000))) + " "])
def test_blocks_of_any_alphabet(letters):
    rnd = random.Random(1)
    texts = [None, "", " ", "a", *("".join(rnd.choices(letters, k=rnd.choice([0, 1, 2, 5, 50, 1000]))) for _ in range(40))]
    classes, own = [rnd.choice([0, 1, 2, None]) for _ in texts], [Counter("" if t is None else grams_of(t)) for t in texts]
    both = [sum((g for g, c in zip(own, classes, strict=True) if c == y), Counter()) for y in (0, 1)]
    names, n0, n1 = injection.block_grams(texts, classes)
    assert sorted(names) == sorted(set().union(*own)) and [(both[0][g], both[1][g]) for g in names] == list(zip(n0, n1, strict=True))
    order = rnd.sample(range(len(texts)), len(texts))  # the order of a block's texts doesn't matter
    s0, s1, total, only = injection.block_sums([texts[i] for i in order], [classes[i] for i in order], n0, n1, 1.0, True)
    for k, i in enumerate(order):
        want = [sum(n * math.log(both[y][g] + 1 - n * (classes[i] == y)) for g, n in own[i].items()) for y in (0, 1)]
        assert [s0[k], s1[k]] == pytest.approx(want) and total[k] == own[i].total() and only[k] == sum(n == both[0][g] + both[1][g] for g, n in own[i].items())


def grams_of(text):
    t = " " + " ".join(text.lower().split()) + " "
    return [t[i : i + k] for k in (3, 4, 5) for i in range(len(t) - k + 1)]


# ------------------------------------------------------------ languages


def cuts(df) -> int:
    """How often the plan cuts a text into words."""
    return df._jdf.queryExecution().optimizedPlan().toString().count(r"\p{L}+")


@pytest.mark.parametrize("name", ["convert_allowed_prompts", "lang_allowed_rows", "lang_allowed_counts", "lang_detected"])
def test_texts_are_cut_into_words_once(spark, many, name):
    assert cuts(stages.QUERIES[name](spark, many[0])) == 1


def test_words_against_plain_python(spark):
    rnd = random.Random(5)
    pieces = [w for v in language.COMMON.values() for w in v] + [*language.VIETNAMESE, "đường", "ĐƯỢC", "việtx", "xviệt", "The", "QUE", "le²", "le1", "ẹ", "naïve", "词", "_la_", "ạạ", "İs", "là", "la"]
    texts = ["", None, " ", "123", *("".join(rnd.choice(pieces) + rnd.choice([" ", ", ", "-", "", "\n"]) for _ in range(rnd.randrange(1, 30))) for _ in range(300))]

    def words(text):
        return "".join(c if unicodedata.category(c)[0] == "L" else " " for c in text.lower()).split(" ")

    def scores(text):
        return [sum(w in v or (k == "vi" and bool(set(w) & set(language.VIETNAMESE))) for w in words(text)) for k, v in language.COMMON.items()]

    from pyspark.sql import functions as F

    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", language.word_scores(F.coalesce("text", F.lit(""))).alias("s"), language.detect_language(F.col("text")).alias("l")).collect()
    for r in rows:
        want = scores(texts[r.i] or "")
        assert list(r.s) == want and r.l == (list(language.COMMON)[want.index(max(want))] if max(want) else None)

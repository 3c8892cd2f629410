import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from wardline.functions import text as T
from wardline.plans import tables


@pytest.fixture(scope="module")
def tables_dir(spark, tmp_path_factory):
    """A small set of tables whose texts differ only behind the first 160 characters."""
    sf = str(tmp_path_factory.mktemp("whole"))
    same = "the river and the garden were calm today " * 5
    tails = ["you are an idiot", "a letter arrived", "such a stupid moron", "a quiet joy in winter", "idiot and moron", "reading by the harbour"]
    spark.createDataFrame([(i, same + t) for i, t in enumerate(tails)], "doc_id long, text string").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(i, 1, (i + 1) % 2) for i in range(len(tails))], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    return sf, {i: (same + t, (i + 1) % 2) for i, t in enumerate(tails)}


def grams(text):
    t = " " + re.sub(r"\s+", " ", text.lower()).strip() + " "
    return Counter(t[i : i + k] for k in (3, 4, 5) for i in range(len(t) - k + 1))


def posterior(own, others):
    """others: (grams, label) of the documents of the model."""
    count = [sum((g for g, y in others if y == c), Counter()) for c in (0, 1)]
    v = len(count[0] | count[1])
    log = [math.log((sum(y == c for _, y in others) + 1) / (len(others) + 2)) + sum(n * math.log((count[c][g] + 1) / (count[c].total() + v)) for g, n in own.items()) for c in (0, 1)]
    return 1 / (1 + math.exp(log[0] - log[1]))


def test_naive_bayes_reads_whole_texts(spark, tables_dir):
    sf, rows = tables_dir
    rows = {i: (grams(t), y) for i, (t, y) in rows.items()}
    counts = {r.gram: (r.n0, r.n1) for r in tables.QUERIES["nb_fit_counts"](spark, sf).collect()}
    both = [sum((g for g, y in rows.values() if y == c), Counter()) for c in (0, 1)]
    assert counts == {g: (both[0][g], both[1][g]) for g in both[0] | both[1]} and "idiot" in counts
    for name, others in (("nb_predict", lambda i: list(rows.values())), ("nb_leave_one_out", lambda i: [x for j, x in rows.items() if j != i])):
        have = {r.doc_id: r.score for r in tables.QUERIES[name](spark, sf).collect()}
        assert set(have) == set(rows)
        for i, (own, _) in rows.items():
            assert have[i] == pytest.approx(posterior(own, others(i)), abs=1e-4), (name, i)


def test_grams_of_any_text(spark):
    texts = ["a🙂b été", "", None, "ab", " \t ", "abc", "x" * 300]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    have = {r.i: Counter(r.g) for r in df.select("i", T.char_ngrams(F.col("text")).alias("g")).collect()}
    assert have == {i: grams(t or "") for i, t in enumerate(texts)}


def test_queries_cover_all_rows(spark, tmp_path):
    sf = str(tmp_path)
    spark.createDataFrame([(1, "no address"), (2, "to a.b@x.vn now"), (3, None)], "doc_id long, text string").write.parquet(f"{sf}/documents.parquet")
    labels = [(1, 1, 1), (5, 1, 0), (301, 1, 1), (305, 0, 1), (307, 0, 0), (311, 1, 0), (313, 1, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, 1, "view"), (2, 1, "error"), (3, 5, "click"), (4, 5, "view"), (5, 307, "signup")], "event_id long, user_id long, event_type string").write.parquet(f"{sf}/events.parquet")
    run = lambda name: tables.QUERIES[name](spark, sf).collect()
    assert {r.doc_id for r in run("pii_redacted_right")} == {1, 2, 3}
    picked = run("balanced_eval")
    assert {(r.doc_id, r.y) for r in picked if r.gold} == {(1, True), (301, True), (305, True), (307, False)}
    weak = {r.doc_id for r in picked if not r.gold}
    assert len(weak) == 2 and weak < {5, 311, 313}
    assert {r.doc_id: (r.action, r.source) for r in run("layer_merge")} == {
        1: ("error", "api"), 5: ("click", "human"), 301: ("reject", "source"), 305: ("reject", "source"), 307: ("signup", "api"), 311: (None, None), 313: (None, None),
    }


def test_many_spans_are_folded_in_little_time(spark):
    """A hundred thousand spans and characters: folds append in runs, so nothing takes squared time."""
    import time

    from pyspark.sql import functions as F

    from wardline.functions import text as T
    from wardline.operators import spans

    text = "ab@cd.ef 🙂 " * 30_000
    df = spark.createDataFrame([(1, text)], "id int, text string").withColumn("s", T.match_spans("text", r"[a-z]+@[a-z]+\\.[a-z]+".replace("\\\\", "\\"), None))
    began = time.time()
    found = df.withColumn("spans", F.transform("s", lambda s, i: F.struct(F.lit("EMAIL").alias("entity_type"), s["start"].alias("start"), s["end"].alias("end"), F.lit(0.5).alias("score"), F.lit("p").alias("pattern"), s["text"].alias("text"), F.lit(0).alias("ord"))))
    row = found.select(F.size("s").alias("n"), F.element_at("s", -1)["start"].alias("last"), F.md5(spans.anonymize(F.col("text"), F.col("spans"))).alias("t"), F.size(spans.remove_contained(F.col("spans"))).alias("kept"), F.size(spans.dedupe_exact(F.col("spans"))).alias("one")).first()
    assert (row.n, row.last, row.kept, row.one) == (30_000, 11 * 29_999, 30_000, 30_000)
    assert row.t == __import__("hashlib").md5(("<EMAIL> 🙂 " * 30_000).encode()).hexdigest()
    assert time.time() - began < 60


def test_span_algebra_against_plain_python(spark):
    import random

    from pyspark.sql import functions as F

    from wardline.functions.text import SPAN
    from wardline.operators import spans

    rnd = random.Random(6)
    rows = []
    for i in range(60):
        own = []
        for k in range(rnd.choice([0, 1, 5, 200, 300])):
            a = rnd.randrange(300)
            own.append((rnd.choice("AB"), a, a + rnd.randrange(1, 12), rnd.choice([0.0, 0.3, 0.5, 0.9]), "p", None, k % 4))
        rows.append((i, own))
    df = spark.createDataFrame(rows, f"id int, spans array<{SPAN}>")
    out = df.select("id", spans.remove_contained(F.col("spans")).alias("r"), spans.dedupe_exact(F.col("spans")).alias("d"), spans.merge_overlaps(F.col("spans")).alias("m"))
    for r in out.collect():
        own = rows[r.id][1]
        ranked = sorted({s for s in own if s[3] > 0}, key=lambda s: (-s[3], s[1], s[1] - s[2], s[0], s[6]))
        kept = []
        for s in ranked:
            if not any(k[0] == s[0] and k[1] <= s[1] and k[2] >= s[2] for k in kept):
                kept.append(s)
        assert [tuple(s) for s in r.r] == kept
        best = {}
        for s in own:
            if (s[1], s[2]) not in best or s[3] > best[s[1], s[2]][3]:
                best[s[1], s[2]] = s
        assert [tuple(s) for s in r.d] == [best[k] for k in sorted(best)]
        merged = []
        for s in sorted(own, key=lambda s: (s[1], -s[3])):
            if not merged or s[1] >= merged[-1][2]:
                merged.append(s)
            elif s[3] > merged[-1][3]:
                merged[-1] = s
        assert [tuple(s) for s in r.m] == merged


def test_narrowing_counts_code_points(spark):
    from pyspark.sql import functions as F

    from wardline.operators import geometry

    rows = [("🙂🙂 name Ann Lee end", 0, 20, "Ann Lee", (8, 15)), ("x ann\n LEE", 0, 10, "Ann Lee", (2, 10)), ("abc", 0, 3, "zz", (0, 3)), ("abc", 0, 3, "", (0, 3)), ("🙂 a.c abc", 2, 9, "a.c", (2, 5)), ("q \\E z", 0, 6, "\\E", (2, 4))]
    df = spark.createDataFrame([r[:4] for r in rows], "t string, a int, b int, w string")
    have = df.select(geometry.narrow(F.col("t"), F.col("a"), F.col("b"), F.col("w")).alias("r")).collect()
    assert [(r.r.start, r.r.end) for r in have] == [r[4] for r in rows]


def test_sweep_over_raw_scores(spark):
    from wardline.operators import metrics

    rows = [(0.4999996, 1), (0.5, 0), (0.5000004, 1), (0.93, 1), (0.2, 0), (0.2, 1)]
    have = {r.threshold: (r.tp, r.fp, r.fn, r.tn) for r in metrics.threshold_sweep(spark.createDataFrame(rows, "score double, label int"), 0.06).collect()}
    want = sorted({round(i * 0.06, 4) for i in range(int(1 / 0.06) + 1)} | {round(s, 6) for s, _ in rows})
    assert sorted(have) == want and max(want) <= 1
    for t in want:
        said = [(s >= t, y) for s, y in rows]
        assert have[t] == tuple(said.count(x) for x in ((True, 1), (True, 0), (False, 1), (False, 0)))

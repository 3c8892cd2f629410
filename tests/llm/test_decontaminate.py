import hashlib
import random
import re

import pytest

from wardline.llm import decontaminate as d

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))
    out = []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for item, t in items:
            v = words(t)
            n = min(10, len(v))
            wins = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if n else set()
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in wins:
                    hit |= set(range(i, i + n))
                    if item is not None:
                        found.add(str(item))
        out.append((doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("part_bytes", [64 << 20, 400])
def test_against_brute_force(spark, monkeypatch, part_bytes):
    monkeypatch.setattr(d, "PART_BYTES", part_bytes)
    rnd = random.Random(5)
    vocab = ["alpha", "Beta", "g4", "été", "Ömer", "x", "y"]
    items = [(i, " ".join(rnd.choices(vocab, k=rnd.choice([1, 3, 9, 10, 11, 14, 25])))) for i in range(9)] + [(9, None), (10, ""), (11, "... !!"), (0, "Alpha beta gamma"), (None, "only here one two"), (None, "zz qq zz")]
    docs = [(i, ", ".join(rnd.choices([*vocab, "zz", "qq"], k=rnd.randrange(0, 60)))) for i in range(60)]
    docs += [(60 + i, f"Lead in, {t} and out") for i, (_, t) in enumerate(items)] + [(80, None), (81, ""), (81, ""), (82, "alpha " * 5000), (None, "alpha beta gamma only here one two"), (None, "qq"), (80, "only here one two"), (83, items[5][1]), (83, items[5][1])]
    have = d.contamination(spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as n_words", "1 as row_", "'x' as TEXT"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(map(tuple, have.collect()), key=str) == brute(docs, items)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    assert d.contamination(none, items).collect() == []
    row = d.contamination(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), items).first()
    assert (row.n_words, row.n_hit, row.n_items, row.contaminated) == (2, 0, 0, False)


def test_rows_that_stay(spark):
    items = spark.createDataFrame([(1, "one two three"), (None, "four five")], "item_id long, text string")
    rows = [(1, "x One, two three", 5), (None, "four five", 6), (None, "clean", 7), (2, None, 8), (2, "clean too", 9), (1, "clean", 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_hit int")
    for part_bytes in (64 << 20, 5):
        d.PART_BYTES = part_bytes
        try:
            out = d.without_contaminated(docs, items)
            assert out.columns == docs.columns and sorted(r.n_hit for r in out.collect()) == [7, 8, 9, 10]
        finally:
            d.PART_BYTES = 64 << 20

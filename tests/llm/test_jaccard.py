import random
import re
from collections import Counter, defaultdict

import pytest

from wardline.llm import jaccard

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))
    return frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[i : i + 5]) for i in range(len(w) - 4)])


def brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = Counter()
    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j]:
                inter = len(sets[i] & sets[j])
                if 100 * inter >= 80 * (len(sets[i]) + len(sets[j]) - inter):
                    links[i] += 1
                    links[j] += 1
                    a, b = find(i), find(j)
                    root[max(a, b)] = min(a, b)
    return {i: (len(s), find(i), links[i]) for i, s in sets.items()}


def rows_of(seed):
    rnd = random.Random(seed)
    word = lambda: f"w{rnd.randrange(400)}"
    common = [word() for _ in range(40)]
    rows = []
    for _ in range(8):
        base = [word() for _ in range(rnd.choice([4, 9, 40, 120]))]
        for _ in range(rnd.choice([1, 5, 30])):
            own = list(base)
            for _ in range(rnd.randrange(0, 1 + len(own) // 25)):
                own[rnd.randrange(len(own))] = word()
            rows.append(" ".join(own))
    rows += [" ".join([*(word() for _ in range(15)), *common]) for _ in range(40)]
    rows += [rows[0], rows[0].upper(), rows[0] + " ", "a b c", "A  B c", "", None, " \n", "a " * 4000, "a " * 3000]
    rnd.shuffle(rows)
    return list(enumerate(rows, 3))


@pytest.mark.parametrize("seed,chunk", [(1, 1_500_000), (2, 300)])
def test_against_brute_force(spark, monkeypatch, seed, chunk):
    monkeypatch.setattr(jaccard, "CHUNK_TOKENS", chunk)
    monkeypatch.setattr(jaccard, "TASK_TOKENS", chunk)
    monkeypatch.setattr(jaccard, "BLOCK_BYTES", 20_000)
    rows = rows_of(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n", "'x' as th", "2 as block", "'z' as TEXT", "7 as k")
    have = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in jaccard.similarity_join(df).collect()}
    assert have == brute(rows)


def test_repeated_rows_and_no_rows(spark):
    df = spark.createDataFrame([(5, "a b c d e f"), (5, "a b c d e f"), (4, "x")], "doc_id long, text string")
    assert sorted(map(tuple, jaccard.similarity_join(df).collect())) == [(4, 1, 4, 0), (5, 2, 5, 1), (5, 2, 5, 1)]
    assert jaccard.similarity_join(df.limit(0)).collect() == []


def test_null_and_recurring_ids(spark):
    base = " ".join(f"w{i}" for i in range(40))
    rows = [(5, "a b c d e f"), (5, "q r s t u v w"), (5, "q r s t u v w"), (6, "zz"), (None, "one two three four five six"), (None, base), (9, base + " x"), (7, base), (None, "k l m n o p"), (None, "k l m n o p q"), (None, None), (8, "zz")]
    out = jaccard.similarity_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = [(5, 2, 5, 0), (5, 3, 5, 1), (5, 3, 5, 1), (6, 1, 6, 1), (8, 1, 6, 1), (None, 2, None, 0), (None, 36, 7, 2), (7, 36, 7, 2), (9, 37, 7, 2), (None, 2, None, 0), (None, 3, None, 0), (None, 0, None, 0)]
    assert sorted(map(tuple, out), key=str) == sorted(want, key=str)


def test_words_that_collide_under_a_polynomial(spark):
    """Thue-Morse words and their complements have one polynomial hash modulo 2**64, whatever the base."""
    rows, other = [], str.maketrans("ab", "ba")
    for n in (1024, 2048, 4096):
        word = "a"
        while len(word) < n:
            word += word.translate(other)
        rows += [(n, word), (n + 1, word.translate(other))]
    out = jaccard.similarity_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(r.component_id == r.doc_id and r.n_links == 0 for r in out) and len(out) == 6


def test_repeated_rows_fill_no_block(spark):
    rows = [(1, "a b c d e f g")] * 500 + [(None, "h i j k l m")] * 300
    out = jaccard.similarity_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {tuple(r) for r in out} == {(1, 3, 1, 499), (None, 2, None, 299)} and len(out) == 800


def test_rows_that_stay(spark):
    base = " ".join(f"w{i}" for i in range(40))
    rows = [(9, base, 1), (None, base, 2), (7, base + " x", 3), (7, "a b", 4), (7, "a b", 5), (None, "zz", 6), (None, "zz", 7), (3, "zz", 8), (1, None, 9), (1, "", 10), (1, " \n", 11), (None, "q w e r t y", 12), (5, "solo", 13)]
    left = jaccard.without_copies(spark.createDataFrame(rows, "doc_id long, text string, n int"))
    assert left.columns == ["doc_id", "text", "n"]
    have = sorted(r.n for r in left.collect())
    assert have[0] == 3 and have[1] in (4, 5) and have[2:] == [8, 9, 10, 11, 12, 13]
    assert jaccard.without_copies(left.limit(0)).collect() == []

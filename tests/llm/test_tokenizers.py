import random
import struct
import time

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from wardline.llm import bpe, token_counts

ALPHABET = "aAàéÉß ΣΣς'’s\n\t  \x1c\x85İ中文字🙂é١٢½,."


def texts():
    rnd = random.Random(4)
    out = ["".join(rnd.choices(ALPHABET, k=rnd.randrange(0, 40))) for _ in range(400)] + ["".join(rnd.choices("ab' \n", k=rnd.randrange(0, 30))) for _ in range(400)]
    out += ["a<|endoftext|>B", "<|startoftext|> x <|ENDOFTEXT|>", "a" * 3000, "ab" * 999, "don't it's we'll 'tis", "!'s  ?", " x  y ", "</w> a</w>b", "\n\n a", "Straße ΟΔΟΣ", "word " * 20000]
    return out


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_backtracking_equals_the_library(spark, name):
    path = public_tokenizers.path(name)
    ref = Tokenizer.from_file(path)
    rows = [*enumerate(texts()), (9000, None), (9001, ""), (9001, "")]
    have = sorted(bpe.encode_decode(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as ids", "2 as TEXT"), path).collect())
    assert len(have) == len(rows)
    by = dict(rows)
    for r in have:
        ids = ref.encode(by[r.doc_id] or "", add_special_tokens=False).ids
        assert list(struct.unpack(f"<{len(ids)}I", r.ids)) == ids and r.n_tokens == len(ids)
        assert r.decoded == ref.decode(ids, skip_special_tokens=False)


def test_counts_with_a_small_table_and_short_sequences(monkeypatch):
    """In this process, so that the constants reach the code: the table is started anew all the time, most sequences count as long."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    ref = Tokenizer.from_file(path)
    monkeypatch.setattr(token_counts, "CACHED", 50)
    monkeypatch.setattr(token_counts, "LONG", 3)
    counter = token_counts.Counter(open(path, encoding="utf-8").read())
    for t in texts():
        assert counter.counts([t]) == [len(ref.encode(t, add_special_tokens=False).ids)]
        assert len(counter.known) <= 50 + len(set(t.split(" "))) + 1


def test_long_sequences(monkeypatch):
    path = public_tokenizers.path("byte_bpe_50k.json")
    ref = Tokenizer.from_file(path)
    counter = token_counts.Counter(open(path, encoding="utf-8").read())
    rnd = random.Random(5)
    long = ["".join(rnd.choices("etaoinshrdlu", k=n)) for n in (255, 256, 257, 5000, 100_000)] + ["a" * 99_999, "ab" * 30_000, "é" * 20_000]
    began = time.time()
    assert counter.counts(long) == [len(ref.encode(t, add_special_tokens=False).ids) for t in long]
    assert time.time() - began < 15 and not any(len(k) > token_counts.KEPT for k in counter.known)


def test_rank_synchronous_counts_equal_the_library(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    ref = Tokenizer.from_file(path)
    rows = [*enumerate(texts()), (9000, None), (9001, ""), (9001, "")]
    by = dict(rows)
    have = token_counts.count_tokens(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n_tokens", "2 as TEXT"), path).collect()
    assert len(have) == len(rows)
    for r in have:
        text = by[r.doc_id] or ""
        assert (r.n_bytes, r.n_tokens) == (len(text.encode()), len(ref.encode(text, add_special_tokens=False).ids))


def test_no_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.encode_decode(none, public_tokenizers.path("word_bpe_49k.json")).collect() == []
    assert token_counts.count_tokens(none, public_tokenizers.path("byte_bpe_50k.json")).collect() == []

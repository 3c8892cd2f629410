import math
import os
import re
import struct
import zlib

import public_tokenizers
import pytest
import regex
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm import test_decontaminate, test_jaccard, test_pii
from wardline.llm import pii, toxicity

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


def added_spans(text):
    """Spans of the added kinds, by plain rules: mod 97 as one number, forty characters on each side."""
    for kind, pattern, _, score, near in pii.KINDS[len(pii.BASE) :]:
        for m in regex.finditer(pattern, text):
            if kind == "iban":
                plain = m[0].replace(" ", "")
                if int("".join(str(int(ch, 36)) for ch in plain[4:] + plain[:4])) % 97 != 1:
                    continue
            around = (text[max(0, m.start() - pii.NEAR) : m.start()] + " " + text[m.end() : m.end() + pii.NEAR]).lower()
            if score + pii.BOOST * bool(re.search(f"(?:^|[^a-z])(?:{near})", around)) >= pii.MIN_SCORE:
                yield m.start(), -m.end(), kind


def plain_redaction(text):
    base = [(m.start(), -m.end(), k) for k, p in test_pii.PLAIN for m in re.finditer(p, text or "") if test_pii.keep(k, m[0])]
    order = {k[0]: i for i, k in enumerate(pii.KINDS)}
    found = sorted([*base, *added_spans(text or "")], key=lambda x: (x[0], x[1], order[x[2]]))
    out, at = "", 0
    for start, end, kind in found:
        if start >= at:
            out, at = out + text[at:start] + f"<{kind.upper()}>", -end
        else:
            at = max(at, -end)
    return out + text[at:] if found else text


def test_run_against_a_plain_version(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    gold = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    learn = {i: y for i, y in gold.items() if zlib.crc32(str(i).encode()) % 3 != 1 and i in docs}
    odds = math.log(sum(learn.values()) / (len(learn) - sum(learn.values())))
    chars = toxicity.gram_counts([r.text or "" for i, r in docs.items() if zlib.crc32(str(i).encode()) % 3 != 1])
    model = toxicity.Model([(toxicity.reduced(docs[i].text), learn[i]) for i in sorted(learn)], chars, odds)
    left = {i: r.text for i, r in docs.items() if model.score(r.text) < toxicity.THRESHOLD}
    linked = test_jaccard.brute(sorted(left.items()))
    left = {i: t for i, t in left.items() if linked[i][1] == i}
    hit = {r[0] for r in test_decontaminate.brute(sorted(left.items()), items) if r[5]}
    left = {i: t for i, t in left.items() if i not in hit}
    ref = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    have = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(have) == set(left) and 0 < len(left) < len(docs)
    for i in left:
        ids = ref.encode(plain_redaction(left[i]) or "", add_special_tokens=False).ids
        assert list(struct.unpack(f"<{len(ids)}I", have[i].ids)) == ids and have[i].n_tokens == len(ids)
        assert have[i].decoded == ref.decode(ids, skip_special_tokens=False)


def test_stages_keep_the_columns_and_stand_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs.limit(0), SF)
        assert out.count() == 0 and (name == "tokens" or out.columns == docs.columns), name


def test_stages_judge_rows_and_not_ids(spark):
    """Rows with null or recurring ids, null texts and repeats: each goes or stays by its own text."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    base = docs.where("n_chars > 500").first()
    extra = [(None, f"zeta {item} eta", "en", "s", 1), (None, "a clean row of its own", "en", "s", 1), (base.doc_id, "another clean row", "en", "s", 1), (None, None, None, None, None)]
    extra = spark.createDataFrame(extra, docs.schema)
    rows = docs.unionAll(extra)
    clean = corpus_pipeline.drop_contaminated(spark, rows, SF)
    texts = [r.text for r in clean.select("text").collect()]
    assert None in texts and "another clean row" in texts and f"zeta {item} eta" not in texts and "a clean row of its own" in texts
    one = corpus_pipeline.drop_near_duplicates(spark, rows.unionAll(extra), SF)
    texts = [r.text for r in one.where("doc_id is null or text = 'another clean row'").select("text").collect()]
    assert sorted(texts, key=str) == sorted([None, None, "another clean row", "a clean row of its own", f"zeta {item} eta"], key=str)
    assert corpus_pipeline.redact_personal_data(spark, rows, SF).count() == rows.count()
    toxic = corpus_pipeline.drop_toxic(spark, rows, SF)
    assert toxic.where("text = 'another clean row' or text is null").count() == 2

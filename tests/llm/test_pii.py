import hashlib
import random
import re

from wardline.llm import pii

PLAIN = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def luhn(digits):
    total = 0
    for i, ch in enumerate(reversed(digits)):
        d = int(ch) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def keep(kind, v):
    d = re.sub("[^0-9]", "", v)
    return {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in v.split(".")), "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]


def brute(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, p in PLAIN for m in re.finditer(p, text or "") if keep(k, m[0])]


def test_base_spans_equal_the_plain_patterns(spark):
    rnd = random.Random(8)
    alphabet = list("a@.@._%-+1234567890 ()-.é🙂")
    texts = ["".join(rnd.choices(alphabet, k=rnd.randrange(0, 60))) for _ in range(1500)]
    texts += [f"x{rnd.choice(['', ' ', '🙂 '])}{' -'[i % 2].join(['4111', '1111', '1111', '1111'])}" for i in range(20)]
    texts += ["a@b.c@d.e", "a@b.com_x@y.z", "1.2.3.4.5.6.7.8", "256.1.1.1 010.001.000.255", "4111111111111111 2", "+1 (743) 555-3824.", "mail é🙂 jo@x.org", None, "", "1" * 60000, "1 " * 60000, "a." * 4000, "a@b" + ".c" * 30000, "+1" + " " * 50000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 as start")
    for r in pii.digests(pii.find_pii(df)).collect():
        want = brute(texts[r.doc_id])
        base = [s for s in r.spans.split(",") if s.split(":")[0] in pii.BASE]
        assert base == want, texts[r.doc_id][:200]
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s.startswith(k) for s in want) for k in pii.BASE]


def test_added_kinds_context_and_redaction(spark):
    rows = [
        (1, "IBAN DE89 3704 0044 0532 0130 00 ok"), (2, "IBAN DE88 3704 0044 0532 0130 00 no"), (3, "ssn 078-05-1120"), (4, "part 078-05-1120"), (5, 'token = "24be64439e3e49cf46"'),
        (6, "é mail jo@x.org, +1 (743) 555-3824 end"), (7, None), (7, None),
    ]
    found = pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string"))
    have = {r.doc_id: (r.text, [(s.kind, round(s.score, 2)) for s in r.pii]) for r in pii.redact(found).collect()}
    assert have[1] == ("IBAN <IBAN> ok", [("iban", 0.95)]) and have[2][1] == []
    assert have[3] == ("ssn <SSN>", [("ssn", 0.65)]) and have[4][1] == []
    assert have[5][0] == "<SECRET>"
    assert have[6][0] == "é mail <EMAIL>, <PHONE> end"
    assert have[7] == (None, []) and found.count() == len(rows)
    assert pii.find_pii(found.drop("pii").limit(0)).collect() == []


def test_clashing_names_and_null_ids(spark):
    df = spark.createDataFrame([(None, "a@b.cd"), (1, None)], "doc_id long, text string").selectExpr("*", "'TOP' as TEXT", "5 as pii", "'x' as _text", "2 as _m_ip", "3 as DOC_ID")
    found = pii.find_pii(df)
    assert found.columns == ["doc_id", "text", "TEXT", "pii_input", "_text", "_m_ip", "DOC_ID", "pii"]
    assert sorted((r.doc_id, r.n_email) for r in pii.digests(found).collect() if r.doc_id is None) == [(None, 1)]
    rows = sorted((tuple(r) for r in pii.redact(found).collect()), key=str)
    assert [r[:7] for r in rows] == [(1, None, "TOP", 5, "x", 2, 3), (None, "<EMAIL>", "TOP", 5, "x", 2, 3)]


def test_many_spans_in_one_text(spark):
    import time

    text = " ".join(f"u{i}@x.org or 10.0.{i % 256}.1, é🙂" for i in range(20000))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    began = time.time()
    row = pii.digests(pii.find_pii(df)).first()
    assert row.spans.split(",") == brute(text) and row.n_email == row.n_ip == 20000
    plain = __import__("re").sub(r"u\d+@x\.org", "<EMAIL>", __import__("re").sub(r"10\.0\.\d+\.1", "<IP>", text))
    assert pii.redact(pii.find_pii(df)).first().text == plain
    assert time.time() - began < 60


def test_overlapping_spans_over_runs(spark):
    rows = [(1, "mail é a@1.2.3.4 " * 300 + "end")]
    assert pii.redact(pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string"))).first().text == "mail é <EMAIL> " * 300 + "end"

"""Prompt-injection detectors: weighted rules, and a character n-gram naive Bayes model with exact leave-one-out.

The rule detector is a column expression.  The naive Bayes model is two grouped counts; to predict, a block of texts asks for each of its
distinct n-grams once.  Leave-one-out never refits: a document's own counts are taken off the totals, which is the same sum.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import BENIGN_MARKERS, RULES, TOPIC_MARKERS, Rule
from ..functions.text import match_spans
from ..sources.places import scratch
from .spans import folded, holds_any

WARN, BLOCK = 0.45, 0.75
DIVERSITY = 0.08
#: Case-folded literals one of which every match of a rule holds.
ANCHORS = {
    "ignore_previous_instructions": ["hướng", "chỉ", "quy", "lệnh", "nội", "system", "instruction", "rule", "prompt"], "prefer_user_instruction_over_system": ["developer", "system", "quy", "hệ"],
    "reveal_hidden_prompt": ["system", "developer", "lời", "chỉ", "prompt", "nội", "quy", "internal"], "print_system_prompt": ["system", "developer", "hidden", "internal"],
    "policy_bypass": ["chính", "bộ", "guardrail", "kiểm", "toàn", "hạn", "safety", "filter", "policy", "restriction"], "unsafe_roleplay": ["dan", "không", "chế", "unrestricted", "limit", "developer"],
    "tool_permission_bypass": ["phép", "quyền", "xác", "hỏi", "permission", "confirmation", "approval"], "permission_bypass_before_tool": ["tool", "api", "database", "lệnh", "terminal", "shell", "command"],
    "direct_shell_permission_bypass": ["shell", "terminal"], "secret_or_data_exfiltration": ["khẩu", "token", "api", "secret", "credential", "password", "thông", "dữ", "user", "lịch"], "production_config_secret_access": ["config", "cấu"],
    "external_secret_exfiltration": ["webhook", "ngoài", "external"], "credential_dump": ["credential", "secret", "token"], "encoded_instruction": ["giải", "decode", "base64", "mã", "encoded"],
    "retrieved_context_instruction": ["tài", "nội", "retrieved", "document"],
}
MATCH = "struct<rule:string,category:string,weight:double,start:int,end:int,text:string>"


def benign_discussion(text: Column, low: Column | None = None) -> Column:
    """Row-level guard: some marker of a harmless discussion and some topic marker, in the lower-cased text."""
    low = F.lower(text) if low is None else low
    return holds_any(low, BENIGN_MARKERS) & holds_any(low, TOPIC_MARKERS)


def _as_match(r: Rule):
    return lambda s: F.struct(F.lit(r.name).alias("rule"), F.lit(r.category).alias("category"), F.lit(r.weight).alias("weight"), s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text")).cast(MATCH)


def rule_matches(text: Column | str, rules: list[Rule] = RULES, low: Column | None = None) -> Column:
    """All matches of all rules, distinct by rule and place; none where the guard holds.

    low: the folded text, as a column of its own, so that it isn't made anew for each literal that is looked for.
    """
    text = F.col(text) if isinstance(text, str) else text
    low = folded(text) if low is None else low
    none = F.array().cast(f"array<{MATCH}>")
    parts = []
    for r in rules:
        found = F.transform(match_spans(text, r.java, None), _as_match(r)).cast(f"array<{MATCH}>")
        parts.append(F.when(holds_any(low, ANCHORS[r.name]), found).otherwise(none) if r.name in ANCHORS else found)
    return F.when(text.isNull() | benign_discussion(text, low), none).otherwise(F.array_distinct(F.concat(*parts)))


def rule_score(matches: Column) -> Column:
    total = F.aggregate(matches, F.lit(0.0), lambda a, m: a + m["weight"])
    kinds = F.size(F.array_distinct(F.transform(matches, lambda m: m["category"])))
    return F.least(F.lit(1.0), F.round(total + DIVERSITY * F.greatest(F.lit(0), kinds - 1), 4))


def action_of(score: Column, warn: float = WARN, block: float = BLOCK) -> Column:
    return F.when(score >= block, "block").when(score >= warn, "review").otherwise("allow")


def detect_rules(docs: DataFrame, text_col: str = "text", rules: list[Rule] = RULES) -> DataFrame:
    """Adds evidence, score, action, is_injection, matched_rules and categories."""
    names = lambda field: F.array_sort(F.array_distinct(F.transform("evidence", lambda m: m[field])))
    return (
        docs.withColumn("_low", folded(F.col(text_col))).withColumn("evidence", rule_matches(text_col, rules, F.col("_low"))).drop("_low").withColumn("score", rule_score(F.col("evidence"))).withColumn("action", action_of(F.col("score")))
        .withColumn("is_injection", F.col("score") >= WARN).withColumn("matched_rules", names("rule")).withColumn("categories", names("category"))
    )


# ---------------------------------------------------------------- naive Bayes


LOW, HIGH = 3, 5  # lengths of character n-grams
BLOCK_BYTES = 1 << 23  # bytes of text whose grams are counted together


def text_gram_counts(text: str) -> tuple[list[str], list[int]]:
    """Distinct character n-grams of a text (stripped, lower-cased, white space runs as one blank, one blank at each side) with counts."""
    import numpy as np

    text = " " + " ".join(text.lower().split()) + " "
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    alphabet, code = np.unique(points, return_inverse=True)
    bits = max(1, int(len(alphabet) - 1).bit_length())
    grams, counts = [], []
    for n in range(LOW, HIGH + 1):
        m = len(points) - n + 1
        if m <= 0:
            continue
        if n * bits > 63:  # a text of very many different characters
            found = Counter(text[i : i + n] for i in range(m))
            grams += found.keys()
            counts += found.values()
            continue
        key = np.zeros(m, np.int64)
        for k in range(n):
            key = key << bits | code[k : k + m]
        _, first, size = np.unique(key, return_index=True, return_counts=True)
        grams += [text[i : i + n] for i in first.tolist()]
        counts += size.tolist()
    return grams, counts


def gram_counts(docs: DataFrame, id_col: str, text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows (id, the kept columns, gram, n): counted within each text, so nothing is shuffled."""
    import numpy as np
    import pyarrow as pa

    names = [id_col, *keep]
    own = docs.select(*names, F.col(text_col).alias("_text"))

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                found = [text_gram_counts(t) if t is not None else ([], []) for t in part.column(len(names)).to_pylist()]
                row = pa.array(np.repeat(np.arange(part.num_rows), [len(g) for g, _ in found]))
                lists = [pa.array([g for x, _ in found for g in x], pa.string()), pa.array([n for _, x in found for n in x], pa.int64())]
                yield pa.RecordBatch.from_arrays([*(part.column(i).take(row) for i in range(len(names))), *lists], [*names, "gram", "n"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields[:-1])
    return own.mapInArrow(run, f"{fields}, gram string, n long")


def _pieces(texts: list[str | None]):
    """The texts normalized and end to end: code points, their places in the alphabet, the alphabet and each text's length."""
    import numpy as np

    texts = [" " + " ".join((t or "").lower().split()) + " " for t in texts]
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    place = np.zeros(0x110000, np.int64)
    place[points] = 1
    alphabet = np.flatnonzero(place)
    place[alphabet] = np.arange(len(alphabet))
    return points, place[points], alphabet, np.array([len(t) for t in texts], np.int64)


def _grouped(code, letters: int, sizes, n: int, group, groups: int):
    """Distinct (group, n-gram) of a block with counts: arrays group, key, count; and the keys and places of all n-grams where keys hold ranks.

    Keys are in the order of the grams' code points and hold for this block only.  Where n characters of the alphabet don't fit, prefixes are ranked.
    """
    import numpy as np

    m = max(0, len(code) - n + 1)
    bits, room = max(1, (letters - 1).bit_length()), 63 - max(1, (groups - 1).bit_length())
    key, width, ranked = code[:m], bits, False
    for k in range(1, n):
        if width + bits > room:
            ranked = True
            key = np.unique(key, return_inverse=True)[1].astype(np.int64)
            width = max(1, int(key.max(initial=0)).bit_length())
        key = key << bits | code[k : k + m]
        width += bits
    inside = np.ones(len(code), bool)
    ends = np.cumsum(sizes)
    for k in range(1, n):
        inside[ends - k] = False  # a text has two characters at least, so what lies before it is another text's end
    inside = inside[:m]
    both = np.repeat(group, sizes)[:m]
    both <<= width
    both |= key
    both = both[inside]
    where = (key, np.flatnonzero(inside)) if ranked else ()
    del key
    both.sort()
    first = np.flatnonzero(np.r_[True, both[1:] != both[:-1]][: len(both)])
    both, count = both[first], np.diff(np.r_[first, len(both)])
    return both >> width, both & ((1 << width) - 1), count, *where


def _spelled(points, alphabet, distinct, n: int, key=None, at=None) -> list[str]:
    """The grams of sorted distinct keys; where they hold ranks, by any place that has the key."""
    import numpy as np

    if key is None:
        bits = max(1, (len(alphabet) - 1).bit_length())
        text = alphabet[distinct[:, None] >> np.arange(n - 1, -1, -1) * bits & ((1 << bits) - 1)]
    else:
        text = points[at[np.unique(key[at], return_index=True)[1]][:, None] + np.arange(n)]
    text = text.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
    return [text[i : i + n] for i in range(0, len(text), n)]


def block_grams(texts: list[str | None], classes: list[int | None]):
    """Distinct grams of a block of texts, shorter ones first, then by code points, and how often classes 0 and 1 have each."""
    import numpy as np

    points, code, alphabet, sizes = _pieces(texts)
    group = np.array([2 if c is None else c for c in classes], np.int64)
    grams, counts = [], [[], []]
    for n in range(LOW, HIGH + 1):
        of, found, count, *where = _grouped(code, len(alphabet), sizes, n, group, 3)
        distinct = np.unique(found)
        grams += _spelled(points, alphabet, distinct, n, *where)
        for y in (0, 1):
            own = np.zeros(len(distinct), np.int64)
            own[np.searchsorted(distinct, found[of == y])] = count[of == y]
            counts[y].append(own)
    return grams, np.concatenate(counts[0]), np.concatenate(counts[1])


def block_sums(texts: list[str | None], classes: list[int | None], n0, n1, smoothing: float, leave_out: bool):
    """For each text: sums over its grams of n * ln(count of a class + smoothing), its grams, and grams that no other text has.

    n0 and n1: counts of the block's grams in the order of block_grams().  leave_out: a text's own grams come off its class.
    """
    import numpy as np

    _, code, alphabet, sizes = _pieces(texts)
    docs = len(texts)
    group, kind = np.arange(docs, dtype=np.int64), np.array([2 if c is None else c for c in classes], np.int64)
    sums, total, only, base = [np.zeros(docs), np.zeros(docs)], np.zeros(docs, np.int64), np.zeros(docs, np.int64), 0
    for n in range(LOW, HIGH + 1):
        of, found, count, *_ = _grouped(code, len(alphabet), sizes, n, group, docs)
        distinct = np.unique(found)
        at = base + np.searchsorted(distinct, found)
        base += len(distinct)
        for y, have in ((0, n0), (1, n1)):
            x = have[at] + smoothing - (count * (kind[of] == y) if leave_out else 0)
            sums[y] += np.bincount(of, count * np.log(x, out=np.zeros(len(x)), where=x > 0), docs)
        total += np.bincount(of, count, docs).astype(np.int64)
        only += np.bincount(of, count == n0[at] + n1[at], docs).astype(np.int64)
    return *sums, total, only


def _class(label_col: str) -> Column:
    """0 or 1; 2 for another label, null for none."""
    return F.when(F.col(label_col) == 0, 0).when(F.col(label_col) == 1, 1).when(F.col(label_col).isNotNull(), 2).cast("int")


def _in_blocks(batches, text: int):
    """Lists of record batches with texts of BLOCK_BYTES, and at most 2**16 rows."""
    import pyarrow.compute as pc

    held, size, rows = [], 0, 0
    for batch in batches:
        for lo in range(0, batch.num_rows, 64):
            part = batch.slice(lo, 64)
            held.append(part)
            size, rows = size + (pc.sum(pc.binary_length(part.column(text))).as_py() or 0), rows + part.num_rows
            if size >= BLOCK_BYTES or rows >= 1 << 16:
                yield held
                held, size, rows = [], 0, 0
    if held:
        yield held


def _counted(held, text: int, kind: int):
    texts, classes = ([x for b in held for x in b.column(i).to_pylist()] for i in (text, kind))
    return block_grams(texts, classes)


def fit(docs: DataFrame, text_col: str = "text", label_col: str = "label") -> DataFrame:
    """Rows (gram, n0, n1): how often each class has the gram; counted in blocks of texts first, so few rows are shuffled."""
    import pyarrow as pa

    def run(batches):
        for held in _in_blocks(batches, 0):
            grams, n0, n1 = _counted(held, 0, 1)
            yield from pa.table([pa.array(grams, pa.string()), pa.array(n0), pa.array(n1)], ["gram", "n0", "n1"]).to_batches(max_chunksize=1 << 16)

    return _model(docs.select(F.col(text_col).alias("_text"), _class(label_col).alias("_class")).mapInArrow(run, "gram string, n0 long, n1 long"))


def _model(grams: DataFrame) -> DataFrame:
    return grams.groupBy("gram").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def _saved(df: DataFrame, name: str) -> DataFrame:
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _blocks(docs: DataFrame, text_col: str, keep: list[Column]) -> DataFrame:
    """The texts in blocks, written once to the shared folder, each block with its distinct grams.

    Rows of a text have _text and the kept columns, the first of them _class; rows of a gram have gram, its place in the block's order, and n0, n1 within the block.
    """
    import pyarrow as pa
    from pyspark import TaskContext

    own = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("_text"), *keep)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields)

    def run(batches):
        first = TaskContext.get().partitionId() << 32
        for block, held in enumerate(_in_blocks(batches, 0), first):
            width = held[0].num_columns
            types = [c.type for c in held[0].columns]
            names = [*held[0].schema.names, "_block", "gram", "place", "n0", "n1"]
            kinds = [*types, pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64()]
            for b in held:
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array([block] * b.num_rows, pa.int64()), *(pa.nulls(b.num_rows, t) for t in kinds[width + 1 :])], names)
            grams, n0, n1 = _counted(held, 0, 1)
            places = pa.array(range(len(grams)), pa.int32())
            rows = [pa.array(grams, pa.string()), places, pa.array(n0), pa.array(n1)]
            for lo in range(0, len(grams), 1 << 16):
                size = min(1 << 16, len(grams) - lo)
                yield pa.RecordBatch.from_arrays([*(pa.nulls(size, t) for t in types), pa.array([block] * size, pa.int64()), *(x.slice(lo, size) for x in rows)], names)

    return _saved(own.mapInArrow(run, f"{fields}, _block long, gram string, place int, n0 long, n1 long"), "naive-bayes-blocks")


def _own_grams(blocks: DataFrame) -> DataFrame:
    return blocks.where(F.col("gram").isNotNull()).select("gram", "_block", "place", "n0", "n1")


def _sums(blocks: DataFrame, model: DataFrame, kept: list[str], smoothing: float, leave_out: bool) -> DataFrame:
    """Rows (the kept columns, _class, s0, s1, own_total, own_only), one for each text: block_sums() with the model's counts.

    A block asks for each of its grams once, so what is shuffled goes with the blocks' distinct grams and with the texts.
    """
    import numpy as np
    import pyarrow as pa

    texts = blocks.where(F.col("gram").isNull()).select("_block", "_text", "_class", *kept)
    asked = _own_grams(blocks).select("gram", "_block", "place").join(model, "gram", "left")
    asked = asked.select(F.col("_block").alias("_asking"), "place", F.coalesce("n0", F.lit(0)).cast("long").alias("n0"), F.coalesce("n1", F.lit(0)).cast("long").alias("n1"))

    def run(left, right):
        place = right.column("place").to_numpy()
        n0, n1 = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
        n0[place], n1[place] = right.column("n0").to_numpy(), right.column("n1").to_numpy()
        found = block_sums(left.column("_text").to_pylist(), left.column("_class").to_pylist(), n0, n1, smoothing, leave_out)
        return pa.table([*(left.column(c) for c in (*kept, "_class")), *map(pa.array, found)], [*kept, "_class", "s0", "s1", "own_total", "own_only"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in blocks.select(*kept, "_class").schema.fields)
    return texts.groupBy("_block").cogroup(asked.groupBy("_asking")).applyInArrow(run, f"{fields}, s0 double, s1 double, own_total long, own_only long")


def class_facts(docs: DataFrame, model: DataFrame, label_col: str = "label") -> DataFrame:
    """One row: documents and grams of each class, and the number of distinct grams."""
    sizes = docs.agg(*[F.count(F.when(F.col(label_col) == y, 1)).alias(f"docs{y}") for y in (0, 1)])
    return sizes.crossJoin(model.agg(F.coalesce(F.sum("n0"), F.lit(0)).alias("total0"), F.coalesce(F.sum("n1"), F.lit(0)).alias("total1"), F.count("*").alias("vocabulary")))


def _posterior(l0: Column, l1: Column) -> Column:
    return F.round(1 / (1 + F.exp(l0 - l1)), 6)


def predict(docs: DataFrame, model: DataFrame, facts: DataFrame, id_col: str, text_col: str = "text", smoothing: float = 1.0, warn: float = 0.5, block: float = 0.85) -> DataFrame:
    """Rows (id, score, action, is_injection), one for each document; grams that the model lacks count too, with their smoothed share."""
    return _predicted(_blocks(docs, text_col, [F.lit(None).cast("int").alias("_class"), F.col(id_col)]), model, facts, id_col, smoothing, warn, block)


def fit_predict(docs: DataFrame, id_col: str, text_col: str = "text", label_col: str = "label", smoothing: float = 1.0, warn: float = 0.5, block: float = 0.85) -> DataFrame:
    """predict() of the documents that the model is fitted on; they are read and counted once for both."""
    blocks = _blocks(docs, text_col, [_class(label_col).alias("_class"), F.col(id_col)])
    model = _saved(_model(_own_grams(blocks)), "naive-bayes-model")
    return _predicted(blocks, model, class_facts(blocks.where(F.col("gram").isNull()), model, "_class"), id_col, smoothing, warn, block)


def _predicted(blocks: DataFrame, model: DataFrame, facts: DataFrame, id_col: str, smoothing: float, warn: float, block: float) -> DataFrame:
    a = smoothing
    words = a * F.greatest(F.lit(1), F.col("vocabulary"))
    log = lambda y: F.ln((F.col(f"docs{y}") + a) / (F.col("docs0") + F.col("docs1") + 2 * a)) + F.col(f"s{y}") - F.col("own_total") * F.ln(F.col(f"total{y}") + words)
    scored = _sums(blocks, model, [id_col], a, False).crossJoin(F.broadcast(facts)).select(id_col, _posterior(log(0), log(1)).alias("score"))
    return scored.withColumn("action", action_of(F.col("score"), warn, block)).withColumn("is_injection", F.col("score") >= warn)


def predict_leave_one_out(docs: DataFrame, id_col: str, text_col: str = "text", label_col: str = "label", smoothing: float = 1.0) -> DataFrame:
    """Rows (id, label, score): each document under the model of all others.

    The document's grams, its one document and its class total come off the counts; a gram that only it has leaves the vocabulary.
    """
    a = smoothing
    blocks = _blocks(docs, text_col, [_class(label_col).alias("_class"), F.col(id_col), F.col(label_col)])
    model = _saved(_model(_own_grams(blocks)), "naive-bayes-model")
    facts = class_facts(blocks.where(F.col("gram").isNull()), model, "_class")
    mine = lambda y: (F.col("_class") == y).cast("long")
    words = a * F.greatest(F.lit(1), F.col("vocabulary") - F.col("own_only"))

    def log_odds(y: int) -> Column:
        # the denominators are the same for all grams of a document, so one pass over its grams gives all sums
        prior = F.ln((F.col(f"docs{y}") - mine(y) + a) / (F.col("docs0") + F.col("docs1") - 1 + 2 * a))
        return prior + F.col(f"s{y}") - F.col("own_total") * F.ln(F.col(f"total{y}") - F.col("own_total") * mine(y) + words)

    rows = _sums(blocks, model, [id_col, label_col], a, True).crossJoin(F.broadcast(facts))
    return rows.select(id_col, label_col, _posterior(log_odds(0), log_odds(1)).alias("score"))


def evidence_grams(docs: DataFrame, model: DataFrame, facts: DataFrame, id_col: str, text_col: str = "text", top: int = 8, smoothing: float = 1.0) -> DataFrame:
    """Rows (id, gram, weight, place): of the `top` grams by weight those that speak for an injection."""
    from pyspark.sql import Window

    a = smoothing
    share = lambda y: (F.coalesce(f"n{y}", F.lit(0)) + a) / (F.col(f"total{y}") + a * F.greatest(F.lit(1), F.col("vocabulary")))
    own = gram_counts(docs, id_col, text_col).join(model, "gram", "left").crossJoin(F.broadcast(facts)).select(id_col, "gram", (F.col("n") * (F.ln(share(1)) - F.ln(share(0)))).alias("weight"))
    w = Window.partitionBy(id_col).orderBy(F.desc("weight"), "gram")
    return own.withColumn("place", F.row_number().over(w)).where((F.col("place") <= top) & (F.col("weight") > 0))


def weak_label(rows: DataFrame, fields: tuple[str, ...] = ("input_text", "ocr_text")) -> DataFrame:
    """Adds pi_spans (over the fields in order, blank ones skipped, ids pi_rule_0001 and on) and the weak label.

    The label is written only where it was null (False where nothing fired), with source 'rule'.
    """
    per_field = []
    for name in fields:
        text = F.col(name)
        per_field.append(F.when(F.length(F.trim(F.coalesce(text, F.lit("")))) > 0, F.transform(rule_matches(text), _with_field(name))).otherwise(F.array().cast("array<struct<field:string,rule:string,category:string,start:int,end:int>>")))
    spans = F.transform(F.concat(*per_field), lambda s, i: F.struct(F.concat(F.lit("pi_rule_"), F.lpad((i + 1).cast("string"), 4, "0")).alias("span_id"), s["field"].alias("field"), s["rule"].alias("rule"), s["category"].alias("attack_type"), s["start"].alias("start"), s["end"].alias("end")))
    return (
        rows.withColumn("pi_spans", spans).withColumn("label_source", F.when(F.col("prompt_injection").isNull(), "rule").otherwise(F.col("label_source")))
        .withColumn("prompt_injection", F.coalesce("prompt_injection", F.size("pi_spans") > 0))
    )


def _with_field(name: str):
    return lambda m: F.struct(F.lit(name).alias("field"), m["rule"].alias("rule"), m["category"].alias("category"), m["start"].alias("start"), m["end"].alias("end"))

"""Operator 8: exact set-similarity self-join of documents by a token-group matrix.

1. Rows with one text become one class (grouped by a digest of the text, never by the text itself).
2. Texts of a block (a hash range of doc ids) become sets of distinct 5-word shingles.  Each block asks the
   shards of the token space in how many sets its tokens occur; requests and answers travel as packed arrays,
   so the shuffle moves bytes and not a row for each token.
3. A set with a link of 0.8 shares one of its n - ceil(0.8 n) + 1 first tokens with its partner, under any
   order that all sets obey.  Rare tokens come first, so a passage that many texts share makes no candidates.
   Tokens found in no other set are dropped at once.
4. Groups: sets whose lowest core token agrees, a core token being about as frequent as the most frequent token of the
   prefix (so neither a passage of many texts nor a change of one copy decides); an oversized group is dealt into chunks by a signature of
   more prefix tokens, which keeps similar sets together.  The matrix (token, group) holds each group's union of
   prefix tokens; the sets of a group visit only groups of a smaller key whose union meets their group's.
5. A group's task bounds the overlap of each visitor with the group's union of whole sets; only groups that pass are
   opened, and an inverted list then gives all exact overlaps.  Links leave as one spanning edge per set.
6. Components by alternating stars over those edges; classes are joined back to their rows.

Null or empty texts, and texts without words, have n_shingles 0, no links, and their own doc_id as component.
Every row counts as a document of its own: repeated rows are links of one class, and rows that share an id but not the text are
linked only if their texts are.  A null doc_id stays null; the component of a group is its smallest id that isn't null, and null if there
is none.  A table without rows gives no rows.  Further columns are ignored, also those whose names differ only in case.

A block sends a message only to the shards its tokens fall into, so the number of messages is at most the number of distinct tokens of
all blocks, whatever the number of shards.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c

#: Width of a shingle in words; the similarity is LINK_NUM / LINK_DEN at least.
WORDS, LINK_NUM, LINK_DEN = 5, 80, 100
#: Tokens below this share of the hash space are ordered by frequency, the others follow by hash.
COUNTED = 0.5
#: Tokens of sets in one chunk of a group, of visits to it in one task, and of a task with many small groups.
CHUNK_TOKENS, TASK_TOKENS = 1_500_000, 1_500_000
BLOCK_BYTES, SHARD_BYTES = 12 << 20, 24 << 20

#: SQL of a text's digest, and of whether it has no word.
_DIGEST = "md5(cast(coalesce(text, '') as binary))"
_WORDLESS = r"coalesce(text, '') rlike r'\A[\x20\x09-\x0D]*\z'"

_U = np.uint64
_LIMIT = _U(int(COUNTED * (1 << 64)))

REQUEST = "kind int, shard int, block int, data binary, more binary"
FOUND = "k long, n long, mult long, gkey long, sig long, prefix array<long>, full binary"


def shingle_sets(texts: pa.ChunkedArray, k: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; with fewer than k words the whole sequence is one shingle."""
    buf, off = c.text_buffers(texts)
    h, _, _, wo = c.words(buf, off, c.NOT_SPACE)
    g = c.grams(h, k)
    out = []
    for a, b in zip(wo[:-1].tolist(), wo[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(c.uniques(g[a : b - k + 1]))
        elif b > a:
            out.append(c.mix(c.grams(h[a:b], b - a) ^ _U(b - a)))
        else:
            out.append(np.zeros(0, _U))
    return out


def _once(batches):
    """Drops rows that a task has seen before with the same doc_id and text digest."""
    seen: set = set()
    for whole in batches:
        for batch in c.slices(whole, "text", 1 << 20):
            fresh = []
            for i, key in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("th").to_pylist(), strict=True)):
                if key not in seen:
                    seen.add(key)
                    fresh.append(i)
            yield batch if len(fresh) == batch.num_rows else batch.take(pa.array(fresh, pa.int64()))


def _representatives(left: pa.Table, reps: pa.Table) -> tuple[list[int], list[int], list[np.ndarray]]:
    """Keys, sizes and sets of the classes of a block, from the rows that stand for them (the first of repeated rows)."""
    want = {(i, th): (k, m) for i, th, k, m in zip(*(reps[x].to_pylist() for x in ("doc_id", "th", "k", "mult")), strict=True)}
    at, keys, mult = [], [], []
    for i, key in enumerate(zip(left["doc_id"].to_pylist(), left["th"].to_pylist(), strict=True)):
        if (found := want.pop(key, None)) is not None:
            at.append(i)
            keys.append(found[0])
            mult.append(found[1])
    return keys, mult, shingle_sets(left["text"].take(pa.array(at, pa.int64())))


def _block_tokens(sets: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([s[: np.searchsorted(s, _LIMIT)] for s in sets]) if sets else np.zeros(0, _U)


def _ask(shards: int):
    def ask(left: pa.Table, right: pa.Table) -> pa.Table:
        _, _, sets = _representatives(left, right)
        tokens, df = c.uniques_counts(_block_tokens(sets))
        shard = (tokens % _U(shards)).astype(np.int32)
        block = left["block"][0].as_py() if left.num_rows else -1
        df = np.minimum(df, 65535).astype(np.uint16)
        return _requests([(1, s, block, c.pack(tokens[own]), c.pack(df[own])) for s, own in c.by_shard(shard)])

    return ask


def _requests(rows: list[tuple]) -> pa.Table:
    kinds = (("kind", pa.int32()), ("shard", pa.int32()), ("block", pa.int32()), ("data", pa.binary()), ("more", pa.binary()))
    return pa.table({n: pa.array([r[i] for r in rows], t) for i, (n, t) in enumerate(kinds)})


def _answer(group: pa.Table) -> pa.Table:
    """Of one shard: for each block's tokens the number of sets that have them, over all blocks."""
    keys = [np.frombuffer(x, _U) for x in group["data"].to_pylist()]
    counts = [np.frombuffer(x, np.uint16) for x in group["more"].to_pylist()]
    every = np.concatenate(keys)
    order = np.argsort(every)
    every, n = every[order], np.concatenate(counts)[order].astype(np.int64)
    at = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
    tokens, total = every[at], np.minimum(np.add.reduceat(n, at), 65535).astype(np.uint16)
    return _requests([(1, s, b, c.pack(total[np.searchsorted(tokens, k)]), None) for s, b, k in zip(group["shard"].to_pylist(), group["block"].to_pylist(), keys, strict=True)])


def _prefixes(shards: int):
    def prefixes(left: pa.Table, right: pa.Table) -> pa.Table:
        kind = np.array(right["kind"].to_pylist(), np.int32)
        answers = right.take(pa.array(np.flatnonzero(kind == 1)))
        ids, mult, sets = _representatives(left, right.take(pa.array(np.flatnonzero(kind == 0))))
        tokens = c.uniques(_block_tokens(sets))
        shard, df = (tokens % _U(shards)).astype(np.int32), np.zeros(len(tokens), np.uint16)
        own = dict(c.by_shard(shard))
        for s, x in zip(answers["shard"].to_pylist(), answers["data"].to_pylist(), strict=True):
            df[own[s]] = np.frombuffer(x, np.uint16)
        n_, gkey, sig, prefix, full = [], [], [], [], []
        for t in sets:
            n = len(t)
            n_.append(n)
            p = n - -(-LINK_NUM * n // LINK_DEN) + 1
            low = t[: np.searchsorted(t, _LIMIT)]
            d = df[np.searchsorted(tokens, low)]
            first = np.lexsort((low, d))[:p]
            shared = low[np.sort(first[d[first] > 1])]
            if p > len(low):
                shared = np.concatenate([shared, t[len(low) : p]])
            if n and len(shared):
                most = int(d[first].max()) if len(first) else 0
                core = low[(d > 1) & (2 * d.astype(np.int64) >= most) & (d <= 2 * most)]
                core = core if len(core) else shared
                gkey.append(int(core[:1].view(np.int64)[0]))
                sig.append(int(c.mix(np.bitwise_xor.reduce(c.mix(core[:3]), keepdims=True)).view(np.int64)[0]))
                prefix.append(shared.view(np.int64))
                full.append(c.pack(t))
            else:
                gkey.append(None), sig.append(None), prefix.append(None), full.append(None)
        return pa.table({
            "k": pa.array(ids, pa.int64()), "n": pa.array(n_, pa.int64()), "mult": pa.array(mult, pa.int64()),
            "gkey": pa.array(gkey, pa.int64()), "sig": pa.array(sig, pa.int64()), "prefix": pa.array(prefix, pa.list_(pa.int64())), "full": pa.array(full, pa.binary()),
        })

    return prefixes


def open_group(sets: list[np.ndarray], mult: list[int], n_members: int, among_members: bool) -> tuple[list[int], np.ndarray]:
    """Links between members (the first n_members sets, if asked for) and from visitors (the others) to members.

    Returns for each set the index of the smallest set in its local component, and the rows it links to.
    """
    root = list(range(len(sets)))
    links = np.zeros(len(sets), np.int64)

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    size = np.array([len(s) for s in sets], np.int64)
    weight = np.array(mult, np.int64)
    tokens = np.concatenate(sets[:n_members])
    owner = np.repeat(np.arange(n_members), size[:n_members])
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    at = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
    union, ends = tokens[at], np.append(at, len(tokens))
    for q in range(0 if among_members else n_members, len(sets)):
        if q < n_members and n_members == 1:
            continue
        pos = np.minimum(np.searchsorted(union, sets[q]), len(union) - 1)
        pos = pos[union[pos] == sets[q]]
        if LINK_DEN * len(pos) < LINK_NUM * size[q]:
            continue  # the bound: even the whole union overlaps too little
        inter = np.bincount(owner[c.ragged(ends[pos], ends[pos + 1] - ends[pos])], minlength=n_members)
        hit = np.flatnonzero(LINK_DEN * inter >= LINK_NUM * (size[q] + size[:n_members] - inter))
        hit = hit[hit > q] if q < n_members else hit
        links[q] += weight[hit].sum()
        links[hit] += weight[q]
        for m in hit.tolist():
            a, b = find(q), find(m)
            root[max(a, b)] = min(a, b)
    return [find(x) for x in range(len(sets))], links


def _open_bucket(group: pa.Table) -> pa.Table:
    """Opens all groups of one task: rows of a group are its members (role 0) and its visitors (role 1)."""
    keys = np.array([group["gkey"].to_numpy(), group["chunk"].to_numpy(), group["part"].to_numpy(), group["role"].to_numpy(), group["k"].to_numpy()])
    order = np.lexsort(keys[::-1])
    keys = keys[:, order]
    change = np.flatnonzero(np.any(keys[:3, 1:] != keys[:3, :-1], axis=0)) + 1
    full, mult = group["full"], group["mult"].to_numpy()
    a, b, n = [], [], []
    for lo, hi in zip([0, *change.tolist()], [*change.tolist(), keys.shape[1]], strict=True):
        members = int((keys[3, lo:hi] == 0).sum())
        if hi - lo < 2 or not members:
            continue
        sets = [np.frombuffer(full[int(i)].as_buffer(), _U) for i in order[lo:hi]]
        root, links = open_group(sets, [int(mult[i]) for i in order[lo:hi]], members, keys[2, lo] == 0)
        for i in np.flatnonzero(links).tolist():
            a.append(int(keys[4, lo + i]))
            b.append(int(keys[4, lo + root[i]]))
            n.append(int(links[i]))
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "links": pa.array(n, pa.int64())})


def _classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of rows doc_id, text: each row's doc_id and class th; for each class th, rep (its least doc_id), mult (its rows), n (its set's
    size), k and component (numbers), least (the component's least doc_id), links (rows of other classes linked directly)."""
    blocks = c.blocks_of(docs, "text", BLOCK_BYTES)
    shards = max(1, -(-blocks * BLOCK_BYTES // SHARD_BYTES) * 2)
    ids = c.materialize(docs.select("doc_id", F.expr(_DIGEST).alias("th")), "ids")
    classes = ids.groupBy("th").agg(F.min("doc_id").alias("rep"), F.count("*").alias("mult"))
    classes = c.materialize(classes.withColumn("k", F.monotonically_increasing_id()), "classes")
    # by id and text: neither a recurring or missing id nor a repeated text fills a block
    block = F.pmod(F.xxhash64("doc_id", "th"), F.lit(blocks)).cast("int").alias("block")
    texts = docs.select("doc_id", "text", F.expr(_DIGEST).alias("th"))
    placed = texts.mapInArrow(_once, texts.schema).select("*", block)
    reps = classes.select(F.col("rep").alias("doc_id"), "th", "k", "mult").select("*", block)
    asked = placed.groupBy("block").cogroup(reps.groupBy("block")).applyInArrow(_ask(shards), REQUEST)
    answers = asked.groupBy("shard").applyInArrow(_answer, REQUEST)
    null = lambda name, kind: F.lit(None).cast(kind).alias(name)
    back = reps.select(F.lit(0).alias("kind"), null("shard", "int"), "block", null("data", "binary"), "doc_id", "th", "k", "mult").unionAll(
        answers.select("kind", "shard", "block", "data", null("doc_id", "long"), null("th", "string"), null("k", "long"), null("mult", "long"))
    )
    found = c.materialize(placed.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(_prefixes(shards), FOUND), "sets")
    linked = c.materialize(_links(found), "links")
    components = c.connected_components(linked.select("a", "b"))
    # a component is named after its smallest doc_id; a class without any id has none
    named = components.join(classes.select(F.col("k").alias("node"), "rep"), "node")
    named = components.join(named.groupBy("component").agg(F.min("rep").alias("least")), "component").select(F.col("node").alias("k"), "component", "least")
    degrees = linked.groupBy(F.col("a").alias("k")).agg(F.sum("links").alias("links"))
    facts = classes.join(found.select("k", "n"), "k").join(named, "k", "left").join(degrees, "k", "left")
    return ids, facts.withColumn("component", F.coalesce("component", "k"))


def similarity_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows doc_id, n_shingles, component_id, n_links (rows linked directly, copies included), one for each row of docs."""
    since = c.mark()
    ids, facts = _classes(c.id_and_text(docs, id_col, text_col))
    empty = F.col("n") == 0
    rows = ids.join(facts, "th").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(empty, F.col("doc_id")).otherwise(F.coalesce("least", "rep")).alias("component_id"),
        F.when(empty, F.lit(0)).otherwise(F.coalesce("links", F.lit(0)) + F.col("mult") - 1).cast("long").alias("n_links"),
    )
    return c.settle(rows, "similar", since)


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each component one row, all columns as they are: that of the least doc_id (null is the largest), then of the first text digest.

    Rows without words all stay.  The texts are shuffled once, by id and text, so neither a group of copies nor a recurring id is hot.
    """
    since, names = c.mark(), docs.columns
    flat = docs.toDF(*[f"c{i}" for i in range(len(names))])
    row = F.struct(*flat.columns).alias("row")
    flat = flat.select(F.col(f"c{names.index(id_col)}").cast("long").alias("doc_id"), F.col(f"c{names.index(text_col)}").alias("text"), row)
    _, facts = _classes(flat.select("doc_id", "text"))
    first = F.min(F.struct(F.col("rep").isNull().alias("none"), "rep", "th")).alias("w")
    kept = facts.where("n > 0").groupBy("component").agg(first).select(F.col("w.rep").alias("rep"), F.col("w.th").alias("kept"))
    kept = c.settle(kept, "kept", since)
    rows = flat.where(f"not ({_WORDLESS})").select("doc_id", F.expr(_DIGEST).alias("th"), "row")
    same = F.col("doc_id").eqNullSafe(F.col("rep")) & (F.col("th") == F.col("kept"))
    one = rows.join(kept, same).groupBy("doc_id", "th").agg(F.first("row").alias("row")).select("row.*")
    return one.unionAll(flat.where(_WORDLESS).select("row.*")).toDF(*names)


def _links(found: DataFrame) -> DataFrame:
    meta = found.where("gkey is not null").select("k", "n", "gkey", "sig", "prefix")
    sizes = meta.groupBy("gkey").agg(F.ceil(F.sum("n") / CHUNK_TOKENS).cast("long").alias("chunks"))
    meta = meta.join(sizes, "gkey").select("k", "n", "gkey", F.pmod("sig", "chunks").alias("chunk"), "prefix")
    matrix = meta.select(F.explode("prefix").alias("token"), "gkey", "chunk").distinct()
    smaller = matrix.select("token", F.col("gkey").alias("g"), F.col("chunk").alias("c"))
    earlier = (F.col("g") < F.col("gkey")) | ((F.col("g") == F.col("gkey")) & (F.col("c") < F.col("chunk")))
    meets = matrix.join(smaller, "token").where(earlier).select("gkey", "chunk", "g", "c").distinct()
    visits = meta.select("k", "n", "gkey", "chunk").join(meets, ["gkey", "chunk"]).select("k", "n", "g", "c")
    parts = visits.groupBy("g", "c").agg(F.ceil(F.sum("n") / TASK_TOKENS).cast("long").alias("parts"))
    members = meta.select("k", "n", F.col("gkey").alias("g"), F.col("chunk").alias("c"))
    counted = members.groupBy("g", "c").agg(F.count("*").alias("m")).join(parts, ["g", "c"], "left")
    live = counted.where("m > 1 or parts is not null").select("g", "c", F.coalesce("parts", F.lit(1)).alias("parts"))
    members = members.join(live, ["g", "c"]).select("k", "n", "g", "c", F.lit(0).alias("role"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    visits = visits.join(live, ["g", "c"]).select("k", "n", "g", "c", F.lit(1).alias("role"), F.pmod(F.xxhash64("k"), F.col("parts")).alias("part"))
    routed = members.unionAll(visits)
    total = found.agg(F.sum(F.when(F.col("gkey").isNotNull(), F.col("n")))).first()[0] or 0
    buckets = max(1, -(-2 * int(total) // TASK_TOKENS))
    routed = routed.select("k", F.col("g").alias("gkey"), F.col("c").alias("chunk"), "part", "role").join(found.where("gkey is not null").select("k", "mult", "full"), "k")
    bucket = F.pmod(F.xxhash64("gkey", "chunk", "part"), F.lit(buckets)).cast("int").alias("bucket")
    return routed.select("*", bucket).groupBy("bucket").applyInArrow(_open_bucket, "a long, b long, links long")

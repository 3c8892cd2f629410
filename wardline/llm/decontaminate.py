"""Operator 5: benchmark decontamination by winnowing.

A fingerprint is the least hash of the k-grams in a window of consecutive k-grams; with k = 5 and windows of 6 k-grams
every span of 10 words has its fingerprint chosen from its own words alone, so a span that a document shares with an
item is never missed.  Document fingerprints are looked up among those of the benchmark, and a hit is extended to the
whole 10-word window, which must occur in an item.  Items of fewer words are one window of their own length.

The benchmark's index is broadcast only in parts of about PART_BYTES of text; a larger benchmark takes one pass over the numbered
documents for each part, one part at a time on the driver and the executors, and the hits are merged by row.  The result is the same.

Null and empty texts have no words and no hits.  Every row is looked at by itself, whatever its id: repeated documents give repeated
rows, a null doc_id stays null.  Repeated items count once; an item with a null id hits words but is not among the items.  An empty
benchmark hits nothing; empty documents give no rows.  Further columns are ignored, also those whose names differ only in case.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c

SPAN, GRAM = 10, 5
PART_BYTES = 64 << 20
#: Pairs (text, window) whose items are listed at a time.
PAIRS = 1 << 16
SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
_U = np.uint64


def fingerprints(h: np.ndarray, span: int = SPAN, gram: int = GRAM) -> np.ndarray:
    """For each window of span words the least hash of its gram-word runs."""
    g = c.grams(h, gram)
    n = len(g) - (span - gram)
    if n <= 0:
        return np.zeros(0, _U)
    low = g[:n].copy()
    for j in range(1, span - gram + 1):
        np.minimum(low, g[j : j + n], out=low)
    return low


class Index:
    """The benchmark's fingerprints, its windows by length, and the items that hold each window."""

    def __init__(self, items: list[tuple[str, str | None]]):
        self.ids = sorted({i for i, _ in items if i is not None})
        at = {x: k for k, x in enumerate(self.ids)}
        buf, off = c.text_buffers(pa.array([t for _, t in items], pa.string()))
        h, _, _, wo = c.words(buf, off, c.ALNUM)
        prints, found = [], {}
        for k, (a, b) in enumerate(zip(wo[:-1].tolist(), wo[1:].tolist(), strict=True)):
            if n := min(b - a, SPAN):
                g = c.grams(h[a:b], n)
                g_ = c.uniques(g)
                found.setdefault(n, []).append((g_, np.full(len(g_), at.get(items[k][0], -1), np.int64)))
                if n == SPAN:
                    prints.append(fingerprints(h[a:b]))
        self.prints = c.uniques(np.concatenate(prints)) if prints else np.zeros(0, _U)
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(self.prints & _U((1 << 20) - 1)).astype(np.int64)] = True
        self.windows = {}
        for n, parts in found.items():
            g, owner = np.concatenate([x for x, _ in parts]), np.concatenate([x for _, x in parts])
            order = np.argsort(g, kind="stable")
            g, owner = g[order], owner[order]
            first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
            self.windows[n] = (g[first], np.append(first, len(g)), owner)

    def match(self, h: np.ndarray, wo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Over the words of many texts: which words are hit; distinct pairs (text, item) as text * number of ids + item."""
        hit = np.zeros(len(h) + 1, np.int64)
        pairs = []
        for n, (keys, first, owner) in self.windows.items():
            if n == SPAN:
                low = fingerprints(h)
                new = np.flatnonzero(np.concatenate([np.ones(min(1, len(low)), bool), low[1:] != low[:-1]]))
                new = np.append(new, len(low))
                runs = np.flatnonzero(self.seen[(low[new[:-1]] & _U((1 << 20) - 1)).astype(np.int64)])
                runs = runs[np.isin(low[new[runs]], self.prints)]
                start = c.ragged(new[runs], new[runs + 1] - new[runs])
                g = np.zeros(len(start), _U)
                for j in range(SPAN):
                    g += h[start + j] * c._GRAM[j]
                g = c.mix(g)
            else:
                g = c.grams(h, n)
                start = np.arange(len(g))
            if not len(g):
                continue
            pos = np.minimum(np.searchsorted(keys, g), len(keys) - 1)
            ok = keys[pos] == g
            start, pos = start[ok], pos[ok]
            ok = np.searchsorted(wo, start, "right") == np.searchsorted(wo, start + n - 1, "right")
            start, pos = start[ok], pos[ok]
            np.add.at(hit, start, 1)
            np.add.at(hit, start + n, -1)
            # a window that a text repeats counts once before its items are listed
            seen = c.uniques((np.searchsorted(wo, start, "right") - 1) * len(keys) + pos)
            text, pos = seen // len(keys), seen % len(keys)
            for lo in range(0, len(pos), PAIRS):
                p, t = pos[lo : lo + PAIRS], text[lo : lo + PAIRS]
                lens = first[p + 1] - first[p]
                own = owner[c.ragged(first[p], lens)]
                pairs.append(c.uniques((np.repeat(t, lens) * len(self.ids) + own)[own >= 0]))
        return np.cumsum(hit[:-1]) > 0, c.uniques(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)


def _digest(ids: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()


def _marks(index: Index, texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict[int, set[int]]]:
    """Word offsets, hit words, hit counts, and the items of each text that has any."""
    buf, off = c.text_buffers(texts)
    h, _, _, wo = c.words(buf, off, c.ALNUM)
    hit, pairs = index.match(h, wo)
    items: dict[int, set[int]] = {}
    for x in pairs.tolist():
        items.setdefault(x // len(index.ids), set()).add(x % len(index.ids))
    total = np.concatenate([[0], np.cumsum(hit)])
    return wo, hit, total[wo[1:]] - total[wo[:-1]], items


def _text_bytes(benchmark: DataFrame, text_col: str) -> int:
    return int(benchmark.agg(F.sum(F.octet_length(text_col))).first()[0] or 0)


def _parts(benchmark: DataFrame, id_col: str, text_col: str) -> list[list[tuple[str, str | None]]]:
    """The items in parts of bounded size, one part at a time on the driver."""
    items = benchmark.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t"))
    n = max(1, -(-_text_bytes(items, "t") // PART_BYTES))
    for p in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == p)
        yield n, [(r["i"], r["t"]) for r in part.collect()]


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row of SCHEMA for each document."""
    docs = c.id_and_text(docs, id_col, text_col)
    found = _found(docs, benchmark, item_col, item_text)
    zero = F.lit(0).cast("long")
    n_hit = F.coalesce("n_hit", zero)
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", zero).alias("n_items"), F.coalesce("items_sha256", F.lit(_digest([]))).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def without_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of docs, all columns as they are, that have no word in an occurring window; ids play no part."""
    names = docs.columns
    flat, at = docs.toDF(*[f"c{i}" for i in range(len(names))]), names.index(text_col)
    size = _text_bytes(benchmark, item_text)
    if size <= PART_BYTES:
        items = c.distinct_names(benchmark, item_col, item_text)
        index = docs.sparkSession.sparkContext.broadcast(Index(next(_parts(items, item_col, item_text))[1]))
        return flat.mapInArrow(_clean(index, at), flat.schema).toDF(*names)
    held = F.struct(*[f"c{i}" for i in range(len(names))]).alias("row")
    flat = flat.select(held, F.col(f"c{at}").alias("text"))
    clean = _found(flat, benchmark, item_col, item_text, keep="row").where("coalesce(n_hit, 0) = 0")
    return clean.select("row.*").toDF(*names)


def _found(docs: DataFrame, benchmark: DataFrame, item_col: str, item_text: str, keep: str = "doc_id") -> DataFrame:
    """The column `keep` of docs with n_words, n_hit, n_items, items_sha256 (the last three may be null without hits)."""
    spark, kind = docs.sparkSession, docs.schema[keep].dataType.simpleString()
    number, hits, numbered = "n_words long, n_hit long, n_items long, items_sha256 string", [], None
    for parts, items in _parts(c.distinct_names(benchmark, item_col, item_text), item_col, item_text):
        index = spark.sparkContext.broadcast(Index(items))
        if parts == 1:
            return docs.mapInArrow(_whole(index, keep), f"`{keep}` {kind}, {number}")
        if numbered is None:  # written once, so that every pass sees the same numbers
            numbered = c.materialize(docs.select(keep, "text").withColumn("row_", F.monotonically_increasing_id()), "numbered")
        hits.append(c.materialize(numbered.select("row_", "text").mapInArrow(_partial(index), "row_ long, hit binary, items array<string>"), "hits"))
        index.destroy()
    every = hits[0]
    for more in hits[1:]:
        every = every.unionAll(more)
    merged = every.groupBy("row_").applyInArrow(_merge, "row_ long, n_hit long, n_items long, items_sha256 string")
    return numbered.mapInArrow(_lengths(keep), f"row_ long, `{keep}` {kind}, n_words long").join(merged, "row_", "left").drop("row_")


def _whole(index, keep: str):
    def run(batches):
        none = _digest([])
        for batch in batches:
            for part in c.slices(batch):
                wo, _, n_hit, items = _marks(index.value, part.column("text"))
                ids = index.value.ids
                found = [sorted(ids[x] for x in items.get(i, ())) for i in range(part.num_rows)]
                columns = [
                    pa.array(np.diff(wo), pa.int64()), pa.array(n_hit, pa.int64()), pa.array([len(x) for x in found], pa.int64()),
                    pa.array([_digest(x) if x else none for x in found], pa.string()),
                ]
                yield pa.RecordBatch.from_arrays([part.column(keep), *columns], [keep, "n_words", "n_hit", "n_items", "items_sha256"])

    return run


def _clean(index, text: int):
    """Rows whose text (the column of this number) has no hit."""

    def run(batches):
        for batch in batches:
            for part in c.slices(batch, batch.schema.names[text], 1 << 20):
                yield part.filter(pa.array(_marks(index.value, part.column(text))[2] == 0))

    return run


def _partial(index):
    def run(batches):
        for batch in batches:
            for part in c.slices(batch):
                wo, hit, n_hit, items = _marks(index.value, part.column("text"))
                rows, ids = np.flatnonzero(n_hit).tolist(), index.value.ids
                bits = pa.array([c.pack(np.packbits(hit[wo[i] : wo[i + 1]])) for i in rows], pa.binary())
                owners = pa.array([[ids[x] for x in items.get(i, ())] for i in rows], pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([part.column("row_").take(pa.array(rows, pa.int64())), bits, owners], ["row_", "hit", "items"])

    return run


def _merge(group: pa.Table) -> pa.Table:
    """One row's hits of all parts of the benchmark."""
    hit = np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in group["hit"].to_pylist()])
    items = {x for row in group["items"].to_pylist() for x in row}
    return pa.table({
        "row_": group["row_"].slice(0, 1), "n_hit": pa.array([int(np.unpackbits(hit).sum())], pa.int64()),
        "n_items": pa.array([len(items)], pa.int64()), "items_sha256": [_digest(list(items))],
    })


def _lengths(keep: str):
    def run(batches):
        for batch in batches:
            for part in c.slices(batch):
                buf, off = c.text_buffers(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("row_"), part.column(keep), pa.array(np.diff(c.words(buf, off, c.ALNUM)[3]), pa.int64())], ["row_", keep, "n_words"])

    return run

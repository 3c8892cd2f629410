"""Operator 7: token counts by rank-synchronous merging of ragged arrays.

All pre-tokens of a batch that weren't counted before lie in one flat array of symbols with the ends of its sequences.  In each
round every sequence finds its adjacent pair of the lowest merge rank, all occurrences of that pair in it are merged at
once (from the left where they overlap), and sequences without a pair to merge leave with their number of symbols.  A sequence of more
than LONG symbols goes through the same rounds by itself, with the places of each pair kept between them.
Counts of pieces of text between single blanks are kept by each worker in a table of bounded size, started anew when full.

Null counts as empty: 0 tokens.  Equal texts give equal rows, a null id stays null; a table without rows gives none; further columns are ignored, also those whose names differ only in case.
"""

from __future__ import annotations

import heapq
import json
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from . import common as c
from .bpe import WHITE, Merger, _Spec, byte_alphabet

#: Entries of a worker's table of counts beyond which it becomes the old one, whose entries move back as they are asked for; characters of
#: the longest key that it keeps.
CACHED, KEPT = 250_000, 200
LIMIT = 1024
#: Symbols of a sequence beyond which it is merged by itself: one round over a long sequence for each rank would take too long.
LONG = 256
_EDGE = re.compile(r"\s\s|\A\s|\s\Z")
SCHEMA = "doc_id long, n_bytes long, n_tokens long"


class MergeTable:
    """Ranks and results of merges over integer symbols."""

    def __init__(self, model: dict):
        merger = Merger(model)
        symbol = {f: i for i, f in enumerate(merger.form.values())}
        self.n = len(symbol)
        self.byte = np.array([symbol[ch] for ch in byte_alphabet()], np.int64)
        pairs = [(symbol[a] * self.n + symbol[b], r, symbol[a + b]) for (a, b), r in merger.rank.items()]
        key, rank, to = (np.array(x, np.int64) for x in zip(*sorted(pairs), strict=True))
        self.key, self.rank, self.to = key, rank, to
        self.never = int(rank.max()) + 1
        self.ranks: dict[int, tuple[int, int]] = {}

    def count(self, pieces: list[bytes]) -> np.ndarray:
        """Number of symbols left of each piece once no pair can be merged."""
        size = np.array([len(p) for p in pieces], np.int64)
        out = np.minimum(size, 1)
        symbols = self.byte[np.frombuffer(b"".join(pieces), np.uint8)]
        for i in np.flatnonzero(size > LONG).tolist():
            out[i] = self.count_long(pieces[i])
        live = np.flatnonzero((size > 1) & (size <= LONG))
        symbols, size = symbols[np.repeat((size > 1) & (size <= LONG), size)], size[live]
        while len(live):
            start = np.cumsum(size) - size
            pair = symbols[:-1] * self.n + symbols[1:]
            at = np.minimum(np.searchsorted(self.key, pair), len(self.key) - 1)
            rank = np.where(self.key[at] == pair, self.rank[at], self.never)
            rank[start[1:] - 1] = self.never  # no pair spans two sequences
            rank, at = np.append(rank, self.never), np.append(at, 0)
            low = np.minimum.reduceat(rank, start)
            mark = (rank == np.repeat(low, size)) & (rank < self.never)
            spot = np.flatnonzero(mark)
            if len(spot):  # of overlapping occurrences every second one, from the left
                run = np.concatenate([[True], np.diff(spot) > 1])
                first = np.maximum.accumulate(np.where(run, np.arange(len(spot)), 0))
                spot = spot[(np.arange(len(spot)) - first) % 2 == 0]
            symbols[spot] = self.to[at[spot]]
            keep = np.ones(len(symbols), bool)
            keep[spot + 1] = False
            own = np.repeat(np.arange(len(size)), size)
            done = low == self.never
            size = np.bincount(own[keep], minlength=len(size))
            out[live[done]] = size[done]
            keep &= ~done[own]
            symbols, size, live = symbols[keep], size[~done], live[~done]
            single = size == 1
            if single.any():
                out[live[single]] = 1
                symbols = symbols[np.repeat(~single, size)]
                size, live = size[~single], live[~single]
        return out


    def count_long(self, piece: bytes) -> int:
        """The same for one long piece: the places of each rank's pair are kept, so a round looks at those places alone."""
        if not self.ranks:
            self.ranks = {k: (r, t) for k, r, t in zip(self.key.tolist(), self.rank.tolist(), self.to.tolist(), strict=True)}
        symbol = self.byte[np.frombuffer(piece, np.uint8)].tolist()
        size = len(symbol)
        before, after = list(range(-1, size - 1)), list(range(1, size + 1))
        places: dict[int, list[int]] = {}
        queue: list[int] = []

        def note(i: int, j: int) -> None:
            found = self.ranks.get(symbol[i] * self.n + symbol[j])
            if found is not None:
                if found[0] not in places:
                    places[found[0]] = []
                    heapq.heappush(queue, found[0])
                places[found[0]].append(i)

        for i in range(size - 1):
            note(i, i + 1)
        left = size
        while queue:
            rank = heapq.heappop(queue)
            for i in sorted(set(places.pop(rank))):
                j = after[i] if symbol[i] >= 0 else size
                found = self.ranks.get(symbol[i] * self.n + symbol[j]) if j < size else None
                if found is None or found[0] != rank:
                    continue  # an overlapping occurrence took one of the two
                symbol[i], symbol[j] = found[1], -1
                after[i] = after[j]
                left -= 1
                if after[j] < size:
                    before[after[j]] = i
                    note(i, after[j])
                if before[i] >= 0:
                    note(before[i], i)
        return left


class Counter:
    def __init__(self, spec: str):
        spec = json.loads(spec)
        self.table = MergeTable(spec["model"])
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        blank, full = f"[{WHITE}]", f"[^{WHITE}]"
        self.pattern = regex.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?\\p{{L}}+| ?\\p{{N}}+| ?[^{WHITE}\\p{{L}}\\p{{N}}]+|{blank}+(?!{full})|{blank}+")
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.known: dict[str, int] = {}
        self.old: dict[str, int] = {}

    def _learn(self, chunks: list[str]) -> None:
        """Counts chunks that aren't in the table yet."""
        pieces, ends = [], []
        for x in chunks:
            pieces += [p.encode() for p in self.pattern.findall(x)]
            ends.append(len(pieces))
        total = np.concatenate([[0], np.cumsum(self.table.count(pieces))]) if pieces else np.zeros(1, np.int64)
        ends = np.array([0, *ends])
        self.known.update(zip(chunks, (total[ends[1:]] - total[ends[:-1]]).tolist(), strict=True))

    def _chunks(self, text: str) -> list[str]:
        """Pieces whose tokens don't depend on one another: a blank between two characters that aren't white begins one."""
        first, *rest = text.split(" ")
        chunks = [first, *[" " + x for x in rest]]
        if not _EDGE.search(text):
            return chunks
        whites = [i for i, x in enumerate(chunks) if not x.strip(" ") or x[-1].isspace() or x[len(x) > 1 and x[0] == " "].isspace()]
        if not whites:
            return chunks
        out: list[str] = []  # pieces with white space at an edge are joined to what follows or precedes
        glue = False
        bad = set(whites)
        for i, x in enumerate(chunks):
            if out and (glue or i in bad):
                out[-1] += x
            else:
                out.append(x)
            glue = i in bad
        return [x for x in out if x]

    def counts(self, texts: list[str]) -> list[int]:
        split, extra = [], []
        for t in texts:
            parts = [t]
            if self.cut is not None and any(s in t for s in self.special):
                parts = self.cut.split(t)
            specials = len(parts) // 2
            chunks = self._chunks(parts[0]) if parts[0] else []
            for p in parts[2::2]:
                chunks += self._chunks(p) if p else []
            split.append(chunks)
            extra.append(specials)
        if len(self.known) > CACHED:
            self.known, self.old = {}, self.known
        new: set[str] = set()
        for chunks in split:
            new.update(chunks)
        new.difference_update(self.known)
        again = new & self.old.keys()
        self.known.update((x, self.old.pop(x)) for x in again)
        new -= again
        if new:
            self._learn(list(new))
        look = self.known.__getitem__
        total = [sum(map(look, chunks)) + n for chunks, n in zip(split, extra, strict=True)]
        for x in new:
            if len(x) > KEPT:
                del self.known[x]
        return total


_loaded: dict[int, Counter] = {}


def _counter(spec) -> Counter:
    if spec.id not in _loaded:
        _loaded.clear()
        _loaded[spec.id] = Counter(spec.value)
    return _loaded[spec.id]


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows doc_id, n_bytes, n_tokens under the byte-level tokenizer file at path."""
    spec = _Spec(docs.sparkSession, path)

    def run(batches):
        counter = _counter(spec)
        for batch in batches:
            for part in c.slices(batch, most=2 << 20):
                _, off = c.text_buffers(part.column("text"))
                n = counter.counts([t or "" for t in part.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(off), pa.int64()), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    return c.id_and_text(docs, id_col, text_col).mapInArrow(run, SCHEMA)

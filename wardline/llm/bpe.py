"""Operator 3: byte-pair encoding by backtracking, decoding by an offset table.

An Aho-Corasick automaton over the vocabulary gives the longest tokens at each place of a word.  Tokens are taken greedily;
a token may follow another only if the pair is compatible, that is if merging the two tokens' joined text gives
these two tokens again.  Where no token fits, the encoder steps back to the next shorter one.  The only sequence whose
neighbours are all compatible is the one that the merges give, so the result is exact, and dead ends are remembered, so
the time is linear in the word.  The compatibility table is filled as pairs come up.

Decoding gathers each id's bytes from one blob by a table of offsets, for a whole batch at once.

The operator understands tokenizer files of two layouts: word BPE with an end-of-word suffix (NFC, white space to blanks, lower
case, a splitting pattern, byte alphabet) and byte-level BPE.  Null counts as empty and gives no tokens; equal texts give equal
rows, a null id stays null; a table without rows gives none; further columns are ignored, also those whose names differ only in case.
"""

from __future__ import annotations

import json
import struct
import unicodedata

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from . import common as c

#: White space as the tokenizers' patterns see it (fixed values: the Unicode White_Space property).
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Entries of a generation of the word table, and of the compatibility table, which is started anew beyond them.
CACHED, PAIRS = 100_000, 250_000
SCHEMA = "doc_id long, n_tokens long, ids binary, decoded string"
_TAIL = "\x00"
#: Marks that always are a piece of their own behind a word.
_MARKS = frozenset(".,;:!?")


def byte_alphabet() -> list[str]:
    """Printable characters for the 256 bytes: printable Latin-1 bytes stand for themselves, the others follow from U+0100."""
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    out, extra = [], 0
    for b in range(256):
        if b in own:
            out.append(chr(b))
        else:
            out.append(chr(256 + extra))
            extra += 1
    return out


def lower_each(text: str) -> str:
    """Lower case character by character, so without Greek final sigma."""
    return text.lower() if "Σ" not in text else "".join(ch.lower() for ch in text)


class Merger:
    """Vocabulary, merge ranks, and plain merging of short strings (which defines compatibility)."""

    def __init__(self, model: dict):
        vocab, self.suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        self.form: dict[str, str] = {}
        for ch in byte_alphabet():
            self.form[ch] = ch
            if self.suffix:
                self.form[ch + self.suffix] = ch + _TAIL
        self.rank: dict[tuple[str, str], int] = {}
        for r, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            if a in self.form and b in self.form:
                self.form.setdefault(a + b, self.form[a] + self.form[b])
                self.rank.setdefault((self.form[a], self.form[b]), r)
        self.ids = {f: vocab[t] for t, f in self.form.items() if t in vocab}

    def merge(self, text: str) -> list[str]:
        parts = [*text[:-2], text[-2:]] if text.endswith(_TAIL) else [*text]
        if len(parts) < 2:
            return parts
        rank, never = self.rank.get, 1 << 60
        ranks = [rank(p, never) for p in zip(parts, parts[1:], strict=False)]
        while ranks and (low := min(ranks)) < never:
            i = ranks.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank((parts[i - 1], parts[i]), never)
            if i < len(ranks):
                ranks[i] = rank((parts[i], parts[i + 1]), never)
        return parts


class Encoder:
    """Backtracking encoder of single words."""

    def __init__(self, model: dict):
        self.merger = Merger(model)
        self.trie = ahocorasick.Automaton()
        for form in self.merger.ids:
            self.trie.add_word(form, form)
        self.trie.make_automaton()
        self.pairs: dict[tuple[str, str], bool] = {}
        self.whole: dict[str, bool] = {}

    def compatible(self, a: str, b: str) -> bool:
        ok = self.pairs.get((a, b))
        if ok is None:
            if len(self.pairs) > PAIRS:
                self.pairs.clear()
            ok = self.pairs[a, b] = self.merger.merge(a + b) == [a, b]
        return ok

    def reachable(self, a: str) -> bool:
        ok = self.whole.get(a)
        if ok is None:
            ok = self.whole[a] = self.merger.merge(a) == [a]
        return ok

    def encode(self, word: str) -> list[int]:
        """Ids of one word, given in the byte alphabet."""
        text = word + _TAIL if self.merger.suffix else word
        size = len(text)
        # most words need no step back: the longest match at each place, one after another
        taken, at = [], 0
        for end, token in self.trie.iter_long(text):
            if end + 1 - len(token) != at or not self.reachable(token) or (taken and not self.compatible(taken[-1], token)):
                break
            at = end + 1
            taken.append(token)
        if at == size:
            ids = self.merger.ids
            return [ids[t] for t in taken]
        fits: list[list[str]] = [[] for _ in range(size)]  # by place, shorter tokens first
        last = size - 2 if self.merger.suffix else size
        for end, token in self.trie.iter(text):
            if self.merger.suffix and end == last:
                continue  # the last character and the end of the word are one symbol
            fits[end + 1 - len(token)].append(token)
        taken = []
        tried: list[int] = [len(fits[0])]
        dead: set[tuple[int, str]] = set()
        at = 0
        while at < size:
            k = tried[-1] - 1
            while k >= 0:
                token = fits[at][k]
                if (at, token) not in dead and self.reachable(token) and (not taken or self.compatible(taken[-1], token)):
                    break
                k -= 1
            if k >= 0:
                tried[-1] = k
                taken.append(token)
                at += len(token)
                if at < size:
                    tried.append(len(fits[at]))
                continue
            if not taken:
                raise ValueError(f"no encoding of {word[:50]!r}")
            tried.pop()
            token = taken.pop()
            at -= len(token)
            dead.add((at, token))  # what follows a token depends on that token alone
        return [self.merger.ids[t] for t in taken]


class Tokenizer:
    """A tokenizer file's pipeline around the backtracking encoder."""

    def __init__(self, spec: str):
        spec = json.loads(spec)
        self.encoder = Encoder(spec["model"])
        self.bytes = byte_alphabet()
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        names = [n["type"] for n in (spec.get("normalizer") or {"normalizers": []})["normalizers"]]
        self.word_level = "Lowercase" in names
        pattern = next((p["pattern"]["Regex"] for p in (spec["pre_tokenizer"].get("pretokenizers") or []) if p["type"] == "Split"), None)
        self.pattern = regex.compile((pattern or "'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+").replace("[^\\s", f"[^{WHITE}").replace("\\s", f"[{WHITE}]").replace("\\S", f"[^{WHITE}]"))
        self.blank = regex.compile(f"[{WHITE}]+")
        self.chunks = c.Recent(self.encode_chunk, CACHED)  # what stands between white space
        self.pieces = c.Recent(self.encode_piece, CACHED)
        vocab = {i: t for t, i in spec["model"]["vocab"].items()} | {i: t for t, i in self.special.items()}
        size = max(vocab) + 1
        blob = [(vocab.get(i, "") + " ").encode() if self.word_level else self._raw(vocab.get(i, "")) for i in range(size)]
        self.blob = np.frombuffer(b"".join(blob), np.uint8)
        self.offset = np.concatenate([[0], np.cumsum([len(b) for b in blob])])

    def _raw(self, token: str) -> bytes:
        back = {ch: b for b, ch in enumerate(self.bytes)}
        return bytes(back[ch] for ch in token) if all(ch in back for ch in token) else token.encode()

    def encode_piece(self, piece: str) -> bytes:
        """Packed ids of a piece that the splitting pattern gives."""
        ids = self.encoder.encode("".join([self.bytes[b] for b in piece.encode()]))
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode_chunk(self, chunk: str) -> bytes:
        """Packed ids of a text."""
        if self.word_level:  # a word, perhaps with a point or comma behind: one piece, or two
            word, mark = (chunk[:-1], chunk[-1]) if chunk[-1:] in _MARKS else (chunk, "")
            if word.isalpha() and unicodedata.is_normalized("NFC", word):
                low = lower_each(word)
                if low.isalpha():
                    return self.pieces[low] + self.pieces[mark] if mark else self.pieces[low]
        out = []
        for part in self.split_special.split(chunk) if self.split_special else [chunk]:
            if part in self.special:
                out.append(struct.pack("<I", self.special[part]))
            elif part:
                if self.word_level:
                    part = lower_each(unicodedata.normalize("NFC", part))
                out += [self.pieces[piece] for piece in self.pattern.findall(part)]
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """Ids of a text, packed as little-endian unsigned 32-bit integers."""
        if not self.word_level:
            return self.chunks[text] if len(text) < 64 else self.encode_chunk(text)
        # white space never joins two pieces, so what stands between it is encoded apart
        odd = any(ch in text for ch in "\x1c\x1d\x1e\x1f")  # str.split() would split there
        return b"".join(map(self.chunks.__getitem__, self.blank.split(text) if odd else text.split()))

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes and offsets of the texts that the ids, split at ends, decode to."""
        start, size = self.offset[ids], self.offset[ids + 1] - self.offset[ids]
        total = np.concatenate([[0], np.cumsum(size)])
        out, off = self.blob[c.ragged(start, size)], total[np.concatenate([[0], ends])]
        if self.word_level:  # tokens are joined by blanks: drop the one at each end
            n = np.diff(off)
            keep = np.ones(len(out), bool)
            keep[off[1:][n > 0] - 1] = False
            out, off = out[keep], np.concatenate([[0], np.cumsum(n - (n > 0))])
        return out, off


_loaded: dict[int, Tokenizer] = {}


def _tokenizer(spec) -> Tokenizer:
    if spec.id not in _loaded:
        _loaded.clear()
        _loaded[spec.id] = Tokenizer(spec.value)
    return _loaded[spec.id]


class _Spec:
    """A broadcast tokenizer file (of fixed size) and its number, by which workers keep what they built from it."""

    def __init__(self, spark, path: str):
        with open(path, encoding="utf-8") as f:
            text = f.read()
        self.held = spark.sparkContext.broadcast(text)
        self.id = hash(text)

    @property
    def value(self) -> str:
        return self.held.value


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of SCHEMA: the ids of each text as packed little-endian 32-bit integers, and the text they decode to."""
    spec = _Spec(docs.sparkSession, path)

    def run(batches):
        tok = _tokenizer(spec)
        for batch in batches:
            for part in c.slices(batch, most=1 << 20):
                packed = [tok.encode(t or "") for t in part.column("text").to_pylist()]
                ends = np.cumsum([len(p) // 4 for p in packed])
                data, off = tok.decode(np.frombuffer(b"".join(packed), "<u4").astype(np.int64), ends)
                if tok.word_level:
                    decoded = pa.StringArray.from_buffers(len(packed), pa.py_buffer(off.astype(np.int32)), pa.py_buffer(c.pack(data)))
                else:
                    raw = data.tobytes()
                    decoded = pa.array([raw[a:b].decode("utf-8", "replace") for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)], pa.string())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(np.concatenate([[0], ends])), pa.int64()), pa.array(packed, pa.binary()), decoded], ["doc_id", "n_tokens", "ids", "decoded"])

    return c.id_and_text(docs, id_col, text_col).mapInArrow(run, SCHEMA)

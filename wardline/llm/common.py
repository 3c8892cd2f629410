"""Shared pieces of the training-data operators: tables, the shared folder, tokens as numpy arrays.

Texts are processed as whole Arrow buffers: one pass finds every word of a batch and gives it a 64-bit
hash (eight bytes at a time, an avalanche step after each, BLAKE2b for long words), so the per-word work of the
operators stays in numpy.  Two different words get one hash with a probability near 2**-64 per pair; no family of words that collide
is known, but the hash has no secret key.
"""

from __future__ import annotations

import ctypes
import hashlib
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK = 1 << 20
#: Bytes from which a freed block goes back to the system at once (glibc would raise its limit to 32 MB and keep the rest).
_RETURNED = 2 << 20


def _return_freed_memory() -> None:
    """Workers serve one stage after another: what pools and heaps keep of one would add up with the next."""
    pa.set_memory_pool(pa.system_memory_pool())
    try:
        ctypes.CDLL("libc.so.6").mallopt(-3, _RETURNED)  # M_MMAP_THRESHOLD
    except (OSError, AttributeError):
        pass  # another C library


_return_freed_memory()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def distinct_names(df: DataFrame, *names: str) -> DataFrame:
    """df without the columns whose names clash with one of `names` (equal but for case, or repeated): of those the exact, first one stays."""
    low, have = {n.lower() for n in names}, df.columns
    keep = set()
    for n in names:
        exact = [i for i, x in enumerate(have) if x == n] or [i for i, x in enumerate(have) if x.lower() == n.lower()]
        keep.update(exact[:1])
    if all(i in keep or x.lower() not in low for i, x in enumerate(have)):
        return df
    flat = df.toDF(*[f"c{i}" for i in range(len(have))])
    return flat.select(*[F.col(f"c{i}").alias(x) for i, x in enumerate(have) if i in keep or x.lower() not in low])


def id_and_text(docs: DataFrame, id_col: str, text_col: str, *more) -> DataFrame:
    """Columns doc_id (long) and text, and `more`; further columns are left out."""
    docs = distinct_names(docs, id_col, text_col)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *more)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir); a temporary one where it is unset, as in tests."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir", None)
    if folder is None:
        found = sc._jsc.sc().getCheckpointDir()
        if found.isDefined():
            return found.get()
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="wardline-")
        sc.setCheckpointDir(folder)
        return sc._jsc.sc().getCheckpointDir().get()
    return folder


#: Tables that materialize() has written and that still exist, oldest first.
_tables: list[str] = []


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _tables.append(path)
    place, files = _on_disk(spark, path)
    files.deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


def _on_disk(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def mark() -> int:
    """A point in the list of written tables, for discard() and settle()."""
    return len(_tables)


def discard(spark: SparkSession, since: int, until: int | None = None) -> None:
    """Deletes the tables written after the mark `since` (and before `until`)."""
    for path in _tables[since:until]:
        place, files = _on_disk(spark, path)
        files.delete(place, True)
    del _tables[since:until]


def settle(df: DataFrame, name: str, since: int) -> DataFrame:
    """Writes df, then deletes what was written since the mark to compute it."""
    out = materialize(df, name)
    discard(df.sparkSession, since, mark() - 1)
    return out


def blocks_of(docs: DataFrame, text: str = "text", block_bytes: int = 12 << 20) -> int:
    """Number of blocks of about block_bytes that the texts of docs fill."""
    total = docs.select(F.sum(F.octet_length(text)).alias("n")).first()["n"] or 0
    return max(1, -(-int(total) // block_bytes))


# ---------------------------------------------------------------- Arrow buffers


def text_buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if large else np.int32
    bufs = column.buffers()
    if len(column) == 0 or bufs[1] is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    off = np.frombuffer(bufs[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8)[off[0] : off[-1]] if bufs[2] is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


# ---------------------------------------------------------------- hashing

_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """Avalanche finaliser over uint64 (the public splitmix64 constants)."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _seeded(n: int, seed: int) -> np.ndarray:
    return mix((np.arange(1, n + 1, dtype=_U) + _U(seed)) * _U(0x9E3779B97F4A7C15))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_STEP, _LENGTH = _U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93)
#: Bytes beyond which a word is hashed by BLAKE2b.
LONG_WORD = 256
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], _U)


def hash_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte strings buf[start:end]: eight bytes at a time through an avalanche step each."""
    size = ends - starts
    h = mix(size.astype(_U) * _LENGTH)
    if not len(size):
        return h
    padded = np.zeros(len(buf) + 16, np.uint8)
    padded[: len(buf)] = buf
    eight = np.lib.stride_tricks.as_strided(padded.view(), (len(buf) + 1, 8), (1, 1))
    long = np.flatnonzero(size > LONG_WORD)
    for i in long.tolist():
        h[i] = int.from_bytes(hashlib.blake2b(buf[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    live, done = np.flatnonzero(size <= LONG_WORD) if len(long) else slice(None), 0
    while True:
        left = size[live] - done
        more = left > 0
        if not more.all():
            live = np.flatnonzero(more) if isinstance(live, slice) else live[more]
            left = size[live] - done
        if not len(left):
            return h
        block = np.ascontiguousarray(eight[starts[live] + done]).view(_U).ravel() & _MASKS[np.minimum(left, 8)]
        h[live] = mix((h[live] + _STEP) ^ block)
        done += 8


#: Bytes of a word: everything but blank and tab to carriage return.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: Bytes of a word: digits, lower-case letters (upper-case ones count as lower-case) and all that isn't ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def words(buf: np.ndarray, offsets: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All words (runs of kept bytes, A-Z lower-cased): hashes, start and end bytes, and each text's word offsets."""
    n, pos = len(buf), 0
    hs, ss, es = [], [], []
    while pos < n:
        end = min(n, pos + CHUNK)
        while end < n:  # cut only where no word goes on
            gaps = np.flatnonzero(~keep[buf[pos:end]])
            cut = max(int(gaps[-1]) + 1 + pos if len(gaps) else -1, int(offsets[np.searchsorted(offsets, end, "right") - 1]))
            if cut > pos:
                end = cut
                break
            end = min(n, end + CHUNK)
        part = buf[pos:end]
        inside = keep.take(part)
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        lo, hi = np.searchsorted(offsets, [pos, end])
        here = offsets[lo:hi] - pos
        first[here] |= inside[here]
        here = here[here > 0]
        last[here - 1] |= inside[here - 1]
        s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
        hs.append(hash_spans(_LOWER.take(part), s, e))
        ss.append(s + pos)
        es.append(e + pos)
        pos = end
    if not hs:
        z = np.zeros(0, np.int64)
        return np.zeros(0, _U), z, z, np.zeros(len(offsets), np.int64)
    h, s, e = np.concatenate(hs), np.concatenate(ss), np.concatenate(es)
    return h, s, e, np.searchsorted(s, offsets)


_GRAM = _seeded(64, 977)


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k consecutive word hashes, for every start of one."""
    if len(h) < k:
        return np.zeros(0, _U)
    out = np.zeros(len(h) - k + 1, _U)
    for j in range(k):
        out += h[j : len(h) - k + 1 + j] * (_GRAM[j % 64] + _U(2 * (j // 64)))
    return mix(out)


def ragged(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Indices of all elements of slices given by start and length, in order."""
    total = int(lens.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(lens) - lens
    return np.repeat(starts - before, lens) + np.arange(total)


def uniques(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values (a plain sort, which numpy vectorises)."""
    x = np.sort(x)
    return x[np.concatenate([np.ones(min(1, len(x)), bool), x[1:] != x[:-1]])] if len(x) else x


def uniques_counts(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x = np.sort(x)
    at = np.flatnonzero(np.concatenate([np.ones(min(1, len(x)), bool), x[1:] != x[:-1]]))
    return x[at], np.diff(np.append(at, len(x)))


def by_shard(shard: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """The shards that occur, each with the places of its elements in order."""
    if not len(shard):
        return []
    order = np.argsort(shard, kind="stable")
    own = shard[order]
    at = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
    return list(zip(own[at].tolist(), np.split(order, at[1:]), strict=True))


def pack(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).tobytes()


#: Groups of the two levels in which partial counts are added up before the driver gets them.
LEVELS = (1024, 32)


def summed_counts(docs: DataFrame, count, size: int) -> np.ndarray:
    """Sum of count(batch) (arrays of `size` integers) over all batches of docs.

    A task adds up its own batches; what tasks give (their non-zero places) is added in two grouped steps, so that the driver gets at
    most LEVELS[-1] arrays whatever the number of tasks.
    """
    kind = "part int, data binary"

    def row(part: int, total: np.ndarray) -> dict:
        at = np.flatnonzero(total)
        return {"part": pa.array([part], pa.int32()), "data": pa.array([pack(at.astype(np.int32)) + pack(total[at])], pa.binary())}

    def add(rows) -> np.ndarray:
        total = np.zeros(size, np.int64)
        for data in rows:
            n = len(data) // 12
            total[np.frombuffer(data, np.int32, n)] += np.frombuffer(data[4 * n :], np.int64)
        return total

    def task(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += count(batch)
        number = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_pydict(row(number, total))

    parts = docs.mapInArrow(task, kind)
    for groups in LEVELS:
        dealt = parts.withColumn("part", F.pmod("part", F.lit(groups)).cast("int"))
        parts = dealt.groupBy("part").applyInArrow(lambda t: pa.table(row(t["part"][0].as_py(), add(t["data"].to_pylist()))), kind)
    return add([bytes(r["data"]) for r in parts.collect()])


def connected_components(edges: DataFrame) -> DataFrame:
    """Components of an undirected graph given as rows (a, b): returns (node, component), component the smallest node.

    Alternating large-star and small-star steps.  Each step is a grouped minimum (combined before the shuffle)
    and a join back, so no neighbourhood is ever gathered in one place; each round is written to the shared folder.
    """
    spark = edges.sparkSession
    e = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    state = None
    while True:
        both = e.select("u", "v").unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        before, e = mark(), materialize(small.where("u <> v").distinct(), "edges")
        discard(spark, before - 1, before)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == state:
            break
        state = tuple(now)
    roots = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(roots)


class Recent(dict):
    """Values computed for strings, of which the recently used ones are kept: two generations of at most `most` entries each.

    A full generation becomes the old one; what is asked for again moves from it to the new one.  Strings of more than `longest`
    characters aren't kept, so the table is bounded in bytes too.
    """

    def __init__(self, make, most: int, longest: int = 200):
        super().__init__()
        self.make, self.most, self.longest, self.old = make, most, longest, {}

    def __missing__(self, key: str):
        value = self.old.pop(key, None)
        if value is None:
            value = self.make(key)
        if len(key) <= self.longest:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value

    def __reduce__(self):
        return (Recent, (self.make, self.most, self.longest))


def slices(batch: pa.RecordBatch, column: str = "text", most: int = 4 << 20):
    """Slices of a batch with about `most` bytes of text each, one row at least."""
    _, off = text_buffers(batch.column(batch.schema.get_field_index(column)))
    at, n = 0, batch.num_rows
    while at < n:
        to = max(at + 1, int(np.searchsorted(off, off[at] + most, "right")) - 1)
        yield batch.slice(at, min(to, n) - at)
        at = min(to, n)

"""Operator 6: media columns of MPEG audio.

store() keeps a payload losslessly as the ancillary bytes of silent Layer III frames (48 kHz, mono, with checksums): an ID3v2 tag
with the payload's length, a first frame with the variable-bitrate table (frames, bytes, 100 seek entries), and frames
of the largest size but for the last one.  Each frame's ancillary part begins with the number of payload bytes in it.

inspect() reads any byte string: it parses ID3v2 and ID3v1 tags, resynchronises (a header that doesn't continue a chain counts only
where another one or the end follows its frame), checks each frame's CRC, reads the variable-bitrate table (Xing, Info or VBRI) and
compares its seek entries with the frames found, and returns exact durations (samples at a rate), frame seek offsets and the payload.

media_columns() applies both to a text column.  The payload is the text in UTF-8 with bytes 0 up to a positive multiple of 64; null
counts as empty.  Equal texts give equal values, whatever their ids; a null id stays null; repeated rows give repeated rows; a table
without rows gives none; further columns are ignored, also those whose names differ only in case.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c

#: Fixed values of the format: kbit/s by (version 1 or 2, layer) and index; sampling rates of version 1.
BITRATES = {
    (1, 1): [0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448],
    (1, 2): [0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384],
    (1, 3): [0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320],
    (2, 1): [0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256],
    (2, 2): [0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160],
    (2, 3): [0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160],
}
RATES = [44100, 48000, 32000]
CRC_POLY, CRC_INIT = 0x8005, 0xFFFF
SIDE, LEAD = 17, 4 + 2 + 17 + 2  # bytes of mono side information; bytes before a stored frame's payload
SCHEMA = (
    "doc_id long, n_bytes long, media binary, payload binary, frames long, samples long, sample_rate int, variable boolean, crc_ok long, crc_bad long, "
    "table string, toc_frames long, toc_bytes long, toc_entries int, toc_right int, tags map<string,string>, seek array<long>"
)


def _crc_table() -> list[int]:
    out = []
    for b in range(256):
        x = b << 8
        for _ in range(8):
            x = (x << 1 ^ CRC_POLY) & 0xFFFF if x & 0x8000 else x << 1
        out.append(x)
    return out


_CRC = _crc_table()


def crc16(data: bytes) -> int:
    x = CRC_INIT
    for b in data:
        x = (x << 8 & 0xFFFF) ^ _CRC[x >> 8 ^ b]
    return x


class Header:
    """A frame header's facts: size in bytes, samples, rate, side information's length, and whether a CRC follows."""

    def __init__(self, head: bytes):
        word = int.from_bytes(head, "big")
        version_bits, layer = word >> 19 & 3, 4 - (word >> 17 & 3)
        rate_index, bitrate_index, padding = word >> 10 & 3, word >> 12 & 15, word >> 9 & 1
        self.valid = word >> 21 == 0x7FF and version_bits != 1 and layer != 4 and rate_index != 3 and bitrate_index not in (0, 15)
        if not self.valid:
            return
        version = 1 if version_bits == 3 else 2
        self.rate = RATES[rate_index] >> (0, 1, 2)[(version_bits == 2) + 2 * (version_bits == 0)]
        self.kbits = BITRATES[version, layer][bitrate_index]
        self.samples = 384 if layer == 1 else 576 if layer == 3 and version == 2 else 1152
        if layer == 1:
            self.size = (12000 * self.kbits // self.rate + padding) * 4
        else:
            self.size = self.samples // 8 * 1000 * self.kbits // self.rate + padding
        mono = word >> 6 & 3 == 3
        self.layer, self.crc = layer, not word >> 16 & 1
        self.side = ((17 if mono else 32) if version == 1 else (9 if mono else 17)) if layer == 3 else 0


_headers: dict[bytes, Header] = {}


def header(head: bytes) -> Header:
    found = _headers.get(head)
    if found is None:
        if len(_headers) > 4096:
            _headers.clear()
        found = _headers[head] = Header(head)
    return found


def _frame_start(index: int) -> bytes:
    """Header, CRC and silent side information of a stored frame with this bitrate index."""
    head = bytes([0xFF, 0xFA, index << 4 | 1 << 2, 0xC0])
    return head + struct.pack(">H", crc16(head[2:] + bytes(SIDE))) + bytes(SIDE)


_SIZES = [3 * k for k in BITRATES[1, 3]]  # bytes of a frame at 48 kHz
_STARTS = [_frame_start(i) if i else b"" for i in range(15)]
_ROOM = _SIZES[14] - LEAD


def _syncsafe(n: int) -> bytes:
    return bytes(n >> s & 127 for s in (21, 14, 7, 0))


def _tag(payload_bytes: int) -> bytes:
    body = b"\x00payload_bytes\x00" + str(payload_bytes).encode()
    frame = b"TXXX" + struct.pack(">IH", len(body), 0) + body
    return b"ID3\x03\x00\x00" + _syncsafe(len(frame)) + frame


def store(payload: bytes) -> bytes:
    """The payload as an MPEG audio stream."""
    full, rest = divmod(len(payload), _ROOM)
    frames = np.zeros((full, _SIZES[14]), np.uint8)
    frames[:, : LEAD - 2] = np.frombuffer(_STARTS[14], np.uint8)
    frames[:, LEAD - 2 : LEAD] = np.frombuffer(struct.pack(">H", _ROOM), np.uint8)
    frames[:, LEAD:] = np.frombuffer(payload, np.uint8, full * _ROOM).reshape(full, _ROOM)
    last = b""
    if rest or not full:
        index = next(i for i in range(1, 15) if _SIZES[i] - LEAD >= rest)
        last = (_STARTS[index] + struct.pack(">H", rest) + payload[full * _ROOM :]).ljust(_SIZES[index], b"\0")
    sound = frames.tobytes() + last
    count, first = full + bool(last), _SIZES[5]
    total = first + len(sound)
    toc = bytes(min(255, 256 * (first + (count * i // 100) * _SIZES[14]) // total) for i in range(100))
    table = b"Xing" + struct.pack(">III", 15, count, total) + toc + struct.pack(">I", 0)
    lead = (bytes([0xFF, 0xFB, 5 << 4 | 1 << 2, 0xC0]) + bytes(SIDE) + table).ljust(first, b"\0")
    return _tag(len(payload)) + lead + sound


def _size(data: bytes, syncsafe: bool) -> int:
    size = 0
    for b in data:
        size = size << 7 | b & 127 if syncsafe else size << 8 | b
    return size


def _text(raw: bytes) -> list[str]:
    """The strings of a text frame: an encoding byte, then values with a zero between them."""
    kind = raw[:1]
    text = raw[1:].decode({b"\x01": "utf-16", b"\x02": "utf-16-be", b"\x03": "utf-8"}.get(kind, "latin-1"), "replace")
    return text.rstrip("\0").split("\0")


def _id3v2(data: bytes, at: int, end: int, version: int) -> dict[str, str]:
    """Text frames of one tag's body: by frame id, user texts by TXXX:description."""
    name, head = (3, 6) if version == 2 else (4, 10)
    found = {}
    while at + head <= end and data[at] != 0:
        frame = data[at : at + name].decode("latin-1")
        size = _size(data[at + name : at + 2 * name], version == 4)
        body = data[at + head : min(end, at + head + size)]
        if frame.startswith("T") and body:
            values = _text(body)
            if frame in ("TXXX", "TXX"):
                found[f"{frame}:{values[0]}"] = "\0".join(values[1:])
            else:
                found[frame] = "\0".join(values)
        at += head + size
    return found


def read_tags(data: bytes) -> tuple[int, dict[str, str]]:
    """End of the leading ID3v2 tags, and their texts."""
    at, found = 0, {}
    while data[at : at + 3] == b"ID3" and len(data) >= at + 10:
        version, flags = data[at + 3], data[at + 5]
        end = at + 10 + _size(data[at + 6 : at + 10], True)
        body = at + 10
        if flags & 64 and version > 2:  # an extended header
            size = _size(data[body : body + 4], version == 4)
            body += size if version == 4 else size + 4
        found |= _id3v2(data, body, min(end, len(data)), version)
        at = end + 10 * bool(flags & 16)
    return min(at, len(data)), found


def read_id3v1(block: bytes) -> dict[str, str]:
    """Fields of the 128 bytes of an ID3v1 tag."""
    places = {"title": (3, 33), "artist": (33, 63), "album": (63, 93), "year": (93, 97), "comment": (97, 127)}
    values = {f"v1:{k}": block[a:b].split(b"\0")[0].decode("latin-1").rstrip() for k, (a, b) in places.items()}
    return {k: v for k, v in values.items() if v}


def read_table(data: bytes, at: int, h: Header) -> dict | None:
    """The variable-bitrate table in the frame at `at`: its kind, frames, bytes, and seek entries as byte offsets from the frame.

    A Xing or Info table has 100 entries in 256ths of the stream; a VBRI table has sizes of equally long parts.
    """
    spot = at + 4 + 2 * h.crc + h.side
    kind = data[spot : spot + 4]
    word = lambda i, n=4: int.from_bytes(data[i : i + n], "big")
    if kind in (b"Xing", b"Info"):
        flags = word(spot + 4)
        spot += 8
        out = {"kind": kind.decode(), "frames": None, "bytes": None, "entries": [], "every": None}
        for bit, name in ((1, "frames"), (2, "bytes")):
            if flags & bit:
                out[name] = word(spot)
                spot += 4
        if flags & 4 and out["bytes"]:
            out["entries"] = [x * out["bytes"] / 256 for x in data[spot : spot + 100]]
        return out
    spot = at + 36
    if data[spot : spot + 4] == b"VBRI":
        entries, scale, width, every = (word(spot + i, 2) for i in (18, 20, 22, 24))
        sizes = [word(spot + 26 + width * i, width) * scale for i in range(entries)]
        offsets = np.cumsum(sizes).tolist() if sizes else []
        return {"kind": "VBRI", "frames": word(spot + 14), "bytes": word(spot + 10), "entries": offsets, "every": every}
    return None


def seek_entries_right(table: dict, first: int, seek: list[int], end: int) -> int:
    """How many seek entries of the table agree with the frames that were found.

    An entry of a Xing table may lie a 256th of the stream before its frame (it is rounded down); one of a VBRI table is exact.
    """
    if table["kind"] == "VBRI":
        every = table["every"]
        ends = [*seek, end]
        base = seek[0] if seek else end
        return sum(every * (i + 1) < len(ends) and ends[every * (i + 1)] - base == x for i, x in enumerate(table["entries"]))
    step = (table["bytes"] or 0) / 256
    return sum(bool(seek) and 0 <= seek[len(seek) * i // 100] - first - x < max(step, 1) for i, x in enumerate(table["entries"]))


def inspect(data: bytes) -> dict:
    """Facts of a stream: frames, samples, sample_rate, variable, crc_ok, crc_bad, tags, the table's numbers, seek offsets, payload.

    An ID3v1 tag counts only where the chain of frames ends: the same bytes inside a frame are sound.
    """
    at, tags = read_tags(data)
    end, tag_at = len(data), len(data) - 128
    seek, payload, crcs = [], [], {}
    samples = ok = bad = 0
    rate, kbits, table, synced, first = None, set(), None, False, at
    is_tag = lambda x: x == tag_at and data[x : x + 3] == b"TAG"
    while at + 4 <= end:
        if is_tag(at):
            tags |= read_id3v1(data[at:end])
            end = at
            break
        h = header(data[at : at + 4])
        after = at + h.size if h.valid else at
        fits = h.valid and after <= end and rate in (None, h.rate)
        if not fits or not (synced or after == end or is_tag(after) or header(data[after : after + 4]).valid):
            synced = False
            at += 1  # resynchronise: at the next byte that may begin a header, or at a closing tag
            found = data.find(b"\xff", at, end)
            if at <= tag_at and is_tag(tag_at) and (found < 0 or found > tag_at):
                found = tag_at
            if found < 0:
                break
            at = found
            continue
        synced = True
        body = at + 4 + 2 * h.crc
        if not seek and rate is None and (table := read_table(data, at, h)) is not None:
            rate, first = h.rate, at
            at = after
            continue
        rate = h.rate
        seek.append(at)
        samples += h.samples
        kbits.add(h.kbits)
        if h.crc and h.layer == 3:
            covered = data[at + 2 : at + 4] + data[body : body + h.side]
            if covered not in crcs:
                if len(crcs) > 4096:
                    crcs.clear()
                crcs[covered] = crc16(covered)
            if crcs[covered] == int.from_bytes(data[at + 4 : at + 6], "big"):
                ok += 1
            else:
                bad += 1
        if not any(data[body : body + h.side]):  # silent: what follows is ancillary
            lead = body + h.side
            n = int.from_bytes(data[lead : lead + 2], "big")
            if n <= after - lead - 2:
                payload.append(data[lead + 2 : lead + 2 + n])
        at = after
    last = min(at, end)
    return {
        "frames": len(seek), "samples": samples, "sample_rate": rate, "variable": len(kbits) > 1, "crc_ok": ok, "crc_bad": bad,
        "table": table and table["kind"], "toc_frames": table and table["frames"], "toc_bytes": table and table["bytes"],
        "toc_entries": len(table["entries"]) if table else 0, "toc_right": seek_entries_right(table, first, seek, last) if table else 0,
        "tags": tags, "seek": seek, "payload": b"".join(payload),
    }


#: Columns of inspect() besides the payload, and their Arrow types.
FACTS = {
    "frames": pa.int64(), "samples": pa.int64(), "sample_rate": pa.int32(), "variable": pa.bool_(), "crc_ok": pa.int64(), "crc_bad": pa.int64(),
    "table": pa.string(), "toc_frames": pa.int64(), "toc_bytes": pa.int64(), "toc_entries": pa.int32(), "toc_right": pa.int32(),
    "tags": pa.map_(pa.string(), pa.string()), "seek": pa.list_(pa.int64()),
}


def _rows(batches):
    for batch in batches:
        for part in c.slices(batch):
            texts = [(t or "").encode() for t in part.column("text").to_pylist()]
            media = [store(t + bytes(-len(t) % 64 if t else 64)) for t in texts]
            facts = [inspect(m) for m in media]
            for f in facts:
                f["tags"] = list(f["tags"].items())
            lead = [part.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array(media, pa.binary()), pa.array([f["payload"] for f in facts], pa.binary())]
            columns = [pa.array([f[k] for f in facts], t) for k, t in FACTS.items()]
            yield pa.RecordBatch.from_arrays([*lead, *columns], ["doc_id", "n_bytes", "media", "payload", *FACTS])


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of SCHEMA: each text's stream, and what reading the stream back gives."""
    return c.id_and_text(docs, id_col, text_col).mapInArrow(_rows, SCHEMA)


def digests(media: DataFrame) -> DataFrame:
    """Digest columns of media_columns()."""
    tail = F.expr("substring(payload, -64, 64)")
    feature = F.format_string(
        "mpeg1-l3 rate=%d frames=%d samples=%d ms=%d vbr=%s crc=%d/%d toc=%d/%d entries=%d/%d last=%d", "sample_rate", "frames", "samples",
        F.expr("samples * 1000 div sample_rate"), F.col("variable").cast("string"), "crc_ok", F.expr("crc_ok + crc_bad"), "toc_frames", "toc_bytes",
        "toc_right", "toc_entries", F.element_at("seek", -1),
    )
    return media.select(
        "doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), F.crc32(tail).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), feature.alias("feature"),
    )

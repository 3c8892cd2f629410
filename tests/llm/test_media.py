import hashlib
import random
import struct
import zlib

import pytest

from wardline.llm import media


def plain_reader(data):
    """The payload of a stored stream, read by the format's rules alone: skip the tag and the first frame, then walk the frames."""
    assert data[:3] == b"ID3"
    at = 10 + sum((data[6 + i] & 127) << 7 * (3 - i) for i in range(4))
    kbits = dict(enumerate([0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320]))
    out, first = b"", True
    while at < len(data):
        sync, index, rate = data[at] << 4 | data[at + 1] >> 4, data[at + 2] >> 4, data[at + 2] >> 2 & 3
        assert sync == 0xFFF and data[at + 1] >> 1 & 7 == 5 and rate == 1 and data[at + 3] >> 6 == 3
        size = 144 * kbits[index] * 1000 // 48000
        if not first:
            crc = 0xFFFF
            for byte in data[at + 2 : at + 4] + data[at + 6 : at + 23]:
                for bit in range(7, -1, -1):
                    top = crc >> 15 ^ byte >> bit & 1
                    crc = (crc << 1 & 0xFFFF) ^ (0x8005 if top else 0)
            assert crc == int.from_bytes(data[at + 4 : at + 6], "big") and not any(data[at + 6 : at + 23])
            n = int.from_bytes(data[at + 23 : at + 25], "big")
            out += data[at + 25 : at + 25 + n]
        first, at = False, at + size
    assert at == len(data)
    return out


@pytest.mark.parametrize("n", [64, 128, 192, 256, 512, 960, 1024, 2048])
def test_tag_letters_anywhere_in_the_payload(n):
    rnd = random.Random(n)
    for i in range(n - 2):
        payload = bytearray(rnd.randbytes(n))
        payload[i : i + 3] = b"TAG"
        data = media.store(bytes(payload))
        assert media.inspect(data)["payload"] == payload == plain_reader(data)
        tagged = media.inspect(data + b"TAGsong".ljust(128, b"\0"))
        assert tagged["payload"] == payload and tagged["tags"]["v1:title"] == "song"


def test_other_tags_and_tables():
    frame = media._STARTS[9] + struct.pack(">H", 10) + b"0123456789"
    frame = frame.ljust(media._SIZES[9], b"\0")
    latin = b"\x00Caf\xe9"
    utf16 = b"\x01" + "Zoë\0Bo".encode("utf-16")
    body = b"".join(n + struct.pack(">IH", len(b), 0) + b for n, b in ((b"TIT2", latin), (b"TPE1", utf16)))
    tag = b"ID3\x03\x00\x00" + media._syncsafe(len(body) + 20) + body + bytes(20)
    table = b"VBRI" + struct.pack(">HHHIIHHHH", 1, 0, 75, 7 * len(frame), 6, 3, len(frame), 2, 2) + struct.pack(">HHH", 2, 2, 2)
    lead = (bytes([0xFF, 0xFB, 9 << 4 | 1 << 2, 0xC0]) + bytes(32) + table).ljust(len(frame), b"\0")
    facts = media.inspect(tag + lead + frame * 6)
    assert facts["tags"] == {"TIT2": "Café", "TPE1": "Zoë\0Bo"} and facts["table"] == "VBRI"
    assert (facts["toc_frames"], facts["toc_bytes"], facts["toc_entries"], facts["toc_right"], facts["frames"]) == (6, 7 * len(frame), 3, 3, 6)
    assert facts["payload"] == b"0123456789" * 6 and not facts["variable"]
    wrong = table[:-2] + b"\0\1"
    assert media.inspect(tag + lead.replace(table, wrong) + frame * 6)["toc_right"] == 2


def test_round_trip_of_any_bytes():
    rnd = random.Random(2)
    for n in (0, 64, 128, 935, 936, 1870, 5000, 40000):
        payload = rnd.randbytes(n)
        data = media.store(payload)
        facts = media.inspect(data)
        assert facts["payload"] == payload and facts["crc_bad"] == 0 and facts["crc_ok"] == facts["frames"] == facts["toc_frames"]
        assert facts["samples"] == 1152 * facts["frames"] and facts["sample_rate"] == 48000
        assert facts["toc_bytes"] == len(data) - media.read_tags(data)[0]
        assert facts["toc_right"] == facts["toc_entries"] == 100 and facts["tags"] == {"TXXX:payload_bytes": str(n)}
        assert plain_reader(data) == payload


def test_resynchronises_and_finds_damage():
    data = media.store(bytes(range(64)) * 60)
    clean = media.inspect(data)
    spot = clean["seek"][2]
    shifted = media.inspect(data[:spot] + b"\xff\xfb\x00junk" + data[spot:] + b"TAG".ljust(128, b"\0"))
    assert shifted["payload"] == clean["payload"] and shifted["seek"][2] == spot + 7
    broken = bytearray(data)
    broken[spot + 4] ^= 1
    assert media.inspect(bytes(broken))["crc_bad"] == 1
    assert media.inspect(b"no audio here")["frames"] == 0 and media.inspect(b"")["frames"] == 0


def test_headers_of_other_kinds():
    stereo = media.Header(bytes([0xFF, 0xFB, 0x90, 0x00]))
    assert (stereo.size, stereo.rate, stereo.samples, stereo.side) == (417, 44100, 1152, 32)
    low = media.Header(bytes([0xFF, 0xF3, 0x40, 0xC0]))
    assert (low.rate, low.samples, low.size, low.side) == (22050, 576, 104, 9)
    assert not media.Header(bytes([0xFF, 0xEB, 0x90, 0x00])).valid


def test_columns(spark):
    rows = [(1, None), (2, ""), (3, "a" * 64), (4, "é" * 500), (5, "x " * 50000), (5, "x " * 50000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as payload", "'no' as TEXT", "0 as Doc_Id")
    for r in media.digests(media.media_columns(df)).collect():
        text = (dict(rows)[r.doc_id] or "").encode()
        payload = text + bytes(-len(text) % 64 if text else 64)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(text), len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-64:])
        assert r.media_sha256 == hashlib.sha256(media.store(payload)).hexdigest() and r.media_bytes == len(media.store(payload))
    assert media.media_columns(df.limit(0)).collect() == []
    assert [r.doc_id for r in media.media_columns(spark.createDataFrame([(None, "x")], "doc_id long, text string")).collect()] == [None]

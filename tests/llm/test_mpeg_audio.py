import hashlib
import os
import struct
import zlib
from fractions import Fraction

from cauza.llm import mpeg_audio as M


def test_round_trip_and_index():
    for n in (0, 1, 63, 64, 65, 1416, 1417, 1418, 2834, 50_000):
        data = M.pad(os.urandom(n).replace(b"\xff", b"\0"))
        assert len(data) % 64 == 0 and len(data) >= 64
        x = M.index(M.encode(data))
        assert x.payload == data and x.crc_bad == x.resyncs == 0 and x.table_ok and x.tag_crc and x.old_tag
        assert x.duration == Fraction(1152 * (len(x.offsets) - 1), 32000)


def test_sync_words_inside_the_payload():
    data = M.pad(b"\xff\xfa\xe8\xc0" * 1000)
    assert M.index(M.encode(data)).payload == data


def test_damage():
    stored = M.encode(M.pad(b"x" * 20_000))
    x = M.index(stored)
    at = x.offsets[5]
    broken = stored[:at] + b"\xff\xfbjunk" * 9 + stored[at:]
    y = M.index(broken)
    assert y.resyncs >= 1 and y.offsets[:4] == x.offsets[:4] and y.offsets[-1] == x.offsets[-1] + 54 and y.table_ok is False
    flipped = bytearray(stored)
    flipped[at + 10] ^= 1
    assert M.index(bytes(flipped)).crc_bad == 1
    flipped = bytearray(stored)
    flipped[30] ^= 1
    assert M.index(bytes(flipped)).tag_crc is False


def test_other_layers_and_tables():
    v2 = 0xFFF3_8000 | 0xC0  # MPEG 2, Layer III, no CRC, mono, 22,050 Hz
    h = M.header(v2)
    assert (h.samples, h.rate, h.kbps, h.side) == (576, 22050, 64, 9)
    frame = struct.pack(">I", v2).ljust(h.length, b"\0")
    vbri = bytearray(frame)
    vbri[36:54] = b"VBRI" + struct.pack(">HHHII", 1, 0, 0, 4 * h.length, 4)
    x = M.index(bytes(vbri) + frame * 3)
    assert x.vbr == "VBRI" and x.table_ok and x.samples == 3 * 576 and x.duration == Fraction(1728, 22050)
    one = 0xFFFF_8000 | 0xC0  # MPEG 1, Layer I
    h = M.header(one)
    assert h.samples == 384 and M.index(struct.pack(">I", one).ljust(h.length, b"\0") * 5).samples == 5 * 384
    assert M.header(0xFFFFFFFF) is None and M.index(b"").offsets == [] and M.index(None).duration == 0


def test_columns(spark):
    texts = [None, "", "a", "é" * 64, "x" * 300_000, "a"]
    df = spark.createDataFrame([(i, t, "m", 1) for i, t in enumerate(texts)], "doc_id bigint, text string, media string, payload int")
    for r in M.digests(df).collect():
        raw = (texts[r.doc_id] or "").encode()
        data = M.pad(raw)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]))
        assert r.media_sha256 == hashlib.sha256(M.encode(data)).hexdigest() and len(r.frame_offsets) == r.n_frames
    back = M.index_column(M.encode_column(df)).collect()
    assert all(bytes(r.payload) == M.pad((texts[r.doc_id] or "").encode()) for r in back) and len(back) == len(texts)
    assert M.digests(df.limit(0)).collect() == []


def walk(data):
    """Frames of a stream that is known to be mono MPEG-1 Layer III at 32,000 Hz, by the plain formulas and a bitwise CRC."""
    at = 10 + (data[6] << 21 | data[7] << 14 | data[8] << 7 | data[9])
    end, frames, good, payload = len(data) - 128, [], 0, b""
    rates = [0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320]
    while at < end:
        assert data[at] == 0xFF and data[at + 1] == 0xFA and data[at + 3] == 0xC0
        kbps = rates[data[at + 2] >> 4]
        length = 144 * kbps * 1000 // 32000
        value = 0xFFFF
        for byte in data[at + 2 : at + 4] + data[at + 6 : at + 23]:
            for k in range(7, -1, -1):
                top = value >> 15 ^ byte >> k & 1
                value = value << 1 & 0xFFFF
                value ^= 0x8005 if top else 0
        good += value == int.from_bytes(data[at + 4 : at + 6], "big")
        payload += data[at + 23 : at + length] if frames else b""
        frames.append((at, kbps))
        at += length
    return frames, good, payload, at == end


def test_index_against_a_plain_walker(spark, sf_dir):
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()][:60] + ["", "\x00" * 5000]
    for text in texts:
        raw = text.encode()
        data = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        stored = M.encode(data)
        frames, good, payload, whole = walk(stored)
        x = M.index(stored)
        assert whole and x.offsets == [f[0] for f in frames] and (x.crc_good, x.crc_bad) == (good, 0) and good == len(frames)
        assert payload[: len(data)] == data == x.payload and not payload[len(data) :].strip(b"\0")
        said = dict(part.split("=", 1) for part in M.feature(x).split(";"))
        seconds = Fraction(1152 * (len(frames) - 1), 32000)
        assert (said["frames"], said["samples"], said["rate"]) == (str(len(frames)), str(1152 * (len(frames) - 1)), "32000")
        assert said["seconds"] == f"{seconds.numerator}/{seconds.denominator}" and said["kbps"] == ",".join(map(str, sorted({f[1] for f in frames[1:]})))
        assert said["crc"] == f"{good}/{good}" and said["table"] == "Xing:True:True" and said["resyncs"] == "0"
        assert said["seek"] == hashlib.sha256(b"".join(struct.pack("<q", f[0]) for f in frames)).hexdigest()[:16]


def test_seek_table_and_a_change_of_kind():
    stored = bytearray(M.encode(M.pad(b"q" * 90_000)))
    assert M.index(bytes(stored)).seek_ok
    at = stored.index(b"Xing") + 16 + 50
    stored[at] ^= 9
    assert M.index(bytes(stored)).seek_ok is False and M.index(bytes(stored)).table_ok
    mono, wide = 0xFFFB_8000 | 0xC0, 0xFFFB_8400  # 44,100 Hz mono, then 48,000 Hz stereo
    one, two = (struct.pack(">I", w).ljust(M.header(w).length, b"\0") for w in (mono, wide))
    x = M.index(one * 4 + two * 5)
    assert len(x.offsets) == 9 and x.resyncs == 0 and x.duration == Fraction(4 * 1152, 44100) + Fraction(5 * 1152, 48000)
    assert len(M.index(one * 4 + two * 2 + one * 4).offsets) == 7  # two headers alone are damage, and so is the frame that no header of its kind follows


def test_null_identifiers(spark):
    df = spark.createDataFrame([(None, "a"), (None, "b"), (3, None)], "doc_id bigint, text string")
    assert sorted((r.doc_id is None, r.n_bytes) for r in M.digests(df).collect()) == [(False, 0), (True, 1), (True, 1)]


def test_digests_of_the_whole_table(spark, sf_dir):
    """Every row of the query against the frames as a plain walker finds them in the stored form."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    rows = M.digests(docs).collect()
    assert len(rows) == len(texts) == docs.count()
    for r in rows:
        raw = texts[r.doc_id]
        data = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        stored = M.encode(data)
        frames, good, payload, whole = walk(stored)
        assert whole and payload[: len(data)] == data
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]))
        assert (r.media_bytes, r.media_sha256, r.n_frames, r.frame_offsets) == (len(stored), hashlib.sha256(stored).hexdigest(), len(frames), [f[0] for f in frames])
        assert f"crc={good}/{good};" in r.feature and Fraction(r.seconds_num, r.seconds_den) == Fraction(1152 * (len(frames) - 1), 32000)

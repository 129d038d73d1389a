"""MPEG audio columns: write a byte payload as an MPEG stream and index any stream.

``encode`` lays a payload out as a tagged variable-bitrate stream: an ID3v2.3 tag whose extended header holds a
CRC-32, a Xing frame with frame count, byte count and seek table, then CRC-protected Layer III frames whose side
information says "no audio" so that the rest of the frame is ancillary data, and an ID3v1 tag. ``index`` reads any
byte string: it skips tags, finds frames by header and by the header that has to follow, goes on at the next sync
word after damage, verifies the CRC-16 of protected frames, reads Xing, Info and VBRI tables, and returns exact
durations (samples over rate, a fraction) with the byte offset of every frame. Where three headers in a row agree on
another layer, rate or mono mode, the stream goes on with that. Not verified are the CRC-16 of Layer II and of
joint-stereo Layer I frames (the bits it covers depend on allocation tables; they count neither as good nor as bad) and
the CRC in extended headers of ID3v2.4. Of VBRI tables the counts are read, of Xing tables the seek entries, too.

Defined cases: null text counts as empty; an empty payload is 64 bytes of 0; a null or empty stream has no frames,
duration 0 and an empty payload; repeated rows give repeated results; other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from fractions import Fraction
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, lean, slices

# Fixed values of ISO/IEC 11172-3 and 13818-3: kbit/s by header index, for (MPEG 1?, layer).
BITRATES = {
    (True, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
# Hz by header index for MPEG 1; MPEG 2 halves and MPEG 2.5 quarters them.
RATES = (44100, 48000, 32000)

ALIGN = 64
RATE = 32000  # every Layer III frame length is a whole number of bytes at this rate
TAG_TEXT = re.compile(rb"payload\x00(\d+)")


class Header(NamedTuple):
    """One frame header; length in bytes, side: bytes of side information, kind: what all frames of a stream share."""

    length: int
    samples: int
    rate: int
    kbps: int
    protected: bool
    side: int
    kind: tuple


@lru_cache(maxsize=4096)
def header(word: int) -> Header | None:
    """The frame header in 32 bits, None if there is none. Free-format streams are not frames here."""
    if word >> 21 != 0x7FF:
        return None
    version, layer = (word >> 19) & 3, 4 - ((word >> 17) & 3)
    bit_index, rate_index, pad = (word >> 12) & 15, (word >> 10) & 3, (word >> 9) & 1
    if version == 1 or layer == 4 or bit_index in (0, 15) or rate_index == 3 or word & 3 == 2:
        return None
    first = version == 3
    rate = RATES[rate_index] >> {3: 0, 2: 1, 0: 2}[version]
    kbps = BITRATES[first, layer][bit_index]
    mono = (word >> 6) & 3 == 3
    if layer == 1:
        samples, length, side = 384, (12000 * kbps // rate + pad) * 4, 16 if mono else 32
    else:
        samples = 1152 if first or layer == 2 else 576
        length = samples // 8 * 1000 * kbps // rate + pad
        side = ((17 if mono else 32) if first else (9 if mono else 17)) if layer == 3 else 0
    if layer == 1 and (word >> 6) & 3 == 1:
        side = 0  # joint stereo: the size of the bit allocation depends on the bound
    return Header(length, samples, rate, kbps, not (word >> 16) & 1, side, (version, layer, rate, mono))


def _crc_row(byte: int) -> int:
    value = byte << 8
    for _ in range(8):
        value = (value << 1 ^ 0x8005 if value & 0x8000 else value << 1) & 0xFFFF
    return value


CRC_TABLE = [_crc_row(b) for b in range(256)]


@lru_cache(maxsize=65536)
def crc16(data: bytes) -> int:
    """CRC-16 with polynomial 0x8005, most significant bit first, from 0xFFFF."""
    value = 0xFFFF
    for byte in data:
        value = (value << 8 & 0xFFFF) ^ CRC_TABLE[value >> 8 ^ byte]
    return value


def pad(data: bytes) -> bytes:
    """data with bytes 0 up to a positive multiple of ALIGN."""
    return data + bytes(max(ALIGN, -(-len(data) // ALIGN) * ALIGN) - len(data))


@lru_cache(maxsize=64)
def _start(bit_index: int) -> bytes:
    """Header, CRC and empty side information of a protected mono MPEG-1 Layer III frame at RATE."""
    head = bytes((0xFF, 0xFA, bit_index << 4 | RATES.index(RATE) << 2, 0xC0))
    side = bytes(17)
    return head + struct.pack(">H", crc16(head[2:] + side)) + side


HEAD = 4 + 2 + 17
#: Bytes of a frame by header index, and what they leave for data.
LENGTHS = [0] + [144 * k * 1000 // RATE for k in BITRATES[True, 3][1:]]
ROOM = LENGTHS[14] - HEAD


def syncsafe(n: int) -> bytes:
    return bytes((n >> s) & 127 for s in (21, 14, 7, 0))


def encode(payload: bytes) -> bytes:
    """payload as a tagged stream; decodable by index()."""
    full, rest = divmod(len(payload), ROOM)
    last = next(i for i in range(1, 15) if LENGTHS[i] - HEAD >= rest) if rest else 0
    lengths = [LENGTHS[1]] + [LENGTHS[14]] * full + [LENGTHS[last]] * bool(rest)
    total = sum(lengths)
    toc = bytearray(100)
    for i in range(100):
        k = i * len(lengths) // 100  # all frames before the last have one length, but for the first
        toc[i] = 256 * (0 if k == 0 else lengths[0] + (k - 1) * LENGTHS[14]) // total
    xing = b"Xing" + struct.pack(">III", 0b111, len(lengths), total) + bytes(toc)
    parts = [(_start(1) + xing).ljust(LENGTHS[1], b"\0")]
    start = _start(14)
    for at in range(0, full * ROOM, ROOM):
        parts += start, payload[at : at + ROOM]
    if rest:
        parts.append((_start(last) + payload[full * ROOM :]).ljust(LENGTHS[last], b"\0"))
    text = b"\0payload\0%d" % len(payload)
    frames = b"TXXX" + struct.pack(">IH", len(text), 0) + text
    extended = struct.pack(">IHII", 10, 0x8000, 0, zlib.crc32(frames))
    tag = b"ID3\x03\x00\x40" + syncsafe(len(extended) + len(frames)) + extended + frames
    old = b"TAG" + b"payload".ljust(30, b"\0") + bytes(60) + b"0000" + (b"%08x" % zlib.crc32(payload)).ljust(30, b"\0") + b"\xff"
    return b"".join([tag, *parts, old])


class Index(NamedTuple):
    """What index() found; duration in seconds as a fraction, tag_crc and table_ok None where there is no such part."""

    offsets: list
    samples: int
    duration: Fraction
    rate: int
    kbps: tuple
    crc_good: int
    crc_bad: int
    resyncs: int
    skipped: int
    vbr: str
    table_ok: bool | None
    seek_ok: bool | None
    tag_crc: bool | None
    old_tag: bool
    payload: bytes


def _tag(data: bytes) -> tuple[int, bool | None, int | None]:
    """Bytes of the ID3v2 tag at the start, whether its CRC holds, and the payload's length if it says so."""
    if data[:3] != b"ID3" or len(data) < 10 or max(data[6:10]) > 127:
        return 0, None, None
    size = data[6] << 21 | data[7] << 14 | data[8] << 7 | data[9]
    end = min(len(data), 10 + size + 10 * bool(data[5] & 0x10))
    body, good = data[10 : 10 + size], None
    if data[3] == 3 and data[5] & 0x40 and len(body) >= 14:
        n, flags, padding = struct.unpack(">IHI", body[:10])
        if flags & 0x8000:
            (want,) = struct.unpack(">I", body[10:14])
            good = zlib.crc32(body[4 + n : len(body) - padding]) == want
        body = body[4 + n :]
    found = TAG_TEXT.search(body)
    return end, good, int(found[1]) if found else None


def _table(data: bytes, at: int, h: Header) -> tuple[str, tuple | None]:
    """Name and (frames, bytes) of the variable-bitrate table in the frame at that offset."""
    for start in {at + 4 + h.side + 2 * h.protected, at + 4 + h.side}:
        name = data[start : start + 4]
        if name in (b"Xing", b"Info"):
            (flags,) = struct.unpack(">I", data[start + 4 : start + 8].rjust(4, b"\0"))
            values, p = [], start + 8
            for bit in (1, 2):
                values.append(int.from_bytes(data[p : p + 4], "big") if flags & bit else None)
                p += 4 * bool(flags & bit)
            return name.decode(), (*values, data[p : p + 100] if flags & 4 else None)
    if data[at + 36 : at + 40] == b"VBRI":
        size, frames = struct.unpack(">II", data[at + 46 : at + 54].ljust(8, b"\0"))
        return "VBRI", (frames, size, None)
    return "", None


def _seek_ok(toc: bytes, offsets: list[int], end: int) -> bool:
    """Whether entry i, in 256ths of the bytes, is where the frame at i hundredths of the frames starts, rounded down."""
    first, total = offsets[0], end - offsets[0]
    return len(toc) == 100 and all(t == 256 * (offsets[i * len(offsets) // 100] - first) // total for i, t in enumerate(toc))


def _agree(data: bytes, at: int, end: int, n: int) -> bool:
    """Whether n headers of one kind follow one another from that offset."""
    kinds = set()
    for _ in range(n):
        h = header(int.from_bytes(data[at : at + 4], "big")) if at + 4 <= end else None
        if h is None:
            return False
        kinds.add(h.kind)
        at += h.length
    return len(kinds) == 1


def index(data: bytes) -> Index:
    """Frames, tags, tables, checksums and payload of any byte string."""
    data = data or b""
    pos, tag_crc, length = _tag(data)
    old_tag = len(data) >= 128 and data[-128:-125] == b"TAG"
    end = len(data) - 128 * old_tag
    offsets, parts, kbps = [], [], set()
    samples = good = bad = resyncs = skipped = rate = 0
    duration, by_rate, kind, vbr, table = Fraction(0), {}, None, "", None
    first_at = None
    while pos + 4 <= end:
        h = header(int.from_bytes(data[pos : pos + 4], "big"))
        after = pos + h.length if h else 0
        fits = h is not None and after <= end
        if fits and kind not in (None, h.kind):
            fits = _agree(data, pos, end, 3)
        elif fits and after + 4 <= end:  # sync words also occur in data: another header has to follow, or three of another kind
            following = header(int.from_bytes(data[after : after + 4], "big"))
            fits = following is not None and (following.kind == h.kind or _agree(data, after, end, 3))
        if not fits:
            found = data.find(b"\xff", pos + 1, end)
            resyncs, skipped, pos = resyncs + 1, skipped + (found if found >= 0 else end) - pos, found if found >= 0 else end
            continue
        kind = h.kind
        if h.protected and h.side:
            check = crc16(data[pos + 2 : pos + 4] + data[pos + 6 : pos + 6 + h.side]) == int.from_bytes(data[pos + 4 : pos + 6], "big")
            good, bad = good + check, bad + (not check)
        if first_at is None:
            first_at = pos
            vbr, table = _table(data, pos, h)
            rate = h.rate
        if not (vbr and pos == first_at):  # the frame of the table holds no audio
            parts.append(data[pos + 4 + 2 * h.protected + h.side : after])
            by_rate[h.rate] = by_rate.get(h.rate, 0) + h.samples
            samples += h.samples
            kbps.add(h.kbps)
        offsets.append(pos)
        pos = after
    duration = sum((Fraction(n, r) for r, n in by_rate.items()), duration)
    payload = b"".join(parts)
    table_ok = None if table is None else table[0] in (None, len(offsets)) and table[1] in (None, pos - (first_at or 0))
    seek_ok = None if table is None or table[2] is None else bool(offsets) and _seek_ok(table[2], offsets, pos)
    return Index(offsets, samples, duration, rate, tuple(sorted(kbps)), good, bad, resyncs, skipped, vbr, table_ok, seek_ok, tag_crc, old_tag, payload if length is None else payload[:length])


def feature(x: Index) -> str:
    """One line that says all of an index, the seek offsets by their digest."""
    seek = hashlib.sha256(struct.pack(f"<{len(x.offsets)}q", *x.offsets)).hexdigest()[:16]
    return f"rate={x.rate};frames={len(x.offsets)};samples={x.samples};seconds={x.duration.numerator}/{x.duration.denominator};kbps={','.join(map(str, x.kbps))};crc={x.crc_good}/{x.crc_good + x.crc_bad};resyncs={x.resyncs};table={x.vbr}:{x.table_ok}:{x.seek_ok};tag={x.tag_crc};seek={seek}"


ENCODED = "n_bytes bigint, media binary"
INDEXED = "payload binary, frame_offsets array<bigint>, n_frames bigint, samples bigint, sample_rate int, seconds_num bigint, seconds_den bigint, crc_good bigint, crc_bad bigint, resyncs bigint, skipped_bytes bigint, feature string"


def encode_column(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_bytes, media): each text, padded, as a stream."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, 1):
                raw = as_bytes(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(len, raw), pa.int64()), pa.array([encode(pad(x)) for x in raw], pa.binary())], [key, "n_bytes", "media"])

    return df.select(F.col(key), F.col(text)).mapInArrow(lean(run), f"`{key}` {dict(df.dtypes)[key]}, {ENCODED}")


def index_column(df: DataFrame, media: str = "media", key: str = "doc_id") -> DataFrame:
    """(key, payload, seek offsets and the rest of Index) of each stream."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, 1):
                found = [index(x) for x in as_bytes(part.column(1))]
                columns = [
                    pa.array([x.payload for x in found], pa.binary()), pa.array([x.offsets for x in found], pa.list_(pa.int64())), pa.array([len(x.offsets) for x in found], pa.int64()), pa.array([x.samples for x in found], pa.int64()), pa.array([x.rate for x in found], pa.int32()),
                    pa.array([x.duration.numerator for x in found], pa.int64()), pa.array([x.duration.denominator for x in found], pa.int64()), pa.array([x.crc_good for x in found], pa.int64()), pa.array([x.crc_bad for x in found], pa.int64()), pa.array([x.resyncs for x in found], pa.int64()), pa.array([x.skipped for x in found], pa.int64()), pa.array([feature(x) for x in found], pa.string()),
                ]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], [key, "payload", "frame_offsets", "n_frames", "samples", "sample_rate", "seconds_num", "seconds_den", "crc_good", "crc_bad", "resyncs", "skipped_bytes", "feature"])

    return df.select(F.col(key), F.col(media)).mapInArrow(lean(run), f"`{key}` {dict(df.dtypes)[key]}, {INDEXED}")


DIGESTS = "n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, n_frames bigint, seconds_num bigint, seconds_den bigint, frame_offsets array<bigint>"


def digests(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """encode() and index() of each text in one pass; everything but n_bytes and media_* comes from the bytes read back."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, 1):
                rows = []
                for raw in as_bytes(part.column(1)):
                    stored = encode(pad(raw))
                    x = index(stored)
                    rows.append((len(raw), len(x.payload), hashlib.sha256(x.payload).hexdigest(), zlib.crc32(x.payload[-ALIGN:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(x), len(x.offsets), x.duration.numerator, x.duration.denominator, x.offsets))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
                names = [x.split()[0] for x in DIGESTS.split(", ")]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds, strict=True))], [key, *names])

    return df.select(F.col(key), F.col(text)).mapInArrow(lean(run), f"`{key}` {dict(df.dtypes)[key]}, {DIGESTS}")

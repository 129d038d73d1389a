"""Byte-level BPE by a SentencePiece model that is written straight from a rank file.

Each byte of a token becomes one character (U+0100 + byte), so that every token is a string without white space;
its score is minus its rank, so that SentencePiece, which merges the adjacent pair with the highest score first and
the leftmost of ties, does the merges of the ranks. Pieces stand in the order of ranks, the unknown piece after them:
the ids are the ranks. Normalisation is the identity. Texts are cut by the pre-token pattern, each pre-token is
encoded alone, and ids are decoded by the inverse of the byte mapping.

Defined cases: null text counts as empty and gives no ids; repeated rows give repeated results; a lone long
pre-token is encoded whole; other columns of the input are not read.
"""

from __future__ import annotations

import base64
import hashlib
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, slices

OFFSET = 0x100
TO_CHARS = {b: OFFSET + b for b in range(256)}
#: Distinct pre-tokens that a worker remembers, and the longest that it remembers.
REMEMBERED, LONGEST = 100_000, 64


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a base64 token and its rank in each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def byte_chars(data: bytes) -> str:
    return data.decode("latin-1").translate(TO_CHARS)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value) -> bytes:
    """A protocol buffer field: bytes and strings by length, floats as 32 bits, whole numbers as varints."""
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value & (1 << 64) - 1)
    value = value.encode() if isinstance(value, str) else value
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def model_bytes(ranks: dict[bytes, int]) -> bytes:
    """A serialised SentencePiece model whose ids are the ranks. Ranks must run from 0 without gaps."""
    tokens = sorted(ranks, key=ranks.__getitem__)
    if [ranks[t] for t in tokens] != list(range(len(tokens))):
        raise ValueError("ranks have gaps")
    if len(unknown := {bytes([b]) for b in range(256)} - ranks.keys()):
        raise ValueError(f"{len(unknown)} bytes have no token")
    normal, unk, bpe = 1, 2, 2
    pieces = [_field(1, _field(1, byte_chars(t)) + _field(2, -float(ranks[t])) + _field(3, normal)) for t in tokens]
    pieces.append(_field(1, _field(1, "<unk>") + _field(2, 0.0) + _field(3, unk)))
    trainer = _field(3, bpe) + _field(4, len(pieces)) + _field(40, len(tokens)) + _field(41, -1) + _field(42, -1) + _field(43, -1)
    normalizer = _field(1, "identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(pieces) + _field(2, trainer) + _field(3, normalizer)


class Codec:
    """Encoder and decoder over one model."""

    def __init__(self, model: bytes, pattern: str):
        import regex
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.cut = regex.compile(pattern).findall
        n = self.model.get_piece_size() - 1
        self.table = [bytes(ord(c) - OFFSET for c in self.model.id_to_piece(i)) for i in range(n)]
        self.seen: dict[str, bytes] = {}

    def _new(self, parts: list[str]) -> list[bytes]:
        ids = self.model.encode(list(map(byte_chars, map(str.encode, parts))), num_threads=1)
        return [struct.pack(f"<{len(x)}I", *x) for x in ids]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; one call of the model for all new pre-tokens."""
        cut = list(map(self.cut, texts))
        asked = set().union(*cut)
        missing = list(asked.difference(self.seen))
        if len(self.seen) + len(missing) > REMEMBERED:  # what these texts have stays, frequent ones among them
            self.seen = {p: self.seen[p] for p in asked.intersection(self.seen)}
        del asked
        if missing:
            self.seen.update(zip(missing, self._new(missing), strict=True))
        out = [b"".join(map(self.seen.__getitem__, parts)) for parts in cut]
        if len(self.seen) > REMEMBERED or any(len(p) > LONGEST for p in missing):
            self.seen = {p: x for p, x in self.seen.items() if len(p) <= LONGEST} if len(self.seen) <= REMEMBERED else {}
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.table.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _codec(model, pattern: str) -> Codec:
    """One for each task: kept in a worker, model and remembered pre-tokens would count beside the JVM in every later task."""
    return Codec(model.value, pattern)


def encode_column(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, ids): ids of each text as a binary column of little-endian unsigned 32-bit integers."""
    model = df.sparkSession.sparkContext.broadcast(model_bytes(read_ranks(ranks_path)))  # size fixed by the vocabulary

    def run(batches):
        codec = _codec(model, pattern)
        for batch in batches:
            for part in slices(batch, 1, 1 << 20):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(codec.encode([x or "" for x in part.column(1).to_pylist()]), pa.binary())], [key, "ids"])

    return df.select(F.col(key), F.col(text)).mapInArrow(lean(run), f"`{key}` {dict(df.dtypes)[key]}, ids binary")


def decode_column(df: DataFrame, ranks_path: str, pattern: str, ids: str = "ids", key: str = "doc_id") -> DataFrame:
    """(key, data): the bytes that ids stand for; null ids count as none."""
    model = df.sparkSession.sparkContext.broadcast(model_bytes(read_ranks(ranks_path)))

    def run(batches):
        codec = _codec(model, pattern)
        for batch in batches:
            for part in slices(batch, 1, 1 << 20):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([codec.decode(x or b"") for x in part.column(1).to_pylist()], pa.binary())], [key, "data"])

    return df.select(F.col(key), F.col(ids)).mapInArrow(lean(run), f"`{key}` {dict(df.dtypes)[key]}, data binary")


def round_trip(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256): encode and decode each text in one pass."""
    model = df.sparkSession.sparkContext.broadcast(model_bytes(read_ranks(ranks_path)))

    def run(batches):
        codec, sha = _codec(model, pattern), hashlib.sha256
        for batch in batches:
            for part in slices(batch, 1, 1 << 20):
                ids = codec.encode([x or "" for x in part.column(1).to_pylist()])
                columns = [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([sha(x).hexdigest() for x in ids], pa.string()), pa.array([sha(codec.decode(x)).hexdigest() for x in ids], pa.string())]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], [key, "n_tokens", "ids_sha256", "decoded_sha256"])

    return df.select(F.col(key), F.col(text)).mapInArrow(lean(run), f"`{key}` {dict(df.dtypes)[key]}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")

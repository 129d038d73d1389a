"""Token ids packed into rows of one length.

Texts are encoded to ids and cut, without loss, into pieces of at most ``length`` tokens. Pieces of a block are packed
best-fit-decreasing: from the longest, each goes to the row with the least room that still holds it. The row is found
in a segment tree over the room sizes 0 to length, whose nodes count the rows there, in log(length) steps. A row holds
its ids (little-endian and unsigned, of ``token_bytes`` bytes: 2, or 4 where the vocabulary or pad needs it, filled up with ``pad``), cumulative segment lengths, the positions where
position ids start again at 0, and for each segment the document and the piece's offset in it.

A task packs the rows it reads, in blocks of ``block`` tokens, so that nothing is shuffled and memory stays bounded;
a document larger than a block makes a block of its own. pack_id is the partition's number times 2^32 plus the row's.

Defined cases: null text counts as empty; a document without tokens is a segment of length 0; rows that repeat an
identifier are packed as documents of their own, rows without one as documents of a null identifier; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, slices

LENGTH, BLOCK, PAD = 2048, 4 << 20, 50256


class Rooms:
    """Open rows by the room they have left; a segment tree finds the least room that is large enough."""

    def __init__(self, length: int):
        self.leaves = 1 << length.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(length + 1)]

    def _add(self, room: int, by: int) -> None:
        node = self.leaves + room
        while node:
            self.count[node] += by
            node >>= 1

    def put(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        self._add(room, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """(room, row) with the least room >= need, taken out; None if there is none."""
        node = self.leaves + need
        if not self.count[node]:
            while node > 1 and (node & 1 or not self.count[node + 1]):  # up to the first ancestor with rows on the right
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.count[2 * node] else 2 * node + 1
        room = node - self.leaves
        self._add(room, -1)
        return room, self.rows[room].pop()


def best_fit(sizes: list[int], length: int) -> list[list[int]]:
    """Item numbers of each row, largest items first."""
    rooms, rows = Rooms(length), []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        found = rooms.take(sizes[i])
        if found is None:
            rows.append([])
            found = length, len(rows) - 1
        rows[found[1]].append(i)
        rooms.put(found[0] - sizes[i], found[1])
    return rows


def pack_block(keys: list, ids: list[np.ndarray], length: int = LENGTH, pad: int = PAD, kind: str = "<u2") -> list[tuple]:
    """(ids, cumulative lengths, keys, offsets) of the rows that hold all tokens of ids."""
    pieces = [(i, at) for i, x in enumerate(ids) for at in (range(0, len(x), length) if len(x) else (0,))]
    out = []
    for row in best_fit([min(length, len(ids[i]) - at) for i, at in pieces], length):
        parts = [ids[pieces[p][0]][pieces[p][1] : pieces[p][1] + length] for p in row]
        cu = np.cumsum([0, *map(len, parts)])
        flat = np.full(length, pad, kind)
        flat[: cu[-1]] = np.concatenate(parts)
        out.append((flat, cu.tolist(), [keys[pieces[p][0]] for p in row], [pieces[p][1] for p in row]))
    return out


def position_ids(cu: list[int]) -> np.ndarray:
    """Positions that start again at each segment."""
    cu = np.asarray(cu)
    return np.arange(cu[-1]) - np.repeat(cu[:-1], np.diff(cu))


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def id_kind(ranks: dict[bytes, int], pad: int) -> str:
    """The type of packed ids."""
    return "<u2" if max([pad, *ranks.values()]) < 1 << 16 else "<u4"


def encoder(ranks: dict[bytes, int], pattern: str):
    import tiktoken

    return tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


FIELDS = "pack_id bigint, n_tokens int, n_segments int, token_bytes int, doc_ids array<{key}>, piece_starts array<int>, cu_seqlens array<int>, position_resets array<int>, ids binary, ids_sha256 string"


def pack(docs: DataFrame, ranks_path: str, pattern: str, length: int = LENGTH, block: int = BLOCK, pad: int = PAD, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The packed rows of docs, FIELDS."""
    kind = dict(docs.dtypes)[key]
    schema = FIELDS.format(key=kind)
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        from pyspark import TaskContext

        ranks = read_ranks(ranks_path)
        encode, kind, first, done = encoder(ranks, pattern), id_kind(ranks, pad), TaskContext.get().partitionId() << 32, 0
        keys, ids, held, key_type = [], [], 0, None

        def flush():
            nonlocal keys, ids, held, done
            rows = pack_block(keys, ids, length, pad, kind)
            raw = [r[0].tobytes() for r in rows]
            columns = [
                pa.array(range(first + done, first + done + len(rows)), pa.int64()), pa.array([r[1][-1] for r in rows], pa.int32()), pa.array([len(r[2]) for r in rows], pa.int32()), pa.array([int(kind[-1])] * len(rows), pa.int32()), pa.array([r[2] for r in rows], pa.list_(key_type)), pa.array([r[3] for r in rows], pa.list_(pa.int32())),
                pa.array([r[1] for r in rows], pa.list_(pa.int32())), pa.array([r[1][:-1] for r in rows], pa.list_(pa.int32())), pa.array(raw, pa.binary()), pa.array([hashlib.sha256(x).hexdigest() for x in raw], pa.string()),
            ]
            done += len(rows)
            keys, ids, held = [], [], 0
            return pa.RecordBatch.from_arrays(columns, names)

        for batch in batches:
            for part in slices(batch, 1):
                key_type = part.column(0).type
                for k, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    x = np.array(encode(t or ""), kind)
                    if held and held + len(x) > block:
                        yield flush()
                    keys.append(k)
                    ids.append(x)
                    held += len(x)
        if keys:
            yield flush()

    return docs.select(F.col(key), F.col(text)).mapInArrow(lean(run), schema)


def unpack(packs: DataFrame) -> DataFrame:
    """(doc_id, piece_start, ids): the segments of the rows, for reading back."""

    def run(batches):
        for batch in batches:
            x = batch.to_pydict()
            keys, starts, ids = [], [], []
            for data, cu, docs, at, n in zip(x["ids"], x["cu_seqlens"], x["doc_ids"], x["piece_starts"], x["token_bytes"], strict=True):
                keys += docs
                starts += at
                ids += [data[n * a : n * b] for a, b in zip(cu, cu[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.field("doc_ids").type.value_type), pa.array(starts, pa.int32()), pa.array(ids, pa.binary())], ["doc_id", "piece_start", "ids"])

    kind = packs.schema["doc_ids"].dataType.elementType.simpleString()
    return packs.select("ids", "cu_seqlens", "doc_ids", "piece_starts", "token_bytes").mapInArrow(lean(run), f"doc_id {kind}, piece_start int, ids binary")


def write_matrices(packs: DataFrame, path: str) -> None:
    """The rows as Parquet: one fixed-length id row each, with its segment lengths; sorted by pack_id within files."""
    packs.select("pack_id", "token_bytes", "ids", "cu_seqlens", "position_resets", "doc_ids", "piece_starts").sortWithinPartitions("pack_id").write.parquet(path)

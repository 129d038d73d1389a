"""SimHash near-duplicates by vantage-point trees over Hamming distance.

Fingerprints: 64 bits, a bit is 1 if it is set in over half of the XXH64 values of a text's shingles.

The upper part of the tree is the partitioning. It is fitted on a bounded sample of fingerprints: a node holds a
vantage point and a radius mu (the sample's median distance from it), members with d <= mu lie inside, the others
outside, and its leaves are shards. Every fingerprint is a member of exactly one shard. Two fingerprints at most r bits
apart have distances from a vantage point that differ by r at most, so an outside member with d <= mu + r also goes as a
guest into the inside, and a guest on into each side whose boundary its distance plus or minus r reaches. A pair thus
meets in the shard of one of them, as member and member or as member and guest, whatever the shards are.

In a shard the tree goes on down to ``leaf`` members, and guests enter a branch only if the triangle inequality lets
it hold a partner. Tasks emit a spanning forest of the links they find, never all pairs. Copies share a fingerprint
and are one node.

Fingerprints of unlike texts lie 32 +- 4 bits from any vantage point, so a level halves the members but leaves a
query 0.78 of its comparisons: the work grows as about the power 1.6 of the number of distinct fingerprints.

Defined cases: null text counts as empty; texts without words have fingerprint 0, linked like any other; repeated rows
give repeated results; an empty table gives no rows; other columns of the input are not read.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, lean, slices, written
from .components import components

RADIUS, LEAF = 3, 64
#: Members of a shard, the least number of shards, and the most fingerprints that the partitioning is fitted on.
SHARD, SHARDS, SAMPLE = 1 << 15, 64, 1 << 16


def fingerprint(text: bytes, width: int = 3, seed: int = 42) -> int:
    """SimHash of a text's shingles of width words, A-Z in lower case."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()  # of bytes: A-Z only, and white space is [\x20\x09-\x0D]
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False)) if len(words) >= width else [b" ".join(words)]
    n, step, counts = max(1, len(words) - width + 1), 1 << 16, np.zeros(64, np.int64)
    values = np.fromiter(map(partial(xxh64_intdigest, seed=seed), shingles), np.dtype("<u8"), n)
    for at in range(0, n, step):
        counts += np.unpackbits(values[at : at + step].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, text: str = "text", key: str = "doc_id", width: int = 3) -> DataFrame:
    """(key, fp): the fingerprint's bits as a signed long."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, 1):
                found = np.array([fingerprint(x, width) for x in as_bytes(part.column(1))], np.uint64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found.view(np.int64))], [key, "fp"])

    return df.select(F.col(key), F.col(text)).mapInArrow(lean(run), f"`{key}` {dict(df.dtypes)[key]}, fp bigint")


class Forest:
    """Union-find over positions; keeps the links that joined two trees."""

    def __init__(self, n: int):
        self.up, self.links = list(range(n)), []

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = i = up[up[i]]
        return i

    def link(self, i: list[int], j: list[int]) -> None:
        up, root = self.up, self.root
        for x, y in zip(i, j, strict=True):
            a, b = root(x), root(y)
            if a != b:
                up[a] = b
                self.links.append((x, y))

    def link_new(self, i: np.ndarray, j: np.ndarray) -> None:
        """link() without the pairs that hang together by now; most do in a dense group."""
        while len(i):
            self.link(i[:1000].tolist(), j[:1000].tolist())
            i, j = i[1000:], j[1000:]
            if len(i):
                nodes, place = np.unique(np.concatenate([i, j]), return_inverse=True)
                roots = np.array([self.root(x) for x in nodes.tolist()])[place]
                new = roots[: len(i)] != roots[len(i) :]
                i, j = i[new], j[new]


def distance(a: np.ndarray, b, words: int = 1) -> np.ndarray:
    """Differing bits; fingerprints of several words lie along the last axis."""
    x = np.bitwise_count(a ^ b)
    return x if words == 1 else x.sum(axis=-1, dtype=np.uint16)


def boundary(d: np.ndarray) -> int:
    """The radius of a vantage point's inside: the median distance, less where nothing would lie outside."""
    mu, most = int(np.partition(d, (len(d) - 1) // 2)[(len(d) - 1) // 2]), int(d.max())
    return mu if mu < most else most - 1


class Tree:
    """A vantage-point tree over members; guests are queries that are no members. points: [n] or [n, words]; points of one label hang together from the start. Counts nodes and comparisons."""

    def __init__(self, points: np.ndarray, members: int | None = None, radius: int = RADIUS, leaf: int = LEAF, labels: np.ndarray | None = None):
        self.points, self.radius, self.leaf, self.words = points, radius, leaf, points.shape[1] if points.ndim > 1 else 1
        self.forest, self.nodes, self.compared = Forest(len(points)), 0, 0
        if labels is not None:
            _, first, place = np.unique(labels, return_index=True, return_inverse=True)
            self.forest.up = first[place].tolist()
        n = len(points) if members is None else members
        self._walk(np.arange(n), np.arange(n, len(points)))

    def _brute(self, own: np.ndarray, asked: np.ndarray) -> None:
        held = self.points[own]
        for at in range(0, len(asked), 1024):
            some = asked[at : at + 1024]
            i, j = np.nonzero(distance(self.points[some][:, None], held[None, :], self.words) <= self.radius)
            self.compared += len(some) * len(own)
            if len(i):
                self.forest.link_new(some[i], own[j])

    def _walk(self, own: np.ndarray, guests: np.ndarray) -> None:
        r, points = self.radius, self.points
        stack = [(own, guests, False)]  # the last: these members hang together already
        while stack:
            own, guests, settled = stack.pop()
            if not len(own) or not len(guests) and (settled or len(own) == 1):
                continue
            if len(own) <= self.leaf:
                self._brute(own, guests if settled else np.concatenate([own, guests]))
                continue
            self.nodes += 1
            vantage = int(own[0])
            d, q = distance(points[own], points[vantage], self.words).astype(np.int64), distance(points[guests], points[vantage], self.words).astype(np.int64)
            self.compared += len(own) + len(guests)
            near = np.concatenate([own[d <= r], guests[q <= r]])
            self.forest.link_new(np.full(len(near), vantage), near)
            if int(d.max()) <= r:  # a ball of this size hangs together by its vantage point, and guests at most r away with it
                settled, guests, q = True, guests[q > r], q[q > r]
            inner = d <= boundary(d)
            most, least = int(d[inner].max()), int(d[~inner].min())
            come = guests[q <= most + r]
            if not settled:
                come = np.concatenate([come, own[~inner & (d <= most + r)]])
            stack.append((own[inner], come, settled))
            stack.append((own[~inner], guests[q >= least - r], settled))


def vp_links(points: np.ndarray, radius: int = RADIUS, leaf: int = LEAF) -> list[tuple[int, int]]:
    """A spanning forest of all links among distinct fingerprints."""
    return Tree(points, None, radius, leaf).forest.links


class Shards:
    """The upper part of the tree: vantage points and radii, fitted on a sample of ``count`` fingerprints."""

    def __init__(self, sample: np.ndarray, count: int, shard: int = SHARD, shards: int = SHARDS, radius: int = RADIUS):
        self.radius, self.nodes, self.leaves = radius, [], 0
        most = max(1.0, min(shard, count / shards)) * len(sample) / max(1, count)  # sampled members of a shard

        def grow(points: np.ndarray) -> int:
            """Number of the node; leaves are -1 - shard."""
            if len(points) <= max(1.0, most):
                self.leaves += 1
                return -self.leaves
            tried = points[:: max(1, len(points) // 8)][:8]
            vantage = max(tried.tolist(), key=lambda v: float(distance(points, np.uint64(v)).std()))
            d = distance(points, np.uint64(vantage))
            mu, at = boundary(d), len(self.nodes)
            self.nodes.append(None)
            self.nodes[at] = (np.uint64(vantage), mu, grow(points[d <= mu]), grow(points[d > mu]))
            return at

        self.root = grow(np.unique(sample))

    def deal(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(shard, position, guest): each position once as member and as guest wherever a partner can be a member."""
        out, r = [], self.radius
        stack = [(self.root, np.arange(len(points)), np.zeros(len(points), bool))]
        while stack:
            node, at, guest = stack.pop()
            if not len(at):
                continue
            if node < 0:
                out.append((np.full(len(at), -1 - node, np.int32), at, guest))
                continue
            vantage, mu, inside, outside = self.nodes[node]
            d = distance(points[at], vantage).astype(np.int64)
            in_, out_ = d <= mu, d > mu
            keep = np.where(guest, d <= mu + r, in_ | (d <= mu + r))
            stack.append((inside, at[keep], (guest | out_)[keep]))
            keep = np.where(guest, d >= mu + 1 - r, out_)
            stack.append((outside, at[keep], guest[keep]))
        if not out:
            return np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, bool)
        return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def fit_shards(nodes: DataFrame, shard: int = SHARD, shards: int = SHARDS, sample: int = SAMPLE, radius: int = RADIUS) -> Shards:
    """Shards for nodes (fp, distinct) from those of them with the least hashes, about ``sample`` at most."""
    count = nodes.count()
    below = min(1.0, sample / max(1, count))
    drawn = nodes.filter(F.pmod(F.xxhash64("fp", F.lit(7)), F.lit(1 << 31)) < int(below * (1 << 31))).select("fp").limit(2 * sample)
    return Shards(np.sort(drawn.toArrow().column(0).to_numpy()).view(np.uint64), count, shard, shards, radius)


def links(nodes: DataFrame, shard: int = SHARD, shards: int = SHARDS, radius: int = RADIUS, leaf: int = LEAF, sample: int = SAMPLE) -> DataFrame:
    """(a, b): links that connect all fingerprints of nodes (fp, distinct) which a chain of distances <= radius connects."""
    fitted = nodes.sparkSession.sparkContext.broadcast(fit_shards(nodes, shard, shards, sample, radius))  # a few thousand nodes at most

    def deal(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy()
            shard, at, guest = fitted.value.deal(fp.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(fp[at]), pa.array(guest)], ["shard", "fp", "guest"])

    def search(table: pa.Table) -> pa.Table:
        fp, guest = table.column("fp").to_numpy(), table.column("guest").to_numpy()
        points = np.concatenate([np.sort(fp[~guest]), np.sort(fp[guest])])
        found = np.array(Tree(points.view(np.uint64), int((~guest).sum()), radius, leaf).forest.links, np.int64).reshape(-1, 2)
        return pa.table({"a": points[found[:, 0]], "b": points[found[:, 1]]})

    dealt = nodes.select("fp").mapInArrow(lean(deal), "shard int, fp bigint, guest boolean")
    return dealt.groupBy("shard").applyInArrow(search, "a bigint, b bigint")


def near_dedup(docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = 3) -> DataFrame:
    """One row for each row of docs: key, fingerprint (16 hex digits), component_id."""
    prints = written(fingerprints(docs, text, key, width), "fingerprints")
    nodes = written(prints.groupBy("fp").agg(F.min(key).alias("least")), "fingerprint-nodes")
    root = components(links(nodes.select("fp")))
    named = nodes.join(root, nodes["fp"] == root["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    label = named.join(named.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    return prints.join(label, "fp").select(key, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

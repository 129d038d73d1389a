"""Near-duplicates by SimHash for a given similarity of texts: the wide setting of simhash_vptree.

Two texts are linked if their sets of shingles of ``width`` words have a Jaccard similarity of ``least`` or more. A radius
of 3 bits cannot serve there: at 0.8, two fingerprints of 64 bits differ in 10 +- 3, and a radius that holds most such
pairs lets the triangle inequality prune nothing. So fingerprints have WORDS times 64 bits, taken over the distinct
shingles, and are searched in VIEWS: each view is BLOCK of their bits, and fingerprints that agree in these make a
cell. A pair of similarity s agrees in a bit with probability p = 1 - arccos(2s / (1 + s)) / pi, 0.848 at 0.8, and meets
in a cell with 1 - (1 - p^12)^32, 0.99 at 0.8, 0.9995 at 0.85. Cells are searched by vantage-point trees over 128 other
bits; RADIUS holds 0.999 of the pairs of similarity 0.8, and of unlike pairs one in 10^8. The first FIRST views are
searched alone, and what hangs together after them is left apart in the others, so that a large group of near copies
does not give its links once for each view.

Links so found only bring texts together; the similarity is then counted exactly over their shingles. A group of
candidates is compared in one task; a group of over ``most_texts`` texts or ``most_shingles`` shingles is cut into
slices, which meet the group's hub (its least node) first. What the hub does not link, mostly little, meets every
slice. So the work is linear in the size of a group that hangs together closely.

Equality of shingles and of whole sets rests on 64-bit hashes. Copies (equal sets) are one node.

Defined cases: null text counts as empty; texts without words are copies of one another; a text of fewer words than
``width`` is one shingle; repeated rows give repeated results; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import among, as_bytes, discard, lean, slices, written
from .components import components
from .simhash_vptree import Tree

WIDTH, LEAST, SEED = 5, 0.8, 42
WORDS, VIEWS, FIRST, BLOCK, RADIUS, LEAF = 6, 32, 4, 12, 32, 64
MOST_TEXTS, MOST_SHINGLES = 2_000, 2_000_000
SHIFT, FACTOR = np.random.default_rng(SEED).integers(0, 1 << 63, (2, WORDS), np.uint64)
FACTOR = FACTOR * np.uint64(2) + np.uint64(1)


def shingles(text: bytes, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct XXH64 values of a text's shingles, A-Z in lower case."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()  # of bytes: A-Z only, and white space is [\x20\x09-\x0D]
    if not words:
        return np.empty(0, np.uint64)
    found = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False)) if len(words) >= width else [b" ".join(words)]
    return np.unique(np.fromiter((xxh64_intdigest(x, SEED) for x in found), np.uint64))


def node_of(own: np.ndarray) -> int:
    """A signed 64-bit name of a set of shingles."""
    from xxhash import xxh64_intdigest

    return int(np.uint64(xxh64_intdigest(own.tobytes(), SEED)).view(np.int64))


def long_print(own: np.ndarray) -> np.ndarray:
    """A fingerprint of WORDS words: a bit is 1 if it is set in over half of the set's shingles, each mixed anew for each word."""
    counts = np.zeros(64 * WORDS, np.int64)
    for at in range(0, len(own), 255):  # sums of 255 fit a byte
        x = (own[at : at + 255, None] ^ SHIFT) * FACTOR
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
        counts += np.unpackbits(x.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return np.packbits(counts * 2 > len(own), bitorder="little").view(np.uint64)


def prints_of(docs: DataFrame, text: str, key: str, width: int) -> DataFrame:
    """(key, node, n, print) of each row: the name and size of its set of shingles, its fingerprint."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, 1):
                sets = [shingles(x, width) for x in as_bytes(part.column(1))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([node_of(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([long_print(s).tobytes() for s in sets], pa.binary())], [key, "node", "n", "print"])

    return docs.select(F.col(key), F.col(text)).mapInArrow(lean(run), f"`{key}` {dict(docs.dtypes)[key]}, node bigint, n bigint, print binary")


def _links_of(nodes: DataFrame, first: int, last: int) -> DataFrame:
    """(a, b): links between the labels of nodes (label, print) whose fingerprints are within RADIUS and meet in a cell of the views from first up to last: in a cell, as many as connect what is not of one label."""

    def deal(batches):
        view = np.arange(first, last, dtype=np.int32)
        home = view * BLOCK // 64  # the word that a view's first bit is in; the 128 other bits start behind its last
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                words = np.frombuffer(b"".join(part.column(1).to_pylist()), "<u8").reshape(-1, WORDS)
                bits = np.unpackbits(words.view(np.uint8), axis=1, bitorder="little")[:, first * BLOCK : last * BLOCK].reshape(-1, len(view), BLOCK)
                block = bits.astype(np.int32) @ (1 << np.arange(BLOCK, dtype=np.int32))
                label = np.repeat(part.column(0).to_numpy(), len(view))
                other = [words[:, (home + k) % WORDS].reshape(-1).view(np.int64) for k in (2, 3)]
                yield pa.RecordBatch.from_arrays([pa.array((block | view << BLOCK).reshape(-1)), pa.array(label), *map(pa.array, other)], ["cell", "label", "x", "y"])

    def search(batches):
        held: list = []

        def flush(some):
            cell, label, x, y = (np.concatenate([b.column(i).to_numpy() for b in some]) for i in range(4))
            edges = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1], True])
            points, out = np.stack([x, y], axis=1).view(np.uint64), []
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                own = label[a:b]
                if (own != own[0]).any():
                    out += [(a + i, a + j) for i, j in Tree(points[a:b], None, RADIUS, LEAF, own).forest.links]
            found = np.array(out, np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(label[found[:, 0]]), pa.array(label[found[:, 1]])], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column(0).to_numpy()  # sorted; the last cell may go on in the next batch
            cut = int(np.searchsorted(key, key[-1], "left"))
            if cut or held and held[-1].column(0)[-1].as_py() != int(key[0]):
                yield flush([*held, batch.slice(0, cut)])
                held = []
            held.append(batch.slice(cut))
        if held:
            yield flush(held)

    cells = nodes.select("label", "print").mapInArrow(lean(deal), "cell int, label bigint, x bigint, y bigint")
    return cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(lean(search), "a bigint, b bigint").distinct()


def candidates(nodes: DataFrame) -> DataFrame:
    """(node, root): nodes (node, print) that hang together by chains of pairs within RADIUS, met in a cell; those alone are left out."""
    first = written(components(_links_of(nodes.select(F.col("node").alias("label"), "print"), 0, FIRST)), "first-components")
    labelled = nodes.join(first, "node", "left").select(F.coalesce("root", "node").alias("label"), "print")
    more = _links_of(labelled, FIRST, VIEWS)
    return components(first.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))


class Sets:
    """The shingle sets of a task's nodes, and their fingerprints."""

    def __init__(self, table: pa.Table, width: int):
        found: dict[int, np.ndarray] = {}
        for node, x in zip(table.column("node").to_pylist(), table.column("text").to_pylist(), strict=True):
            # rows that share an identifier with other texts are not the node that was asked for
            if node not in found and node_of(own := shingles((x or "").encode(), width)) == node:
                found[node] = own
        self.names, sets = list(found), list(found.values())
        self.sizes = np.array([len(s) for s in sets], np.int64)
        self.prints = np.stack([long_print(s) for s in sets]) if sets else np.zeros((0, WORDS), np.uint64)
        names, place = np.unique(np.concatenate([np.zeros(0, np.uint64), *sets]), return_inverse=True)
        self.parts, self.mark = np.split(place, np.cumsum(self.sizes)[:-1]), np.zeros(len(names), bool)

    def similar(self, x: int, others: np.ndarray, least: float) -> np.ndarray:
        """Those of others whose similarity with x is least or more."""
        near = np.bitwise_count(self.prints[others] ^ self.prints[x]).sum(axis=1) <= 64 * WORDS // 3  # ten standard deviations above the mean at 0.8
        asked = others[near & (np.minimum(self.sizes[others], self.sizes[x]) >= least * np.maximum(self.sizes[others], self.sizes[x]))]
        if not len(asked):
            return asked
        self.mark[self.parts[x]] = True
        shared = np.add.reduceat(self.mark[np.concatenate([self.parts[i] for i in asked])], np.r_[0, np.cumsum(self.sizes[asked])[:-1]], dtype=np.int64)
        self.mark[self.parts[x]] = False
        return asked[shared >= least * (self.sizes[asked] + self.sizes[x] - shared) - 1e-9]

    def forest(self, least: float) -> list[tuple[int, int]]:
        """A spanning forest of all similar pairs."""
        links, rest = [], np.arange(len(self.names))
        while len(rest):
            stack, rest = [int(rest[0])], rest[1:]
            while stack and len(rest):
                x = stack.pop()
                hit = self.similar(x, rest, least)
                links += [(x, int(i)) for i in hit]
                stack += hit.tolist()
                rest = rest[~np.isin(rest, hit)]
        return links

    def table(self, links: list[tuple[int, int]]) -> pa.Table:
        return pa.table({"a": pa.array([self.names[i] for i, _ in links], pa.int64()), "b": pa.array([self.names[j] for _, j in links], pa.int64())})


def links(docs: DataFrame, nodes: DataFrame, width: int, least: float, text: str, key: str, most_texts: int, most_shingles: int) -> DataFrame:
    """(a, b): checked links that connect all nodes which a chain of checked candidates connects."""
    together = candidates(nodes)
    members = nodes.drop("print").join(together, "node").select("node", "least", "n", "root")
    size = members.groupBy("root").agg(F.greatest(F.ceil(F.count(F.lit(1)) / most_texts), F.ceil(F.sum("n") / most_shingles)).cast("int").alias("g"))
    members = written(members.join(written(size, "group-sizes"), "root").select("root", "least", "node", "g", F.pmod(F.xxhash64("node"), "g").cast("int").alias("i")), "candidates")
    own = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    texts = written(among(own, members, {"least": F.col("id")}).select("root", "node", "g", "i", "text"), "candidate-texts")

    def alone(table: pa.Table) -> pa.Table:
        own = Sets(table, width)
        return own.table(own.forest(least))

    def by_hub(table: pa.Table) -> pa.Table:
        own, hub = Sets(table, width), table.column("root")[0].as_py()
        if hub not in own.names:
            return own.table([])
        x = own.names.index(hub)
        return own.table([(x, int(j)) for j in own.similar(x, np.flatnonzero(np.arange(len(own.names)) != x), least)])

    def by_rest(table: pa.Table) -> pa.Table:
        own, rest = Sets(table, width), {node for node, is_rest in zip(table.column("node").to_pylist(), table.column("rest").to_pylist(), strict=True) if is_rest}
        all_ = np.arange(len(own.names))
        return own.table([(x, int(j)) for x, name in enumerate(own.names) if name in rest for j in own.similar(x, all_[all_ != x], least)])

    found = texts.filter("g = 1").groupBy("root").applyInArrow(alone, "a bigint, b bigint")
    large = texts.filter("g > 1")
    if large.isEmpty():
        return found
    every = F.sequence(F.lit(0), F.col("g") - 1)
    hub = F.col("node") == F.col("root")
    hubs = large.select("root", "node", "text", F.explode(F.when(hub, every).otherwise(F.array("i"))).alias("i"))
    first = written(hubs.groupBy("root", "i").applyInArrow(by_hub, "a bigint, b bigint"), "hub-links")
    rest = large.filter(~hub).join(first.select(F.col("b").alias("node")), "node", "left_anti")
    parts = rest.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / most_texts).cast("int").alias("h"))
    parts = written(parts, "rest-sizes")
    rest = rest.join(parts, "root").select("root", "node", "text", F.pmod(F.xxhash64("node", F.lit(1)), "h").cast("int").alias("r"), F.explode(every).alias("i"), F.lit(True).alias("rest"))
    others = large.join(parts, "root").select("root", "node", "text", F.explode(F.sequence(F.lit(0), F.col("h") - 1)).alias("r"), "i", F.lit(False).alias("rest"))
    second = rest.unionByName(others).groupBy("root", "r", "i").applyInArrow(by_rest, "a bigint, b bigint")
    return found.unionByName(first).unionByName(second)


def near_dedup(docs: DataFrame, width: int = WIDTH, least: float = LEAST, text: str = "text", key: str = "doc_id", most_texts: int = MOST_TEXTS, most_shingles: int = MOST_SHINGLES) -> DataFrame:
    """One row for each row of docs: key, component_id (the least key of its component)."""
    prints = written(prints_of(docs, text, key, width), "signatures")
    nodes = written(prints.groupBy("node").agg(F.min(key).alias("least"), F.first("n").alias("n"), F.first("print").alias("print")), "signature-nodes")
    root = components(links(docs, nodes, width, least, text, key, most_texts, most_shingles))
    named = nodes.join(root, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    label = written(named.join(named.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("node", "component_id"), "component-names")
    discard(nodes)
    return prints.select(key, "node").join(label, "node").select(key, "component_id")

"""Near-duplicates of a given Jaccard similarity by a chosen-path set similarity join.

A document's set is its distinct shingles of ``width`` words, A-Z in lower case; equal sets are one node. A node's tokens
are TOKENS minwise values (place, value); two nodes of similarity s share a token with probability s.

Trees: at a branch of a tree each token is chosen with probability 1 / (least TOKENS), by a hash of branch and token
that all nodes agree on, and a node goes down to a child for each of its chosen tokens. So a node has 1 / least children
on the average, two of similarity ``least`` meet again in one child, and unlike ones part. Children are rows (path, node);
Spark counts them by path, and each level is one exchange of the rows whose path has several nodes. A branch of ``limit``
nodes or fewer is a leaf: its nodes are compared exhaustively by sketches (4 bits of each token). One that is larger
branches again, ``depth`` times at most, and no more once it keeps ALIKE of its parent's nodes: these are too alike to
part. It is compared in slices, each with the branch's least node, its hub. When it is known what hangs together, the nodes of
such branches as hold several components come together at the rarest of ASKED tokens, all branches at once: two of
similarity ``least`` have 17 of 32 in common with 1 - 4*10^-6, so that one is among the 16 rarest of both. What all texts of
a branch have in common, a passage say, is rare in none, and so these leaves stay small. One of over ``limit`` nodes is
compared in pairs of slices, but nodes of its most frequent component not with one another.

A pair of similarity ``least`` survives a level in a tree with 1 - 1/e = 0.63, two with 0.47, three with 0.37, four with
0.31, so that TREES = 24 independent trees find it with 1 - 4*10^-11, 1 - 3*10^-7, 1 - 10^-5 and 0.9999, more alike ones
more surely; a leaf's sketches let 4.5 standard deviations pass.

What leaves bring together are candidates; the links are checked on the full sets. A group of candidates that hangs
together is worked through in one task, where every pair that is not yet connected is looked at. A group of over
``most_texts`` texts or ``most_shingles`` shingles is worked through in slices, each with the group's hub, and what then is
of several components leaf by leaf; nodes of branches that did not part, once for all trees, in pairs of slices of half that
size. So no task holds more than two slices or a leaf, and the work is linear in the group, but for texts that share even
their rarest tokens with over ``limit`` others, and yet are of many components: of these rows are their square by ``limit``
while candidates are sought, and by a thousand while these are checked.

Equality of shingles and sets rests on 64-bit hashes.

Defined cases: null text, text without words: an empty set, linked with nothing, a component of its own; a text of fewer
words than ``width`` is one shingle; repeated rows give repeated results; a null key has the least key of its component,
null if it is alone, and counts as kept then; ties do not arise; an empty table gives no rows; texts of any length are
taken whole; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import among, as_bytes, discard, lean, slices, written
from .components import components
from .simhash_similar import node_of, shingles
from .simhash_vptree import Forest

WIDTH, LEAST = 3, 0.85
TOKENS, TREES, DEPTH, LIMIT, ALIKE = 64, 24, 4, 256, 0.6
MOST_TEXTS, MOST_SHINGLES = 2_000, 2_000_000
#: Tokens of which the rarest bring nodes of unparted branches together.
ASKED = 32
#: Cells of a table of sets by common values, up to which a task counts all pairs by one product.
DENSE = 8 << 20
SHIFT, FACTOR = np.random.default_rng(13).integers(0, 1 << 63, (2, TOKENS), np.uint64)
FACTOR = FACTOR * np.uint64(2) + np.uint64(1)
PLACES = np.arange(TOKENS, dtype=np.uint64) << np.uint64(32)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def minwise(own: np.ndarray) -> np.ndarray:
    """TOKENS least values, of 32 bits, of a set under as many orders."""
    least = np.full(TOKENS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(own), 512):
        np.minimum(least, ((own[at : at + 512, None] ^ SHIFT) * FACTOR).min(axis=0), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def sketch(values: np.ndarray) -> np.ndarray:
    """Four mixed bits of each token, 16 tokens in a word: [n, TOKENS] to [n, TOKENS / 16]."""
    bits = (_mix(values.astype(np.uint64) + PLACES) & np.uint64(15)).reshape(len(values), -1, 16)
    return np.bitwise_or.reduce(bits << (np.arange(16, dtype=np.uint64) * np.uint64(4)), axis=2)


def agreeing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Tokens whose bits agree."""
    x = a ^ b
    x |= x >> np.uint64(1)
    x |= x >> np.uint64(2)
    return TOKENS - np.bitwise_count(x & np.uint64(0x1111111111111111)).sum(axis=1, dtype=np.int64)


def least_agreeing(least: float) -> int:
    """As many as sets of similarity ``least`` agree in, less 4.5 standard deviations."""
    p = least + (1 - least) / 16
    return int(TOKENS * p - 4.5 * (TOKENS * p * (1 - p)) ** 0.5)


def least_equal(least: float) -> int:
    """As many of ASKED tokens as sets of similarity ``least`` have in common, less 5 standard deviations."""
    return max(1, int(ASKED * least - 5 * (ASKED * least * (1 - least)) ** 0.5))


def chosen(tokens: np.ndarray, branch: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, path of the child) for each token that a row's branch chooses."""
    value = _mix(tokens ^ branch[:, None])
    row, place = np.nonzero(value < np.uint64(int(2**64 / (least * TOKENS))))
    return row, _mix(value[row, place] + (branch[row] << np.uint64(1) | np.uint64(1)))


def signatures(docs: DataFrame, text: str, key: str, width: int) -> DataFrame:
    """(key, node, n, tokens): name, size and minwise values of each row's set; those of an empty one are null."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, 1):
                sets = [shingles(x, width) for x in as_bytes(part.column(1))]
                tokens = [minwise(s).tobytes() if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([node_of(s) if len(s) else None for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(tokens, pa.binary())], [key, "node", "n", "tokens"])

    return docs.select(F.col(key), F.col(text)).mapInArrow(lean(run), f"`{key}` {dict(docs.dtypes)[key]}, node bigint, n bigint, tokens binary")


def _children(rows: DataFrame, least: float, trees: int = 0) -> DataFrame:
    """(path, node, above) of the children of rows (path, node, n, tokens), above being their branch's n; where path is null, of the roots of all trees."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                tokens = np.frombuffer(b"".join(part.column(3).to_pylist()), "<u4").reshape(-1, TOKENS) + PLACES
                if part.column(0).null_count:
                    branches = [np.full(len(tokens), _mix(np.array([tree + 1], np.uint64))[0]) for tree in range(trees)]
                else:
                    branches = [part.column(0).to_numpy().view(np.uint64)]
                for branch in branches:
                    row, path = chosen(tokens, branch, least)
                    row = pa.array(row)
                    yield pa.RecordBatch.from_arrays([pa.array(path.view(np.int64)), part.column(1).take(row), part.column(2).take(row)], ["path", "node", "above"])

    return rows.select("path", "node", F.col("n").cast("long").alias("n"), "tokens").mapInArrow(lean(run), "path bigint, node bigint, above bigint")


def leaves(nodes: DataFrame, least: float, trees: int, depth: int, limit: int) -> tuple[DataFrame, DataFrame]:
    """(path, node) of the leaves with several nodes, and (path, node, n, hub) of branches that do not part, of trees over nodes (node, tokens)."""
    rows = written(_children(nodes.select("node", "tokens", F.lit(None).cast("long").alias("path"), F.lit(1 << 62).alias("n")), least, trees), "paths")
    small, dense = [], []
    for level in range(1, depth + 1):
        by = rows.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("hub"), F.max("above").alias("above")).filter("n > 1")
        members = written(rows.select("path", "node").join(by, "path"), "branches")
        discard(rows)
        small.append(members.filter(F.col("n") <= limit).select("path", "node"))
        large = members.filter(F.col("n") > limit)
        stays = F.lit(True) if level == depth else F.col("n") >= ALIKE * F.col("above")
        dense.append(large.filter(stays).select("path", "node", "n", "hub"))
        parting = large.filter(~stays)
        if level == depth or parting.isEmpty():
            break
        rows = written(_children(parting.select("path", "node", "n").join(nodes.select("node", "tokens"), "node"), least), "paths")
    union = lambda parts: parts[0] if len(parts) == 1 else union([parts[0].unionByName(parts[1]), *parts[2:]])
    return union(small), union(dense)


def _slices(dense: DataFrame, limit: int, spread) -> DataFrame:
    """(path, node, label) of branches (path, node, label, n) cut into slices; nodes that are to be spread go to each of them."""
    parts = F.ceil(F.col("n") / limit).cast("int")
    dealt = F.when(spread, F.sequence(F.lit(0), parts - 1)).otherwise(F.array(F.pmod(F.xxhash64("node", "path"), parts).cast("int")))
    return dense.select("path", "node", "label", F.explode(dealt).alias("i")).select(F.xxhash64("path", "i").alias("path"), "node", "label")


def _mixed(rows: DataFrame) -> DataFrame:
    """The rows whose path holds several labels."""
    several = rows.groupBy("path").agg(F.min("label").alias("a"), F.max("label").alias("b")).filter("a < b").drop("a", "b")
    return rows.join(several, "path")


def _rare(asked: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """(path, node, label): nodes (node, label) at their rarest tokens, so many that two of similarity ``least`` share one; tokens of one node alone are left out."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                tokens = np.frombuffer(b"".join(part.column(1).to_pylist()), "<u4").reshape(-1, TOKENS)[:, :ASKED] + PLACES[:ASKED]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(np.repeat(np.arange(len(tokens)), ASKED))), pa.array(tokens.reshape(-1).view(np.int64))], ["node", "path"])

    common = least_equal(least)  # and so one of the ASKED + 1 - common rarest ones
    tokens = asked.select("node").join(nodes.select("node", "tokens"), "node").select("node", "tokens").mapInArrow(lean(run), "node bigint, path bigint")
    tokens = written(tokens, "tokens")
    held = tokens.join(tokens.groupBy("path").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "path")
    order = F.sort_array(F.collect_list(F.struct("n", "path")))
    first = held.groupBy("node").agg(order.alias("x")).filter(F.size("x") >= common)  # those of one node are rarer still
    first = first.select("node", F.explode(F.slice("x", F.lit(1), F.size("x") + 1 - common)).alias("x"))
    return first.select(F.col("x.path").alias("path"), "node").join(asked, "node").select("path", "node", "label")


def _cells(rows: DataFrame, limit: int) -> DataFrame:
    """Leaves (path, node, label) with several labels; of a larger one than ``limit`` pairs of slices, of which one at least has nodes that are not of its most frequent label. No pair of nodes comes in two of a leaf's cells, unless both are of one slice."""
    labels = rows.groupBy("path", "label").agg(F.count(F.lit(1)).alias("n"))
    most = F.max(F.struct("n", "label")).alias("most")
    size = labels.groupBy("path").agg(F.sum("n").alias("n"), most).filter("n > most.n")
    other, cut = F.col("label") != F.col("most.label"), F.col("n") > limit
    parts = lambda n: F.when(cut, F.ceil(n / limit)).otherwise(1).cast("int")
    named = rows.join(written(size, "leaf-sizes"), "path").withColumns({"few": parts(F.col("n") - F.col("most.n")), "many": parts(F.col("most.n"))})
    deal = lambda n: F.pmod(F.xxhash64("node", "path"), n).cast("int")
    own = F.when(~cut, 0).when(other, deal(F.col("few"))).otherwise(F.col("few") + deal(F.col("many")))
    with_ = F.when(~cut, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("few") - 1 + F.when(other, F.col("many")).otherwise(0)))
    dealt = named.select("path", "node", "label", own.alias("i"), F.explode(with_).alias("j"))
    return dealt.select(F.xxhash64("path", F.least("i", "j"), F.greatest("i", "j")).alias("path"), "node", "label")


def _blocks(dense: DataFrame, known: DataFrame, size: int) -> DataFrame:
    """(path, node, label): pairs of slices of the nodes (node, root, label) in branches that do not part and hold several labels; all of a group's branches at once, so that no pair comes twice."""
    several = _mixed(dense.select("path", "node").join(known, "node")).select("root", "node", "label").distinct()
    parts = written(several.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("h")), "block-counts")
    own = F.pmod(F.xxhash64("node"), "h").cast("int")
    cut = several.join(parts, "root").select("root", "node", "label", own.alias("i"), F.explode(F.sequence(F.lit(0), F.col("h") - 1)).alias("j"))
    return cut.select(F.xxhash64("root", F.least("i", "j"), F.greatest("i", "j")).alias("path"), "node", "label")


def candidates(nodes: DataFrame, small: DataFrame, dense: DataFrame, least: float, limit: int) -> DataFrame:
    """(node, root): nodes that hang together by sketches alike; those alone are left out."""
    own = F.col("node").alias("label")
    first = small.select("path", "node", own).unionByName(_slices(dense.select("path", "node", own, "n", "hub"), limit, F.col("node") == F.col("hub")))
    root = written(components(compared(first, nodes, least)), "labels")
    if dense.isEmpty():
        return root
    named = dense.join(root.withColumnRenamed("root", "label"), "node", "left").select("path", "node", F.coalesce("label", "node").alias("label"))
    asked = written(_mixed(named).select("node", "label").distinct(), "mixed-nodes")
    if asked.isEmpty():
        return root
    more = written(compared(_cells(written(_rare(asked, nodes, least), "rare-tokens"), limit), nodes, least), "label-links")
    if more.isEmpty():
        return root
    return written(components(root.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more)), "labels")


def compared(found: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """(a, b): links between labels whose nodes meet in a leaf with sketches alike; as many as connect what is connected in a task."""
    most = least_agreeing(least)

    def sketched(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                own = sketch(np.frombuffer(b"".join(part.column(1).to_pylist()), "<u4").reshape(-1, TOKENS))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(w.view(np.int64)) for w in np.ascontiguousarray(own.T))], ["node", *words])

    words = [f"w{i}" for i in range(TOKENS // 16)]
    sketches = nodes.select("node", "tokens").mapInArrow(lean(sketched), "node bigint, " + ", ".join(f"{w} bigint" for w in words))

    def flush(some):
        columns = [np.concatenate([b.column(i).to_numpy() for b in some]) for i in range(2 + len(words))]
        path, (names, label), own = columns[0], np.unique(columns[1], return_inverse=True), np.stack(columns[2:], 1).view(np.uint64)
        forest, at, d = Forest(len(names)), np.arange(len(path)), 0
        while len(at):  # each row with the one d behind it, while that is of its leaf
            d += 1
            at = at[at + d < len(path)]
            at = at[path[at] == path[at + d]]
            asked = at[label[at] != label[at + d]]
            for k in range(0, len(asked), 1 << 16):
                i = asked[k : k + (1 << 16)]
                i = i[agreeing(own[i], own[i + d]) >= most]
                forest.link_new(label[i], label[i + d])
        links = np.array(forest.links, np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(names[links[:, 0]]), pa.array(names[links[:, 1]])], ["a", "b"])

    def run(batches):
        held, n = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column(0).to_numpy()  # sorted; the last leaf may go on in the next batch
            cut = int(np.searchsorted(key, key[-1], "left"))
            if n > 50_000 and (cut or held[-1].column(0)[-1].as_py() != int(key[0])):
                yield flush([*held, batch.slice(0, cut)])
                held, n = [], 0
                batch = batch.slice(cut)
            held.append(batch)
            n += batch.num_rows
        if held:
            yield flush(held)

    rows = found.join(sketches, "node").select("path", "label", *words)
    return rows.repartition("path").sortWithinPartitions("path").mapInArrow(lean(run), "a bigint, b bigint").distinct()


class Sets:
    """Nodes with their sets and sketches, and labels of what is known to hang together."""

    def __init__(self, table: pa.Table, least: float):
        self.names, self.label = (table.column(c).to_numpy() for c in ("node", "label"))
        self.least, self.enough = least, least_agreeing(least)
        self.sketches = sketch(np.frombuffer(b"".join(table.column("tokens").to_pylist()), "<u4").reshape(-1, TOKENS))
        sets = [np.frombuffer(x, np.uint64) for x in table.column("set").to_pylist()]
        self.sizes = np.array([len(x) for x in sets], np.int64)
        values, place, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        self.parts, self.mark, self.shared = np.split(place, np.cumsum(self.sizes)[:-1]), np.zeros(len(values), bool), None
        common = np.cumsum(n > 1) - 1  # values of one set alone meet nothing
        if len(sets) * (n > 1).sum() <= DENSE:
            row, kept = np.repeat(np.arange(len(sets)), self.sizes), n[place] > 1
            marks = np.zeros((len(sets), int((n > 1).sum())), np.float32)
            marks[row[kept], common[place[kept]]] = 1
            self.shared = (marks @ marks.T).astype(np.int64)  # whole numbers below 2^24

    def similar(self, x: int, others: np.ndarray) -> np.ndarray:
        """Those of others whose similarity with x is ``least`` or more."""
        if self.shared is not None:
            both = self.shared[x, others]
            return others[both >= self.least * (self.sizes[others] + self.sizes[x] - both) - 1e-9]
        near = agreeing(self.sketches[others], self.sketches[x]) >= self.enough
        asked = others[near & (np.minimum(self.sizes[others], self.sizes[x]) >= self.least * np.maximum(self.sizes[others], self.sizes[x]) - 1e-9)]
        if not len(asked):
            return asked
        self.mark[self.parts[x]] = True
        shared = np.add.reduceat(self.mark[np.concatenate([self.parts[i] for i in asked])], np.r_[0, np.cumsum(self.sizes[asked])[:-1]], dtype=np.int64)
        self.mark[self.parts[x]] = False
        return asked[shared >= self.least * (self.sizes[asked] + self.sizes[x] - shared) - 1e-9]

    def forest(self) -> tuple[np.ndarray, list[tuple[int, int]]]:
        """The component of each row, and links between rows of unlike labels that make them."""
        out, links, rest = np.full(len(self.names), -1), [], np.arange(len(self.names))
        while len(rest):
            stack = rest[self.label[rest] == self.label[rest[0]]].tolist()
            start, rest = stack[0], rest[self.label[rest] != self.label[rest[0]]]
            out[stack] = start
            while stack and len(rest):
                x = stack.pop()
                hit = self.similar(x, rest)
                if len(hit):
                    links += [(x, int(i)) for i in hit]
                    here = np.isin(self.label[rest], self.label[hit])
                    stack += rest[here].tolist()
                    out[rest[here]] = start
                    rest = rest[~here]
        return out, links


def _components_in(rows: DataFrame, by: list[str], least: float) -> DataFrame:
    """(node, label): in each group of rows (root, node, set, tokens), the component's least node, or the group's root for its own component."""

    def one(table: pa.Table) -> pa.Table:
        table = table.append_column("label", table.column("node"))
        own, root = Sets(table, least), table.column("root")[0].as_py()
        of, _ = own.forest()
        chief = np.full(len(of), np.iinfo(np.int64).max)
        np.minimum.at(chief, of, own.names)
        for i in np.flatnonzero(own.names == root):
            chief[of[i]] = root
        return pa.table({"node": own.names, "label": chief[of]})

    return rows.groupBy(*by).applyInArrow(one, "node bigint, label bigint")


def _links_in(rows: DataFrame, least: float) -> DataFrame:
    """(a, b): links between labels in each path of rows (path, node, label, set, tokens)."""

    def one(table: pa.Table) -> pa.Table:
        own = Sets(table, least)
        links = np.array(own.forest()[1], np.int64).reshape(-1, 2)
        return pa.table({"a": own.label[links[:, 0]], "b": own.label[links[:, 1]]})

    return rows.groupBy("path").applyInArrow(one, "a bigint, b bigint")


def _sets(rows: DataFrame, width: int) -> DataFrame:
    """(root, node, g, set, tokens) from rows (root, node, g, text); a text that is not the node's goes."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, 3):
                found = [(i, own) for i, (node, x) in enumerate(zip(part.column(1).to_pylist(), as_bytes(part.column(3)), strict=True)) if node_of(own := shingles(x, width)) == node]
                kept = part.select([0, 1, 2]).take(pa.array([i for i, _ in found], pa.int64()))
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array([x.tobytes() for _, x in found], pa.binary()), pa.array([minwise(x).tobytes() for _, x in found], pa.binary())], ["root", "node", "g", "set", "tokens"])

    return rows.select("root", "node", "g", "text").mapInArrow(lean(run), "root bigint, node bigint, g int, set binary, tokens binary")


def clusters(docs: DataFrame, nodes: DataFrame, width: int = WIDTH, least: float = LEAST, trees: int = TREES, depth: int = DEPTH, limit: int = LIMIT, text: str = "text", key: str = "doc_id", most_texts: int = MOST_TEXTS, most_shingles: int = MOST_SHINGLES) -> DataFrame:
    """(node, label): the component of those nodes (node, least, n, tokens) that have a candidate, by links of similarity ``least`` or more."""
    small, dense = leaves(nodes, least, trees, depth, limit)
    members = nodes.select("node", "least", "n").join(candidates(nodes, small, dense, least, limit), "node")
    size = members.groupBy("root").agg(F.greatest(F.ceil(F.count(F.lit(1)) / most_texts), F.ceil(F.sum("n") / most_shingles)).cast("int").alias("g"))
    members = written(members.join(written(size, "group-sizes"), "root").select("root", "least", "node", "g"), "candidates")
    own = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    # a node's least key may be on other texts too, and on several rows of its own
    sets = written(_sets(among(own, members, {"least": F.col("id")}), width).dropDuplicates(["node"]), "candidate-sets")
    found = _components_in(sets.filter("g = 1"), ["root"], least)
    large = sets.filter("g > 1")
    if large.isEmpty():
        return found
    dealt = F.when(F.col("node") == F.col("root"), F.sequence(F.lit(0), F.col("g") - 1)).otherwise(F.array(F.pmod(F.xxhash64("node"), "g").cast("int")))
    cut = large.select("root", "node", "set", "tokens", F.explode(dealt).alias("i"))
    known = written(_components_in(cut, ["root", "i"], least).distinct(), "slice-components")
    named = known.join(large.select("node", "root"), "node")
    some = small.join(known, "node").unionByName(_blocks(dense, named, max(limit, most_texts // 2)))
    rest = written(_mixed(some), "mixed-leaves").join(large.select("node", "set", "tokens"), "node")
    links = written(_links_in(rest, least), "leaf-links")
    root = components(known.select(F.col("node").alias("a"), F.col("label").alias("b")).unionByName(links))
    return found.unionByName(known.join(root, "node", "left").select("node", F.coalesce("root", "label").alias("label")))


def near_dedup(docs: DataFrame, width: int = WIDTH, least: float = LEAST, text: str = "text", key: str = "doc_id", **options) -> DataFrame:
    """One row for each row of docs: key, n_shingles, component_id (the least key of its component), kept."""
    found = written(signatures(docs, text, key, width), "signatures")
    nodes = written(found.filter("n > 0").groupBy("node").agg(F.min(key).alias("least"), F.first("n").alias("n"), F.first("tokens").alias("tokens")), "signature-nodes")
    root = clusters(docs, nodes, width, least, text=text, key=key, **options)
    named = nodes.join(root, "node", "left").select("node", "least", F.coalesce("label", "node").alias("root"))
    label = written(named.join(named.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("node", "component_id"), "component-names")
    discard(nodes)
    full = found.filter("n > 0").select(key, "n", "node").join(label, "node").select(key, F.col("n").alias("n_shingles"), "component_id")
    out = full.unionByName(found.filter("n = 0").select(key, F.col("n").alias("n_shingles"), F.col(key).alias("component_id")))
    return out.withColumn("kept", F.col(key).eqNullSafe(F.col("component_id")))

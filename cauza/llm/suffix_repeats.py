"""Removal of passages that repeat across documents, by prefix-partitioned sparse suffix trees over words.

A window is ``window`` consecutive words of one document. A word is removed if a window that covers it has a word
sequence that also starts in a document with a smaller identifier.

Which suffixes: a window's anchor is its sequence of ``gram`` words with the least hash, the leftmost of equals. Equal
windows have equal anchors at equal places, and about 22 neighbouring windows share one. The trees hold the suffixes
that start at anchors, each with the words to its left that its windows reach; anchors of a single document are counted
first and dropped, as no repeat contains them. Suffixes of a document that are equal in all words that count (texts of a
short period) are one row with several places.

Which tree: suffixes are partitioned by their prefix, at first the ``gram`` words of the anchor. A prefix with more than
``most`` windows is lengthened: the windows are told apart by how far left of the anchor they start, in blocks of
``BLOCK``; the suffix then starts further left and its prefix is what all windows of the block have in common, window -
BLOCK + 1 words. Where that is still too much, the prefix is the whole window, and the subtree is the single node of
depth ``window``: its least identifier is an aggregate over the windows' bytes, with partial sums.

In a task, the suffixes below each prefix are sorted by words; the longest common prefixes of neighbours give the
subtree's internal nodes (intervals). A second tree holds the words to the left, read backwards. A repeat that starts o
words left of an anchor is a node of the first tree at depth window - o or more together with a node of the second at
depth o or more; cuts of both trees at these depths name the windows' classes, and the least identifier of a class
stays. maximal_repeats() lists the nodes of one group: depth, extension to the left, leaves.

Words are compared as bytes everywhere: hashes only choose groups, and windows with equal digests are grouped by bytes.

Defined cases: null text has no words; documents shorter than a window lose nothing; a null identifier neither removes
nor loses words; rows that repeat an identifier with the same text get the same result, and equal identifiers never
remove each other's words; an empty table gives no rows; other columns of the input are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, discard, lean, shared_dir, slices, written

WINDOW, GRAM, MOST, CHUNK, BLOCK = 50, 8, 50_000, 300_000, 8


def _odd(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, n, np.uint64) | np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def rolled(words: np.ndarray, n: int, seed: int) -> np.ndarray:
    """A 64-bit hash of each n consecutive word hashes."""
    out = np.zeros(len(words) - n + 1, np.uint64)
    for j, c in enumerate(_odd(n, seed)):
        out += words[j : j + len(out)] * c
    return _mix(out)


def word_hashes(words: list[bytes]) -> np.ndarray:
    from xxhash import xxh64_intdigest

    return np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))


def anchors(hashes: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Hash and place of the anchor of each window; empty for a text shorter than one."""
    if len(hashes) < window:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    grams = rolled(hashes, gram, 1)
    width = window - gram + 1
    place = np.empty(len(hashes) - window + 1, np.int64)
    step = 1 << 16
    for at in range(0, len(place), step):
        view = np.lib.stride_tricks.sliding_window_view(grams[at : at + step + width - 1], width)
        place[at : at + step] = view.argmin(axis=1) + np.arange(at, at + len(view))
    return grams[place], place


def _digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _count_anchors(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """(id, th, n_words, sha, anchors, windows): distinct anchors of each document, and how many windows have them."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, 2):
                rows = []
                for known, text in zip(part.column(0).is_valid().to_pylist(), as_bytes(part.column(2)), strict=True):
                    words = text.split()
                    found, n = np.unique(anchors(word_hashes(words) if known else np.zeros(0, np.uint64), window, gram)[0], return_counts=True)
                    rows.append((len(words), _digest(words), found.view(np.int64), n.astype(np.int64)))
                offsets = np.cumsum([0, *(len(r[2]) for r in rows)])
                lists = [pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), pa.array(np.concatenate([r[i] for r in rows]))).cast(pa.list_(pa.int64())) for i in (2, 3)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows]), *lists], ["id", "th", "n_words", "sha", "anchors", "windows"])

    return docs.mapInArrow(lean(run), "id bigint, th bigint, n_words bigint, sha string, anchors array<bigint>, windows array<bigint>")


#: A suffix starts at each of places; its windows start lo to hi words to the left of that; words reach from the first to the last of them.
ROW = "kind int, k bigint, id bigint, th bigint, lo int, hi int, places array<int>, words binary"
SHORT, LONGER, TEXT = 0, 1, 2


def suffixes(words: list[bytes], short: np.ndarray, longer: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> list[tuple]:
    """(kind, k, lo, hi, places, words) of one document's suffixes: at the anchors in short, and by blocks at those in longer."""
    hashes = word_hashes(words)
    value, place = anchors(hashes, window, gram)
    value = value.view(np.int64)
    first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]]) if len(place) else place
    last = np.r_[first[1:], len(place)] - 1
    held: dict[tuple, list[int]] = {}

    def hold(kind: int, k: int, at: int, lo: int, hi: int) -> None:
        held.setdefault((kind, k, lo, hi, b" ".join(words[at - hi : at - lo + window])), []).append(at)

    wanted = np.isin(value[first], short)
    for a, b in zip(first[wanted].tolist(), last[wanted].tolist(), strict=True):
        at = int(place[a])
        hold(SHORT, int(value[a]), at, at - b, at - a)
    wanted = np.isin(value[first], longer)
    if wanted.any():
        core = rolled(hashes, window - BLOCK + 1, 4)
        for a, b in zip(first[wanted].tolist(), last[wanted].tolist(), strict=True):
            at = int(place[a])
            lo, hi = at - b, at - a
            for block in range(lo // BLOCK, hi // BLOCK + 1):
                o = block * BLOCK
                # the suffix of this block starts o words further left
                hold(LONGER, int(_mix(core[at - o : at - o + 1] + np.uint64(block)).view(np.int64)[0]), at - o, max(lo - o, 0), min(hi - o, BLOCK - 1))
    return [(kind, k, lo, hi, places, seg) for (kind, k, lo, hi, seg), places in held.items()]


def _suffix_rows(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """ROW for (id, th, text, short, longer), and each document's words."""
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.binary()]
    names = [x.split()[0] for x in ROW.split(", ")]

    def run(batches):
        for batch in batches:
            for part in slices(batch, 2, 1 << 19):
                out = []
                lists = zip(part.column(0).to_pylist(), part.column(1).to_pylist(), as_bytes(part.column(2)), part.column(3).to_pylist(), part.column(4).to_pylist(), strict=True)
                for key, th, text, short, longer in lists:
                    words = text.split()
                    out += [(kind, k, key, th, *rest) for kind, k, *rest in suffixes(words, np.array(short, np.int64), np.array(longer, np.int64), window, gram)]
                    out.append((TEXT, 0, key, th, 0, 0, None, b" ".join(words)))
                for at in range(0, len(out), 20_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out[at : at + 20_000]), kinds, strict=True)], names)

    return docs.mapInArrow(lean(run), ROW)


def sorted_suffixes(flat: np.ndarray, at: np.ndarray, length: np.ndarray, depth: int, step: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Order of the word sequences that start at ``at`` and go on by ``step`` for ``length`` words, and the longest common prefix of each with the one before it (depth at most). Words are numbers from 1."""
    place = at[:, None] + step * np.arange(depth)
    held = np.arange(depth) < length[:, None]
    rows = np.where(held, flat[np.where(held, place, 0)], 0).astype(">u4")
    order = np.argsort(rows.view(f"S{4 * depth}").reshape(-1), kind="stable") if len(rows) else np.zeros(0, np.int64)
    rows = rows[order]
    differ = rows[1:] != rows[:-1]
    return order, np.r_[0, np.where(differ.any(axis=1), differ.argmax(axis=1), depth)] if len(rows) else np.zeros(0, np.int64)


class Subtree:
    """The suffixes below one or more prefixes: sorted, with the intervals of their common prefixes, and the tree to the left."""

    def __init__(self, texts: list[bytes], lo: np.ndarray, hi: np.ndarray, window: int = WINDOW):
        self.window, self.lo, self.hi = window, lo, hi
        cut = [t.split(b" ") for t in texts]
        sizes = np.array(list(map(len, cut)), np.int64)
        known: dict[bytes, int] = {}
        flat = np.fromiter((known.setdefault(w, len(known) + 1) for words in cut for w in words), np.int64, int(sizes.sum()))
        start = np.cumsum(sizes) - sizes
        self.order, self.lcp = sorted_suffixes(flat, start + hi, sizes - hi, window)
        self.left_order, self.left_lcp = sorted_suffixes(flat, start + hi - 1, hi, max(1, int(hi.max(initial=0))), -1)

    @staticmethod
    def cut(order: np.ndarray, lcp: np.ndarray, depth: int) -> np.ndarray:
        """The number of the node at this depth that each suffix lies below."""
        out = np.empty(len(order), np.int64)
        out[order] = np.cumsum(lcp < depth)
        return out

    def repeats(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, o): windows, o words left of the row's suffix, with an equal one in a row of a smaller document."""
        rows, offsets = [], []
        for o in range(int(self.lo.min(initial=0)), int(self.hi.max(initial=-1)) + 1):
            some = np.flatnonzero((self.lo <= o) & (o <= self.hi))
            if len(some) < 2:
                continue
            node = (self.cut(self.order, self.lcp, self.window - o) * (len(self.order) + 1) + self.cut(self.left_order, self.left_lcp, o))[some]
            by = np.argsort(node, kind="stable")
            first = np.flatnonzero(np.r_[True, node[by][1:] != node[by][:-1]])
            own = docs[some[by]]
            hit = own > np.repeat(np.minimum.reduceat(own, first), np.diff(np.r_[first, len(by)]))
            rows.append(some[by][hit])
            offsets.append(np.full(int(hit.sum()), o))
        if not rows:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(rows), np.concatenate(offsets)


def maximal_repeats(tree: Subtree, least: int = WINDOW) -> list[tuple[int, int, list[int]]]:
    """(depth, left, rows): internal nodes whose words, with the ``left`` words before them that all leaves share, are ``least`` or more."""
    place = np.empty(len(tree.left_order), np.int64)
    place[tree.left_order] = np.arange(len(place))
    out, stack = [], [(0, 0)]  # (depth, first)
    for i, depth in enumerate([*tree.lcp[1:].tolist(), 0], 1):
        first = i - 1
        while stack and stack[-1][0] > depth:
            deep, first = stack.pop()
            rows = tree.order[first:i]
            at = np.sort(place[rows])
            left = int(min([tree.left_lcp[at[0] + 1 : at[-1] + 1].min(initial=tree.window), tree.hi[rows].min()]))
            if deep + left >= least:
                out.append((deep, left, sorted(rows.tolist())))
        if not stack or stack[-1][0] < depth:
            stack.append((depth, first))
    return out


SPANS = "id bigint, th bigint, a int, b int"


def _subtrees(rows: DataFrame, window: int, chunk: int) -> DataFrame:
    """SPANS from rows (k, id, th, lo, hi, places, words); a task builds the subtrees of some prefixes at a time."""

    def run(batches):
        held, n = [], 0

        def flush(some):
            table = pa.Table.from_batches(some).combine_chunks()
            ids, ths, lo, hi = (table.column(c).to_numpy() for c in (1, 2, 3, 4))
            row, o = Subtree(as_bytes(table.column(6).combine_chunks()), lo.astype(np.int64), hi.astype(np.int64), window).repeats(ids)
            by = np.lexsort((o, row))
            row, o = row[by], o[by]
            first = np.flatnonzero(np.r_[True, (np.diff(row) != 0) | (np.diff(o) != 1)]) if len(row) else row
            last = np.r_[first[1:], len(row)][: len(first)] - 1
            places = table.column(5).combine_chunks()
            offsets, flat = places.offsets.to_numpy().astype(np.int64), places.values.to_numpy()
            count = (offsets[1:] - offsets[:-1])[row[first]]
            owner = np.repeat(np.arange(len(first)), count)
            at = flat[np.repeat(offsets[row[first]], count) + np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)]
            own = row[first][owner]
            return pa.RecordBatch.from_arrays([pa.array(ids[own]), pa.array(ths[own]), pa.array((at - o[last][owner]).astype(np.int32)), pa.array((at - o[first][owner] + window).astype(np.int32))], ["id", "th", "a", "b"])

        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, 1000)
                batch = batch.slice(part.num_rows)
                key = part.column(0).to_numpy()
                cut = int(np.searchsorted(key, key[-1], "left"))
                if held and n > chunk and (cut or held[-1].column(0)[-1].as_py() != int(key[0])):
                    yield flush([*held, part.slice(0, cut)] if cut else held)
                    held, n, part = [], 0, part.slice(cut)
                held.append(part)
                n += part.column(6).nbytes // 6
        if held:
            yield flush(held)

    return rows.select("k", "id", "th", "lo", "hi", "places", "words").repartition("k").sortWithinPartitions("k").mapInArrow(lean(run), SPANS)


def _windows(rows: DataFrame, window: int, bits: int) -> DataFrame:
    """(k1, k2, id, th, starts, words): each window of rows by its digest of twice ``bits`` bits, with its words."""

    def run(batches):
        from xxhash import xxh64_intdigest

        for batch in batches:
            for part in slices(batch, 5, 1 << 18):
                out = []
                for key, th, lo, hi, places, seg in zip(*(part.column(i).to_pylist() for i in range(6)), strict=True):
                    words = seg.split(b" ")
                    for o in range(lo, hi + 1):
                        own = b" ".join(words[hi - o : hi - o + window])
                        out.append((xxh64_intdigest(own, 2) >> 64 - bits, xxh64_intdigest(own, 3) >> 64 - bits, key, th, [p - o for p in places], own))
                columns = list(zip(*out)) if out else [()] * 6
                k = [pa.array(np.array(c, np.uint64).view(np.int64)) for c in columns[:2]]
                yield pa.RecordBatch.from_arrays([*k, pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.int64()), pa.array(columns[4], pa.list_(pa.int32())), pa.array(columns[5], pa.binary())], ["k1", "k2", "id", "th", "starts", "words"])

    return rows.select("id", "th", "lo", "hi", "places", "words").mapInArrow(lean(run), "k1 bigint, k2 bigint, id bigint, th bigint, starts array<int>, words binary")


def _whole(rows: DataFrame, window: int, bits: int = 64) -> DataFrame:
    """(id, th, block, bits): starts of windows, 64 in a row, that also start in a smaller document."""
    every = written(_windows(rows, window, bits), "windows")
    exact = every.groupBy("k1", "k2", "words").agg(F.min("id").alias("least"))
    least = written(exact.groupBy("k1", "k2").agg(F.min("least").alias("least"), F.count(F.lit(1)).alias("n")), "least-windows")
    # the table is written first, so that both sides of the join are plain exchanges, which Spark splits where a window is hot
    hit = every.select("k1", "k2", "id", "th", "starts").join(least.filter("n = 1"), ["k1", "k2"]).filter("id > least").select("id", "th", "starts")
    collided = least.filter("n > 1")
    if not collided.isEmpty():  # equal digests of unlike windows: by their bytes
        apart = every.join(collided.select("k1", "k2"), ["k1", "k2"], "left_semi")
        hit = hit.union(apart.join(exact.select("words", "least"), "words").filter("id > least").select("id", "th", "starts"))
    return hit.select("id", "th", F.explode("starts").alias("start")).groupBy("id", "th", F.expr("start div 64").alias("block")).agg(F.expr("bit_or(shiftleft(1L, start % 64))").alias("bits"))


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, most: int = MOST, chunk: int = CHUNK, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_words, n_removed, kept_sha256) for each row of docs."""
    kept, all_docs = repeats(docs, window, gram, most, chunk, text, key)
    digests = kept.select("id", "th", "n_removed", F.sha2("kept", 256).alias("new"))
    both = all_docs.alias("d").join(digests.alias("k"), ["id", "th"], "left")
    return both.select(F.col("id").alias(key), "n_words", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("new", "sha").alias("kept_sha256"))


def repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, most: int = MOST, chunk: int = CHUNK, text: str = "text", key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(id, th, n_removed, spans, kept) of the documents that lose words, and (id, th, n_words, sha) of all; th is the text's xxhash64."""
    if window < gram or window < BLOCK:
        raise ValueError(f"a window has {max(gram, BLOCK)} words at least")
    spark = docs.sparkSession
    docs = docs.select(F.col(key).cast("long").alias("id"), F.xxhash64(text).alias("th"), F.col(text).alias("text"))
    counted = written(_count_anchors(docs, window, gram), "anchors")
    pairs = counted.select("id", "th", F.explode(F.arrays_zip("anchors", "windows")).alias("p")).select("id", "th", F.col("p.anchors").alias("anchor"), F.col("p.windows").alias("n"))
    shared = written(pairs.groupBy("anchor").agg(F.min("id").alias("a"), F.max("id").alias("b"), F.sum("n").alias("n")).filter("a < b").select("anchor", (F.col("n") > most).alias("longer")), "shared-anchors")
    lists = pairs.drop("n").join(shared, "anchor").groupBy("id", "th").agg(F.collect_set(F.when(~F.col("longer"), F.col("anchor"))).alias("short"), F.collect_set(F.when(F.col("longer"), F.col("anchor"))).alias("longer"))
    path = shared_dir(spark, "suffixes")
    _suffix_rows(docs.join(lists, ["id", "th"]).select("id", "th", "text", "short", "longer"), window, gram).write.partitionBy("kind").option("compression", "zstd").parquet(path)
    found = spark.read.schema(ROW).parquet(path)
    discard(shared)

    longer = found.filter(F.col("kind") == LONGER)
    too_many = written(longer.groupBy("k").agg(F.sum(F.expr("hi - lo + 1")).alias("n")).filter(F.col("n") > most).select("k"), "hot-prefixes")
    deep = _subtrees(found.filter(F.col("kind") == SHORT).unionByName(longer.join(too_many, "k", "left_anti").select(found.columns)), window, chunk)
    wide = _whole(longer.join(too_many, "k", "left_semi"), window)
    marks = deep.select("id", "th", F.struct("a", "b").alias("span"), F.lit(None).cast("struct<block:bigint,bits:bigint>").alias("starts"))
    marks = marks.union(wide.select("id", "th", F.lit(None).cast("struct<a:int,b:int>"), F.struct("block", "bits")))
    # repeated rows of a document give repeated spans: sets
    spans = marks.groupBy("id", "th").agg(F.collect_set("span").alias("spans"), F.collect_set("starts").alias("starts"))
    texts = found.filter(F.col("kind") == TEXT).select("id", "th", "words").dropDuplicates(["id", "th"])

    def run(batches):
        for batch in batches:
            for part in slices(batch, 2):
                counts, kept, marked = [], [], []
                for data, places, starts in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), part.column(4).to_pylist(), strict=True):
                    words = data.split(b" ")
                    step = np.zeros(len(words) + 1, np.int64)
                    first = [s["block"] * 64 + i for s in starts for i in range(64) if s["bits"] >> i & 1]
                    np.add.at(step, [s["a"] for s in places] + first, 1)
                    np.add.at(step, [s["b"] for s in places] + [i + window for i in first], -1)
                    gone = np.cumsum(step)[:-1] > 0
                    counts.append(int(gone.sum()))
                    kept.append(b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g))
                    edges = np.flatnonzero(np.diff(np.r_[0, gone.astype(np.int8), 0]))
                    marked.append([{"a": int(a), "b": int(b)} for a, b in zip(edges[::2], edges[1::2], strict=True)])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(counts, pa.int64()), pa.array(marked, pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))), pa.array(kept, pa.binary())], ["id", "th", "n_removed", "spans", "kept"])

    kept = texts.join(spans, ["id", "th"]).mapInArrow(lean(run), "id bigint, th bigint, n_removed bigint, spans array<struct<a:int,b:int>>, kept binary")
    return kept, counted.drop("anchors", "windows")

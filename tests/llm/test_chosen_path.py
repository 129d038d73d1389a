import random
import re

import numpy as np
from pyspark.sql import functions as F

from cauza.llm import chosen_path as C


def grams(text, width=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def brute(rows, width=3, least=85):
    sets = [grams(t, width) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    where = {}
    for i, s in enumerate(sets):
        for g in s:
            where.setdefault(g, []).append(i)
    for i, s in enumerate(sets):
        for j in {j for g in s for j in where[g] if j < i}:
            both = len(s & sets[j])
            if root(i) != root(j) and 100 * both >= least * (len(s) + len(sets[j]) - both):
                up[root(i)] = root(j)
    least_of = {}
    for i, (key, _) in enumerate(rows):
        least_of[root(i)] = min((k for k in (least_of.get(root(i)), key) if k is not None), default=None)
    return sorted(str((key, len(s), c := least_of[root(i)], key == c)) for i, ((key, _), s) in enumerate(zip(rows, sets)))


def got(df):
    return sorted(str(tuple(r)) for r in df.select("doc_id", "n_shingles", "component_id", "kept").collect())


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"node": F.lit("x"), "n": F.lit(1), "least": F.lit(None).cast("int"), "path": F.lit(0)})


def made(n, seed, size=120):
    """Texts and copies of them with some words replaced: similarities of 0.6 to 1, many next to 0.85."""
    rnd, out = random.Random(seed), []
    for k in range(n):
        words = [f"w{rnd.randrange(400)}" for _ in range(rnd.choice([1, 2, 3, 9, size]))]
        out.append(" ".join(words))
        for _ in range(rnd.choice([0, 0, 1, 3])):
            other = list(words)
            for i in rnd.sample(range(len(words)), min(len(words), rnd.randrange(0, 7))):
                other[i] = f"x{rnd.randrange(400)}"
            out.append(" ".join(other))
    keys = list(range(len(out)))
    rnd.shuffle(keys)
    return list(zip(keys, out))


ODD = [(9001, None), (9002, ""), (9003, " \t\n"), (9004, "One"), (9005, "one"), (9006, "É e"), (9007, "é e"), (None, "alone null key here"), (None, None), (None, "one"), (9001, "other text of an id"), (9010, "w " * 30_000), (9011, "w  w W\x0bw"), (9004, "One"), (9012, "a\xa0b c d"), (9013, "a b c d")]


def test_odd_rows_and_edges(spark):
    rows = made(60, 1) + ODD
    assert got(C.near_dedup(frame(spark, rows))) == brute(rows)


def test_small_limits_branch_deeply_and_slice(spark):
    rows = made(40, 2, 60) + [(7000 + i, t) for i, (_, t) in enumerate(group(150, 3))]
    want = brute(rows)
    assert got(C.near_dedup(frame(spark, rows), limit=6, depth=3, most_texts=20)) == want
    assert got(C.near_dedup(frame(spark, rows), limit=4, depth=1, most_shingles=300)) == want


def group(n, seed, size=100, step=2):
    """Copies of one text, a few words each replaced: a group that neither parts nor is all linked."""
    rnd, words = random.Random(seed), [f"g{i}" for i in range(size)]
    out = []
    for k in range(n):
        other = list(words)
        for i in rnd.sample(range(size), rnd.randrange(0, 2 * step)):
            other[i] = f"h{rnd.randrange(10_000)}"
        out.append((k, " ".join(other)))
    return out


def test_a_large_group(spark):
    rows = group(900, 4) + [(5000 + i, t) for i, (_, t) in enumerate(made(10, 5))]
    assert got(C.near_dedup(frame(spark, rows), limit=100, most_texts=200)) == brute(rows)


def test_a_chain(spark):
    rnd, words, rows = random.Random(6), [f"c{i}" for i in range(100)], []
    for i in range(120):  # neighbours are near, ends are not
        words[rnd.randrange(100)] = f"y{i}"
        rows.append((i, " ".join(words)))
    want = brute(rows)
    assert got(C.near_dedup(frame(spark, rows))) == want
    assert got(C.near_dedup(frame(spark, rows), most_texts=30, limit=20)) == want


def test_empty(spark):
    assert C.near_dedup(frame(spark, ODD).limit(0)).collect() == []


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert got(C.near_dedup(docs)) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_recall_of_the_trees(spark):
    """Pairs of sets of 200 with similarity 0.85 meet in a leaf as often as stated, at one level and at four."""
    rnd = np.random.default_rng(7)
    values = []
    for _ in range(400):
        own = rnd.integers(0, 1 << 63, 216, np.uint64)
        values += [C.minwise(own[:200]), C.minwise(own[16:])]  # 184 of 216: 0.852
    rows = spark.createDataFrame([(i, v.tobytes()) for i, v in enumerate(values)], "node bigint, tokens binary")

    def met(limit, depth):
        small, dense = C.leaves(rows, 0.85, C.TREES, depth, limit)
        found = small.unionByName(dense.select("path", "node"))
        pairs = found.groupBy("path", F.expr("node div 2").alias("pair")).count().filter("count = 2").select("pair").distinct()
        return pairs.count() / 400

    assert met(256, 1) == 1.0
    assert met(1, 4) >= 0.99
    assert C.agreeing(C.sketch(np.stack(values[::2])), C.sketch(np.stack(values[1::2]))).min() >= C.least_agreeing(0.85)


def passages(n):
    """Minwise values of n nodes that have a passage in common, and of a near copy of every tenth."""
    rnd = np.random.default_rng(8)
    own = rnd.integers(0, 1 << 32, (n, C.TOKENS), np.uint32)
    own[:, ::3] = own[0, ::3]
    near = own[::10].copy()
    near[:, 1::7] = rnd.integers(0, 1 << 32, (len(near), 9), np.uint32)
    return np.concatenate([own, near])


def test_a_passage_in_common_costs_no_square(spark, monkeypatch):
    """Nodes of a branch that does not part, of many components, were compared slice by slice, each with all of them."""
    compared, met = C.compared, []

    def counted(found, nodes, least):
        met.append([r["count"] for r in found.groupBy("path").count().collect()])
        return compared(found, nodes, least)

    monkeypatch.setattr(C, "compared", counted)
    for n in (600, 1200):
        tokens = passages(n)
        nodes = spark.createDataFrame([(i, v.tobytes()) for i, v in enumerate(tokens)], "node bigint, tokens binary")
        dense = nodes.select(F.lit(1).cast("long").alias("path"), "node", F.lit(len(tokens)).cast("long").alias("n"), F.lit(0).cast("long").alias("hub"))
        small = dense.limit(0).select("path", "node")
        met.clear()
        of = {r.node: r.root for r in C.candidates(nodes, small, dense, 0.85, 50).collect()}
        assert all(of[10 * i] == of[n + i] for i in range(n // 10))
        assert len(set(of.values())) == n // 10
        first, second = met
        assert sum(second) <= 30 * len(tokens) and sum(x * x for x in second) <= 100 * len(tokens)


def test_cells_bring_all_pairs_of_labels_together(spark):
    """Every two nodes of a leaf that have several labels meet once, in cells of two slices or fewer; a leaf of one label has none."""
    label = {i: 0 if i < 150 else i for i in range(260)}
    rows = [(1, i, label[i]) for i in label] + [(2, i, 7) for i in range(90)] + [(3, 1000 + i, i) for i in range(5)]
    frame = spark.createDataFrame(rows, "path bigint, node bigint, label bigint")
    cells = {}
    for r in C._cells(frame, 20).collect():
        cells.setdefault(r.path, []).append((r.node, r.label))
    met = {}
    for own in cells.values():
        assert len(own) <= 90
        for k, (a, x) in enumerate(own):
            for b, y in own[:k]:
                if x != y:
                    met[min(a, b), max(a, b)] = 1
    assert set(met) == {(a, b) for a in label for b in label if a < b and label[a] != label[b]} | {(1000 + a, 1000 + b) for b in range(5) for a in range(b)}
    assert sum(map(len, cells.values())) <= 5 + 110 * 18 + 150 * 8

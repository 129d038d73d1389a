import random

import numpy as np
import xxhash

from cauza.llm import simhash_vptree as V


def brute_print(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    values = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum((2 * sum(v >> b & 1 for v in values) > len(values)) << b for b in range(64)) if words else 0


def brute_components(points):
    up = list(range(len(points)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(points)):
        for j in range(i):
            if (points[i] ^ points[j]).bit_count() <= 3:
                up[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(points))]


def planted(n, seed, bits=64):
    rnd, out = random.Random(seed), set()
    while len(out) < n:
        p = rnd.getrandbits(bits)
        out.add(p)
        for _ in range(rnd.choice([0, 0, 1, 6])):
            for b in rnd.sample(range(64), rnd.randrange(1, 6)):
                p ^= 1 << b
            out.add(p)
    return sorted(out)[:n]


def partition(n, pairs):
    up = list(range(n))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in pairs:
        up[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(n)]


def test_tree_finds_all_links():
    for seed, bits, leaf in ((1, 64, 8), (2, 12, 8), (3, 16, 4), (4, 64, 64)):
        points = planted(600, seed, bits)
        found = V.vp_links(np.array(points, np.uint64), leaf=leaf)
        assert all((points[i] ^ points[j]).bit_count() <= 3 for i, j in found)
        assert len(found) < len(points)
        assert partition(len(points), found) == brute_components(points)


def test_links_through_shards(spark):
    for bits, shard, shards in ((64, 20000, 1), (14, 40, 4), (64, 3, 64), (64, 1 << 15, 64)):
        points = planted(500, 7, bits)
        signed = [(int(np.uint64(p).view(np.int64)),) for p in points]
        where = {s[0]: i for i, s in enumerate(signed)}
        found = [(where[r.a], where[r.b]) for r in V.links(spark.createDataFrame(signed, "fp bigint"), shard=shard, shards=shards).collect()]
        assert partition(len(points), found) == brute_components(points)


def test_shards_fitted_on_few_points_are_exact():
    points = np.array(planted(800, 11), np.uint64)
    shards = V.Shards(points[::40], len(points), shard=50, shards=16)
    assert shards.leaves > 8
    which, at, guest = shards.deal(points)
    assert sorted(at[~guest].tolist()) == list(range(len(points)))  # one member each
    meet = set()
    for k in range(shards.leaves):
        own, come = at[(which == k) & ~guest], at[(which == k) & guest]
        meet |= {tuple(sorted((int(i), int(j)))) for i in own for j in np.r_[own, come] if i != j}
    close = [(i, j) for i in range(len(points)) for j in range(i) if (int(points[i]) ^ int(points[j])).bit_count() <= 3]
    assert close and all(tuple(sorted(p)) in meet for p in close)


def test_bounds_save_comparisons():
    points = np.unique(np.random.default_rng(2).integers(0, 1 << 63, 20_000, np.uint64))
    tree = V.Tree(points)
    assert tree.nodes > 300
    assert tree.compared < 0.1 * len(points) ** 2
    ball = np.array([1 << i | 1 << j for i in range(64) for j in range(i)] + [1 << i for i in range(64)], np.uint64)  # 2,080 points, most within 3 bits of others
    assert partition(len(ball), V.vp_links(ball)) == [0] * len(ball)


def test_near_dedup(spark):
    rnd = random.Random(3)
    base = [" ".join(rnd.choice("abcdefghij") * rnd.randrange(1, 4) for _ in range(300)) for _ in range(6)]
    rows = [(100 - i, t) for i, t in enumerate(base)] + [(i, base[i % 6] + " Zz") for i in range(20)] + [(40, None), (41, ""), (42, " \n"), (43, "One"), (44, "one two"), (45, "ONE two"), (46, "É ß\x1c x"), (47, "x " * 70000), (40, None)]
    df = spark.createDataFrame([(*r, 1, "n") for r in rows], "doc_id bigint, text string, fp int, component_id string")
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in V.near_dedup(df).collect()}
    prints = [brute_print(t) for _, t in rows]
    roots = brute_components(prints)
    want = {i: (f"{p:016x}", min(rows[k][0] for k in range(len(rows)) if roots[k] == r)) for (i, _), p, r in zip(rows, prints, roots)}
    assert got == want
    assert V.near_dedup(df).count() == len(rows)
    assert V.near_dedup(df.limit(0)).collect() == []


def test_whole_table(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    prints = [brute_print(r.text) for r in rows]
    roots = brute_components(prints)
    want = {r.doc_id: (f"{p:016x}", min(rows[k].doc_id for k in range(len(rows)) if roots[k] == root)) for r, p, root in zip(rows, prints, roots)}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in V.near_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect()}
    assert got == want


def test_labels_hang_together_from_the_start():
    points = np.array(planted(400, 21), np.uint64)
    labels = np.arange(len(points)) % 50
    found = V.Tree(points, labels=labels).forest.links
    plain = brute_components([int(p) for p in points])
    first = {}
    same = [(i, first.setdefault(int(k), i)) for i, k in enumerate(labels)]
    want = partition(len(points), [*same, *((i, r) for i, r in enumerate(plain))])
    assert partition(len(points), [*same, *found]) == want
    assert len(found) == 50 - len(set(want)) and all(labels[i] != labels[j] for i, j in found)


def test_tables_make_trees(spark):
    """The partitioning and the trees below it exist on the driver's tables, not only on large ones."""
    nodes = V.fingerprints(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")).select("fp").distinct()
    shards = V.fit_shards(nodes)
    points = np.sort(nodes.toArrow().column(0).to_numpy()).view(np.uint64)
    which, at, guest = shards.deal(points)
    trees = [V.Tree(points[np.r_[at[(which == k) & ~guest], at[(which == k) & guest]]], int(((which == k) & ~guest).sum())) for k in range(shards.leaves)]
    assert shards.leaves >= 64
    assert sum(t.nodes for t in trees) >= 64
    assert sum(t.compared for t in trees) < 0.2 * len(points) ** 2


def test_components_of_chains_stars_and_rings(spark):
    from cauza.llm.components import components

    rnd = random.Random(6)
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 50)] + [(2000 + i, 2000 + (i + 1) % 40) for i in range(40)] + [(5, 5), (-7, -9), (-9, -7), (-9, -8)]
    rnd.shuffle(edges)
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    got = {r.node: r.root for r in components(df.repartition(7)).collect()}
    want = {i: 0 for i in range(301)} | {1000 + i: 1000 for i in range(50)} | {2000 + i: 2000 for i in range(40)} | {-7: -9, -8: -9, -9: -9}
    assert got == want
    assert components(df.limit(0)).collect() == []

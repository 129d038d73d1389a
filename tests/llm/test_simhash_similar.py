import random

import numpy as np

import corpus_pipeline as C
from cauza.llm import simhash_similar as S


def grams(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def similarity(a, b):
    a, b = grams(a), grams(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def pairs(n, seed):
    """Texts 2k and 2k + 1 differ in some words, which lie spread: similarities of about 0.7 to 1."""
    rnd, out = random.Random(seed), []
    for k in range(n):
        words = [f"w{rnd.randrange(5000)}" for _ in range(300)]
        other = list(words)
        for i in rnd.sample(range(300), k % 11):
            other[i] = f"x{rnd.randrange(5000)}"
        out += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
    return out


def least_of_each(rows):
    up = {i: i for i, _ in rows}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for k, (i, a) in enumerate(rows):
        for j, b in rows[:k]:
            if root(i) != root(j) and similarity(a, b) >= 0.8:
                up[max(root(i), root(j))] = min(root(i), root(j))
    return {i: root(i) for i, _ in rows}


def test_stage_drops_all_near_copies_and_no_others(spark):
    rows = pairs(120, 1)
    near = {2 * k + 1 for k in range(120) if similarity(rows[2 * k][1], rows[2 * k + 1][1]) >= 0.8}
    assert 60 < len(near) < 120
    left = {r.doc_id for r in C.near(spark, spark.createDataFrame(rows, "doc_id bigint, text string"), "").collect()}
    assert left == {i for i, _ in rows} - near


def test_components_in_one_task_and_in_slices(spark):
    rnd = random.Random(2)
    words = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(60):  # a chain that drifts: neighbours are near, ends are not
        words[rnd.randrange(200)] = f"y{i}"
        rows.append((i, " ".join(words)))
    rows += [(100 + i, t) for i, t in pairs(10, 3)] + [(200, "One two"), (201, "one  TWO"), (202, "one"), (203, None), (204, " "), (205, "x " * 70_000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = least_of_each(rows)
    assert want[59] == 0 and want[204] == 203 and want[201] == 200
    for most in (2000, 7):
        assert {r.doc_id: r.component_id for r in S.near_dedup(df, most_texts=most).collect()} == want
    assert S.near_dedup(df.limit(0)).collect() == []


def test_large_group_meets_its_hub_first(spark):
    """Near copies of one text in slices; some that only hang on to it by another copy."""
    rnd = random.Random(9)
    base = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(90):
        words = list(base)
        for j in rnd.sample(range(300), 2):
            words[j] = f"v{i}.{j}"
        rows.append((i, " ".join(words)))
    far = list(base)
    for j in range(0, 40, 5):
        far[j] = f"z{j}"
        rows.append((200 + j, " ".join(far)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = least_of_each(rows)
    for most in (2000, 20, 3):
        assert {r.doc_id: r.component_id for r in S.near_dedup(df, most_texts=most).collect()} == want


def test_candidates_hold_nearly_all_pairs_of_the_least_similarity():
    """Recall by similarity, of pairs of random sets: in a cell together, and within the radius there."""
    rnd = np.random.default_rng(4)
    met = {0.8: 0, 0.9: 0}
    for least in met:
        for _ in range(300):
            n = 400
            shared = int(np.ceil(2 * n * least / (1 + least)))
            a = rnd.integers(0, 1 << 63, n, np.uint64)
            b = np.concatenate([a[:shared], rnd.integers(0, 1 << 63, n - shared, np.uint64)])
            bits = np.unpackbits(np.stack([S.long_print(a), S.long_print(b)]).view(np.uint8), axis=1, bitorder="little")
            same = (bits[0] == bits[1])[: S.VIEWS * S.BLOCK].reshape(S.VIEWS, S.BLOCK).all(axis=1)
            words = np.bitwise_count(S.long_print(a) ^ S.long_print(b))
            met[least] += any(words[(v * S.BLOCK // 64 + 2) % S.WORDS] + words[(v * S.BLOCK // 64 + 3) % S.WORDS] <= S.RADIUS for v in np.flatnonzero(same))
    assert met[0.8] >= 0.97 * 300 and met[0.9] == 300


def test_long_print_against_plain_counting():
    own = np.random.default_rng(1).integers(0, 1 << 63, 700, np.uint64)
    got, limit = S.long_print(own), (1 << 64) - 1
    for word in range(S.WORDS):
        values = []
        for x in own.tolist():
            x = ((x ^ int(S.SHIFT[word])) * int(S.FACTOR[word])) & limit
            x ^= x >> 29
            x = x * 0xBF58476D1CE4E5B9 & limit
            values.append(x ^ x >> 32)
        assert int(got[word]) == sum((2 * sum(v >> b & 1 for v in values) > len(values)) << b for b in range(64))

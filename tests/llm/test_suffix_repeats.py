import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from cauza.llm import suffix_repeats as S


def brute(rows, window):
    least = {}
    cut = [(i, "".join(t or "").encode().split()) for i, t in rows]
    for i, w in cut:
        if i is not None:
            for p in range(len(w) - window + 1):
                k = tuple(w[p : p + window])
                least[k] = min(least.get(k, i), i)
    out = []
    for i, w in cut:
        gone = set()
        for p in range(len(w) - window + 1):
            if i is not None and least[tuple(w[p : p + window])] < i:
                gone.update(range(p, p + window))
        out.append((i, len(w), len(gone), hashlib.sha256(b" ".join(x for p, x in enumerate(w) if p not in gone)).hexdigest()))
    return sorted(map(str, out))


def table(seed, n=120, window=50):
    rnd = random.Random(seed)
    words = [f"w{i}é" for i in range(400)]
    passages = [[rnd.choice(words) for _ in range(rnd.choice([window - 1, window, window + 1, 3 * window]))] for _ in range(5)]
    rows = []
    for i in range(n):
        text = [rnd.choice(words) for _ in range(rnd.choice([0, 3, window - 1, window, 90, 200]))]
        for _ in range(rnd.randrange(3)):
            at = rnd.randrange(len(text) + 1)
            text[at:at] = rnd.choice(passages)
        rows.append((rnd.randrange(1000), rnd.choice(["\n", " ", " \t "]).join(text)))
    rows += [(rows[3][0] + 1, rows[3][1]), rows[4], rows[4], (2000, None), (2001, ""), (None, rows[5][1]), (2002, "x " * 400), (2003, "x " * 90 + "y"), (2004, " ".join(words * 8)), (2005, "a b " * 300), (2006, "b a " * 250 + "q")]
    return rows


def got(df):
    return sorted(str((r[0], r.n_words, r.n_removed, r.kept_sha256)) for r in df.collect())


@pytest.mark.parametrize("most", [50_000, 60, 8])  # prefixes of 8 words, of 43, and whole windows
def test_against_brute_force(spark, most):
    rows = table(most)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id bigint, text string, id int, words string")
    assert got(S.remove_repeats(df, most=most, chunk=500)) == brute(rows, 50)


def test_equal_digests_are_told_apart_by_bytes(spark):
    rows = [(i, 0, 0, 3, [5], " ".join(f"{i % 7} {j}" for j in range(26)).encode()) for i in range(40)]
    df = spark.createDataFrame(rows, "id bigint, th bigint, lo int, hi int, places array<int>, words binary")
    got = {bits: sorted(map(tuple, S._whole(df, 49, bits).collect())) for bits in (64, 1)}
    assert got[1] == got[64]
    assert {r[0] for r in got[64]} == set(range(7, 40))


def test_subtree_nodes_against_plain_comparison():
    rnd = random.Random(8)
    segs, lo, hi = [], [], []
    for _ in range(60):
        h = rnd.randrange(6)
        low = rnd.randrange(h + 1)
        segs.append([rnd.choice("ab") for _ in range(h - low + 10)])
        lo.append(low)
        hi.append(h)
    tree = S.Subtree([" ".join(s).encode() for s in segs], np.array(lo), np.array(hi), 10)
    right = [s[h:] for s, h in zip(segs, hi)]
    assert [right[i] for i in tree.order] == sorted(right, key=lambda r: [tree_word(segs, w) for w in r])
    docs = np.array([rnd.randrange(20) for _ in segs])
    least = defaultdict(lambda: 99)
    for i, s in enumerate(segs):
        for o in range(lo[i], hi[i] + 1):
            k = (o, tuple(s[hi[i] - o : hi[i] - o + 10]))
            least[k] = min(least[k], docs[i])
    want = sorted((i, o) for i, s in enumerate(segs) for o in range(lo[i], hi[i] + 1) if least[o, tuple(s[hi[i] - o : hi[i] - o + 10])] < docs[i])
    assert sorted(zip(*(x.tolist() for x in tree.repeats(docs)))) == want
    nodes = S.maximal_repeats(tree, 4)
    assert nodes
    for depth, left, rows in nodes:
        common = {tuple(segs[i][hi[i] - left : hi[i] + depth]) for i in rows}
        assert len(common) == 1 and len(rows) > 1
        head = right[rows[0]][:depth]
        assert rows == [i for i in range(len(segs)) if right[i][:depth] == head]  # all leaves below it
        assert len({tuple(right[i][: depth + 1]) for i in rows}) > 1 or depth == 10 or {len(right[i]) for i in rows} == {depth}  # and not deeper


def tree_word(segs, word):
    """Words are numbered as they appear."""
    return list(dict.fromkeys(w for s in segs for w in s)).index(word)


def test_periods_are_one_row():
    words = b"x y ".split() * 5000
    value = np.unique(S.anchors(S.word_hashes(words))[0].view(np.int64))
    rows = S.suffixes(words, value, value[:0])
    assert len(rows) <= 6
    assert sum(len(r[4]) * (r[3] - r[2] + 1) for r in rows) == len(words) - 49  # each window once


def test_shared_anchors_without_repeats(spark):
    """Documents that share 30 words, too few for a window: subtrees without any deep node."""
    own = lambda i, k: " ".join(f"{i}.{j}" for j in range(k))
    rows = [(i, f"{own(i, 40)} {own(99, 30)} {own(i + 100, 40)}") for i in range(12)]
    assert got(S.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string"))) == brute(rows, 50)


def test_empty(spark):
    assert S.remove_repeats(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []


def test_whole_table(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    assert got(S.remove_repeats(df)) == brute(rows, 50)


def test_equal_windows_have_equal_anchors():
    rnd = random.Random(5)
    text = [str(rnd.randrange(30)).encode() for _ in range(3000)]
    text[2000:2200] = text[100:300]
    value, place = S.anchors(S.word_hashes(text))
    by = defaultdict(set)
    for p in range(len(text) - 49):
        by[tuple(text[p : p + 50])].add((int(value[p]), int(place[p]) - p))
    assert all(len(x) == 1 for x in by.values())


def test_what_windows_of_50_words_leave_and_take(spark):
    """Why planted passages may stay and clean documents may lose words: the windows are exact and 50 words long."""
    rnd = random.Random(9)
    fresh = lambda n: [f"u{rnd.randrange(10**9)}" for _ in range(n)]
    passage = fresh(80)
    altered = passage[:40] + ["changed"] + passage[41:]  # 40 and 39 equal words on either side: no window of 50
    partly = passage[:60] + ["changed"] + passage[61:]  # one run of 60
    common = fresh(50)
    rows = [(1, passage + fresh(30)), (2, fresh(30) + altered), (3, fresh(30) + partly), (4, fresh(20) + passage), (5, fresh(40) + common), (6, common + fresh(40))]
    out = {r.doc_id: r.n_removed for r in S.remove_repeats(spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id bigint, text string")).collect()}
    # 2: a planted copy that stays whole; 3: loses the part that fills a window; 6: own words, but one common passage
    assert out == {1: 0, 2: 0, 3: 60, 4: 80, 5: 0, 6: 50}


def test_a_very_long_text(spark):
    rnd = random.Random(10)
    words = [f"v{rnd.randrange(5000)}" for _ in range(120_000)]
    rows = [(1, " ".join(words[40_000:41_000])), (2, " ".join(words)), (3, " ".join(words[:70] + ["x"] + words[90_000:90_049]))]
    assert got(S.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string"))) == brute(rows, 50)

import random
import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from cauza.llm import divergence_audit as D


def words(text):
    text = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text)


def brute(rows, least=30, smoothing=5, top=50):
    counts, docs, sources = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source, own = lang or "", source or "", words(text)
        sources[lang].add(source)
        counts[lang, source].update(own)
        docs[lang].update(set(own))
    out = set()
    for lang, names in sources.items():
        kept = [t for t, n in docs[lang].items() if n >= least]
        whole = sum((counts[lang, s] for s in names), Counter())

        def p(c):
            total = sum(c[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (c[t] + smoothing) // (total + smoothing * len(kept)) for t in kept}

        shares, q = {s: p(counts[lang, s]) for s in names}, p(whole)
        for s in names:
            pairs = [(sum(abs(shares[s][t] - shares[o][t]) for t in kept), o) for o in names - {s}]
            terms = [(shares[s][t] - q[t], t) for t in kept if counts[lang, s][t] and shares[s][t] > q[t]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out |= {(lang, s, part, item, v, i) for i, (v, item) in enumerate(found[:most], 1)}
    return out


def frame(spark, rows):
    df = spark.createDataFrame(rows, "text string, lang string, source string")
    return df.withColumns({"n": F.lit("x"), "term": F.lit(None).cast("int"), "docs": F.lit(1), "doc_id": F.lit(None).cast("bigint")})


def got(df):
    rows = [tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def made(n, seed):
    rnd = random.Random(seed)
    some = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(80)] + ["ÄRGER", "Ärger", "日本", "İx", "A"]
    rows = [(" ".join(rnd.choices(some, k=rnd.randrange(0, 60))) + rnd.choice(["", "!", " 7b", "\x00c"]), rnd.choice(["x", "x", "y", None, ""]), rnd.choice(["s1", "s1", "s1", "s2", "ß", None])) for _ in range(n)]
    return [*rows, (None, "x", "s9"), ("", "lonely", "only"), ("one two", "z", "a"), (None, "z", "b"), *rows[:3], *rows[:3]]


def test_odd_rows(spark):
    rows = made(150, 1)
    assert got(D.audit(frame(spark, rows))) == brute(rows)
    assert got(D.audit(frame(spark, rows), least_docs=1, top=3, smoothing=1)) == brute(rows, 1, 1, 3)


def test_many_parts_and_pieces(spark):
    rows = made(120, 2) + [("Long é words, " * 3000 + "x" * 70_000, "x", "s1")]
    assert got(D.audit(frame(spark, rows), least_docs=2, part=7, piece=1000)) == brute(rows, 2)


def test_empty(spark):
    assert D.audit(frame(spark, made(3, 1)).limit(0)).collect() == []


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.text, r.lang, r.source) for r in docs.collect()]
    assert got(D.audit(docs)) == brute(rows)


def test_equal_hashes_are_told_apart_by_bytes():
    texts = [b"ab Cd ab x", b"", b"cd efg", b"X"]
    for digest in (None, lambda b: 1, lambda b: len(b), lambda b: b[0]):
        terms, group, place, n, docs = D.counted(texts, np.array([0, 0, 1, 0]), digest)
        found = {(int(g), terms[t]): (int(k), int(d)) for g, t, k, d in zip(group, place, n, docs)}
        assert found == {(0, b"ab"): (2, 1), (0, b"cd"): (1, 1), (0, b"x"): (2, 2), (1, b"cd"): (1, 1), (1, b"efg"): (1, 1)}


def test_terms_do_not_cross_texts_and_pieces_do_not_cut_terms():
    low, start, end, owner = D.boundaries([b"ab", b"", b"CD e", b"\xc3\xa4"])
    assert [(low[a:b].tobytes(), int(o)) for a, b, o in zip(start, end, owner)] == [(b"ab", 0), (b"cd", 2), (b"e", 2), (b"\xc3\xa4", 3)]
    text = b"aaa bb ccccccccccccc d " * 20
    parts = list(D.pieces(text, 5))
    assert b"".join(parts) == text and [w for p in parts for w in p.split()] == text.split()


def test_shares_are_exact():
    rnd = random.Random(3)
    for _ in range(300):
        total, kept = rnd.randrange(1, 9 * 10**15 // 2), rnd.randrange(1, 10**6)
        n = rnd.randrange(0, total + 1)
        assert int(D.shares(np.array([n]), total, kept)[0]) == 1 + 10**9 * (n + 5) // (total + 5 * kept)


def test_distances_equal_dense_ones():
    rnd = np.random.default_rng(4)
    for _ in range(30):
        s, c = int(rnd.integers(1, 7)), int(rnd.integers(1, 30))
        dense = rnd.integers(0, 9, (s, c)) * (rnd.random((s, c)) < 0.4)
        row, column = np.nonzero(dense)
        m = D.Matrix(row, column, dense[row, column], dense.sum(1) + 3, c, c)
        p = np.array([D.shares(dense[a], dense[a].sum() + 3, c) for a in range(s)])
        for a in range(s):
            assert m.distances(a).tolist() == np.abs(p - p[a]).sum(1).tolist()

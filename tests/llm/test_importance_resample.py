import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from cauza.llm import importance_resample as I


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


def grams(text, n):
    w = words(text)
    return [zlib.crc32(" ".join(w[i : i + k]).encode()) for k in range(1, n + 1) for i in range(len(w) - k + 1)]


def brute(rows, target, n=1, buckets=10_000, least=20, share=10, seed=2024):
    own, other = Counter(), Counter()
    found = [(i, [g % buckets for g in grams(t, n)], len(words(t))) for i, t in rows]
    for _, g, _ in found:
        own.update(g)
    for t in target:
        other.update(g % buckets for g in grams(t, n))
    s_all, t_all = float(sum(own.values())), float(sum(other.values()))
    gain = {b: math.floor(1000 * math.log((other[b] + 1.0) * (s_all + buckets) / ((own[b] + 1.0) * (t_all + buckets)))) for b in own}
    out = []
    for i, g, n_words in found:
        weight = sum(gain[b] for b in g) // len(g) if g else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n_words])
    long = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    most = share * len(long) // 100
    return sorted(str((*r[:4], None)) for r in [x for x in out if x[4] < least] + long[most:]) + sorted(str((*r[:4], k)) for k, r in enumerate(long[:most], 1))


def got(df):
    rows = [tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect()]
    return sorted(str(r) for r in rows if r[4] is None) + sorted(str(r) for r in rows if r[4] is not None)


def same(df, want):
    found = got(df)
    half = sum(x.endswith("None)") for x in want)
    assert found[:half] == want[:half] and set(found[half:]) == set(want[half:]) and len(found) == len(want)


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"score": F.lit("x"), "rank": F.lit(1), "before": F.lit(None).cast("int"), "n_words": F.lit(0)})


def made(n, seed):
    rnd = random.Random(seed)
    some = [f"w{i}" for i in range(300)] + ["É", "é", "日本", "A1", "a1", "İ"]
    rows = [(i, rnd.choice([" ", "-", "\x00"]).join(rnd.choices(some, k=rnd.choice([0, 5, 19, 20, 21, 80])))) for i in range(n)]
    return [*rows, (n, None), (n + 1, ""), (None, "x " * 30), (None, None), (3, "again " * 25), rows[5], rows[5]]


def test_odd_rows(spark):
    rows, target = made(300, 1), ["w1 w2 W3, é", None, "", "w1 w1 unknown"]
    t = spark.createDataFrame([(x,) for x in target], "text string")
    same(I.resample(frame(spark, rows), t), brute(rows, target))
    same(I.resample(frame(spark, rows), t, n=3, buckets=97, share=35, least_words=5, seed=7, piece=200), brute(rows, target, 3, 97, 5, 35, 7))


def test_ties_go_to_the_smaller_key(spark):
    rows = [(i % 40, "same words " * 15) for i in range(400)]
    t = spark.createDataFrame([("same",)], "text string")
    same(I.resample(frame(spark, rows), t, share=50), brute(rows, ["same"], share=50))


def test_empty_tables_and_long_texts(spark):
    none = spark.createDataFrame([], "text string")
    assert I.resample(frame(spark, made(9, 1)).limit(0), none).collect() == []
    rows = [*made(20, 2), (90, "Long text é " * 100_000), (91, "x" * 500_000 + " y" * 30)]
    same(I.resample(frame(spark, rows), none, n=2, piece=10_000), brute(rows, [], 2))


def test_whole_table(spark, sf_dir):
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    rows, target = [(r.doc_id, r.text) for r in docs.collect()], [r.text for r in bench.collect()]
    same(I.resample(docs, bench), brute(rows, target))
    want = {eval(x)[0] for x in brute(rows, target) if not x.endswith("None)")}
    taken = I.drawn(docs, bench)
    assert taken.columns == docs.columns and {r.doc_id for r in taken.collect()} == want


def test_suffix_array_and_runs():
    rnd = np.random.default_rng(3)
    for _ in range(40):
        n, sizes = int(rnd.integers(1, 5)), rnd.integers(0, 12, 5)
        ids = rnd.integers(1, 4, int(sizes.sum())).astype(np.int32)
        left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(ids))
        order, lcp = I.suffix_array(ids, left, n)
        suffix = lambda i: tuple(ids[i : i + min(n, left[i])])
        assert [suffix(i) for i in order] == sorted(suffix(i) for i in range(len(ids)))
        made = []
        spelled = [b"", b"a", b"b", b"c"]
        for k, (places, bucket) in enumerate(I.bucket_runs(ids, left, spelled, n, 1 << 32), 1):
            assert sorted(places.tolist()) == [i for i in range(len(ids)) if left[i] >= k]
            for p, b in zip(places.tolist(), bucket.tolist()):
                assert b == zlib.crc32(b" ".join(spelled[i] for i in ids[p : p + k]))
            made.append(len(places))


def test_an_ngram_is_hashed_once(monkeypatch):
    seen = []
    crc = zlib.crc32
    monkeypatch.setattr(I.zlib, "crc32", lambda x: (seen.append(x), crc(x))[1])
    I.featured([b"a b a b a b", b"b a b"], 2, 100)
    assert sorted(seen) == [b"a", b"a b", b"b", b"b a"]

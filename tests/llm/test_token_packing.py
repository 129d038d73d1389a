import random
from collections import defaultdict

import numpy as np
import public_tokenizers as P

from cauza.llm import token_packing as T

PATH = P.path("byte_bpe_50k.tiktoken")


def plain(sizes, length):
    rooms, rows = [], []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        fit = min((r for r in rooms if r >= sizes[i]), default=None)
        rooms.append(length - sizes[i]) if fit is None else rooms.__setitem__(rooms.index(fit), fit - sizes[i])
        rows.append(i)
    return sorted(rooms)


def test_best_fit_matches_a_linear_search():
    for seed in range(20):
        rnd = random.Random(seed)
        length = rnd.choice([1, 7, 64, 100])
        sizes = [rnd.randrange(length + 1) for _ in range(rnd.randrange(200))]
        rows = T.best_fit(sizes, length)
        assert sorted(i for r in rows for i in r) == list(range(len(sizes)))
        assert sorted(length - sum(sizes[i] for i in r) for r in rows) == plain(sizes, length)


def test_positions():
    assert T.position_ids([0, 3, 3, 5]).tolist() == [0, 1, 2, 0, 1]


def test_round_trip(spark):
    rnd = random.Random(2)
    texts = [None, "", "a"] + ["word " * rnd.randrange(3000) + "é" for _ in range(60)]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)] + [(2, "a", 1, "x")], "doc_id bigint, text string, ids int, n_tokens string")
    packs = T.pack(df, PATH, P.PATTERN, length=256, block=20_000)
    rows = packs.collect()
    encode = T.encoder(T.read_ranks(PATH), P.PATTERN)
    pieces = defaultdict(set)
    for r in T.unpack(packs).collect():
        pieces[r.doc_id].add((r.piece_start, bytes(r.ids)))
    for i, t in enumerate(texts):
        ids = np.frombuffer(b"".join(p[1] for p in sorted(pieces[i])), "<u2").tolist()
        assert ids == encode(t or "")
    for r in rows:
        assert len(r.ids) == 512 and r.cu_seqlens[-1] == r.n_tokens <= 256 and r.position_resets == r.cu_seqlens[:-1] and r.n_segments == len(r.doc_ids)
        assert set(np.frombuffer(r.ids, "<u2")[r.n_tokens :].tolist()) <= {T.PAD}
    assert len({r.pack_id for r in rows}) == len(rows)
    assert sum(d == 2 for r in rows for d in r.doc_ids) == 2
    assert T.pack(df.limit(0), PATH, P.PATTERN).collect() == []


def test_long_texts_and_null_identifiers(spark):
    long = "".join(f"w{i} " for i in range(150_000))
    df = spark.createDataFrame([(1, long), (None, "a b"), (None, "c"), (2, "y" * 100_000)], "doc_id bigint, text string")
    packs = T.pack(df, PATH, P.PATTERN, length=512, block=100_000)
    encode = T.encoder(T.read_ranks(PATH), P.PATTERN)
    got = T.unpack(packs).collect()
    for key, text in ((1, long), (2, "y" * 100_000)):
        parts = sorted((r.piece_start, bytes(r.ids)) for r in got if r.doc_id == key)
        assert np.frombuffer(b"".join(p[1] for p in parts), "<u2").tolist() == encode(text)
    assert sorted(np.frombuffer(r.ids, "<u2").tolist() for r in got if r.doc_id is None) == sorted([encode("a b"), encode("c")])
    rows, total = packs.collect(), sum(r.n_tokens for r in packs.collect())
    assert len(rows) <= -(-total // 512) + 8  # fill is lost at the edges of blocks only


def test_large_vocabularies_take_four_bytes(spark, tmp_path):
    import base64

    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 70_000}
    path = f"{tmp_path}/ranks"
    with open(path, "wb") as out:
        out.writelines(base64.b64encode(k) + b" %d\n" % v for k, v in ranks.items())
    assert T.id_kind(T.read_ranks(PATH), T.PAD) == "<u2" and T.id_kind(ranks, 0) == "<u4"
    row = T.pack(spark.createDataFrame([(1, "abc")], "doc_id bigint, text string"), path, r"\w+", length=8, pad=0).collect()[0]
    assert row.token_bytes == 4 and np.frombuffer(row.ids, "<u4").tolist() == [70_000, 99, 0, 0, 0, 0, 0, 0]
    assert [bytes(r.ids) for r in T.unpack(T.pack(spark.createDataFrame([(1, "abc")], "doc_id bigint, text string"), path, r"\w+", length=8, pad=0)).collect()] == [np.array([70_000, 99], "<u4").tobytes()]


def test_whole_table_against_a_plain_version(spark, sf_dir):
    """Packed and unpacked, every document has its ids; rows are as many as a linear search needs for each task's pieces."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").coalesce(1)
    packs = T.pack(docs, PATH, P.PATTERN)
    encode = T.encoder(T.read_ranks(PATH), P.PATTERN)
    ids = {r.doc_id: encode(r.text or "") for r in docs.collect()}
    got = defaultdict(list)
    for r in T.unpack(packs).collect():
        got[r.doc_id].append((r.piece_start, np.frombuffer(r.ids, "<u2").tolist()))
    assert {k: [t for _, p in sorted(v) for t in p] for k, v in got.items()} == ids
    sizes = [min(T.LENGTH, len(x) - at) for x in ids.values() for at in (range(0, len(x), T.LENGTH) if x else (0,))]
    assert packs.count() == len(plain(sizes, T.LENGTH))

import hashlib
import random
import struct

import public_tokenizers as P
import tiktoken

from cauza.llm import bpe_codec as B

PATH = P.path("byte_bpe_50k.tiktoken")
ODD = [None, "", "▁ ▁a", "日本語 text 123 \r\n\t  x", " " * 3000, "a" * 5000, "<unk> <s>", "\x00\x01é́", "don't we'll I'M", "𝔘𝔫𝔦 🙂🙂", "ȀĀ Ȁ"]


def test_round_trip(spark):
    ranks = B.read_ranks(PATH)
    ref = tiktoken.Encoding("ref", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rnd = random.Random(1)
    texts = ODD + ["".join(rnd.choice("abé ñ\n\t1'’sd▁日🙂<>|x") for _ in range(rnd.randrange(60))) for _ in range(500)]
    df = spark.createDataFrame([(i, t, 3, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, n_tokens int, ids string")
    want = {}
    for i, t in enumerate(texts):
        ids = ref.encode_ordinary(t or "")
        want[i] = (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    assert {r[0]: tuple(r)[1:] for r in B.round_trip(df, PATH, P.PATTERN).collect()} == want
    ids = B.encode_column(df, PATH, P.PATTERN)
    assert {r.doc_id: bytes(r.data) for r in B.decode_column(ids, PATH, P.PATTERN).collect()} == {i: (t or "").encode() for i, t in enumerate(texts)}
    assert B.round_trip(df.limit(0), PATH, P.PATTERN).collect() == []


def test_memory_of_pretokens_is_bounded(monkeypatch):
    ranks = B.read_ranks(PATH)
    codec = B.Codec(B.model_bytes(ranks), P.PATTERN)
    monkeypatch.setattr(B, "REMEMBERED", 50)
    ref = tiktoken.Encoding("ref", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for k in range(20):
        texts = [f"w{k} v{i} {'z' * 90}{i}" for i in range(30)]
        assert codec.encode(texts) == [struct.pack(f"<{len(x)}I", *x) for x in map(ref.encode_ordinary, texts)]
        assert len(codec.seen) <= 50


def test_every_token_encodes_to_itself():
    ranks = B.read_ranks(PATH)
    codec = B.Codec(B.model_bytes(ranks), P.PATTERN)
    tokens = list(ranks)
    assert codec.model.encode([B.byte_chars(t) for t in tokens], num_threads=1) == [[ranks[t]] for t in tokens]


def test_very_long_texts(spark):
    ref = tiktoken.Encoding("ref", pat_str=P.PATTERN, mergeable_ranks=B.read_ranks(PATH), special_tokens={})
    texts = ["".join(f"w{i} é\n" for i in range(120_000)), "z" * 60_000, " " * 200_000, "ab" * 30_000 + "🙂"]
    got = {r.doc_id: r for r in B.round_trip(spark.createDataFrame(list(enumerate(texts)) + [(None, "x")], "doc_id bigint, text string"), PATH, P.PATTERN).collect()}
    for i, t in enumerate(texts):
        ids = ref.encode_ordinary(t)
        assert got[i].n_tokens == len(ids) and got[i].ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest() and got[i].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
    assert got[None].n_tokens == 1


def test_memory_of_many_pretokens(monkeypatch):
    import tracemalloc

    codec = B.Codec(B.model_bytes(B.read_ranks(PATH)), P.PATTERN)
    monkeypatch.setattr(codec, "_new", lambda parts: [p.encode().ljust(12) for p in parts])
    tracemalloc.start()
    for k in range(30):
        codec.encode([" ".join(f"{'abcdefghij'[k % 10]}{i:x}".translate(str.maketrans("0123456789", "klmnopqrst")) + "uv"[k // 10 % 2] for i in range(9000))])
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert 0 < len(codec.seen) <= 100_000 and held < 25e6


def test_frequent_pretokens_stay(monkeypatch):
    codec, new = B.Codec(B.model_bytes(B.read_ranks(PATH)), P.PATTERN), []
    encode = codec._new
    monkeypatch.setattr(codec, "_new", lambda parts: (new.extend(parts), encode(parts))[1])
    monkeypatch.setattr(B, "REMEMBERED", 60)
    for k in range(12):
        codec.encode(["the " + " ".join(chr(97 + k) + chr(97 + i) for i in range(20))])
    assert new.count("the") == 1

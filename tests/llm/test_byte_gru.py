import math
import zlib

import numpy as np
import pyarrow as pa

from cauza.llm import byte_gru as G


def test_gradients_by_finite_differences():
    net = G.Net(["a", "b", "c"], 3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rnd = np.random.default_rng(0)
    data, mask, target = rnd.integers(0, 256, (7, 4)).astype(np.uint8), np.ones((7, 4)), np.array([0, 1, 2, 1])
    mask[5:, 2] = 0
    _, g = net.gradients(data, mask, target)
    for k, v in net.p.items():
        at, old = np.unravel_index(np.abs(g[k]).argmax(), v.shape), None
        old = v[at]
        v[at] = old + 1e-6
        up = net.gradients(data, mask, target)[0]
        v[at] = old - 1e-6
        down = net.gradients(data, mask, target)[0]
        v[at] = old
        assert abs((up - down) / 2e-6 - g[k][at]) < 1e-6


def test_gradients_with_a_target_for_each_position():
    net = G.Net(["a", "b", "c"], 3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rnd = np.random.default_rng(1)
    data, mask, target = rnd.integers(0, 256, (7, 4)).astype(np.uint8), np.ones((7, 4)), rnd.integers(0, 3, (7, 4))
    _, g = net.gradients(data, mask, target)
    for k, v in net.p.items():
        at = np.unravel_index(np.abs(g[k]).argmax(), v.shape)
        up, down = (net.gradients(data, mask, target)[0] for v[at] in (v[at] + 1e-6, v[at] - 1e-6))
        assert abs((up - down) / 2e-6 - g[k][at]) < 1e-6


def test_labels_change_where_the_language_does():
    rnd = np.random.default_rng(4)  # two languages with the same letters
    word = [[b"abc ", b"bca ", b"cab "], [b"acb ", b"bac ", b"cba "]]
    text = lambda k, n: b"".join(word[k][i] for i in rnd.integers(0, 3, n))
    net = G.Net(["one", "two"], 8)
    net.fit([text(k, 100) for k in (0, 1) for _ in range(40)], np.repeat([0, 1], 40), 150)
    found = G.positions(net, text(0, 100) + text(1, 100) + text(0, 100))
    assert [sum(x == "two" for x in found[i : i + 360]) > 180 for i in (20, 420, 820)] == [False, True, False]
    assert sum(x == y for x, y in zip(found, ["one"] * 400 + ["two"] * 400 + ["one"] * 400)) >= 1160


def test_memory_of_the_pipelines_scores_is_bounded():
    import tracemalloc

    import pyarrow as pa

    import corpus_pipeline as C

    net = G.Net(["a", "b", "c", "d"], 1)
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * 3000] * 2000)], ["text"])  # 6 MB
    tracemalloc.start()
    for part in G.by_length(batch, 0, 4, C.HELD):
        G.pooled(net, G.as_bytes(part.column(0)), C.HELD)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 70e6


def plain(net, text):
    """Probabilities of each position by one scalar at a time: both states, gates and softmax, for a single text."""
    sig, h = lambda v: 1 / (1 + math.exp(-v)), net.hidden
    states = {}
    for way in "fb":
        w, u, c = (net.p[k + way].astype(float).tolist() for k in "wuc")
        now, states[way] = [0.0] * h, [None] * len(text)
        for t in range(len(text)) if way == "f" else reversed(range(len(text))):
            row, own = w[text[t]], [sum(now[i] * u[i][j] for i in range(h)) for j in range(3 * h)]
            r, z = ([sig(row[k + j] + own[k + j]) for j in range(h)] for k in (0, h))
            n = [math.tanh(row[2 * h + j] + r[j] * (own[2 * h + j] + c[j])) for j in range(h)]
            now = [(1 - z[j]) * n[j] + z[j] * now[j] for j in range(h)]
            states[way][t] = now
    out = []
    for t, byte in enumerate(text):
        x = [net.p["d"][k] + sum(states[way][t][j] * net.p["v" + way][j][k] for way in "fb" for j in range(h)) for k in range(len(net.labels))]
        e = [math.exp(v - max(x)) for v in x]
        out.append([v / sum(e) * net.known[byte] for v in e])
    return np.array(out)


def test_forward_pass_equals_a_plain_loop_over_bytes():
    net = G.Net(["a", "b", "c"], 4, seed=2)
    rnd = np.random.default_rng(6)
    net.p = {k: (v + rnd.normal(0, 0.3, v.shape)).astype(np.float32) for k, v in net.p.items()}
    net.known[[7, 200]] = False
    texts = [b"", b"x", b"\xc3\xa9t\xc3\xa9 hello " * 9, b"q" * 300, rnd.integers(0, 256, 700).astype(np.uint8).tobytes(), b"z"]
    want = [plain(net, t).mean(axis=0) if t else np.zeros(3) for t in texts]
    for held in (1 << 20, 200, 7):  # one block, many blocks, blocks of a position
        assert np.allclose(G.pooled(net, texts, held), want, atol=1e-5)
    assert G.positions(net, texts[4]) == [net.labels[i] for i in plain(net, texts[4]).argmax(axis=1)]
    assert G.positions(net, b"") == []


def test_states_run_through_whole_texts():
    """A byte far away on either side still changes a position's probabilities where gates keep the state."""
    net = G.Net(["a", "b"], 4)
    for way in "fb":
        net.p["w" + way][:, 4:8] = 9.0  # update gates near 1: states are kept
        net.p["w" + way][ord("!"), 4:8] = -9.0
        net.p["u" + way][:] = 0
    quiet = b"x" * 3000
    middle = [np.concatenate([x[:, :, 0] for _, x in list(G.scored(net, [t]))[::-1]])[1500] for t in (quiet, b"!" + quiet[1:], quiet[1:] + b"!")]
    assert abs(middle[1] - middle[0]).max() > 1e-3 and abs(middle[2] - middle[0]).max() > 1e-3


def test_lanes_hold_all_texts_and_stay_short():
    sizes = np.array([5, 0, 900, 3, 3, 40, 900, 1])
    rows = G.lanes(sizes)
    assert sorted(i for row in rows for i in row) == [0, 2, 3, 4, 5, 6, 7]
    assert max(sum(sizes[i] for i in row) for row in rows) <= 2 * 900
    assert G.lanes(np.array([0, 0])) == G.lanes(np.array([], np.int64)) == []


def test_rare_languages_are_learned(spark):
    rows = [(i, "abc de " * 20, "common") for i in range(3000)] + [(5000 + i, "vwx yz " * 20, "rare") for i in range(4)] + [(6000 + i, "", "empty") for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    net = G.train(df, rows=20, updates=40)
    assert net.labels == ["common", "rare"]
    assert {r.lang_pred for r in G.predict(df.filter("doc_id between 5000 and 5999"), net).collect()} == {"rare"}


def test_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(sf_dir.replace("0.001", "0.01") + "/documents.parquet")
    got = G.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == 1000 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == r.lang for r in held) / len(held) >= 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_cases(spark):
    rows = [(i, f"{'abcde' if i % 2 else 'vwxyz'} " * 30, "one" if i % 2 else "two") for i in range(60)]
    odd = [(100, None, "one"), (101, "", "two"), (102, "12 34 !", None), (103, "abcde " * 20_000, None), (None, "abcde", "one"), (104, "vwxyz", None), (104, "vwxyz", None)]
    df = spark.createDataFrame([(*r, 1, "s") for r in rows + odd], "doc_id bigint, text string, lang string, letters int, held_out string")
    got = {r.doc_id: (r.lang_pred, r.held_out) for r in G.identify(df).collect()}
    assert got[100][0] == got[101][0] == got[102][0] == "und" and got[103][0] == "one" and got[104][0] == "two" and got[None][1] is True
    assert G.identify(df).count() == len(rows) + len(odd)
    assert G.identify(df.limit(0)).collect() == []
    assert {r.lang_pred for r in G.identify(df.filter("lang is null")).collect()} == {"und"}
    assert {r.lang_pred for r in G.identify(df.filter("lang is null or lang = 'one'")).collect()} == {"und", "one"}


def test_recognised_names_the_language_and_rejects_what_has_none(spark):
    rows = [(i, f"{'abcde' if i % 2 else 'vwxyz'} " * 30, "one" if i % 2 else "two", "s") for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, __text string")
    net = G.train(df, rows=30, updates=60)
    odd = [(900, "abcde " * 200 + "vwxyz " * 200, "one", None), (901, "\u043f\u0440\u0438\u0432\u0435\u0442 " * 40, None, "s"), (902, None, "one", "s"), (903, "...", "two", "s"), (904, "vwxyz " * 9, "one", "s")]
    got = {r.doc_id: r.lang for r in G.recognised(spark.createDataFrame(rows + odd, df.schema), net, 0.66).collect()}
    assert got == {r[0]: r[2] for r in rows} | {904: "two"}


def test_states_of_parts_are_computed_once(monkeypatch):
    """Each direction reads little more than the bytes; more only where scores do not fit."""
    import pyarrow as pa

    net, read = G.Net(["a", "b", "c", "d"], 1), []
    step = G.Runner.step
    monkeypatch.setattr(G.Runner, "step", lambda self, byte: (read.append(byte.size), step(self, byte))[1])
    sizes = np.random.default_rng(1).integers(1000, 3000, 2000).tolist()
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * n for n in sizes])], ["text"])
    for held in (4 << 20, 8 << 20):
        read.clear()
        for part in G.by_length(batch, 0, 4, held):
            G.pooled(net, G.as_bytes(part.column(0)), held)
        assert sum(read) < 2 * 1.3 * sum(sizes)


def test_a_step_takes_no_tanh(monkeypatch):
    """An exp is half a tanh where numpy has no AVX-512; gates far beyond its range are still 0 and 1."""
    net = G.Net(["a", "b"], 4)
    for way in "fb":
        net.p["w" + way][ord("x")] *= 1000
    monkeypatch.setattr(G.np, "tanh", None)
    got = G.pooled(net, [b"axbxa" * 20])
    assert np.isfinite(got).all() and abs(got.sum() - 1) < 1e-5


def test_uneven_lanes_are_read_once(monkeypatch):
    """Scores a little beyond those held, by uneven ends of lanes, do not make states be computed twice."""
    net, read = G.Net(["a", "b", "c", "d"], 1), []
    step = G.Runner.step
    monkeypatch.setattr(G.Runner, "step", lambda self, byte: (read.append(byte.size), step(self, byte))[1])
    texts = [b"x" * 1000] * 10
    G.pooled(net, texts, 4 * sum(map(len, texts)) * 9 // 10)
    assert sum(read) == 2 * sum(map(len, texts))


def test_long_texts_share_their_steps():
    """Of a task's texts, the longest ones had so few beside them that what a step costs whatever its lanes was as much as the lanes' share."""
    rnd = np.random.default_rng(4)
    sizes = np.r_[76_000, rnd.integers(20_000, 30_000, 200), rnd.integers(500, 4_000, 7_800)]
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * n for n in sizes.tolist()])], ["text"])
    work = 0
    for part in G.by_length(batch, 0, 4):
        own = np.array([len(x) for x in part.column(0).to_pylist()])
        work += max(own[lane].sum() for lane in G.lanes(own)) * (len(G.lanes(own)) + G.STEP)
    assert work <= 1.7 * sizes.sum()

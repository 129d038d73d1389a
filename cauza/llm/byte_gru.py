"""Language identification by a bidirectional gated recurrent network over bytes.

One step of either direction reads one byte: the byte's row of the input table feeds the reset, update and candidate
gates (sigmoid, sigmoid, tanh). Every position is labelled by a softmax over the states of both directions there; a
document's probabilities are the mean over its positions, where bytes that training never saw speak for no language.
Both directions run through the whole text with one state.

Texts are read side by side in lanes; a lane holds texts one after another and starts each with an empty state. Memory
does not grow with the length of a text: where the scores of all positions would be too many, states are kept at the
starts of blocks, and from the last block to the first the scores of a block are computed again.

The network is trained in numpy by backpropagation through time with Adam, on windows of ``WINDOW`` bytes of whole texts,
each with its document's language as target; every other window goes over into a second text at a random place, so that
states learn to leave a language where it ends. Training reads a bounded sample: for each language, the ``rows`` labelled
documents with the least hashes among those whose CRC-32 of the identifier's text is not divisible by ``folds`` and whose
text is not empty; the rest is held out. The sample is drawn within each language, so that rare ones are learned too.

Defined cases: null text, or text without a letter, is ``und`` with score 0; documents without a language or text are
not learned from; without any labelled document all are ``und``; with a single language every text with letters gets
it; a null identifier counts as held out; repeated rows give repeated results; other columns are not read.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import as_bytes, lean

WINDOW, HIDDEN = 128, 16
#: Labelled documents of each language, updates, windows of an update, step size.
ROWS, UPDATES, BATCH, RATE = 250, 300, 128, 0.02
FOLDS = 5
#: Lanes side by side, and the most scores that are held at once: 192 MB. The more, the more lanes share the steps of a long text.
LANES, HELD = 512, 48 << 20
#: What a step costs whatever the number of lanes, in lanes.
STEP = 100
#: Steps whose scores are taken together.
SPAN = 16


def gates(x: np.ndarray, own: np.ndarray, c: np.ndarray, hidden: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Reset, update and candidate from the byte's row x (changed in place) and the state's product own."""
    rz = x[:, : 2 * hidden]
    rz += own[:, : 2 * hidden]
    rz *= 0.5
    np.tanh(rz, out=rz)
    rz *= 0.5
    rz += 0.5
    n = x[:, 2 * hidden :]
    last = own[:, 2 * hidden :]
    last += c
    n += rz[:, :hidden] * last
    np.tanh(n, out=n)
    return rz[:, :hidden], rz[:, hidden:], n


def softmax(x: np.ndarray, axis: int = -1) -> np.ndarray:
    """In place."""
    x -= x.max(axis=axis, keepdims=True)
    np.exp(x, out=x)
    x /= x.sum(axis=axis, keepdims=True)
    return x


class Net:
    """Parameters and passes. Arrays of bytes are time-major: [positions, lanes]. w: rows of bytes, u: products of the state (reset, update, candidate side by side), c: candidate offset, v: scores of labels."""

    def __init__(self, labels: list[str], hidden: int = HIDDEN, seed: int = 7):
        rnd = np.random.default_rng(seed)
        some = lambda fan, *shape: rnd.normal(0, 1 / np.sqrt(fan), shape).astype(np.float32)
        self.labels, self.hidden = labels, hidden
        self.known = np.ones(256, bool)
        self.p = {}
        for way in "fb":
            self.p |= {f"w{way}": some(2, 256, 3 * hidden), f"u{way}": some(hidden, hidden, 3 * hidden), f"c{way}": np.zeros(hidden, np.float32), f"v{way}": some(hidden, hidden, len(labels))}
        self.p["d"] = np.zeros(len(labels), np.float32)

    def step(self, byte: np.ndarray, h: np.ndarray, way: str, keep: list | None = None) -> np.ndarray:
        """The state after one more byte in each lane; keep gets what the backward pass needs."""
        own = h @ self.p[f"u{way}"]
        r, z, n = gates(np.take(self.p[f"w{way}"], byte, axis=0), own, self.p[f"c{way}"], self.hidden)
        if keep is not None:
            keep.append((h, r, z, n, own[:, 2 * self.hidden :]))
        out = h - n
        out *= z
        out += n
        return out

    def gradients(self, data: np.ndarray, mask: np.ndarray, target: np.ndarray) -> tuple[float, dict]:
        """Mean cross entropy over all positions of windows [positions, lanes], and its gradients by backpropagation through time. target: of each lane, or of each position."""
        p, hidden, total = self.p, self.hidden, mask.sum()
        kind = p["d"].dtype
        held, states = {"f": [], "b": []}, {}
        for way in "fb":
            h, out = np.zeros((data.shape[1], hidden), kind), []
            for t in self._times(len(data), way):
                h = self.step(data[t], h, way, held[way]) * mask[t][:, None]
                out.append(h)
            states[way] = np.stack(out if way == "f" else out[::-1])
        e = softmax(states["f"] @ p["vf"] + states["b"] @ p["vb"] + p["d"])
        aim = (np.arange(len(data))[:, None], np.arange(data.shape[1]), target)
        loss = -float((np.log(e[aim] + 1e-9) * mask).sum() / total)
        e[aim] -= 1
        e *= (mask / total)[:, :, None]
        g = {"d": e.sum(axis=(0, 1))}
        flat = data.reshape(-1)
        order = np.argsort(flat, kind="stable")
        seen, first = np.unique(flat[order], return_index=True)
        for way in "fb":
            g[f"v{way}"] = np.tensordot(states[way], e, ([0, 1], [0, 1]))
            back, pre = e @ p[f"v{way}"].T, np.empty((*data.shape, 3 * hidden), kind)
            gu, gc, dh = np.zeros_like(p[f"u{way}"]), np.zeros_like(p[f"c{way}"]), np.zeros((data.shape[1], hidden), kind)
            for t, (h, r, z, n, own) in zip(self._times(len(data), way)[::-1], held[way][::-1], strict=True):
                dh = (dh + back[t]) * mask[t][:, None]
                dn = dh * (1 - z) * (1 - n * n)
                x = pre[t]
                x[:, :hidden] = dn * own * r * (1 - r)
                x[:, hidden : 2 * hidden] = dh * (h - n) * z * (1 - z)
                x[:, 2 * hidden :] = dn
                y = x.copy()
                y[:, 2 * hidden :] *= r
                gu += h.T @ y
                gc += y[:, 2 * hidden :].sum(axis=0)
                dh = dh * z + y @ p[f"u{way}"].T
            gw = np.zeros_like(p[f"w{way}"])
            gw[seen] = np.add.reduceat(pre.reshape(-1, 3 * hidden)[order], first, axis=0)
            g |= {f"w{way}": gw, f"u{way}": gu, f"c{way}": gc}
        return loss, g

    @staticmethod
    def _times(n: int, way: str) -> range:
        return range(n) if way == "f" else range(n - 1, -1, -1)

    def fit(self, texts: list[bytes], target: np.ndarray, updates: int = UPDATES, batch: int = BATCH, rate: float = RATE, seed: int = 3, window: int = WINDOW) -> list[float]:
        """Adam over batches with equal shares of the languages: a text, then one of its windows, at random, every other one continued by a second text; returns the losses."""
        rnd, losses = np.random.default_rng(seed), []
        self.known = np.bincount(np.frombuffer(b"".join(texts), np.uint8), minlength=256) > 0
        of = [np.flatnonzero(target == k) for k in range(len(self.labels))]
        m, v = ({k: np.zeros_like(x) for k, x in self.p.items()} for _ in range(2))
        for step in range(1, updates + 1):
            pick = np.concatenate([rnd.choice(x, max(1, batch // len(of))) for x in of])
            data, mask = np.zeros((window, len(pick)), np.uint8), np.zeros((window, len(pick)), np.float32)
            aim = np.tile(target[pick], (window, 1))
            for lane, i in enumerate(pick.tolist()):
                end = window if lane % 2 else int(rnd.integers(1, window))
                at = int(rnd.integers(0, max(1, len(texts[i]) - window + 1)))
                some = texts[i][at : at + end]
                if end < window:
                    i = int(rnd.choice(pick))
                    aim[len(some) :, lane] = target[i]
                    at = int(rnd.integers(0, max(1, len(texts[i]) - window + 1)))
                    some += texts[i][at : at + window - len(some)]
                data[: len(some), lane], mask[: len(some), lane] = np.frombuffer(some, np.uint8), 1
            loss, g = self.gradients(data, mask, aim)
            losses.append(loss)
            now = rate * (1 - step / (updates + 1))
            scale = min(1, 1 / (np.sqrt(sum(float((x * x).sum()) for x in g.values())) + 1e-9))
            for k, x in g.items():
                x = x * scale
                m[k] += (x - m[k]) * 0.1
                v[k] += (x * x - v[k]) * 0.01
                self.p[k] -= (now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
        return losses


class Runner:
    """States of lanes, stepped in one or both directions at once: [directions, lanes, hidden]. Gates lie in separate rows, so that numpy works on whole arrays; sigmoids are 1 / (1 + exp(-x)) and tanh is 2 / (1 + exp(-2 x)) - 1, as an exp costs half a tanh where numpy has no AVX-512, the signs and the 2 are worked into the tables, and a gate's division is the one by 1 + exp(-x). The last SPAN states are kept, and scored together."""

    def __init__(self, net: Net, ways: str, n: int):
        h, p = net.hidden, net.p
        self.states, self.i, self.saved = np.zeros((SPAN + 1, len(ways), n, h), np.float32), 0, []
        split = lambda x: x.reshape(*x.shape[:-1], 3, h)
        scale = np.array([-1, -1, -2], np.float32)[:, None]
        rows = np.stack([split(p[f"w{w}"]) * scale for w in ways])  # direction, byte, gate
        self.rows = np.ascontiguousarray(rows.transpose(2, 0, 1, 3)).reshape(-1, h)  # gate, direction, byte
        self.u = np.ascontiguousarray(np.stack([split(p[f"u{w}"]) * scale for w in ways]).transpose(2, 0, 1, 3))
        self.c = np.repeat(np.stack([p[f"c{w}"] for w in ways])[:, None, :] * np.float32(-2), n, axis=1)
        self.v = np.stack([p[f"v{w}"].T for w in ways])
        self.at = (np.arange(3 * len(ways)) * 256).reshape(3, len(ways), 1)
        self.own, self.pre = np.empty((3, len(ways), n, h), np.float32), np.empty((3, len(ways), n, h), np.float32)
        self.parts = self.pre[:2], self.own[:2], self.pre[0], self.pre[1], self.pre[2], self.own[2]

    @property
    def h(self) -> np.ndarray:
        return self.states[self.i]

    @property
    def full(self) -> bool:
        return self.i == SPAN

    def step(self, byte: np.ndarray) -> None:
        """One more byte in each lane, byte: [directions, lanes]. Where an exp overflows a gate is 0; callers ignore that, once for many steps."""
        h, after, (gates, own, r, z, n, last) = self.states[self.i], self.states[self.i + 1], self.parts
        self.rows.take(self.at + byte, axis=0, out=self.pre, mode="clip")
        np.matmul(h, self.u, out=self.own)
        gates += own
        np.exp(gates, out=gates)
        gates += 1
        last += self.c
        last /= r
        n += last
        np.exp(n, out=n)
        n += 1
        np.divide(2, n, out=n)
        n -= 1
        # h = n + z (h - n)
        np.subtract(h, n, out=after)
        after /= z
        after += n
        self.i += 1

    def clear(self, way: int, lanes: list[int]) -> None:
        """Empty states for lanes in which another text starts; the ones before are still to be scored."""
        now = self.states[self.i, way]
        if self.i:
            self.saved.append((self.i, way, lanes, now[lanes]))
        now[lanes] = 0

    def scores(self) -> np.ndarray:
        """[steps, directions, labels, lanes] of the states since the last call."""
        for i, way, lanes, values in self.saved:
            self.states[i, way, lanes] = values
        self.saved = []
        out = self.v @ self.states[1 : self.i + 1].transpose(0, 1, 3, 2)
        self.states[0] = self.states[self.i]
        self.i = 0
        return out


def lanes(sizes: np.ndarray, most: int = LANES) -> list[list[int]]:
    """Texts of each lane, the longest first into the lane that is shortest. Of some numbers of lanes, from the one that the longest text fills to one lane a text, the one with the least work; no lane is much longer than the longest text."""
    order = [i for i in np.argsort(-sizes, kind="stable").tolist() if sizes[i]]
    if not order:
        return []
    size = sizes.tolist()
    least = max(1, min(most, sum(size) // size[order[0]]))
    best, out = None, []
    for n in sorted({least + (min(most, len(order)) - least) * i // 4 for i in range(5)}):
        heap, rows = [(0, i) for i in range(n)], [[] for _ in range(n)]
        for i in order:
            held, lane = heap[0]
            rows[lane].append(i)
            heapq.heapreplace(heap, (held + size[i], lane))
        work = max(heap)[0] * (n + STEP)
        if best is None or work < best:
            best, out = work, rows
    return out


def scored(net: Net, texts: list[bytes], held: int = HELD):
    """Yields (owner, probabilities) of runs of positions, the last ones first: [positions, lanes] and [positions, labels, lanes]; owner is the text of a position, -1 for none."""
    rows = lanes(np.array(list(map(len, texts)), np.int64))
    if not rows:
        return
    sizes = [sum(len(texts[i]) for i in row) for row in rows]
    steps, n, k = max(sizes), len(rows), len(net.labels)
    data, owner = np.zeros((n, steps), np.uint8), np.full((n, steps), -1, np.int16 if len(texts) < 1 << 15 else np.int32)
    starts, ends = {}, {}
    for lane, row in enumerate(rows):
        at = 0
        for i in row:
            end = at + len(texts[i])
            data[lane, at:end] = np.frombuffer(texts[i], np.uint8)
            owner[lane, at:end] = i
            starts.setdefault(at, []).append(lane)
            ends.setdefault(end - 1, []).append(lane)
            at = end
    data = np.ascontiguousarray(data.T)
    owner = np.ascontiguousarray(owner.T)

    def finish(a: int, b: int, x: np.ndarray):
        for end in range(b, a, -256):  # in the cache
            at = max(a, end - 256)
            some = x[at - a : end - a]
            some += net.p["d"][:, None]
            softmax(some, 1)
            known = net.known[data[at:end]]
            if not known.all():
                some *= known[:, None, :]
            yield owner[at:end], some

    if steps * n * k <= held + held // 4:  # what uneven ends of lanes add to a part's scores; blocks would read it twice
        run, x = Runner(net, "fb", n), np.zeros((steps, k, n), np.float32)
        both = np.empty((2, n), np.uint8)
        with np.errstate(over="ignore"):
            for t in range(steps):
                back = steps - 1 - t
                if t in starts:
                    run.clear(0, starts[t])
                if back in ends:
                    run.clear(1, ends[back])
                both[0], both[1] = data[t], data[back]
                run.step(both)
                if run.full or not back:
                    score = run.scores()
                    x[t + 1 - len(score) : t + 1] += score[:, 0]
                    x[back : back + len(score)] += score[::-1, 1]
        yield from finish(0, steps, x)
        return

    # whole blocks last: where scores are a little too many, only the short first block is computed twice
    block, kept = max(1, held // (n * k)), {}
    cuts = [0, *range((steps - 1) % block + 1, steps + 1, block)]
    first, second = Runner(net, "f", n), Runner(net, "b", n)

    def forward(a: int, b: int, out: np.ndarray | None) -> None:
        with np.errstate(over="ignore"):
            for t in range(a, b):
                if t in starts:
                    first.clear(0, starts[t])
                first.step(data[t][None])
                if first.full or t == b - 1:
                    score = first.scores()
                    if out is not None:
                        out[t + 1 - len(score) - a : t + 1 - a] = score[:, 0]

    for a, b in zip(cuts, cuts[1:]):
        kept[a] = first.h.copy()
        if b < steps:
            forward(a, b, None)
    for a, b in zip(cuts[-2::-1], cuts[:0:-1]):
        x = np.empty((b - a, k, n), np.float32)
        first.h[:] = kept.pop(a)
        forward(a, b, x)
        with np.errstate(over="ignore"):
            for t in range(b - 1, a - 1, -1):
                if t in ends:
                    second.clear(0, ends[t])
                second.step(data[t][None])
                if second.full or t == a:
                    score = second.scores()
                    x[t - a : t - a + len(score)] += score[::-1, 0]
        yield from finish(a, b, x)


def pooled(net: Net, texts: list[bytes], held: int = HELD) -> np.ndarray:
    """Mean probabilities over the positions of each text, [texts, labels]; zeros for an empty one."""
    total = np.zeros((len(texts), len(net.labels)))
    for owner, x in scored(net, texts, held):
        first, last = owner[0], owner[-1]
        one = np.flatnonzero((first == last) & (first >= 0))  # lanes within one text, most of them
        total[first[one]] += x.sum(axis=0)[:, one].T
        for lane in np.flatnonzero(first != last).tolist():
            edges = np.flatnonzero(np.r_[True, owner[1:, lane] != owner[:-1, lane]])
            sums = np.add.reduceat(x[:, :, lane], edges, axis=0)
            for i, own in zip(owner[edges, lane].tolist(), sums, strict=True):
                if i >= 0:
                    total[i] += own
    return total / np.maximum(1, np.array(list(map(len, texts)), np.int64))[:, None]


def positions(net: Net, text: bytes) -> list[str]:
    """The label of every byte of one text."""
    best = [x[:, :, 0].argmax(axis=1) for _, x in scored(net, [text])][::-1]
    return [net.labels[i] for i in np.concatenate(best).tolist()] if best else []


def by_length(batch: pa.RecordBatch, column: int, labels: int, held: int = HELD):
    """Parts of a batch with texts of similar length, the longest first: lanes then stay full, and long texts have as many beside them as can be. The scores of a part take 7/8 of those held, so that with the lanes' uneven ends they still are, and states are not computed twice; only a longer text alone is worked in blocks."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    order = np.argsort(-size, kind="stable")
    part = (np.cumsum(size[order]) - size[order]) // max(1 << 19, held // max(1, labels) * 7 // 8)
    for some in np.split(order, np.flatnonzero(np.diff(part)) + 1):
        if len(some):
            yield batch.take(pa.array(some))


def is_held_out(key: Column, folds: int = FOLDS) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % folds == 0, F.lit(True))


def train(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", rows: int = ROWS, updates: int = UPDATES) -> Net:
    """A network from a bounded sample: of each language, the ``rows`` labelled documents with the least hashes, whole texts."""
    h = F.pmod(F.xxhash64(key, F.lit(5)), F.lit(1 << 31))
    learned = docs.filter(~is_held_out(F.col(key)) & F.col(lang).isNotNull() & (F.length(text) > 0)).select(h.alias("h"), F.col(key).alias("k"), F.col(lang).alias("l"), F.col(text).alias("t"))
    count = learned.groupBy("l").agg(F.count(F.lit(1)).alias("n"))
    # a threshold on the hash first: only about twice the rows of each language go to the tasks that order them
    drawn = learned.join(F.broadcast(count), "l").filter(F.col("h") * F.col("n") < F.lit(2 * rows) * F.lit(1 << 31))  # count: a row for each language
    first = drawn.withColumn("i", F.row_number().over(W.partitionBy("l").orderBy("h", "k", "t"))).filter(F.col("i") <= rows)
    found = first.select("l", "t", "h", "k").toArrow().sort_by([("l", "ascending"), ("h", "ascending"), ("k", "ascending"), ("t", "ascending")]).to_pydict()
    labels = sorted(set(found["l"]))
    net = Net(labels)
    if len(labels) > 1:
        net.fit([t.encode() for t in found["t"]], np.array([labels.index(x) for x in found["l"]]), updates)
    return net


def _guess(net: Net, letters: list[bool], texts: list[bytes], held: int = HELD) -> tuple[list[str], list[float]]:
    """Label and score of each text."""
    if not net.labels:
        return ["und"] * len(texts), [0.0] * len(texts)
    p = pooled(net, [x if ok else b"" for x, ok in zip(texts, letters, strict=True)], held)
    best, score = p.argmax(axis=1).tolist(), p.max(axis=1).clip(0, 1).round(5).tolist()
    return [net.labels[b] if ok else "und" for b, ok in zip(best, letters, strict=True)], [s if ok else 0.0 for s, ok in zip(score, letters, strict=True)]


def _letters(text: str) -> Column:
    return F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))


def predict(docs: DataFrame, net: Net, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, held_out, lang_pred, score) for each row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(net)  # a fixed number of parameters for each language

    def run(batches):
        for batch in batches:
            for part in by_length(batch, 3, len(shared.value.labels)):
                label, score = _guess(shared.value, part.column(2).to_pylist(), as_bytes(part.column(3)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(label, pa.string()), pa.array(score, pa.float64())], [key, "held_out", "lang_pred", "score"])

    rows = docs.select(F.col(key), is_held_out(F.col(key)).alias("held_out"), _letters(text).alias("letters"), F.col(text).alias("text"))
    return rows.mapInArrow(lean(run), f"`{key}` {dict(docs.dtypes)[key]}, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id") -> DataFrame:
    """train() and predict() on one table."""
    return predict(docs, train(docs, text, lang, key), text, key)


def recognised(docs: DataFrame, net: Net, least_score: float = 0.0, text: str = "text", lang: str = "lang", held: int = HELD) -> DataFrame:
    """The rows of docs, all columns, whose text has letters and a label with at least that score; that label takes the place of lang. Nothing is shuffled. held: scores at once, see HELD."""
    shared = docs.sparkSession.sparkContext.broadcast(net)
    at, names = len(docs.columns), docs.columns
    to, read = names.index(lang), names.index(text)

    def run(batches):
        for batch in batches:
            for part in by_length(batch, read, len(shared.value.labels), held):
                label, score = _guess(shared.value, part.column(at).to_pylist(), as_bytes(part.column(read)), held)
                kept = pa.array([x != "und" and s >= least_score for x, s in zip(label, score, strict=True)], pa.bool_())
                columns = [part.column(i) if i != to else pa.array(label, pa.string()) for i in range(at)]
                yield pa.RecordBatch.from_arrays([c.filter(kept) for c in columns], part.schema.names[:at])

    # by place, so that names do not matter
    return docs.select(*(F.col(f"`{c}`") for c in names), _letters(text).alias("letters")).mapInArrow(lean(run), docs.schema)

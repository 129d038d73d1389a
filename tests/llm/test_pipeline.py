import hashlib
import re
import struct
from collections import defaultdict

import public_tokenizers as P
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline as C
from cauza.llm import budget_mix, byte_gru
from cauza.llm.bpe_codec import read_ranks

WS = re.compile(r"[\x20\x09-\x0d]")


def plain_mix(rows):
    """Whole-number water filling and prefixes, one leaf at a time."""
    leaf = lambda r: (budget_domain(r["source"]), r["lang"] or "-", r["source"] or "-")
    tokens = lambda r: len(re.findall(r"[^\x20\x09-\x0d]+", r["text"] or ""))
    supply = defaultdict(int)
    for r in rows:
        supply[leaf(r)] += tokens(r)

    def fill(caps, weights, given):
        out, left = {}, sorted(caps, key=lambda k: (caps[k] / weights[k], k))
        while left and caps[left[0]] * sum(weights[k] for k in left) <= given * weights[left[0]]:
            out[left[0]] = caps[left[0]]
            given -= caps[left.pop(0)]
        total = sum(weights[k] for k in left)
        return out | {k: min(caps[k], given * weights[k] // total) for k in left}

    def share(level, prefix, given, found):
        below = sorted({k[level] for k in supply if k[:level] == prefix})
        caps = {b: sum(v for k, v in supply.items() if k[: level + 1] == (*prefix, b)) * C.EPOCHS for b in below}
        listed = (budget_mix.DOMAIN_WEIGHTS, budget_mix.LANG_WEIGHTS, {})[level]
        for b, amount in fill(caps, {b: listed.get(b, 1) for b in below}, given).items():
            if level == 2:
                found[(*prefix, b)] = amount
            else:
                share(level + 1, (*prefix, b), amount, found)
        return found

    budget = share(0, (), sum(supply.values()) * C.SHARE // 100, {})
    kept, used = [], defaultdict(int)
    md5 = lambda r: hashlib.md5(f"{budget_mix.SEED}:1:{r['doc_id']}".encode()).hexdigest()
    for r in sorted(rows, key=lambda r: (md5(r), r["doc_id"])):
        if budget[leaf(r)] == supply[leaf(r)]:
            kept.append(r)
        elif used[leaf(r)] < budget[leaf(r)]:
            ends = [m.end() for m in re.finditer(r"[^\x20\x09-\x0d]+", r["text"])]
            take = min(len(ends), budget[leaf(r)] - used[leaf(r)])
            kept.append(r | {"text": r["text"] if take == len(ends) else r["text"][: ends[take - 1]]})
        used[leaf(r)] += tokens(r)
    assert all(min(used[k], budget[k]) == budget[k] for k in used)
    return kept


def budget_domain(source):
    found = re.search(r"[0-9]{1,6}$", source or "")
    return f"d{int(found[0]) % 4}" if found else "-"


def grams(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text).encode().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain(spark, docs):
    net = byte_gru.train(docs)
    rows = [r.asDict() for r in docs.orderBy("doc_id").collect()]
    probabilities = byte_gru.pooled(net, [(r["text"] or "").encode() for r in rows])
    least = 1 / len(net.labels) + C.LEAST_CONFIDENCE * (1 - 1 / len(net.labels))
    rows = [r | {"lang": net.labels[p.argmax()]} for r, p in zip(rows, probabilities) if r["text"] and any(c.isalpha() for c in r["text"]) and round(p.max(), 5) >= least]
    best = {}
    for r in rows:
        k = WS.sub("", r["text"])
        if k not in best or (len(r["text"]), -r["doc_id"]) > (len(best[k]["text"]), -best[k]["doc_id"]):
            best[k] = r
    rows = sorted(best.values(), key=lambda r: r["doc_id"])
    sets, up = [grams(r["text"]) for r in rows], list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9:
                up[max(root(i), root(j))] = min(root(i), root(j))
    rows = plain_mix([r for i, r in enumerate(rows) if root(i) == i])
    encode = tiktoken.Encoding("ref", pat_str=P.PATTERN, mergeable_ranks=read_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={}).encode_ordinary
    out = []
    for r in rows:
        ids = encode(r["text"])
        out.append((r["doc_id"], len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(r["text"].encode()).hexdigest()))
    return sorted(out)


def test_run_matches_a_plain_version(spark, sf_dir):
    want = plain(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
    assert sorted(tuple(r) for r in C.run(spark, sf_dir).collect()) == want
    assert len(want) > 100


def test_stages_on_odd_rows(spark, tmp_path):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept int, component_id string, epoch int"
    text = ["der und die das", "the of and to", "les des une que"]
    rows = [(i, f"{text[i % 3]} {'xyz'[i % 3] * (i % 7)} {i // 3}" * 4, ["de", "en", "fr"][i % 3], f"src{i % 5}", None, 1, "c", 2) for i in range(90)]
    rows += [(200, None, None, None, 0, 1, "c", 2), (201, "", "en", None, 0, 1, "c", 2), (None, "the of and to q", None, "src1", 5, 1, "c", 2), (202, "the of " * 40_000, "en", "src", 1, None, None, None), rows[4], rows[4]]
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in C.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.schema.names == docs.schema.names, name
        left = [r.doc_id for r in out.select("doc_id").collect()]
        assert set(left) <= {r[0] for r in rows} and 202 in left
        if name in ("exact_dedup", "simhash_near_dedup"):
            assert left.count(4) == 1
        assert (200 in left) == (name != "language")
        assert stage(spark, docs.limit(0), str(tmp_path)).collect() == []
    assert C.run(spark, str(tmp_path)).agg(F.count("doc_id")).first()[0] > 0


def test_language_drops_what_has_none_and_renames_the_rest(spark, sf_dir):
    docs = spark.read.parquet(sf_dir.replace("0.001", "0.01") + "/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    by = {lang: [r.text[:400] for r in rows.values() if r.lang == lang and 400 < len(r.text)][:12] for lang in ("de", "en", "fr")}
    junk = [(10_000 + i, " ".join(x), "en", "src1", 0) for i, x in enumerate(zip(*by.values()))] + [(20_000, "\u043f\u0440\u0438\u0432\u0435\u0442 " * 50, "en", "src1", 0), (20_001, "12 34 ... 56", "en", "src1", 0)]
    out = {r.doc_id: r for r in C.language(spark, docs.unionByName(spark.createDataFrame(junk, docs.schema)), "").collect()}
    assert not {20_000, 20_001} & out.keys()
    assert sum(j[0] in out for j in junk[:12]) <= 2  # thirds of three languages
    assert len(out.keys() & rows.keys()) >= 0.99 * len(rows)
    assert sum(out[i].lang == rows[i].lang for i in out.keys() & rows.keys()) >= 0.98 * len(rows)
    assert all((r.text, r.source, r.n_chars) == (rows[i].text, rows[i].source, rows[i].n_chars) for i, r in out.items() if i in rows)


def test_mixing_cuts_at_the_budget(spark):
    rows = [(i, f"  a{i} b\tc\n" * (i % 9 + 1), "en", f"src{i % 2}", 1) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    out = C.mixed(spark, docs, "").collect()
    taken = {r.doc_id: r.take_tokens for r in budget_mix.mix(docs, share=C.SHARE, epochs=C.EPOCHS).collect()}
    whole = {r[0]: r[1] for r in rows}
    assert {r.doc_id: len(r.text.split()) for r in out} == {k: v for k, v in taken.items() if v}
    cut = [r for r in out if r.text != whole[r.doc_id]]
    assert 1 <= len(cut) <= 2 and all(whole[r.doc_id].startswith(r.text) and r.n_chars == len(r.text) for r in cut)


def test_stages_begin_with_little_heap(spark, sf_dir):
    """What earlier work left on the heap is returned before a stage begins."""
    heap = spark._jvm.java.lang.Runtime.getRuntime()
    held = spark.range(40_000_000).selectExpr("collect_list(id % 100000) AS x").selectExpr("size(x)")
    assert held.first()[0] == 40_000_000
    before, seen = heap.totalMemory(), []
    C._lean(lambda *_: seen.append(heap.totalMemory()))(spark, None, sf_dir)
    assert seen[0] < before / 2
    assert all(stage.__wrapped__ for _, stage in C.STAGES)

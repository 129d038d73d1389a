import hashlib
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from cauza.llm import exact_dedup as X

ROWS = [(5, "a b\n c"), (3, "abc"), (4, "  a b c  "), (1, None), (2, " \t\n"), (9, ""), (7, "é x" * 5000), (8, "éx" * 5000), (10, "A bc"), (3, "abc"), (None, "q"), (11, "q")]


def brute(rows):
    groups = defaultdict(list)
    norm = lambda t: re.sub(r"[\x20\x09-\x0d]", "", t or "")
    for i, t in rows:
        groups[norm(t)].append((i, t or ""))
    out = []
    for text, members in groups.items():
        keep = min(members, key=lambda m: (-len(m[1]), m[0] is None, m[0] or 0))[0]
        out += [(i, keep, len(members), i == keep, hashlib.sha256(text.encode()).hexdigest()) for i, _ in members]
    return sorted(map(str, out))


def rows_of(df):
    return sorted(str(tuple(r)) for r in df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect())


def frame(spark, rows):
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    return df.withColumn("digest", F.lit(1)).withColumn("keep_id", F.lit("x")).withColumn("id", F.lit(None).cast("int"))


def test_cases(spark):
    assert rows_of(X.exact_dedup(frame(spark, ROWS))) == brute(ROWS)


def test_collisions_are_told_apart_by_bytes(spark):
    weak = lambda c: F.substring(F.sha2(c, 256), 1, 1)
    rows = [(i, f"text {i % 40}" + " " * (i % 3)) for i in range(200)] + ROWS[:9]
    assert rows_of(X.exact_dedup(frame(spark, rows), digest=weak)) == brute(rows)


def test_empty(spark):
    assert X.exact_dedup(frame(spark, ROWS).limit(0)).collect() == []


def test_state_outlives_a_run(spark, tmp_path):
    def add(rows):
        spark.createDataFrame(rows, X.KEYED).write.mode("append").parquet(f"{tmp_path}/in")
        X.run_available(spark, f"{tmp_path}/in", f"{tmp_path}/state", 1)

    add([("d1", 5, 3, "f"), ("d2", 6, 3, "f")])
    add([("d1", 2, 3, "g"), ("d3", 7, 1, "g")])
    add([("d2", 9, 4, "h")])
    got = {tuple(r) for r in X.read_state(spark, f"{tmp_path}/state").collect()}
    assert got == {("d1", 2, "g", 2), ("d2", 9, "h", 2), ("d3", 7, "g", 1)}


def test_long_texts_and_arrivals(spark):
    rows = [(i, f"{'ab c' * 40_000}{i % 3}") for i in range(7)] + [(20, "ab c" * 40_000 + " 0  "), (21, None), (21, None)]
    for arrivals in (1, 2, 5):
        assert rows_of(X.exact_dedup(frame(spark, rows), arrivals=arrivals)) == brute(rows)


def test_arrivals_meet_in_one_state(spark, tmp_path, monkeypatch):
    made = []
    run = X.run_available
    monkeypatch.setattr(X, "run_available", lambda s, folder, checkpoint, *a: (run(s, folder, checkpoint, *a), made.append((checkpoint, {r.digest: r.group_size for r in X.read_state(s, checkpoint).collect()}))))
    rows = [(i, f"t {i % 4}") for i in range(60)]
    assert rows_of(X.exact_dedup(frame(spark, rows))) == brute(rows)
    assert len(made) == 2 and made[0][0] == made[1][0]
    before, after = made[0][1], made[1][1]
    assert sum(before.values()) < 60 == sum(after.values())
    assert any(before[d] < after[d] for d in before)  # rows of the second arrival were hits on state of the first


def test_locators_lead_to_contents(spark, tmp_path):
    rows = [(i, f"text {i}\n") for i in range(300)] + [(7, "text 7\n")]
    spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3).write.parquet(f"{tmp_path}/d")
    for docs in (spark.read.parquet(f"{tmp_path}/d"), spark.read.parquet(f"{tmp_path}/d").withColumn("_metadata", F.lit(1)), spark.createDataFrame(rows, "doc_id bigint, text string")):
        source = X.located(docs, "doc_id", "text")
        assert source.select("locator").distinct().count() == 301
        some = source.filter("id % 50 = 7").select("locator", "id")
        assert sorted((r.id, r.content) for r in X.contents(source, some).collect()) == sorted((i, f"text{i}") for i, _ in rows if i % 50 == 7)


def test_a_later_call_meets_the_state_and_checks_its_bytes(spark, tmp_path):
    weak = lambda c: F.substring(F.sha2(c, 256), 1, 1)
    first, second = [(i, f"text {i % 9}") for i in range(30)], [(100 + i, f"te xt {i % 12}") for i in range(40)] + [(200, "text 3" + " " * 9)]
    schema = "doc_id bigint, text string"
    for k, (digest, files) in enumerate([(X.sha256, False), (X.sha256, True), (weak, True)]):
        held = f"{tmp_path}/state{k}"
        frames = [spark.createDataFrame(r, schema) for r in (first, second)]
        if files:
            for i, df in enumerate(frames):
                df.write.parquet(f"{tmp_path}/in {k}/{i}")
            frames = [spark.read.parquet(f"{tmp_path}/in {k}/{i}") for i in range(2)]
        assert rows_of(X.exact_dedup(frames[0], digest=digest, checkpoint=held)) == brute(first)
        got = rows_of(X.exact_dedup(frames[1], digest=digest, checkpoint=held))
        if digest is X.sha256:
            ids = {i for i, _ in second}
            assert got == [r for r in brute(first + second) if eval(r)[0] in ids]
        else:  # equal digests of unlike texts are told apart
            assert len({eval(r)[4] for r in got}) == 12 and all(len({eval(r)[4] for r in got if eval(r)[1] == keep}) == 1 for keep in {eval(r)[1] for r in got})


def test_the_retained_locator_is_what_leads_to_the_bytes(spark, tmp_path, monkeypatch):
    rows = [(i, f"t {i % 4}") for i in range(20)]
    read = X.read_state
    monkeypatch.setattr(X, "read_state", lambda *a: read(*a).withColumn("locator", F.lit("nowhere#0")))
    with pytest.raises(RuntimeError):
        X.exact_dedup(spark.createDataFrame(rows, "doc_id bigint, text string"))


def test_filter_rules_out_only_what_is_not_there(spark):
    from cauza.llm.common import leave, split_by_filter

    docs = spark.range(5000).select(F.when(F.col("id") != 4999, F.col("id")).alias("id"), F.lit("x").alias("__bits"))
    some = spark.range(0, 9000, 7).union(spark.range(1).select(F.lit(None).cast("long"))).toDF("id")
    safe, asked = split_by_filter(docs, {"id": F.col("id")}, some)
    assert {r.id for r in safe.collect()} & {r.id for r in some.collect()} == set()
    assert safe.count() + asked.count() == 5000 and asked.count() < 900
    assert sorted(r.id for r in leave(docs, some, {"id": F.col("id")}).collect()) == [i for i in range(4999) if i % 7]
    assert leave(docs, some.limit(0), {"id": F.col("id")}).count() == 5000


def test_state_stores_are_closed(spark, sf_dir):
    before = _open_stores(spark)
    assert X.exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet")).count() > 0
    assert _open_stores(spark) <= before


def _open_stores(spark):
    kind = spark._jvm.java.lang.Class.forName("org.apache.spark.sql.execution.streaming.state.StateStore$")
    fields = [f for f in kind.getDeclaredFields() if f.getName().endswith("loadedProviders")]
    fields[0].setAccessible(True)
    return fields[0].get(kind.getField("MODULE$").get(None)).size()

from collections import defaultdict

import duckdb
import pytest

from cauza.llm import budget_mix as B

SCHEMA = "doc_id bigint, text string, lang string, source string, budget int, domain string"


def rows(n=400):
    out = [(i, "w " * (i * 7 % 50), ["en", "de", "fr", None][i % 4] if i % 3 else "en", f"src{i % 7}" if i % 5 else "src0", 1, "z") for i in range(n)]
    return out + [(900, None, "es", "src1", 1, "z"), (901, "", None, None, 1, "z"), (902, "x " * 100_000, "en", "big", 1, "z"), (3, "w w", "en", "src1", 1, "z"), (3, "w w", "en", "src1", 1, "z")]


def test_matches_sql(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    out = B.mix(df)
    documents = df.toPandas()  # noqa: F841
    want = duckdb.connect().execute(f"SELECT {', '.join(out.columns)} FROM ({B.SQL})").fetchall()
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, want))


@pytest.mark.parametrize("share", [0, 10, 60, 150, 500])
def test_budgets_are_met(spark, share):
    supply = spark.createDataFrame([("d0", "en", "a", 100), ("d0", "en", "b", 10), ("d0", "de", "a", 50), ("d1", "en", "c", 5), ("d1", "fr", "c", 300)], "domain string, lang string, source string, supply bigint")
    got = {(r.domain, r.lang, r.source): (r.budget, r.supply) for r in B.budgets(supply, {"domain": {"d0": 1, "d1": 3}}, share, 2).collect()}
    total = sum(s for _, s in got.values())
    assert all(0 <= b <= 2 * s for b, s in got.values())
    given = min(total * share // 100, 2 * total)
    assert given - len(got) * 2 <= sum(b for b, _ in got.values()) <= given


def test_shortage_goes_to_siblings_first(spark):
    supply = spark.createDataFrame([("d0", "en", "a", 10), ("d0", "en", "b", 1000), ("d1", "en", "c", 1000)], "domain string, lang string, source string, supply bigint")
    got = {r.source: r.budget for r in B.budgets(supply, {}, 50, 1).collect()}
    assert got == {"a": 10, "b": 492, "c": 502}


def test_weights_of_zero_take_nothing(spark):
    supply = spark.createDataFrame([("d0", "en", "a", 100), ("d0", "de", "a", 900), ("d1", "en", "c", 100), ("d2", "en", "c", 100)], "domain string, lang string, source string, supply bigint")
    for weights in ({"domain": {"d1": 0}, "lang": {"de": 0}}, {"domain": {"d1": -3}, "lang": {"de": -1}}):
        got = {(r.domain, r.lang): r.budget for r in B.budgets(supply, weights, 15, 1).collect()}
        # d0 cannot hand the tokens of de down: what they would have taken goes to d2
        assert got == {("d0", "en"): 90, ("d0", "de"): 0, ("d1", "en"): 0, ("d2", "en"): 90}
    got = {(r.domain, r.lang): r.budget for r in B.budgets(supply, {"domain": {"d0": 9, "d1": 0}, "lang": {"de": 0}}, 15, 1).collect()}
    assert got == {("d0", "en"): 100, ("d0", "de"): 0, ("d1", "en"): 0, ("d2", "en"): 80}


def test_documents_without_tokens_below_a_weight_of_zero(spark):
    data = [(1, None, "en", "src0", 1, "z"), (2, "", "en", "src1", 1, "z"), (3, "a b", "de", "src1", 1, "z"), (4, "", "fr", "src2", 1, "z")]
    df = spark.createDataFrame(data, SCHEMA)
    assert {r.doc_id for r in B.mix(df, {"domain": {"d1": 0}, "lang": {}}, share=100).collect()} == {1, 4}
    assert {r.doc_id for r in B.mix(df, {"domain": {}, "lang": {"fr": 0}}, share=100).collect()} == {1, 2, 3}


def test_epochs_and_prefixes(spark):
    out = B.mix(spark.createDataFrame(rows(), SCHEMA), share=150, epochs=3).collect()
    taken = defaultdict(int)
    for r in out:
        taken[r.domain, r.lang, r.source, r.epoch] += r.take_tokens
        assert 0 <= r.take_tokens <= r.tokens
    full = {k[:3]: v for k, v in taken.items() if k[3] == 1}
    assert all(v <= full[k[:3]] for k, v in taken.items())
    assert B.mix(spark.createDataFrame([], SCHEMA)).collect() == []

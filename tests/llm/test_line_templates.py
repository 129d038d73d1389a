import hashlib

import duckdb
from pyspark.sql import functions as F

from cauza.llm import line_templates as T

ROWS = [
    (1, "Share this page\nuser 17 logged in from 10.0.0.1 at noon\nbody one\n\n  \nunique words here"),
    (2, "Share  this\tpage\nuser 99 logged in from 10.0.0.2 at noon\nbody two"),
    (3, " Share this page \nuser 5 logged in from 10.3.0.1 at night\nbody three"),
    (4, "user 7 logged in from home at noon\nbody four\nShare this page"),
    (5, None), (6, ""), (7, "\n\n"), (8, "é " * 30_000 + "\nShare this page"), (9, "Share this page"), (9, "Share this page"), (10, "a b\na b\na b"), (11, "x\ta1 b\rc"),
]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "z") for r in rows], "doc_id bigint, text string, pos int, line string")


def got(df):
    return sorted(str((r.doc_id, r.n_lines, r.n_dropped, hashlib.sha256(r.kept_text.encode()).hexdigest())) for r in df.collect())


def sql(df):
    c = duckdb.connect()
    documents = df.toPandas()  # noqa: F841
    return sorted(map(str, c.execute(f"SELECT doc_id, n_lines, n_dropped, kept_sha256 FROM ({T.SQL})").fetchall()))


def test_matches_sql(spark):
    df = frame(spark, ROWS)
    assert got(T.line_dedup(df)) == sql(df)


def test_templates_are_dropped_after_the_first(spark):
    out = {r.doc_id: r for r in T.line_dedup(frame(spark, ROWS)).collect()}
    assert out[1].n_dropped == 0 and "Share this page" in out[1].kept_text
    assert out[2].kept_text == "body two" and out[2].n_dropped == 2
    assert out[5].kept_text == out[6].kept_text == "" and out[7].kept_text == "\n\n"
    assert out[10].n_dropped == 0  # one document only


def test_several_families_in_one_leaf(spark):
    """Three families of eight tokens with the same leading tokens, in many modules and by many people."""
    families = ("error in module {} was fixed by {}", "error in module {} could not find {}", "error in module {} has been closed {}")
    rows = [(i, "\n".join(f.format(f"m{chr(97 + i % 26)}q", f"p{chr(97 + (i * 7 + k) % 26)}{chr(97 + i // 26)}") for k, f in enumerate(families)) + f"\nthis is {'a b c d e f'.split()[i % 6]} {chr(97 + i % 26) * 3} {chr(97 + i // 26) * 4} own words") for i in range(60)]
    df = frame(spark, rows)
    assert got(T.line_dedup(df)) == sql(df)
    out = {r.doc_id: r for r in T.line_dedup(df).collect()}
    assert out[0].n_dropped == 0 and all(out[i].n_dropped >= 3 for i in range(1, 60))
    members = spark.createDataFrame([(b"l", str(i).encode(), t.split()) for i, (_, text) in enumerate(rows) for t in text.split("\n")[:3]], "leaf binary, line binary, tokens array<string>")
    members = members.select("leaf", F.md5(F.array_join("tokens", " ").cast("binary")).cast("binary").alias("line"), "tokens").distinct()
    found = T.templates(members).join(members, "line").collect()
    names = {bytes(r.template): set() for r in found}
    for r in found:
        names[bytes(r.template)].add(tuple(r.tokens[4:6]))
    assert sorted(map(sorted, names.values())) == [[("could", "not")], [("has", "been")], [("was", "fixed")]]  # one template for each family


def test_leading_tokens_alone_are_no_template(spark):
    """Short lines that share only their leading tokens stay lines of their own."""
    rows = [(i, f"this is a {chr(97 + i % 26) * 3} {chr(97 + i // 26) * 3} {chr(98 + i % 20)}{i // 20 * 'z'}q") for i in range(50)]
    df = frame(spark, rows)
    assert got(T.line_dedup(df)) == sql(df)
    assert all(r.n_dropped == 0 for r in T.line_dedup(df).collect())


def test_small_leaves_meet_in_one_exchange(spark):
    """All levels of the tree stay inside the tasks that hold the leaves, and agree with the tree that is dealt out by token."""
    families = ("was fixed by", "could not find", "has been closed")
    texts = {f"p q r {f} {chr(97 + i % 26)}x {chr(97 + i // 3)}y" for f in families for i in range(60)} | {f"s t u v{chr(97 + i)} w w" for i in range(9)} | {f"s t u {chr(97 + i)} {i} {i}" for i in range(30)}
    lines = spark.createDataFrame([(t[:5].encode(), t) for t in sorted(texts)], "leaf binary, text string")
    within = T.templates_within(lines.groupBy("leaf").agg(F.collect_set("text").alias("texts")))
    plan = within._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("Exchange hashpartitioning") == 1
    members = lines.select("leaf", F.unhex(F.md5(F.col("text").cast("binary"))).alias("line"), F.split("text", " ").alias("tokens"))
    rows = lambda df: sorted((bytes(r.line), bytes(r.template)) for r in df.collect())
    found = rows(within)
    assert found == rows(T.templates(members)) and len({t for _, t in found}) > 3


def test_large_leaves_are_dealt_out(spark):
    df = frame(spark, ROWS)
    drops = lambda small: sorted((r.id, r.pos) for r in T.dropped_lines(df, small=small).collect())
    assert drops(T.SMALL) == drops(0) == drops(120) != []


def test_empty(spark):
    assert T.line_dedup(frame(spark, ROWS).limit(0)).collect() == []


def test_plan_has_no_python(spark):
    plan = T.line_dedup(frame(spark, ROWS))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan

import random

from cauza.llm import components as C


def plain(edges):
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {x: root(x) for x in up}


def test_one_task_and_rounds_of_many_agree(spark):
    rnd = random.Random(1)
    edges = [(rnd.randrange(900), rnd.randrange(900)) for _ in range(500)] + [(5000, 5000 + i) for i in range(1, 700)] + [(i, i + 1) for i in range(7000, 7300)] + [(-3, 4)]
    want = {k: v for k, v in plain(edges).items() if any(a != b and k in (a, b) for a, b in edges)}
    df = spark.createDataFrame(edges, "a bigint, b bigint").repartition(6)
    for together, remembered in ((10**6, 10**6), (100, 10**6), (100, 50), (10**6, 50)):
        assert {r.node: r.root for r in C.components(df, together, remembered).collect()} == want
    assert C.components(df.limit(0)).collect() == []


def test_tasks_remember_a_bounded_number_of_nodes(spark):
    edges = spark.range(0, 4000, 1, 1).selectExpr("id + 1 AS a", "id AS b")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        rows = C.stars(edges, 300).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len({r.b for r in rows}) > 5 and len(rows) == 4000

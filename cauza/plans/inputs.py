"""Queries of sources and sinks, the runtime, streams, and of the numerics under discovery."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions.columns import merit_ratio, sigmoid
from ..operators.learners import TLearner
from ..operators.notears import CausalRegressionDiscovery, expm, projected_lbfgs
from ..session import table
from ..sources.causal_source import read_causal
from ..sources.frames import CausalFrame, batches, intake, key_values, make, read_csv, recode
from ..sources.shared import new_path
from ..streaming.scoring import score_stream
from .effects import EVT, evt
from .learning import T_SQL, _panel
from .networks import _sig, Steps, model
from .runtime import launch
from .trees import PANEL, panel_frame

ARMS = {"AUTOMOBILE": 1, "BUILDING": 1, "FURNITURE": 0}


def kv_parse(spark, sf_dir):
    """The number in each event's properties and one that is never there, out of key-value text."""
    text = F.regexp_replace("props", r'[{}" ]', "")
    dense = key_values(text, ["k", "missing"], -1.0)
    return table(spark, sf_dir, "events").select("event_id", F.get(dense, F.lit(0)).alias("k"), F.get(dense, F.lit(1)).alias("missing"))


KV_SQL = "SELECT event_id, coalesce(try_cast(regexp_extract(props, '\"k\" *: *([0-9.eE+-]+)', 1) AS DOUBLE), -1) AS k, -1.0::DOUBLE AS missing FROM events"


def csv_recode(spark, sf_dir):
    """Customers written as CSV, read with roles, segments recoded to arms; segments without a code have no arm."""
    path = new_path(spark, "customers")
    table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal", "c_nationkey").write.csv(path, header=True)
    df = read_csv(spark, path, {"treatment": ["c_mktsegment"], "features": ["c_acctbal", "c_nationkey"]}, ARMS)
    return df.groupBy(F.col("c_mktsegment").alias("arm")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"), F.max("c_nationkey").alias("nation"))


CSV_SQL = f"SELECT CASE c_mktsegment {' '.join(f"WHEN '{k}' THEN {v}" for k, v in ARMS.items())} END AS arm, count(*) AS n, round(sum(c_acctbal), 2) AS balance, max(c_nationkey) AS nation FROM customer GROUP BY 1"


def segment_codes(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", recode(F.col("c_mktsegment"), ARMS).alias("arm"))


def intake_shapes(spark, sf_dir):
    """The same samples as a frame, a function, a dictionary, a pair and an array."""
    own = lambda s: table(s, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    rows = [list(r) for r in own(spark).collect()]  # 25 nations
    sources = {"frame": own(spark), "function": own, "dictionary": {"node_names": ["a", "b"], "data": own(spark)}, "pair": (["a", "b"], rows), "array": np.array(rows)}
    out = None
    for name, source in sources.items():
        df = intake(spark, source)
        one = df.toDF("a", "b").agg(F.sum("a").cast("long").alias("a"), F.sum("b").cast("long").alias("b"), F.count(F.lit(1)).alias("n")).withColumns({"source": F.lit(name), "columns": F.lit(",".join(df.columns))})
        out = one if out is None else out.unionByName(one)
    return out


INTAKE_SQL = "SELECT s.source, s.columns, sum(n_nationkey)::BIGINT AS a, sum(n_regionkey)::BIGINT AS b, count(*) AS n FROM nation, (VALUES ('frame', 'n_nationkey,n_regionkey'), ('function', 'n_nationkey,n_regionkey'), ('dictionary', 'a,b'), ('pair', 'a,b'), ('array', 'x0,x1')) s(source, columns) GROUP BY ALL"


def batch_union(spark, sf_dir):
    """Batches of events as one frame."""
    e = table(spark, sf_dir, "events").select("event_type", "value")
    parts = [e.filter(F.col("event_type") == t) for t in sorted(r[0] for r in e.select("event_type").distinct().collect())]  # the kinds of events
    return batches(parts).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("value"))


def frame_subset(spark, sf_dir):
    """A checked frame with roles, cut to rows and to one of its features."""
    frame = CausalFrame(panel_frame(spark, sf_dir), ["c_acctbal", "c_nationkey"], n_period=7, treat_dt=6).check()
    part = frame.subset(F.col("c_nationkey") < 10, ["c_nationkey"]).check()
    return part.df.groupBy("w").agg(F.count(F.lit(1)).alias("n"), F.sum("c_nationkey").alias("nations"), F.sum(F.get("y", F.lit(part.treat_dt))).alias("y")).withColumn("features", F.lit(",".join(part.features)))


def source_frame(spark, sf_dir):
    """The panel with a column for each year, read again by the roles of its columns; both filters go to the files."""
    path, years = new_path(spark, "panel"), [f"y{k}" for k in range(7)]
    panel_frame(spark, sf_dir).select("id", "w", "c_acctbal", "c_nationkey", *(F.get("y", F.lit(k)).alias(n) for k, n in enumerate(years))).write.parquet(path)
    frame = read_causal(spark, path, ["c_acctbal", "c_nationkey"], years, treat_dt=6)
    rows = frame.df.filter((F.col(frame.treatment) == 1) & (F.col("c_nationkey") < 10))
    return rows.groupBy(F.col("c_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"), F.sum(F.get(frame.outcomes, F.lit(0))).alias("first"), F.sum(F.get(frame.outcomes, F.lit(frame.treat_dt))).alias("last"))


SOURCE_SQL = f"WITH {PANEL} SELECT c_nationkey::DOUBLE AS nation, count(*) AS n, round(sum(c_acctbal), 2) AS balance, sum(y[1])::DOUBLE AS first, sum(y[7])::DOUBLE AS last FROM panel WHERE w = 1 AND c_nationkey < 10 GROUP BY 1"


def loss_by_name(spark, sf_dir):
    """A loss that a configuration names, at a prediction of one half."""
    loss, y, half = make("cauza.operators.losses.Logistic"), (F.get("y", F.lit(6)) > 0).cast("double"), F.lit(0.5)
    return panel_frame(spark, sf_dir).groupBy("w").agg(*(F.round(F.sum(f(y, half)), 6).alias(n) for n, f in (("loss", loss.loss), ("grad", loss.grad), ("hess", loss.hess))))


def launched(spark, sf_dir):
    """Counts of the regions' nations by concurrent jobs, in the order of their numbers."""
    found = launch(lambda i, num, param, data: (i, num, data.filter(F.col(param) == i).count()), 5, "n_regionkey", table(spark, sf_dir, "nation"))
    return spark.createDataFrame([(k, i, num, n) for k, (i, num, n) in enumerate(found)], "place int, id int, num int, n bigint")


def learner_output(spark, sf_dir):
    """A learner's result as it is written and read again."""
    df, path = _panel(spark, sf_dir), new_path(spark, "effects")
    own = TLearner(["x1", "x2"]).fit(df)
    own.estimate(df)
    own.output(path)
    return spark.read.parquet(path).groupBy("w").agg(F.round(F.avg("effect_1"), 6).alias("effect"), F.count(F.lit(1)).alias("n"))


OUTPUT_SQL = f"SELECT w, round(avg(effect), 6) AS effect, count(*) AS n FROM ({T_SQL.replace('round(', '(').replace(', 6) AS effect', ') AS effect').replace('SELECT id,', 'SELECT w, id,')}) GROUP BY w"


def stream_scores(spark, sf_dir):
    """Events as a stream through a network: the same scores as in a table."""
    source, out, state = (new_path(spark, f"stream-{n}") for n in ("in", "out", "state"))
    evt(spark, sf_dir).select("event_id", "f1", "f2").write.parquet(source)
    stream = spark.readStream.schema("event_id bigint, f1 double, f2 double").parquet(source)
    score_stream(model("ipw"), stream, out, state, "event_id").awaitTermination()
    return spark.read.parquet(out).select("event_id", F.round("score", 7).alias("score"))


def _stream_sql() -> str:
    s = Steps(model("ipw").params)
    (z,) = s.dense("dnn", ["f1", "f2"], 3)
    return f"WITH {', '.join(s.ctes)} SELECT event_id, round({_sig(z)}, 7) AS score FROM {s.last}"


def merit_guard(spark, sf_dir):
    """Merit over exposure of each group; a group that was never exposed has 1."""
    e = evt(spark, sf_dir).withColumn("shown", F.when(F.col("G") == 3, 0.0).otherwise(F.col("W")))
    by = e.groupBy("G").agg(F.avg(sigmoid(F.col("z")) * (F.col("shown") > 0).cast("double")).alias("merit"), F.avg("shown").alias("exposure"))
    return by.select("G", F.round(merit_ratio(F.col("merit"), F.col("exposure")), 9).alias("ratio"))


def acyclicity(spark, sf_dir):
    """tr(e^A) - d of a matrix with one cycle of two nodes, with weights from the table, and of one without."""
    r = table(spark, sf_dir, "lineitem").agg((F.avg("l_discount") * 20).alias("a"), (F.avg("l_tax") * 20).alias("b")).first()
    cycle, free = np.array([[0, r.a, 0.3], [r.b, 0, 0], [0, 0, 0]]), np.array([[0, r.a, 0.3], [0, 0, r.b], [0, 0, 0]])
    return spark.createDataFrame([(n, round(float(np.trace(expm(m))) - 3, 9)) for n, m in (("cycle", cycle), ("free", free))], "graph string, h double")


def box_minimum(spark, sf_dir):
    """The least of a quadratic around the means of two columns, inside a box."""
    r = table(spark, sf_dir, "lineitem").agg(F.avg("l_discount").alias("a"), F.avg("l_quantity").alias("b")).first()
    at, steep = np.array([r.a, r.b]), np.array([40.0, 1.0])
    x = projected_lbfgs(lambda v: (float((steep * (v - at) ** 2).sum()) / 2, steep * (v - at)), np.array([0.9, 0.0]), np.array([0.2, 0.0]), np.array([1.0, 100.0]))
    return spark.createDataFrame([(round(float(x[0]), 2), round(float(x[1]), 2))], "x double, y double")


_FLAT = np.round(np.random.default_rng(3).normal(0, 0.5, 2 * 8 + 2 * 4 + 2), 3)


def notears_loss(spark, sf_dir):
    """Half the squared error of the discovery network under fixed weights, and its gradient by the output offsets."""
    own = CausalRegressionDiscovery(hidden=2)
    rows = panel_frame(spark, sf_dir).select((F.col("c_acctbal") / 3000).alias("a"), (F.col("c_nationkey") / 8).alias("b"), (F.col("id") % 16).alias("part"))

    def partial(pdf):
        import pandas as pd

        loss, g = own.partial(_FLAT, pdf[["a", "b"]].to_numpy(float))
        return pd.DataFrame({"part": [int(pdf["part"].iloc[0])], "loss": [loss], "g0": [g[-2]], "g1": [g[-1]]})

    return rows.groupBy("part").applyInPandas(partial, "part bigint, loss double, g0 double, g1 double").select("part", *(F.round(c, 6).alias(c) for c in ("loss", "g0", "g1")))


def _notears_sql() -> str:
    d = m = 2
    n = d * m * d
    pos, neg = (_FLAT[k * n : (k + 1) * n].reshape(d, m, d) for k in (0, 1))
    b1, w2, b2 = _FLAT[2 * n : 2 * n + 4].reshape(d, m), _FLAT[2 * n + 4 : 2 * n + 8].reshape(d, m), _FLAT[2 * n + 8 :]
    errors = []
    for j, x in enumerate("ab"):
        hidden = [f"({float(w2[j, k])!r}) / (1 + exp(-(({float(pos[j, k, 0] - neg[j, k, 0])!r}) * a + ({float(pos[j, k, 1] - neg[j, k, 1])!r}) * b + ({float(b1[j, k])!r}))))" for k in range(m)]
        errors.append(f"{' + '.join(hidden)} + ({float(b2[j])!r}) - {x} AS e{j}")
    return f"WITH {PANEL.split(chr(44) + chr(10) + 'binned')[0]}, r AS (SELECT c_acctbal / 3000 AS a, c_nationkey / 8 AS b, id % 16 AS part FROM panel), e AS (SELECT part, {', '.join(errors)} FROM r) SELECT part, round(sum(e0 * e0 + e1 * e1) / 2, 6) AS loss, round(sum(e0), 6) AS g0, round(sum(e1), 6) AS g1 FROM e GROUP BY part"


DEEP = CausalRegressionDiscovery(hidden=[4, 3])
_DEEP_FLAT = np.round(np.random.default_rng(5).normal(0, 0.6, sum(int(np.prod(s)) for s in DEEP.shapes(2))), 3)


def notears_deep(spark, sf_dir):
    """Half the squared error of a network with two hidden layers under fixed weights, and its derivative by each of them."""
    rows = panel_frame(spark, sf_dir).select((F.col("c_acctbal") / 3000).alias("a"), (F.col("c_nationkey") / 8).alias("b"))
    return DEEP.squared(rows, _DEEP_FLAT).select("i", F.round("g", 5).alias("g"))


def _deep_sql() -> str:
    pos, neg, b1, w2, b2, w3, b3 = (p.tolist() for p in DEEP._unpack(_DEEP_FLAT, 2))
    m, o = DEEP.widths
    sig = lambda terms: f"1 / (1 + exp(-({' + '.join(terms)})))"
    h1 = [f"{sig([f'({pos[j][k][0] - neg[j][k][0]!r}) * a', f'({pos[j][k][1] - neg[j][k][1]!r}) * b', f'({b1[j][k]!r})'])} AS h{j}{k}" for j in range(2) for k in range(m)]
    h2 = [f"{sig([*(f'({w2[j][k][q]!r}) * h{j}{k}' for k in range(m)), f'({b2[j][q]!r})'])} AS g{j}{q}" for j in range(2) for q in range(o)]
    error = [f"{' + '.join(f'({w3[j][q][0]!r}) * g{j}{q}' for q in range(o))} + ({b3[j][0]!r}) - {x} AS e{j}" for j, x in enumerate("ab")]
    second = [f"e{j} * ({w3[j][q][0]!r}) * g{j}{q} * (1 - g{j}{q}) AS s{j}{q}" for j in range(2) for q in range(o)]
    first = [f"({' + '.join(f's{j}{q} * ({w2[j][k][q]!r})' for q in range(o))}) * h{j}{k} * (1 - h{j}{k}) AS f{j}{k}" for j in range(2) for k in range(m)]
    by = [f"f{j}{k} * {x}" for j in range(2) for k in range(m) for x in "ab"]
    terms = ["(e0 * e0 + e1 * e1) / 2", *by, *(f"-({t})" for t in by), *(f"f{j}{k}" for j in range(2) for k in range(m)), *(f"s{j}{q} * h{j}{k}" for j in range(2) for k in range(m) for q in range(o)), *(f"s{j}{q}" for j in range(2) for q in range(o)), *(f"e{j} * g{j}{q}" for j in range(2) for q in range(o)), "e0", "e1"]
    return f"WITH {PANEL.split(chr(44) + chr(10) + 'binned')[0]}, r AS (SELECT c_acctbal / 3000 AS a, c_nationkey / 8 AS b FROM panel), h AS (SELECT *, {', '.join(h1)} FROM r), g AS (SELECT *, {', '.join(h2)} FROM h), e AS (SELECT *, {', '.join(error)} FROM g), s AS (SELECT *, {', '.join(second)} FROM e), f AS (SELECT *, {', '.join(first)} FROM s), t AS (SELECT [{', '.join(f'sum({t})' for t in terms)}] AS v FROM f) SELECT (i - 2)::INT AS i, round(v[i], 5) AS g FROM t, range(1, {len(terms) + 1}) p(i)"


QUERIES = {
    "kv_parse": (kv_parse, KV_SQL), "csv_recode": (csv_recode, CSV_SQL), "segment_codes": (segment_codes, f"SELECT c_custkey, CASE c_mktsegment {' '.join(f"WHEN '{k}' THEN {v}" for k, v in ARMS.items())} END AS arm FROM customer"),
    "intake_shapes": (intake_shapes, INTAKE_SQL), "batch_union": (batch_union, "SELECT event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY event_type"),
    "frame_subset": (frame_subset, f"WITH {PANEL} SELECT w, count(*) AS n, sum(c_nationkey)::BIGINT AS nations, sum(y[7]) AS y, 'c_nationkey' AS features FROM panel WHERE c_nationkey < 10 GROUP BY w"),
    "source_frame": (source_frame, SOURCE_SQL),
    "loss_by_name": (loss_by_name, f"WITH {PANEL}, z AS (SELECT w, (y[7] > 0)::INT AS z FROM panel) SELECT w, round(sum(0.5 - 0.5 * z + ln(1 + exp(-0.5))), 6) AS loss, round(sum(1 / (1 + exp(-0.5)) - z), 6) AS grad, round(sum(1 / (1 + exp(-0.5)) * (1 - 1 / (1 + exp(-0.5)))), 6) AS hess FROM z GROUP BY w"),
    "launched": (launched, "SELECT n_regionkey::INT AS place, n_regionkey::INT AS id, 5 AS num, count(*) AS n FROM nation GROUP BY n_regionkey"), "learner_output": (learner_output, OUTPUT_SQL), "stream_scores": (stream_scores, _stream_sql()),
    "merit_guard": (merit_guard, f"WITH {EVT} SELECT g AS \"G\", round(CASE WHEN g = 3 THEN 1 ELSE avg(1 / (1 + exp(-z))) / avg(w) END, 9) AS ratio FROM evt GROUP BY g"),
    "acyclicity": (acyclicity, "WITH r AS (SELECT avg(l_discount) * 20 AS a, avg(l_tax) * 20 AS b FROM lineitem) SELECT 'cycle' AS graph, round(exp(sqrt(a * b)) + exp(-sqrt(a * b)) - 2, 9) AS h FROM r UNION ALL SELECT 'free', 0.0"),
    "box_minimum": (box_minimum, "SELECT round(greatest(avg(l_discount), 0.2), 2) AS x, round(avg(l_quantity), 2) AS y FROM lineitem"), "notears_loss": (notears_loss, _notears_sql()), "notears_deep": (notears_deep, _deep_sql()),
}

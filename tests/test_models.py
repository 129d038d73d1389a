import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cauza.operators import learners as L
from cauza.operators.debias import MODELS
from cauza.operators.notears import CausalRegressionDiscovery, expm, projected_lbfgs
from cauza.plans.runtime import launch
from cauza.sources.frames import intake, read_csv


def linear(n=3000, seed=0, arms=2):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, 2))
    w = (r.random(n) < 1 / (1 + np.exp(-x[:, 0]))).astype(int) if arms == 2 else r.integers(0, arms, n)
    y = x[:, 0] * 2 + w * (1.5 + x[:, 1]) + r.normal(scale=0.2, size=n)
    return pd.DataFrame({"id": range(n), "a": x[:, 0], "b": x[:, 1], "w": w, "y": y})


@pytest.mark.parametrize("cls", [L.TLearner, L.XLearner, L.DRLearner, L.DML, L.SLearner])
def test_learners_recover_the_effect(spark, cls):
    df = spark.createDataFrame(linear())
    model = cls(["a", "b"]).fit(df)
    got = model.estimate(df).agg(F.avg("effect_1"), F.corr("effect_1", F.col("b"))).first()
    assert abs(got[0] - 1.5) < 0.15
    if cls is not L.SLearner:
        assert got[1] > 0.95


def test_more_arms_and_checks(spark, tmp_path):
    df = spark.createDataFrame(linear(arms=3))
    model = L.TLearner(["a", "b"]).fit(df)
    got = model.estimate(df).agg(F.avg("effect_1"), F.avg("effect_2")).first()
    assert abs(got[0] - 1.5) < 0.1 and abs(got[1] - 3.0) < 0.1
    model.output(f"{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out").count() == 3000
    with pytest.raises(ValueError):
        L.DML(["a"]).fit(df.filter("w = 1"))
    with pytest.raises(ValueError):
        L.TLearner(["zz"]).fit(df)
    with pytest.raises(ValueError):
        L.DML(["a"]).fit(df, instruments=["b"])


def confounded(n=6000, seed=3, arms=(0, 1, 2)):
    """A control c moves arm and outcome alike; effects depend on the feature a."""
    r = np.random.default_rng(seed)
    a, c = r.normal(size=(2, n))
    logits = np.stack([k * c for k in range(len(arms))], 1)
    p = np.exp(logits) / np.exp(logits).sum(1, keepdims=True)
    w = (r.random(n)[:, None] > p.cumsum(1)).sum(1)
    y = 3 * c + a + w * (1.5 + a) + r.normal(scale=0.2, size=n)
    return pd.DataFrame({"id": range(n), "a": a, "c": c, "w": np.array(arms)[w], "y": y})


@pytest.mark.parametrize("arms", [(0, 1), (0, 2), (-1, 4, 9)])
@pytest.mark.parametrize("cls", [L.DRLearner, L.DML])
def test_controls_and_arms_of_any_number(spark, cls, arms):
    pdf = confounded(arms=arms)
    df = spark.createDataFrame(pdf)
    options = {"joint": False} if cls is L.DRLearner else {}
    got = cls(["a"], controls=["c"], **options).fit(df).estimate(df.drop("c")).orderBy("id").toPandas()
    for i, k in enumerate(arms[1:], 1):
        assert np.abs(got[f"effect_{k}"] - i * (1.5 + pdf["a"])).mean() < 0.2
    # without the control, arms and outcome move together
    blind = cls(["a"], **options).fit(df).estimate(df).agg(F.avg(f"effect_{arms[-1]}")).first()[0]
    assert abs(blind - (len(arms) - 1) * 1.5) > 0.5


@pytest.mark.parametrize("cls", [L.TLearner, L.SLearner, L.XLearner])
def test_other_learners_take_arms_of_any_number(spark, cls):
    pdf = linear()
    plain, coded = (cls(["a", "b"]).fit(df := spark.createDataFrame(pdf.assign(w=w))).estimate(df).orderBy("id").toPandas() for w in (pdf["w"], pdf["w"] * 5 - 2))
    assert np.allclose(plain["effect_1"], coded["effect_3"])


def test_gram_of_all_rows_and_final_regressors(spark):
    from pyspark.ml.regression import DecisionTreeRegressor

    pdf = linear(500)
    df = spark.createDataFrame(pdf).repartition(7)
    x = np.column_stack([np.ones(500), pdf["a"], pdf["b"]])
    assert np.allclose(L.gram(df, [F.lit(1.0), F.col("a"), F.col("b")]), x.T @ x)
    want = np.linalg.lstsq(x, pdf[["y", "w"]].to_numpy(float), rcond=None)[0]
    assert np.allclose(L.least_squares(df, [F.lit(1.0), F.col("a"), F.col("b")], [F.col("y"), F.col("w")]), want)
    with pytest.raises(ValueError):
        L.least_squares(df.withColumn("a", F.lit(None).cast("double")), [F.col("a")], [F.col("y")])
    assert (L.gram(df.limit(0), [F.col("a")]) == 0).all()
    big = spark.createDataFrame(linear(2000))
    got = L.DRLearner(["a", "b"], final=DecisionTreeRegressor(maxDepth=3)).fit(big).estimate(big)
    assert got.select("effect_1").distinct().count() <= 8 and got.agg(F.corr("effect_1", "b")).first()[0] > 0.8


def batch(n=40, seed=1):
    r = np.random.default_rng(seed)
    return pd.DataFrame({"f1": r.normal(size=n), "f2": r.normal(size=n), "y": r.integers(0, 2, n), "T": r.integers(0, 2, n), "W": r.uniform(0.1, 1, n), "G": r.integers(1, 6, n)})


@pytest.mark.parametrize("name", [n for n in MODELS if n not in ("dr", "ips")])
def test_gradients(name):
    model = MODELS[name](["f1", "f2"], hidden=(5, 4), l2=0.01)
    rnd = np.random.default_rng(0)
    params = {k: v + rnd.normal(scale=0.05, size=v.shape) for k, v in model.init(rnd).items()}  # off the kinks
    pdf = batch()
    _, g = model.gradient(params, pdf)
    for k, v in params.items():
        at = np.unravel_index(np.abs(g[k]).argmax(), v.shape)
        old = v[at]
        v[at] = old + 1e-6
        up = model.gradient(params, pdf)[0]
        v[at] = old - 1e-6
        down = model.gradient(params, pdf)[0]
        v[at] = old
        assert abs((up - down) / 2e-6 - g[k][at]) < 1e-4 * max(1, abs(g[k][at])), k


@pytest.mark.parametrize("name", ["ipw", "dr", "macr"])
def test_training_ranks_labels(spark, name):
    r = np.random.default_rng(2)
    x = r.normal(size=(1500, 2))
    y = (r.random(1500) < 1 / (1 + np.exp(-2 * x[:, 0]))).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"event_id": range(1500), "f1": x[:, 0], "f2": x[:, 1], "y": y, "T": r.integers(0, 2, 1500), "W": r.uniform(0.2, 1, 1500), "G": r.integers(1, 6, 1500)}))
    model = MODELS[name](["f1", "f2"]).fit(df, 25)
    s = model.predict(df).toPandas().set_index("event_id").sort_index()["score"].to_numpy()
    order = s.argsort().argsort()
    auc = (order[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() - 1) / 2) / ((y == 1).sum() * (y == 0).sum())
    assert auc > 0.75 and model.losses[-1] < model.losses[0]
    with pytest.raises(ValueError):
        MODELS[name](["f1"], nonsense=1)


def test_kernel_sums_in_blocks():
    from cauza.operators.autodiff import Tensor
    from cauza.operators.debias import rbf_sum

    r = np.random.default_rng(4)
    a, b = Tensor(r.normal(size=(37, 3))), Tensor(r.normal(size=(21, 3)))
    out = rbf_sum(a, b, 1.7, block=8)
    d = ((a.value[:, None] - b.value[None]) ** 2).sum(-1)
    assert np.isclose(out.value, np.exp(-d / 1.7**2).sum())
    out.backward()
    for x in (a, b):
        old = x.value[2, 1]
        x.value[2, 1] = old + 1e-6
        up = float(rbf_sum(a, b, 1.7).value)
        x.value[2, 1] = old - 1e-6
        down = float(rbf_sum(a, b, 1.7).value)
        x.value[2, 1] = old
        assert abs((up - down) / 2e-6 - x.grad[2, 1]) < 1e-6


def test_one_worker_is_the_plain_mini_batch_loop(spark):
    pdf = batch(90, 3).assign(event_id=range(90))
    model = MODELS["ipw"](["f1", "f2"], batch_size=16, workers=1).fit(spark.createDataFrame(pdf), 3)
    again = MODELS["ipw"](["f1", "f2"], batch_size=16, workers=1)
    order = spark.createDataFrame(pdf).select(*(F.col(c).cast("double") for c in ("f1", "f2", "y")), "W")
    rows = order.withColumn("h", F.xxhash64("f1", "f2", "y", "W")).orderBy("h").toPandas()
    params = again.init(np.random.default_rng(again.seed))
    m, v = ({k: np.zeros_like(x) for k, x in params.items()} for _ in range(2))
    step = 0
    for epoch in (1, 2, 3):
        for at in range(0, 90, 16):
            step += 1
            some = rows.iloc[at : at + 16]
            again._adam(params, m, v, {k: g / len(some) for k, g in again.gradient(params, some, epoch)[1].items()}, step)
    assert step == 18
    assert all(np.allclose(params[k], model.params[k]) for k in params)


def test_scores_do_not_depend_on_batches(spark):
    df = spark.createDataFrame(batch(200, 5).assign(event_id=range(200)))
    for name in ("dmbr", "macr", "dr"):
        model = MODELS[name](["f1", "f2"]).fit(df, 1)
        got = [{r.event_id: round(r.score, 9) for r in model.predict(df.repartition(n)).collect()} for n in (1, 7)]
        assert got[0] == got[1]


def test_more_treatment_classes(spark):
    df = spark.createDataFrame(batch(120, 6).assign(event_id=range(120), K=lambda d: d.G % 3))
    model = MODELS["dr"](["f1", "f2"], treatment="K", classes=3, encode=True).fit(df, 4)
    assert model.losses[-1] < model.losses[0] and model.predict(df).count() == 120


def test_expm_and_box():
    a = np.random.default_rng(0).normal(size=(5, 5))
    w, v = np.linalg.eig(a)
    assert np.allclose(expm(a), (v * np.exp(w) @ np.linalg.inv(v)).real)
    target = np.array([2.0, -3.0, 0.5])
    x = projected_lbfgs(lambda x: (((x - target) ** 2 * [1, 10, 100]).sum(), 2 * (x - target) * [1, 10, 100]), np.zeros(3), np.array([0.0, 0.0, -9]), np.array([1.0, 9.0, 9.0]))
    assert np.allclose(x, [1.0, 0.0, 0.5], atol=1e-4)


def test_continuous_discovery(spark):
    r = np.random.default_rng(0)
    a, c = r.normal(size=(2, 400))
    b = np.sin(1.5 * a) * 2 + r.normal(scale=0.2, size=400)
    df = spark.createDataFrame(pd.DataFrame({"a": a, "b": b, "c": c}))
    model = CausalRegressionDiscovery(max_iteration=2, hidden=4, lambda1=0.02, lambda2=0.01, inner_steps=25)
    flat = r.normal(size=2 * 36 + 2 * 12 + 3) * 0.3
    x = np.stack([a, b, c], 1)[:50]
    f, g = model.partial(flat, x)
    for i in (0, 40, 75, 90, 98):
        e = np.zeros_like(flat)
        e[i] = 1e-6
        assert abs((model.partial(flat + e, x)[0] - model.partial(flat - e, x)[0]) / 2e-6 - g[i]) < 1e-4
    deep = CausalRegressionDiscovery(hidden=[4, 3])
    flat = r.normal(size=sum(int(np.prod(s)) for s in deep.shapes(3))) * 0.5
    f, g = deep.partial(flat, x)
    for i, e in enumerate(np.eye(len(flat)) * 1e-6):
        assert abs((deep.partial(flat + e, x)[0] - deep.partial(flat - e, x)[0]) / 2e-6 - g[i]) < 1e-4
    found, _ = CausalRegressionDiscovery(max_iteration=1, hidden=[4, 3], lambda1=0.02, lambda2=0.01, inner_steps=12).fit(df).get_result()
    assert not found.is_cyclic()
    graph, _ = model.fit(df).get_result()
    pairs = {frozenset(e) for e in graph.edges()}
    assert frozenset("ab") in pairs and not graph.is_cyclic() and len(pairs) <= 2


def test_sources(spark, tmp_path):
    m = [[1, 2], [3, 4]]
    assert intake(spark, m).columns == ["x0", "x1"] and intake(spark, {"node_names": ["p", "q"], "data": m}).columns == ["p", "q"]
    assert intake(spark, lambda s: s.range(2)).count() == 2
    with pytest.raises(ValueError):
        intake(spark, ("only", m))
    spark.createDataFrame([(1, "yes", 2.0), (2, "no", 3.0)], "i int, t string, x double").coalesce(1).write.csv(f"{tmp_path}/c", header=True)
    df = read_csv(spark, f"{tmp_path}/c", {"treatment": ["t"], "features": ["x"]}, {"yes": 1, "no": 0})
    assert sorted(map(tuple, df.collect())) == [(0, 3.0), (1, 2.0)]
    with pytest.raises(ValueError):
        read_csv(spark, f"{tmp_path}/c", {"features": ["zz"]})
    assert launch(lambda i, n, p, d: (i, n, p), 3, "p") == [(0, 3, "p"), (1, 3, "p"), (2, 3, "p")]


def test_scores_with_batch_norm_do_not_depend_on_the_batch(spark):
    r = np.random.default_rng(2)
    x = r.normal(loc=3.0, size=(1200, 2))
    y = (r.random(1200) < 1 / (1 + np.exp(-2 * (x[:, 0] - 3)))).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"event_id": range(1200), "f1": x[:, 0], "f2": x[:, 1], "y": y, "T": 1, "W": 0.5, "G": 1}))
    for size in (128, None):
        model = MODELS["ipw"](["f1", "f2"], batch_norm=True, batch_size=size).fit(df, 15)
        assert abs(model.params["dnn.mean0"]).max() > 0.1 and (model.params["dnn.var0"] != 1).all()
        whole = {s.event_id: s.score for s in model.predict(df).collect()}
        few = {s.event_id: s.score for s in model.predict(df.filter("event_id < 3")).collect()}
        assert all(abs(whole[k] - v) < 1e-12 for k, v in few.items())
    hit = df.join(model.predict(df), "event_id").agg(F.avg(((F.col("score") > 0.5).cast("int") == F.col("y")).cast("double"))).first()[0]
    assert hit > 0.6


def test_dropout_masks_differ_by_worker_and_step():
    model = MODELS["ipw"](["f1", "f2"], dropout=0.5)
    params = model.init(np.random.default_rng(0))
    losses = [model.gradient(params, batch(), 1, worker, step)[0] for worker in (0, 1) for step in (0, 1)]
    assert len(set(losses)) == 4 and model.gradient(params, batch(), 1, 1, 1)[0] == losses[-1]


def test_constants_get_no_gradients_and_parameters_those_of_before():
    """Of rows, labels and weights no gradient is computed; selections with repeated and negative places still add up."""
    from cauza.operators.autodiff import Tensor

    r = np.random.default_rng(2)
    x, w, z = Tensor(r.normal(size=(6, 3)), constant=True), Tensor(r.normal(size=(3, 2))), Tensor(r.normal(size=(5, 2)))
    scaled = x * 2.0 - 1.0
    out = (scaled @ w * np.arange(6.0)[:, None]).sum() + z[np.array([0, 2, 3])].sum() + z[np.array([1, 1, -1])].sum() * 3.0
    out.backward()
    assert x.grad is None and scaled.grad is None and scaled.constant and not out.constant
    assert np.allclose(w.grad, (scaled.value * np.arange(6.0)[:, None]).sum(0)[:, None])
    assert z.grad[:, 0].tolist() == [1, 6, 1, 1, 3]


def test_kernel_of_rows_with_themselves_has_its_whole_gradient():
    from cauza.operators.autodiff import Tensor
    from cauza.operators.debias import rbf_sum

    a = np.random.default_rng(4).normal(size=(20, 3))
    one, two, other = Tensor(a), Tensor(a), Tensor(a)
    rbf_sum(one, one, 1.5).backward()
    rbf_sum(two, other, 1.5).backward()
    assert np.allclose(one.grad, two.grad + other.grad)

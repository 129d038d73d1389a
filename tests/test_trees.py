import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cauza.operators import bins as B
from cauza.operators import boosting as T
from cauza.operators import histograms as H
from cauza.sources.frames import CausalFrame

PERIODS, T0 = 4, 3


def panel(n=1500, seed=0):
    """Treated units are confounded by x0 and gain 2 where x1 > 0, in the last period."""
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, 3))
    w = (r.random(n) < 1 / (1 + np.exp(-x[:, 0]))).astype(int)
    base = 3 * x[:, :1] + w[:, None] * 1.5
    y = base + r.normal(scale=0.3, size=(n, PERIODS))
    tau = np.where(x[:, 1] > 0, 2.0, 0.0)
    y[:, T0:] += (w * tau)[:, None]
    return pd.DataFrame({"id": range(n), "a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "w": w, "y": y.tolist(), "tau": tau})


@pytest.fixture(scope="module")
def frame(spark):
    return CausalFrame(spark.createDataFrame(panel()), ["a", "b", "c"], n_period=PERIODS, treat_dt=T0)


def test_plans_match_the_driver_search(spark):
    """Histogram, scan, admissibility and best split as plans against the numpy search, for both losses."""
    r = np.random.default_rng(5)
    n = 600
    pdf = pd.DataFrame({"leaf": 0, "w": r.integers(0, 2, n), "f0": r.integers(0, 6, n), "f1": r.integers(0, 9, n), **{a: np.abs(r.normal(size=(n, PERIODS)) + 2).tolist() if "h" in a else r.normal(size=(n, PERIODS)).tolist() for a in H.SUMS}})
    hist = H.histogram(spark.createDataFrame(pdf), ["f0", "f1"], PERIODS).cache()
    stats = {k: np.zeros((2, 9, 2, PERIODS)) for k in H.SUMS} | {"n": np.zeros((2, 9, 2)), "e": np.zeros((2, 9, 2))}
    for row in hist.collect():
        for k in H.SUMS:
            stats[k][row.feature, row.bin, row.w, row.t] = row[k]
        stats["n"][row.feature, row.bin, row.w] = row.n
    got = stats["n"].sum(axis=(1, 2))
    assert got.tolist() == [n, n]
    sides = H.scan(hist).cache()
    for did in (False, True):
        c = T.Config(lambd=2.0)
        costs = (H.did_costs if did else H.gbct_costs)(sides, PERIODS, T0, 2.0)
        best = H.best_split(costs, H.admissible(sides)).first()
        f, b, cost, _, _ = T.search(stats, T0, c, did)
        assert (best.feature, best.bin) == (f, b) and abs(best.loss - cost) < 1e-8 * abs(cost)


def test_debiased_effect(frame):
    model = T.GradientBoostingCausalRegressionTree(T.Config(n_estimators=30, max_depth=2, learning_rate=0.3, anchor=8)).fit(frame)
    got = model.predict(frame, "effect").join(frame.df.select("id", "tau"), "id").select(F.avg(F.abs(F.get("effect", F.lit(0)) - F.col("tau"))), F.avg("tau"), F.avg(F.get("effect", F.lit(0)))).first()
    raw = model.predict(frame, "effect-ND").join(frame.df.select("id", "tau"), "id").select(F.avg(F.abs(F.get("effect-ND", F.lit(0)) - F.col("tau")))).first()
    assert got[0] < 0.7 and got[0] < raw[0] and abs(got[1] - got[2]) < 0.4
    counts = model.split_counts()
    assert counts["b"] > 0 and sum(counts.values()) == sum(len(n.children) > 0 for t in model.trees for n in t.nodes.values())
    assert model.valid_losses == sorted(model.valid_losses, reverse=True)[: len(model.valid_losses)] or min(model.valid_losses) < model.valid_losses[0]
    leaf = model.predict(frame, "leaf_id").first()["leaf_id"]
    assert len(leaf) == len(model.trees)


def test_save_and_stream(spark, frame, tmp_path):
    from cauza.streaming.scoring import score_stream

    model = T.DifferenceInDifferencesRegressionTree(T.Config(n_estimators=6, max_depth=2, learning_rate=0.5)).fit(frame)
    model.save(spark, f"{tmp_path}/model")
    again = T.DifferenceInDifferencesRegressionTree.load(spark, f"{tmp_path}/model", model.config)
    want = {r.id: r.effect for r in model.predict(frame).collect()}
    assert {r.id: r.effect for r in again.predict(frame).collect()} == want
    rows = frame.df.select("id", "a", "b", "c")
    rows.write.parquet(f"{tmp_path}/in")
    score_stream(again, spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/cp", "id").awaitTermination()
    assert {r.id: r.effect for r in spark.read.parquet(f"{tmp_path}/out").collect()} == want
    assert len(model.predict(frame, "eta").first()["eta"]) == len(model.trees)


def test_uplift(spark):
    r = np.random.default_rng(1)
    x, w = r.normal(size=1200), r.integers(0, 2, 1200)
    y = (r.random(1200) < np.where((w == 1) & (x > 0), 0.8, 0.3)).astype(float)
    df = spark.createDataFrame(pd.DataFrame({"id": range(1200), "x": x, "w": w, "y": [[float(v)] for v in y]}))
    model = T.GradientBoostingUpliftTree(T.Config(n_estimators=15, max_depth=1, learning_rate=0.3, lambd=1.0)).fit(CausalFrame(df, ["x"], n_period=1, treat_dt=0))
    got = model.predict(df, "effect").join(df, "id").select(F.avg(F.when(F.col("x") > 0, F.get("effect", F.lit(0)))), F.avg(F.when(F.col("x") <= 0, F.get("effect", F.lit(0))))).first()
    assert got[0] > 0.8 and abs(got[1]) < 0.6


def test_bins(spark):
    x = np.random.default_rng(0).normal(size=20_000)
    x[:500] = 0
    values, counts = np.unique(x, return_counts=True)
    bounds = B.feature_bounds(values, counts, 64, 10)
    assert len(bounds) <= 64 and bounds == sorted(bounds) and bounds[-1] == float("inf")
    found = B.transform(x, bounds)
    assert all((x <= b).sum() == (found <= i).sum() for i, b in enumerate(bounds))
    assert (found == found[0]).sum() == 500 and np.bincount(found).min() >= 10
    df = spark.createDataFrame(pd.DataFrame({"x": x[:2000], "k": np.arange(2000) % 5.0}))
    fitted = B.fit_bins(df, ["x", "k"])
    v, n = np.unique(x[:2000], return_counts=True)
    assert fitted["x"] == B.feature_bounds(v, n) and len(fitted["k"]) == 5
    assert B.transform(np.array([np.nan]), bounds)[0] == len(bounds) and np.isnan(B.inverse(np.array([len(bounds)]), bounds)[0])
    assert B.categories(np.array([1, 2, 3, -1]), np.array([90, 9, 1, 50])) == [1, 2]


def test_frame_checks(spark):
    df = spark.createDataFrame([(1, 2.0, 0, [1.0])], "id int, x double, w int, y array<double>")
    with pytest.raises(ValueError):
        CausalFrame(df, ["z"])
    with pytest.raises(ValueError):
        CausalFrame(df, ["x"], n_period=2, treat_dt=2)
    with pytest.raises(ValueError):
        CausalFrame(df, ["x"], n_period=2, treat_dt=1).check()


def plain_bounds(values, counts, most, least):
    """The greedy scan over values one by one, as published; values without a number between them are one."""
    v, n = [], []
    for x, k in zip(values.tolist(), counts.tolist()):
        if v and x <= np.nextafter(v[-1], np.inf):
            v[-1], n[-1] = x, n[-1] + k
        else:
            v.append(x), n.append(k)
    ends, held = [], 0
    if len(v) <= most:
        for i in range(len(v) - 1):
            held += n[i]
            if held >= least:
                ends.append(i)
                held = 0
    else:
        most = max(1, min(most, sum(n) // least))
        big = [k >= sum(n) / most for k in n]
        bins, left = most - sum(big), sum(k for k, b in zip(n, big) if not b)
        mean = left / max(1, bins)
        for i in range(len(v) - 1):
            left -= 0 if big[i] else n[i]
            held += n[i]
            if big[i] or held >= mean or (big[i + 1] and held >= max(1.0, mean / 2)):
                ends.append(i)
                held = 0
                if len(ends) >= most - 1:
                    break
                if not big[i]:
                    bins -= 1
                    mean = left / max(1, bins)
    out = []
    for b in (float(np.nextafter((v[i] + v[i + 1]) / 2, np.inf)) for i in ends):
        if not out or b > np.nextafter(out[-1], np.inf):
            out.append(b)
    return [*out, np.inf]


def shapes(seed, n=4000):
    rnd = np.random.default_rng(seed)
    ulps = 1 + np.cumsum(rnd.integers(1, 3, 3000)) * np.finfo(float).eps
    return {"normal": np.abs(rnd.normal(size=n)), "heavy": np.exp(rnd.normal(size=n) * 20), "few": rnd.integers(1, 40, n) * 1.0, "frequent": np.where(rnd.random(n) < 0.4, rnd.choice([0.5, 0.7, 3.0], n), rnd.random(n)), "ulps": rnd.choice(ulps, n), "mixed": np.round(np.abs(rnd.normal(size=n)), rnd.integers(1, 5)) + 1.0}


def test_scan_over_cells_opens_what_it_has_to():
    """Cells of many values give the bounds of the values once the open ones are cut."""
    for seed in range(12):
        for name, x in shapes(seed).items():
            values, counts = np.unique(x, return_counts=True)
            for most, least in ((4, 10), (16, 1), (63, 10), (255, 3)):
                want = plain_bounds(values, counts, most, least)
                edge = np.unique(np.r_[0, np.random.default_rng(seed).integers(0, len(values), 30)])
                cells = B.Cells(values[edge], values[np.r_[edge[1:], len(values)] - 1], np.add.reduceat(counts, edge))
                for _ in range(60):
                    bounds, opened = B.greedy(cells.merged(), most, least)
                    opened = [k for k in sorted(opened) if cells.low[k] < cells.high[k]]
                    if not opened:
                        break
                    at = np.unique(np.concatenate([np.searchsorted(values, np.r_[cells.low, values[-1]])[:-1], *(np.linspace(*np.searchsorted(values, [cells.low[k], cells.high[k]]), 4).astype(int) for k in opened)]))
                    cells = B.Cells(values[at], values[np.r_[at[1:], len(values)] - 1], np.add.reduceat(counts, at))
                assert bounds == want, (name, seed, most, least)


def test_bounds_of_many_values_are_exact(spark):
    names = list(shapes(0))
    x = pd.DataFrame(shapes(0)) * np.where(np.random.default_rng(1).random((4000, len(names))) < 0.3, -1, 1)
    x.iloc[:300] = 0.0
    x.iloc[300:310] = np.nan
    df = spark.createDataFrame(x).repartition(5)
    for parts in (16, 300):
        found = B.fit_bins(df, names, 32, 10, parts=parts)
        for name in names:
            assert found[name] == B.feature_bounds(*np.unique(x[name].dropna(), return_counts=True), 32, 10), (name, parts)
    forced = {"normal": [0.5, -0.3, 1.0], "few": [3.0, 3.5], "heavy": [1e6]}
    found = B.fit_bins(df, names, 16, 5, forced, parts=16)
    for name in names:
        assert found[name] == B.feature_bounds(*np.unique(x[name].dropna(), return_counts=True), 16, 5, forced.get(name, ())) and len(found[name]) <= 16
        assert set(forced.get(name, ())) <= set(found[name])
    none = B.fit_bins(df.limit(0), names[:2], 16, 5)
    assert none == {n: [float("inf")] for n in names[:2]}


def test_forced_bounds_stay_inside_max_bin():
    values, counts = np.arange(-50, 51) * 1.0, np.full(101, 10)
    for most in (2, 3, 4, 8, 20):
        bounds = B.feature_bounds(values, counts, most, 1, [10.0, 20.0, 30.0, -5.0])
        assert len(bounds) <= most and bounds == sorted(bounds) and bounds[-1] == float("inf")
    assert {10.0, 20.0, 30.0, -5.0} <= set(B.feature_bounds(values, counts, 8, 1, [10.0, 20.0, 30.0, -5.0]))
    assert len(B.feature_bounds(values, counts, 20, 1, [10.0, 20.0])) == 20
    # rows decide where the free bins go: 8 of them, half of the rows below -ZERO
    free = [b for b in B.feature_bounds(values, counts, 12, 1, [25.0]) if b not in (25.0, float("inf"), B.ZERO, -B.ZERO)]
    assert len(free) == 8 and sum(b < 0 for b in free) == 4 and sum(b > 25 for b in free) == 2


def test_right_children_by_subtraction(spark):
    from cauza.operators import boosting as G

    rnd = np.random.default_rng(1)
    n = 1200
    pdf = pd.DataFrame({"id": range(n), "a": rnd.normal(size=n), "b": rnd.normal(size=n), "w": rnd.integers(0, 2, n)})
    pdf["y"] = [list(map(float, row)) for row in rnd.normal(size=(n, 3)) + pdf[["a"]].to_numpy() * np.array([0, 0, 1]) * pdf[["w"]].to_numpy()]
    frame = CausalFrame(spark.createDataFrame(pdf), ["a", "b"], n_period=3, treat_dt=2)
    asked, plain = [], G.Boosting._level

    class Left(G.GradientBoostingCausalRegressionTree):
        def _level(self, state, since, tree, level):
            asked.append(list(level))
            return super()._level(state, since, tree, level)

    class Both(G.GradientBoostingCausalRegressionTree):
        """Sums every child."""

        def _level(self, state, since, tree, level):
            out, loss = plain(self, state, since, tree, sorted({*level, *(k + 1 for k in level if k)}))
            return out, loss

    models = [cls(G.Config(n_estimators=2, max_depth=3)).fit(frame) for cls in (Left, Both)]
    assert all(k % 2 or not k for level in asked for k in level)
    assert [[(k, x.feature, x.bin) for k, x in sorted(t.nodes.items())] for t in models[0].trees] == [[(k, x.feature, x.bin) for k, x in sorted(t.nodes.items())] for t in models[1].trees]
    assert all(np.allclose(x.theta, models[1].trees[i].nodes[k].theta) for i, t in enumerate(models[0].trees) for k, x in t.nodes.items())


def bins_of(model, df):
    x = df.select(*(v.alias(f"x{i}") for i, v in enumerate(model._values(df)))).toPandas().to_numpy(float)
    return np.stack([B.transform(x[:, i], model.bounds[f]) for i, f in enumerate(model.features)], 1).astype(np.int64)


def test_scores_are_columns_and_equal_those_of_bins(spark):
    pdf = panel(800, 3)
    pdf.loc[::7, "b"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("a", F.when(F.col("id") % 11 != 0, F.col("a"))).withColumn("kind", F.when(F.col("id") % 13 != 0, F.concat(F.lit("k"), (F.col("id") % 5).cast("string")))).orderBy("id").coalesce(1)
    frame = CausalFrame(df, ["a", "b", "kind"], n_period=PERIODS, treat_dt=T0, categorical=["kind"])
    for cls in (T.GradientBoostingCausalRegressionTree, T.DifferenceInDifferencesRegressionTree):
        model = cls(T.Config(n_estimators=5, max_depth=3, learning_rate=0.5, min_var_rate=0.0)).fit(frame)
        bins = bins_of(model, df)
        assert (bins[:, 2] == 5 + 1).sum() == sum(i % 13 == 0 for i in range(800)) and set(bins[:, 2]) == {0, 1, 2, 3, 4, 6}
        theta = model._theta(bins)
        get = lambda what: np.array([r[0] for r in model.predict(frame, what).orderBy("id").select(what).collect()])
        assert np.allclose(get("outcome").reshape(theta.shape), theta, atol=1e-12)
        assert (get("leaf_id") == np.stack([t.leaves(bins) for t in model.trees], 1)).all()
        gap = theta[:, 1] - theta[:, 0]
        if model.did:
            eta = np.stack([t.values(bins)[1] for t in model.trees], 1)
            assert np.allclose(get("eta"), eta) and np.allclose(get("effect"), gap[:, T0:] - 0.5 * eta.sum(1, keepdims=True), atol=1e-12)
        else:
            assert np.allclose(get("effect"), gap[:, T0:] - gap[:, :T0].mean(1, keepdims=True), atol=1e-12)
        plan = model.predict(frame, "effect")._jdf.queryExecution().executedPlan().toString()
        assert not [w for w in ("Python", "Pandas", "Arrow") if w in plan.replace("ArrowEvalPython", "Python")]


def test_categories_of_a_fit_travel_with_the_model(spark, tmp_path):
    rnd = np.random.default_rng(2)
    n = 1500
    kind = rnd.choice(["b", "a", "c", "rare"], n, p=[0.5, 0.3, 0.195, 0.005])
    w = rnd.integers(0, 2, n)
    y = rnd.normal(scale=0.2, size=(n, 2))
    y[:, 1] += w * np.where(kind == "a", 3.0, 0.0)
    df = spark.createDataFrame(pd.DataFrame({"id": range(n), "kind": kind, "code": rnd.integers(-1, 3, n), "w": w, "y": y.tolist()}))
    frame = CausalFrame(df, ["kind", "code"], n_period=2, treat_dt=1, categorical=["kind", "code"])
    model = T.GradientBoostingCausalRegressionTree(T.Config(n_estimators=20, max_depth=2, learning_rate=0.5, lambd=0.1)).fit(frame)
    assert model.dictionaries["kind"] == ["b", "a", "c"] and sorted(model.dictionaries["code"]) == ["0", "1", "2"]
    model.save(spark, f"{tmp_path}/m")
    again = T.GradientBoostingCausalRegressionTree.load(spark, f"{tmp_path}/m", model.config)
    new = spark.createDataFrame([(1, "a", 0), (2, "b", 0), (3, "never seen", 0), (4, None, -5)], "id bigint, kind string, code int")
    got = {r.id: r.effect[0] for r in again.predict(new).collect()}
    assert got == {r.id: r.effect[0] for r in model.predict(new).collect()}
    assert abs(got[1] - 3) < 0.4 and abs(got[2]) < 0.4 and abs(got[3]) < 0.6
    subset = frame.subset(features=["code"])
    assert subset.categorical == ["code"]


def test_trivial_features_are_flagged_and_left_out(spark):
    pdf = panel(400, 4).assign(flat=1.0, few=lambda d: (d["id"] < 3) * 1.0)
    model = T.GradientBoostingCausalRegressionTree(T.Config(n_estimators=3, max_depth=2, min_points_per_bin=1)).fit(CausalFrame(spark.createDataFrame(pdf), ["flat", "a", "few", "b"], n_period=PERIODS, treat_dt=T0))
    assert model.trivial == ["flat", "few"] and not {"flat", "few"} & {f for f, n in model.split_counts().items() if n}


def test_each_tree_draws_rows_of_its_own():
    units = np.random.default_rng(0).integers(0, 1 << 32, 20_000)
    draws = np.stack([T.drawn(units, k) < 0.5 for k in range(6)])
    assert np.abs(draws.mean(1) - 0.5).max() < 0.02
    for i in range(6):
        for j in range(i):
            assert abs((draws[i] & draws[j]).mean() - 0.25) < 0.02
    assert (T.drawn(units, 1, seed=1) != T.drawn(units, 1)).mean() > 0.99 and T.drawn(units, 3).max() < 1


def test_trees_that_cannot_be_split_have_no_rows_as_in_sql(spark, sf_dir, tmp_path):
    """Treated customers order more after treatment, so that no split has effects of at most 0."""
    import duckdb

    from cauza.plans import ensembles as E

    customer = pd.read_parquet(f"{sf_dir}/customer.parquet")
    treated = customer[customer["c_mktsegment"].isin(["AUTOMOBILE", "BUILDING"])]
    orders = pd.DataFrame({"o_custkey": np.repeat(treated["c_custkey"].to_numpy(), 3), "o_orderdate": pd.Timestamp("2001-05-01").as_unit("us")})
    customer.to_parquet(f"{tmp_path}/customer.parquet")
    orders.to_parquet(f"{tmp_path}/orders.parquet")
    with duckdb.connect() as db:
        for name in ("customer", "orders"):
            db.execute(f"CREATE VIEW {name} AS FROM '{tmp_path}/{name}.parquet'")
        for kind, rows in (("monotone", 0), ("gbct", len(customer))):
            query, sql = E.QUERIES[f"{kind}_two_trees"]
            want = sorted(db.execute(sql).fetchall())
            assert sorted(map(tuple, query(spark, str(tmp_path)).collect())) == want and len(want) == rows


def test_a_fit_sums_over_cells_of_bins_and_arms(spark, monkeypatch):
    """Levels read a row for each occurring combination of bins and arm, however many rows there are; trees and losses are those of rows."""
    pdf = panel(700, 6).assign(a=lambda d: d["a"].round(), b=lambda d: d["b"].round())
    binary = pdf.assign(y=[[float(v > 0) for v in y] for y in pdf["y"]])
    held = []

    def seen(df, inner=T.checkpointed):
        out = inner(df)
        held.append(out.count())
        return out

    monkeypatch.setattr(T, "checkpointed", seen)
    for base, rows in ((T.GradientBoostingCausalRegressionTree, pdf), (T.DifferenceInDifferencesRegressionTree, pdf), (T.GradientBoostingUpliftTree, binary)):
        own = CausalFrame(spark.createDataFrame(rows), ["a", "b"], n_period=PERIODS, treat_dt=T0)
        by_row = type("ByRow", (base,), {"_cells": lambda self, state: state})
        models = [cls(T.Config(n_estimators=4, max_depth=2, anchor=3, min_points_per_bin=1)).fit(own) for cls in (base, by_row)]
        assert held == [k := len(rows[["a", "b", "w"]].drop_duplicates()), k, len(rows), len(rows)] and k < 150
        held.clear()
        assert np.allclose(models[0].valid_losses, models[1].valid_losses, rtol=1e-12)
        one, other = ([(k, x.feature, x.bin, x.theta, x.eta) for t in m.trees for k, x in sorted(t.nodes.items())] for m in models)
        assert [x[:3] for x in one] == [x[:3] for x in other] and len(one) > 8
        assert all(np.allclose(x[3], z[3], atol=1e-12) and abs(x[4] - z[4]) < 1e-9 for x, z in zip(one, other, strict=True))

import numpy as np
import pandas as pd

from cauza.operators import notears
from cauza.plans import models


def test_query_runs_the_whole_method(spark, sf_dir, monkeypatch):
    made, steps = [], []

    class Seen(notears.CausalRegressionDiscovery):
        def fit(self, df, names=None):
            made.append(self)
            return super().fit(df, names)

    def until_done(value, x, low, high, limit=50, inner=notears.projected_lbfgs):
        asked = [0]

        def counted(z):
            asked[0] += 1
            return value(z)

        out = inner(counted, x, low, high, limit)
        steps.append((asked[0], limit))
        return out

    monkeypatch.setattr(notears, "CausalRegressionDiscovery", Seen)
    monkeypatch.setattr(notears, "projected_lbfgs", until_done)
    assert models.notears_adjacency(spark, sf_dir).count() == 16
    assert made[0].max_iteration >= 3 and made[0].hidden == 10
    assert all(asked <= limit for asked, limit in steps)  # ended by convergence, not by the limit


def test_passes_read_blocks_and_sum_all_rows(spark):
    """A block holds many rows, the last one of a batch what is left; sums are those of the plain formulas."""
    r = np.random.default_rng(3)
    x = r.normal(size=(notears.BLOCK + 700, 3))
    df = spark.createDataFrame(pd.DataFrame(x, columns=list("abc"))).coalesce(1)
    assert notears.CausalRegressionDiscovery.packed(df).count() == 2
    for hidden in (5, [4, 3]):
        own = notears.CausalRegressionDiscovery(hidden=hidden)
        flat = r.normal(size=sum(int(np.prod(s)) for s in own.shapes(3)))
        got = own.squared(df, flat).orderBy("i").toPandas()["g"].to_numpy()
        pos, neg, b1, *deeper = own._unpack(flat, 3)

        def loss(pos, neg, b1, *deeper):
            z = np.einsum("nk,jmk->njm", x, pos - neg) + b1
            for w, b in zip(deeper[::2], deeper[1::2]):
                z = np.einsum("njm,jmo->njo", 1 / (1 + np.exp(-z)), w) + b
            return 0.5 * ((z[:, :, 0] - x) ** 2).sum()

        assert np.isclose(got[0], loss(pos, neg, b1, *deeper))
        for i in range(0, len(flat), 7):
            step = np.zeros(len(flat))
            step[i] = 1e-5
            ends = [loss(*own._unpack(flat + s * step, 3)) for s in (1, -1)]
            assert np.isclose(got[i + 1], (ends[0] - ends[1]) / 2e-5, rtol=1e-4, atol=1e-2)


def test_rounds_go_on_until_the_graph_is_acyclic(spark, sf_dir, monkeypatch):
    """No number of rounds ends the query before h_tol does, here by subproblems that halve all weights."""
    made, ends = [], []

    class Seen(notears.CausalRegressionDiscovery):
        def fit(self, df, names=None):
            made.append(self)
            return super().fit(df, names)

    def halved(value, x, low, high, limit=50):
        out = np.clip(x, low, high) / 2
        pos, neg, *_ = made[0]._unpack(out, 4)
        ends.append(float(np.trace(notears.expm(((pos - neg) ** 2).sum(1).T))) - 4)
        return out

    monkeypatch.setattr(notears, "CausalRegressionDiscovery", Seen)
    monkeypatch.setattr(notears, "projected_lbfgs", halved)
    assert models.notears_adjacency(spark, sf_dir).count() == 16
    assert ends[-1] <= made[0].h_tol < ends[-2] and len(ends) > 3

"""The learner classes on two features of the panel, held against normal equations in SQL.

Propensities come from a tree without a split, the share of treated rows, which SQL can state; base learners of the
classes are exchangeable, so that this is their own path. Folds are even and odd identifiers.
"""

from __future__ import annotations

from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.sql import functions as F

from ..operators import learners as L
from .trees import PANEL, panel_frame

FEATURES = ["x1", "x2"]


def _panel(spark, sf_dir):
    p = panel_frame(spark, sf_dir)
    return p.select("id", "w", F.col("c_nationkey").cast("double").alias("x1"), (F.col("c_acctbal") / 1000).alias("x2"), F.get("y", F.lit(6)).alias("y"), (F.col("id") % 2).cast("int").alias("fold"))


def _effects(spark, sf_dir, cls, **options):
    df = _panel(spark, sf_dir)
    share = DecisionTreeClassifier(maxDepth=0)
    return cls(FEATURES, classifier=share, **options).fit(df).estimate(df).select("id", F.round("effect_1", 6).alias("effect"))


def tlearner_fit(spark, sf_dir):
    return _effects(spark, sf_dir, L.TLearner)


def slearner_fit(spark, sf_dir):
    return _effects(spark, sf_dir, L.SLearner)


def xlearner_fit(spark, sf_dir):
    return _effects(spark, sf_dir, L.XLearner)


def drlearner_fit(spark, sf_dir):
    """With an outcome model for each arm."""
    return _effects(spark, sf_dir, L.DRLearner, fold_column="fold", joint=False)


#: Three arms by nation, whatever their numbers; effects depend on the balance, the nation is a control.
ARM_OF = {0: 1, 1: 3, 2: 7}


def _several_arms(spark, sf_dir, cls):
    df = _panel(spark, sf_dir).withColumn("w", F.element_at(F.create_map(*(F.lit(v) for pair in ARM_OF.items() for v in pair)), (F.col("x1") % 3).cast("int")))
    model = cls(["x2"], controls=["x1"], classifier=DecisionTreeClassifier(maxDepth=0), fold_column="fold").fit(df)
    return model.estimate(df).select("id", F.round("effect_3", 6).alias("effect_3"), F.round("effect_7", 6).alias("effect_7"))


def drlearner_arms(spark, sf_dir):
    """One outcome model over balance, nation and arms; three arms."""
    return _several_arms(spark, sf_dir, L.DRLearner)


def dml_arms(spark, sf_dir):
    """Residuals of three arms' indicators and of the outcome; one system of equations for both effects."""
    return _several_arms(spark, sf_dir, L.DML)


def dml_fit(spark, sf_dir):
    return _effects(spark, sf_dir, L.DML, fold_column="fold")


P = PANEL.split(",\nbinned")[0] + ", p AS (SELECT id, w, c_nationkey::DOUBLE AS x1, c_acctbal / 1000 AS x2, y[7] AS y, (id % 2)::INT AS fold FROM panel)"


def ols(name: str, source: str, y: str, cond: str = "TRUE", keys: str = "") -> str:
    """CTE (keys, b0, b1, b2): the least squares plane of y over x1 and x2, by the normal equations of centred sums."""
    group, k = (f"GROUP BY {keys}", f"{keys}, ") if keys else ("", "")
    sums = f"SELECT {k}avg({y}) AS my, avg(x1) AS m1, avg(x2) AS m2, var_pop(x1) AS v1, var_pop(x2) AS v2, covar_pop(x1, x2) AS v12, covar_pop(x1, {y}) AS c1, covar_pop(x2, {y}) AS c2 FROM {source} WHERE {cond} {group}"
    slopes = f"SELECT *, (v2 * c1 - v12 * c2) / (v1 * v2 - v12 * v12) AS b1, (v1 * c2 - v12 * c1) / (v1 * v2 - v12 * v12) AS b2 FROM ({sums})"
    return f"{name} AS (SELECT {k}my - b1 * m1 - b2 * m2 AS b0, b1, b2 FROM ({slopes}))"


def at(name: str) -> str:
    return f"({name}.b0 + {name}.b1 * p.x1 + {name}.b2 * p.x2)"


def determinant(m: list[list[str]]) -> str:
    (a, b, c), (d, e, f), (g, h, i) = m
    return f"({a} * ({e} * {i} - {f} * {h}) - {b} * ({d} * {i} - {f} * {g}) + {c} * ({d} * {h} - {e} * {g}))"


ARMS = f"{ols('c', 'p', 'y', 'w = 0')}, {ols('t', 'p', 'y', 'w = 1')}"
T_SQL = f"WITH {P}, {ARMS} SELECT id, round({at('t')} - {at('c')}, 6) AS effect FROM p, c, t"
S_SQL = f"""WITH {P}, {ols('ow', 'p', 'w')}, {ols('oy', 'p', 'y')}, r AS (SELECT w - {at('ow')} AS rw, y - {at('oy')} AS ry FROM p, ow, oy),
e AS (SELECT sum(rw * ry) / sum(rw * rw) AS effect FROM r) SELECT id, round(effect, 6) AS effect FROM p, e"""
X_SQL = f"""WITH {P}, {ARMS}, d AS (SELECT p.*, CASE WHEN w = 0 THEN {at('t')} - y ELSE y - {at('c')} END AS d FROM p, c, t), {ols('low', 'd', 'd', 'w = 0')}, {ols('high', 'd', 'd', 'w = 1')},
g AS (SELECT avg(w) AS g FROM p) SELECT id, round(g * {at('low')} + (1 - g) * {at('high')}, 6) AS effect FROM p, low, high, g"""
DR_SQL = f"""WITH {P}, o AS (SELECT *, 1 - fold AS other FROM p), {ols('c', 'o', 'y', 'w = 0', 'other')}, {ols('t', 'o', 'y', 'w = 1', 'other')}, s AS (SELECT other, avg(w) AS s FROM o GROUP BY other),
d AS (SELECT p.*, {at('t')} + w * (y - {at('t')}) / greatest(s, 0.01) - {at('c')} - (1 - w) * (y - {at('c')}) / greatest(1 - s, 0.01) AS d FROM p JOIN c ON c.other = p.fold JOIN t ON t.other = p.fold JOIN s ON s.other = p.fold),
{ols('f', 'd', 'd')} SELECT id, round({at('f')}, 6) AS effect FROM p, f"""
_A = [["a11", "a12", "a13"], ["a12", "a22", "a23"], ["a13", "a23", "a33"]]
_COLUMN = lambda k: [[f"d{i + 1}" if j == k else _A[i][j] for j in range(3)] for i in range(3)]
DML_SQL = f"""WITH {P}, o AS (SELECT *, 1 - fold AS other FROM p), {ols('m', 'o', 'y', keys='other')}, s AS (SELECT other, avg(w) AS s FROM o GROUP BY other),
r AS (SELECT y - {at('m')} AS ry, w - s AS u1, (w - s) * x1 AS u2, (w - s) * x2 AS u3 FROM p JOIN m ON m.other = p.fold JOIN s ON s.other = p.fold),
q AS (SELECT {', '.join(f'sum(u{i} * u{j}) AS a{i}{j}' for i in (1, 2, 3) for j in range(i, 4))}, {', '.join(f'sum(u{i} * ry) AS d{i}' for i in (1, 2, 3))} FROM r),
b AS (SELECT {', '.join(f'{determinant(_COLUMN(k))} / {determinant(_A)} AS b{k}' for k in range(3))} FROM q) SELECT id, round({at('b')}, 6) AS effect FROM p, b"""



def solved(name: str, source: str, xs: list[str], ys: list[str], keys: str = "") -> str:
    """CTEs that end in name (keys, b<i>_<k>): the coefficients of the columns ys on the columns xs, by elimination in the normal equations."""
    d, m, k = len(xs), len(ys), f"{keys}, " if keys else ""
    cell = lambda i, j: f"a{min(i, j)}_{max(i, j)}" if j < d else f"a{i}_{j}"
    sums = ", ".join(f"sum(({xs[i]}) * ({([*xs, *ys])[j]})) AS a{i}_{j}" for i in range(d) for j in range(d + m) if j >= i)
    out = [f"{name}_s AS (SELECT {k}{sums} FROM {source} {f'GROUP BY {keys}' if keys else ''})"]
    out.append(f"{name}_0 AS (SELECT {k}{', '.join(f'{cell(i, j)} AS r{i}_{j}' for i in range(d) for j in range(d + m))} FROM {name}_s)")
    for p in range(d):
        row = lambda i, j: f"r{p}_{j} / r{p}_{p}" if i == p else f"r{i}_{j} - r{i}_{p} * r{p}_{j} / r{p}_{p}"
        out.append(f"{name}_{p + 1} AS (SELECT {k}{', '.join(f'{row(i, j)} AS r{i}_{j}' for i in range(d) for j in range(d + m))} FROM {name}_{p})")
    out.append(f"{name} AS (SELECT {k}{', '.join(f'r{i}_{d + j} AS b{i}_{j}' for i in range(d) for j in range(m))} FROM {name}_{d})")
    return ", ".join(out)


ARMED = f"{P.replace('p AS (SELECT', 'p0 AS (SELECT')}, p AS (SELECT id, x1, x2, y, fold, 1 - fold AS other, (x1 % 3 = 1)::INT::DOUBLE AS w1, (x1 % 3 = 2)::INT::DOUBLE AS w2 FROM p0), s AS (SELECT other, avg(w1) AS s1, avg(w2) AS s2, 1 - avg(w1) - avg(w2) AS s0 FROM p GROUP BY other)"
DR_ARMS_SQL = f"""WITH {ARMED}, {solved('m', 'p', ['1.0', 'x2', 'x1', 'w1', 'w2'], ['y'], 'other')},
o AS (SELECT p.*, s0, s1, s2, b0_0 + b1_0 * x2 + b2_0 * x1 AS m0, b0_0 + b1_0 * x2 + b2_0 * x1 + b3_0 AS m1, b0_0 + b1_0 * x2 + b2_0 * x1 + b4_0 AS m2 FROM p JOIN m ON m.other = p.fold JOIN s ON s.other = p.fold),
d AS (SELECT id, x2, m1 + w1 * (y - m1) / greatest(s1, 0.01) - m0 - (1 - w1 - w2) * (y - m0) / greatest(s0, 0.01) AS d1, m2 + w2 * (y - m2) / greatest(s2, 0.01) - m0 - (1 - w1 - w2) * (y - m0) / greatest(s0, 0.01) AS d2 FROM o),
{solved('f', 'd', ['1.0', 'x2'], ['d1', 'd2'])} SELECT id, round(b0_0 + b1_0 * x2, 6) AS effect_3, round(b0_1 + b1_1 * x2, 6) AS effect_7 FROM d, f"""
DML_ARMS_SQL = f"""WITH {ARMED}, {solved('m', 'p', ['1.0', 'x2', 'x1'], ['y'], 'other')},
o AS (SELECT p.*, y - b0_0 - b1_0 * x2 - b2_0 * x1 AS ry, w1 - s1 AS u1, w2 - s2 AS u2 FROM p JOIN m ON m.other = p.fold JOIN s ON s.other = p.fold),
{solved('f', 'o', ['u1', 'u1 * x2', 'u2', 'u2 * x2'], ['ry'])} SELECT id, round(b0_0 + b1_0 * x2, 6) AS effect_3, round(b2_0 + b3_0 * x2, 6) AS effect_7 FROM o, f"""
QUERIES = {"drlearner_arms": (drlearner_arms, DR_ARMS_SQL), "dml_arms": (dml_arms, DML_ARMS_SQL), "tlearner_fit": (tlearner_fit, T_SQL), "slearner_fit": (slearner_fit, S_SQL), "xlearner_fit": (xlearner_fit, X_SQL), "drlearner_fit": (drlearner_fit, DR_SQL), "dml_fit": (dml_fit, DML_SQL)}

"""Meta-learners, doubly robust and double machine learning estimators of treatment effects.

Closed forms on one feature are single aggregations. The general learners take any pyspark.ml regressor and
classifier; treatments are two or more whole numbers, the least one the control. Folds come from a hash of the key, not
from row order. A fit writes the columns that it needs once, as each of its models reads them.

The doubly robust and the double machine learner take controls beside the features: both enter the models of outcome and
treatment, effects depend on features alone. Their last step is linear by default: sums of outer products of the rows'
vectors are one distributed aggregate, which is solved for the effects of all arms at once.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.frames import write_result
from ..sources.shared import checkpointed


def line(x: Column, y: Column) -> tuple[Column, Column]:
    """Intercept and slope of the least squares line."""
    return F.regr_intercept(y, x), F.regr_slope(y, x)


def arm_lines(df: DataFrame, x: str, y: str, w: str = "w") -> DataFrame:
    """One row (a0, b0, a1, b1): the line of each arm."""
    pick = lambda c, d: F.when(F.col(w) == d, F.col(c))
    return df.agg(*(v.alias(f"{n}{d}") for d in (0, 1) for n, v in zip("ab", line(pick(x, d), pick(y, d)))))


def t_learner_line(df: DataFrame, x: str, y: str, w: str = "w") -> DataFrame:
    """df with effect: the difference of the arms' lines."""
    lines = F.broadcast(arm_lines(df, x, y, w))  # one row
    return df.crossJoin(lines).withColumn("effect", F.col("a1") - F.col("a0") + (F.col("b1") - F.col("b0")) * F.col(x)).drop("a0", "b0", "a1", "b1")


def s_learner_line(df: DataFrame, x: str, y: str, w: str = "w") -> DataFrame:
    """(effect): the coefficient of w in y ~ 1 + x + w."""
    xx, ww, xw, xy, wy = F.var_pop(x), F.var_pop(w), F.covar_pop(x, w), F.covar_pop(x, y), F.covar_pop(w, y)
    return df.agg(((xx * wy - xw * xy) / (xx * ww - xw * xw)).alias("effect"))


def x_learner_line(df: DataFrame, x: str, y: str, w: str = "w") -> DataFrame:
    """df with effect: lines of imputed effects in each arm, weighted by the share of treated rows."""
    with_lines = df.crossJoin(F.broadcast(arm_lines(df, x, y, w)))
    d = F.when(F.col(w) == 0, F.col("a1") + F.col("b1") * F.col(x) - F.col(y)).otherwise(F.col(y) - F.col("a0") - F.col("b0") * F.col(x))
    imputed = with_lines.withColumn("__d", d)
    tau = arm_lines(imputed, x, "__d", w).crossJoin(df.agg(F.avg(w).alias("g")))
    effect = F.col("g") * (F.col("a0") + F.col("b0") * F.col(x)) + (1 - F.col("g")) * (F.col("a1") + F.col("b1") * F.col(x))
    return df.crossJoin(F.broadcast(tau)).withColumn("effect", effect).drop("a0", "b0", "a1", "b1", "g")


def cross_means(df: DataFrame, strata: str, fold: str, value: Column, name: str, folds: int = 2) -> DataFrame:
    """df with the mean of value in the row's stratum over the other folds."""
    sums = df.groupBy(strata, fold).agg(F.sum(value).alias("__s"), F.count(value).alias("__n"))
    total = sums.groupBy(strata).agg(F.sum("__s").alias("__ts"), F.sum("__n").alias("__tn"))
    other = sums.join(total, strata).select(strata, fold, F.try_divide(F.col("__ts") - F.coalesce("__s", F.lit(0.0)), F.col("__tn") - F.col("__n")).alias(name))
    return df.join(other, [strata, fold])


def aipw_strata(df: DataFrame, strata: str, fold: str, y: str, w: str = "w") -> DataFrame:
    """df with psi, the doubly robust pseudo-outcome from stratum means of the other fold; null where that lacks an arm in the stratum."""
    out = cross_means(df, strata, fold, F.col(w).cast("double"), "__p")
    for d in (0, 1):
        out = cross_means(out, strata, fold, F.when(F.col(w) == d, F.col(y)), f"__m{d}")
    psi = F.col("__m1") - F.col("__m0") + F.col(w) * (F.col(y) - F.col("__m1")) / F.col("__p") - (1 - F.col(w)) * (F.col(y) - F.col("__m0")) / (1 - F.col("__p"))
    return out.withColumn("psi", psi).drop("__p", "__m0", "__m1")


def dml_strata(df: DataFrame, strata: str, fold: str, y: str, w: str = "w") -> DataFrame:
    """(effect): slope of outcome residuals on treatment residuals, both from stratum means of the other fold."""
    out = cross_means(cross_means(df, strata, fold, F.col(w).cast("double"), "__p"), strata, fold, F.col(y), "__m")
    rw, ry = F.col(w) - F.col("__p"), F.col(y) - F.col("__m")
    return out.agg((F.sum(rw * ry) / F.sum(rw * rw)).alias("effect"))


def gram(df: DataFrame, columns: Sequence[Column]) -> np.ndarray:
    """Sums of products of all pairs of columns: a task adds up its rows, Spark the tasks' sums."""
    k = len(columns)
    i, j = np.triu_indices(k)

    def run(batches):
        total = np.zeros((k, k))
        for batch in batches:
            x = np.asarray(batch.column(0).flatten()).reshape(-1, k)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], ["i", "j", "s"])

    rows = df.select(F.array(*(F.coalesce(c.cast("double"), F.lit(float("nan"))) for c in columns)).alias("x")).mapInArrow(run, "i int, j int, s double")
    out = np.zeros((k, k))
    for r in rows.groupBy("i", "j").agg(F.sum("s").alias("s")).collect():  # a row for each pair of columns
        out[r.i, r.j] = out[r.j, r.i] = r.s
    return out


def least_squares(df: DataFrame, inputs: Sequence[Column], targets: Sequence[Column]) -> np.ndarray:
    """Coefficients [inputs, targets] of the least squares fits of all targets, in one pass."""
    sums = gram(df, [*inputs, *targets])
    k = len(inputs)
    if not np.isfinite(sums).all():
        raise ValueError("a value is missing or not finite")
    return np.linalg.lstsq(sums[:k, :k], sums[:k, k:], rcond=None)[0]


def _linear(coefficients: np.ndarray, columns: Sequence[Column]) -> Column:
    out = F.lit(float(coefficients[0]))
    for b, c in zip(coefficients[1:].tolist(), columns, strict=True):
        out = out + F.lit(b) * c
    return out


class InferenceModel:
    """fit(), estimate() and output() around a subclass's _fit and _effect; columns: features, y, w, key."""

    def __init__(self, features: Sequence[str], y: str = "y", w: str = "w", key: str = "id", regressor=None, classifier=None, folds: int = 2, seed: int = 0):
        self.features, self.y, self.w, self.key, self.folds, self.seed = list(features), y, w, key, folds, seed
        self.regressor = regressor or LinearRegression(regParam=0.0, solver="normal")
        self.classifier = classifier or LogisticRegression(regParam=1e-3)
        self.result: DataFrame | None = None

    def fit(self, df: DataFrame) -> InferenceModel:
        if missing := {*self.features, self.y, self.w} - set(df.columns):
            raise ValueError(f"columns are missing: {sorted(missing)}")
        df = checkpointed(df.select(*self._columns(df)))
        self.arms = [r[0] for r in df.select(F.col(self.w).cast("int").alias("w")).distinct().orderBy("w").collect()]
        if len(self.arms) < 2 or None in self.arms:
            raise ValueError("two arms are needed, and one for each row")
        self.base = self.arms[0]
        self._fit(df)
        return self

    def _columns(self, df: DataFrame) -> list[str]:
        return [c for c in dict.fromkeys([self.key, *self.features, self.y, self.w]) if c in df.columns]

    def _arm_code(self) -> Column:
        """The place of a row's arm among the arms."""
        return (F.array_position(F.array(*map(F.lit, self.arms)), F.col(self.w).cast("int")) - 1).cast("double")

    def estimate(self, df: DataFrame) -> DataFrame:
        """df with effect_k for each arm k but the least."""
        self.result = self._effect(df)
        return self.result

    def get_result(self) -> DataFrame:
        return self.result

    def output(self, path: str) -> None:
        write_result(self.result, path)

    def _model(self, estimator, df: DataFrame, inputs: Sequence[str], label: str):
        kind = estimator.copy()
        kind.setParams(featuresCol="__x", labelCol=label, predictionCol="__p")
        return Pipeline(stages=[VectorAssembler(inputCols=list(inputs), outputCol="__x", handleInvalid="keep"), kind]).fit(df.withColumn(label, F.col(label).cast("double")))

    @staticmethod
    def _apply(model, df: DataFrame, name: str, probability: int | None = None) -> DataFrame:
        out = model.transform(df)
        value = F.get(vector_to_array("probability"), F.lit(probability)) if probability is not None else F.col("__p")
        return out.select(*df.columns, value.alias(name))


class TLearner(InferenceModel):
    """A model for each arm; effects are differences to the least arm's."""

    def _fit(self, df):
        self.models = {k: self._model(self.regressor, df.filter(F.col(self.w) == k), self.features, self.y) for k in self.arms}

    def _effect(self, df):
        out = df
        for k, m in self.models.items():
            out = self._apply(m, out, f"__m{k}")
        return out.select(*df.columns, *((F.col(f"__m{k}") - F.col(f"__m{self.base}")).alias(f"effect_{k}") for k in self.arms[1:]))


class SLearner(InferenceModel):
    """One model on the features and an indicator of each arm but the least."""

    def _arm(self, df, value):
        return df.withColumns({f"__w{k}": (value == k).cast("double") for k in self.arms[1:]})

    def _fit(self, df):
        self.inputs = [*self.features, *(f"__w{k}" for k in self.arms[1:])]
        self.model = self._model(self.regressor, self._arm(df, F.col(self.w)), self.inputs, self.y)

    def _effect(self, df):
        out = df
        for k in self.arms:
            out = self._apply(self.model, self._arm(out, F.lit(k)), f"__s{k}")
        return out.select(*df.columns, *((F.col(f"__s{k}") - F.col(f"__s{self.base}")).alias(f"effect_{k}") for k in self.arms[1:]))


class XLearner(InferenceModel):
    """Models of imputed effects in either arm, weighted by the propensity."""

    def _fit(self, df):
        base = {k: self._model(self.regressor, df.filter(F.col(self.w) == k), self.features, self.y) for k in self.arms}
        self.parts = {}
        for k in self.arms[1:]:
            low = self._apply(base[k], df.filter(F.col(self.w) == self.base), "__m").withColumn("__d", F.col("__m") - F.col(self.y))
            high = self._apply(base[self.base], df.filter(F.col(self.w) == k), "__m").withColumn("__d", F.col(self.y) - F.col("__m"))
            pair = df.filter(F.col(self.w).isin(self.base, k)).withColumn("__t", (F.col(self.w) == k).cast("double"))
            self.parts[k] = self._model(self.regressor, low, self.features, "__d"), self._model(self.regressor, high, self.features, "__d"), self._model(self.classifier, pair, self.features, "__t")

    def _effect(self, df):
        out = df
        for k, (low, high, g) in self.parts.items():
            out = self._apply(g, self._apply(high, self._apply(low, out, f"__l{k}"), f"__h{k}"), f"__g{k}", 1)
        return out.select(*df.columns, *((F.col(f"__g{k}") * F.col(f"__l{k}") + (1 - F.col(f"__g{k}")) * F.col(f"__h{k}")).alias(f"effect_{k}") for k in self.arms[1:]))


class _CrossFit(InferenceModel):
    """controls: columns for the models of outcome and treatment beside the features. fold_column: a column that numbers the folds from 0; without it a hash of the key does."""

    def __init__(self, *args, controls: Sequence[str] = (), fold_column: str | None = None, **kwargs):
        super().__init__(*args, **kwargs)
        self.controls, self.fold_column = list(controls), fold_column

    def _columns(self, df):
        wanted = [*self.controls, *([self.fold_column] if self.fold_column else [])]
        if missing := set(wanted) - set(df.columns):
            raise ValueError(f"columns are missing: {sorted(missing)}")
        return list(dict.fromkeys([*super()._columns(df), *wanted]))

    @property
    def inputs(self) -> list[str]:
        return [*self.features, *self.controls]

    def _shares(self, train: DataFrame, part: DataFrame) -> DataFrame:
        """part with __pr: the probability of each arm, from a model of train."""
        model = self._model(self.classifier, train.withColumn("__arm", self._arm_code()), self.inputs, "__arm")
        return model.transform(part).select(*part.columns, vector_to_array("probability").alias("__pr"))

    def _fold(self, df):
        if self.fold_column:
            return df.withColumn("__fold", F.col(self.fold_column).cast("int"))
        return df.withColumn("__fold", F.pmod(F.xxhash64(F.col(self.key), F.lit(self.seed)), F.lit(self.folds)).cast("int"))

    def _check(self, df):
        lacking = df.groupBy("__fold").agg(F.countDistinct(self.w).alias("n")).filter(F.col("n") < len(self.arms)).count()
        if lacking:
            raise ValueError(f"{lacking} folds lack an arm")


class DRLearner(_CrossFit):
    """Doubly robust pseudo-outcomes by cross-fitting, then a regression on the features.

    The outcome has one model over features, controls and an indicator of each arm but the least; with joint=False one for
    each arm over features and controls. final: a regressor for each arm's effect; without one all are linear, by one aggregate.
    """

    def __init__(self, *args, least_propensity: float = 0.01, joint: bool = True, final=None, **kwargs):
        super().__init__(*args, **kwargs)
        self.least_propensity, self.joint, self.final = least_propensity, joint, final

    def _outcomes(self, train: DataFrame, part: DataFrame) -> DataFrame:
        """part with __m0, __m1, ...: each arm's outcome, from models of train."""
        if not self.joint:
            for i, k in enumerate(self.arms):
                part = self._apply(self._model(self.regressor, train.filter(F.col(self.w) == k), self.inputs, self.y), part, f"__m{i}")
            return part
        marks = [f"__w{i}" for i in range(1, len(self.arms))]
        at = lambda df, code: df.withColumns({m: (code == i).cast("double") for i, m in enumerate(marks, 1)})
        model = self._model(self.regressor, at(train, self._arm_code()), [*self.inputs, *marks], self.y)
        for i in range(len(self.arms)):
            part = self._apply(model, at(part, F.lit(i)), f"__m{i}")
        return part.drop(*marks)

    def _fit(self, df):
        df = self._fold(df)
        self._check(df)
        parts = []
        for f in range(self.folds):
            train, part = df.filter(F.col("__fold") != f), df.filter(F.col("__fold") == f)
            parts.append(self._outcomes(train, self._shares(train, part)))
        both = parts[0]
        for p in parts[1:]:
            both = both.unionByName(p)
        own = lambda i: F.col(f"__m{i}") + F.when(self._arm_code() == i, (F.col(self.y) - F.col(f"__m{i}")) / F.greatest(F.get("__pr", F.lit(i)), F.lit(self.least_propensity))).otherwise(0.0)
        gaps = [own(i) - own(0) for i in range(1, len(self.arms))]
        if self.final is None:
            self.models = least_squares(both, [F.lit(1.0), *map(F.col, self.features)], gaps)
        else:
            both = checkpointed(both.select(*self.features, *(g.alias(f"__psi{i}") for i, g in enumerate(gaps))))
            self.models = [self._model(self.final, both, self.features, f"__psi{i}") for i in range(len(gaps))]

    def _effect(self, df):
        if self.final is None:
            return df.withColumns({f"effect_{k}": _linear(self.models[:, i], [F.col(c) for c in self.features]) for i, k in enumerate(self.arms[1:])})
        for k, m in zip(self.arms[1:], self.models, strict=True):
            df = self._apply(m, df, f"effect_{k}")
        return df


class DML(_CrossFit):
    """Residuals of the outcome and of each arm's indicator by cross-fitting; effects linear in the features, of all arms by one aggregate. No instruments."""

    def fit(self, df: DataFrame, instruments=None) -> DML:
        if instruments is not None:
            raise ValueError("instruments are not supported")
        return super().fit(df)

    def _fit(self, df):
        df = self._fold(df)
        self._check(df)
        parts = []
        for f in range(self.folds):
            train, part = df.filter(F.col("__fold") != f), df.filter(F.col("__fold") == f)
            parts.append(self._shares(train, self._apply(self._model(self.regressor, train, self.inputs, self.y), part, "__m")))
        both = parts[0]
        for p in parts[1:]:
            both = both.unionByName(p)
        rest = [(self._arm_code() == i).cast("double") - F.get("__pr", F.lit(i)) for i in range(1, len(self.arms))]
        terms = [r * c for r in rest for c in (F.lit(1.0), *map(F.col, self.features))]
        self.final = least_squares(both, terms, [F.col(self.y) - F.col("__m")])[:, 0].reshape(len(rest), -1)

    def _effect(self, df):
        return df.withColumns({f"effect_{k}": _linear(self.final[i], [F.col(c) for c in self.features]) for i, k in enumerate(self.arms[1:])})

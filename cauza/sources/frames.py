"""Inputs: discrete sample frames, causal frames with column roles, panels, key-value rows, CSV with recoding."""

from __future__ import annotations

import importlib
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def intake(spark: SparkSession, source, names: list[str] | None = None) -> DataFrame:
    """A frame from a DataFrame, an array, a callable (given the session), a dict with node_names and data, or (names, data)."""
    if callable(source) and not isinstance(source, DataFrame):
        source = source(spark)
    if isinstance(source, dict):
        names, source = list(source["node_names"]), source["data"]
    elif isinstance(source, tuple):
        names, source = ([source[0]] if isinstance(source[0], str) else list(source[0])), source[1]
    if isinstance(source, DataFrame):
        if names is not None and len(names) != len(source.columns):
            raise ValueError(f"{len(names)} names for {len(source.columns)} columns")
        return source.toDF(*names) if names is not None else source
    data = np.asarray(source)
    if data.ndim != 2:
        raise ValueError("a matrix of samples has two dimensions")
    names = names if names is not None else [f"x{i}" for i in range(data.shape[1])]
    if len(names) != data.shape[1]:
        raise ValueError(f"{len(names)} names for {data.shape[1]} columns")
    return spark.createDataFrame([r.tolist() for r in data], names)


def batches(parts: list[DataFrame]) -> DataFrame:
    """Batches of samples as one frame."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@dataclass(frozen=True)
class CausalFrame:
    """A DataFrame with column roles. outcomes is an array column with n_period values; treat_dt is the period of treatment."""

    df: DataFrame
    features: list[str]
    treatment: str = "w"
    outcomes: str = "y"
    key: str = "id"
    n_period: int = 1
    treat_dt: int = 0
    side: list[str] = field(default_factory=list)
    categorical: list[str] = field(default_factory=list)  # those features that are categories

    def __post_init__(self):
        if unknown := set(self.categorical) - set(self.features):
            raise ValueError(f"no features: {sorted(unknown)}")
        if missing := {*self.features, self.treatment, self.outcomes, self.key, *self.side} - set(self.df.columns):
            raise ValueError(f"columns are missing: {sorted(missing)}")
        if not 0 <= self.treat_dt < self.n_period:
            raise ValueError("treat_dt has to be a period")

    def subset(self, rows: Column | None = None, features: list[str] | None = None) -> CausalFrame:
        """The rows that hold and some of the features; roles, panel and bins (columns of the frame) stay as they are."""
        if unknown := set(features or []) - set(self.features):
            raise ValueError(f"no features: {sorted(unknown)}")
        kept = [f for f in self.features if features is None or f in features]
        df = (self.df if rows is None else self.df.filter(rows)).drop(*(f for f in self.features if f not in kept))
        return replace(self, df=df, features=kept, categorical=[f for f in self.categorical if f in kept])

    def check(self) -> CausalFrame:
        """One pass over the rows: outcomes of n_period values, treatment 0 or 1."""
        bad = self.df.agg(F.sum(((F.size(self.outcomes) != self.n_period) | F.col(self.outcomes).isNull()).cast("int")).alias("y"), F.sum((~F.coalesce(F.col(self.treatment).isin(0, 1), F.lit(False))).cast("int")).alias("w")).first()
        if bad.y or bad.w:
            raise ValueError(f"{bad.y} rows with other numbers of outcomes, {bad.w} with a treatment other than 0 and 1")
        return self


def panel(rows: DataFrame, key: str, period: str, periods: list, value: Column) -> DataFrame:
    """(key, y): one aggregate for each period, in their order, missing ones 0."""
    wide = rows.groupBy(key).pivot(period, periods).agg(value)
    return wide.select(key, F.array(*(F.coalesce(F.col(f"`{p}`"), F.lit(0)).cast("double") for p in periods)).alias("y"))


def read_csv(spark: SparkSession, path: str, roles: dict[str, list[str]], treatment_info: dict | None = None) -> DataFrame:
    """A CSV with header: columns of roles are checked, treatments recoded by treatment_info."""
    df = spark.read.csv(path, header=True, inferSchema=True)
    wanted = [c for group in roles.values() for c in group]
    if missing := set(wanted) - set(df.columns):
        raise ValueError(f"columns are missing: {sorted(missing)}")
    df = df.select(*dict.fromkeys(wanted))
    for c in roles.get("treatment", []) if treatment_info else []:
        df = df.withColumn(c, recode(F.col(c), treatment_info))
    return df


def recode(value: Column, codes: dict) -> Column:
    """codes[value], null for a value without a code."""
    pairs = [F.lit(x) for k, v in codes.items() for x in (str(k), v)]
    return F.create_map(*pairs)[value.cast("string")]


def key_values(text: Column, keys: list[str], default: float = 0.0) -> Column:
    """A dense array from "k:v,k:v" text; absent keys and values that are no numbers get default."""
    found = F.str_to_map(text, F.lit(","), F.lit(":"))
    return F.array(*(F.coalesce(F.try_element_at(found, F.lit(k)).try_cast("double"), F.lit(default)) for k in keys))


def make(path: str, *args, **kwargs):
    """An object of the class at module.path.Class, for data sets and losses that a configuration names."""
    module, _, name = path.rpartition(".")
    return getattr(importlib.import_module(module), name)(*args, **kwargs)


def write_result(df: DataFrame, path: str, kind: str = "parquet") -> None:
    df.write.format(kind).save(path)

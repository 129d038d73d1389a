"""Queries that train: debiasing networks on events, continuous discovery on the panel."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..operators.debias import MODELS
from .effects import evt
from .trees import panel_frame

#: Of each network, with its default mini-batches.
EPOCHS = 10
OPTIONS = {"fairco": {"group_count": 5}, "macr": {"user": ["f1"], "item": ["f2"]}}


def _fit(name: str):
    def query(spark, sf_dir):
        df = evt(spark, sf_dir).select("event_id", "f1", "f2", "y", "T", "W", "G")
        model = MODELS[name](["f1", "f2"], **OPTIONS.get(name, {})).fit(df, EPOCHS)
        return model.predict(df).select("event_id", F.round("score", 6).alias("score"))

    query.__doc__ = f"Scores of all events by the {name} model."
    return query


def notears_adjacency(spark, sf_dir):
    """Weighted edges among standardised columns of the panel."""
    from ..operators.notears import CausalRegressionDiscovery

    p = panel_frame(spark, sf_dir).select((F.col("c_acctbal") / 3000).alias("balance"), (F.col("c_nationkey") / 8).alias("nation"), F.get("y", F.lit(0)).alias("first"), F.get("y", F.lit(6)).alias("last"))
    model = CausalRegressionDiscovery(max_iteration=math.inf).fit(p)  # the default of 3 ends before the graph is acyclic
    names = p.columns
    return spark.createDataFrame([(a, b, round(float(model.weights[i, j]), 6)) for i, a in enumerate(names) for j, b in enumerate(names)], "parent string, child string, weight double")


QUERIES = {f"{name}_fit": (_fit(name), None) for name in MODELS} | {"notears_adjacency": (notears_adjacency, None)}

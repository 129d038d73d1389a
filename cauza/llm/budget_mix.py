"""Mixing sources to target weights by a hierarchical token budget. DataFrame functions only.

Documents are leaves of a tree domain - language - source. A budget of tokens goes down the tree by the weights of the
children. A child cannot take more than ``epochs`` times the tokens below it; what it cannot take goes to its
siblings by their weights, and only what no sibling can take is left to the level above, since a parent is never given
more than its children can take. All amounts are whole numbers: a share is rounded down, so that fewer tokens than a
node has children can remain unassigned.

A leaf with budget a and s tokens gives a / s whole epochs and of one further epoch the token-prefix: its documents in
the order of md5(seed:epoch:identifier), until the rest of the budget is met; the last document gives only as many
tokens as are left (take_tokens). Prefix sums run over 4,096 hash buckets first, and only in the bucket where the
budget ends over rows, so that no leaf, however large, is ordered in one task: the window over a leaf's buckets has 4,096
rows at most.

Tokens are the runs of characters other than [\\x20\\x09-\\x0D].

Defined cases: null text has no tokens; documents without tokens go with the prefix they stand in and take 0, and a
leaf without tokens gives one whole epoch; null domain, language or source is a value of its own (``-``); a weight that
is not listed is 1; below a weight of 0 or less nothing is taken, documents without tokens included; rows that repeat an
identifier are rows of their own; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import written

#: Of the query and the pipeline. Domains come from the number at the end of the source's name.
DOMAIN_WEIGHTS = {"d0": 4, "d1": 3, "d2": 2, "d3": 1}
LANG_WEIGHTS = {"en": 4, "de": 3, "fr": 2, "es": 1}
SHARE, EPOCHS, SEED = 90, 2, 17
LEVELS = ("domain", "lang", "source")


def domain_of(source: Column) -> Column:
    """d0 to d3 by the number at the end of the source's name, - if there is none."""
    number = r"([0-9]{1,6})$"
    return F.when(source.rlike(number), F.concat(F.lit("d"), (F.regexp_extract(source, number, 1).cast("int") % 4).cast("string"))).otherwise(F.lit("-"))


def weight_of(name: Column, weights: dict[str, int]) -> Column:
    found = F.lit(1).cast("long")
    for k, v in weights.items():
        found = F.when(name == k, F.lit(v).cast("long")).otherwise(found)
    return found


def fill(nodes: DataFrame, parents: list[str], name: str) -> DataFrame:
    """Adds ``budget`` to nodes (parents, name, cap, weight, given): given is the parent's budget, cap the most a node can take."""
    order = [F.when(F.col("weight") > 0, F.col("cap") / F.col("weight")).asc_nulls_last(), F.col(name)]
    within = W.partitionBy(*parents) if parents else W.partitionBy(F.lit(0))
    before = within.orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    until = within.orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    after = within.orderBy(*order).rowsBetween(0, W.unboundedFollowing)
    w = F.greatest(F.col("weight"), F.lit(0).cast("long"))
    step = nodes.withColumns({"filled": F.coalesce(F.sum("cap").over(before), F.lit(0).cast("long")), "weights": F.sum(w).over(after)})
    step = step.withColumn("whole", F.min(((F.col("weight") > 0) & (F.col("cap") * F.col("weights") <= (F.col("given") - F.col("filled")) * F.col("weight"))).cast("int")).over(until))
    open_ = F.col("whole") == 0
    step = step.withColumns({"shares": F.max(F.when(open_, F.col("weights"))).over(within), "first_rest": F.max(F.when(open_, F.col("given") - F.col("filled"))).over(within)})
    share = F.expr("case when weight <= 0 or shares = 0 then 0 else least(cap, (first_rest * weight) div shares) end")
    return step.withColumn("budget", F.when(F.col("whole") == 1, F.col("cap")).otherwise(share)).drop("filled", "weights", "whole", "shares", "first_rest")


def _open(weights: dict[str, dict[str, int]]) -> Column:
    """Whether all weights on the way to a leaf are above 0."""
    found = F.lit(True)
    for level in LEVELS:
        found = found & (weight_of(F.col(level), weights.get(level, {})) > 0)
    return found


def budgets(supply: DataFrame, weights: dict[str, dict[str, int]], share: int, epochs: int) -> DataFrame:
    """(domain, lang, source, supply, open, budget) of each leaf of supply (domain, lang, source, supply)."""
    levels = list(LEVELS)
    # what a weight of 0 or less shuts out, on any level, has no tokens to give to the nodes above it either
    supply = supply.withColumn("open", _open(weights)).withColumn("__cap", F.when(F.col("open"), F.col("supply") * epochs).otherwise(F.lit(0).cast("long")))
    given = supply.agg(F.expr(f"coalesce(sum(supply), 0) * {share} div 100").alias("given"))
    above, keys = None, []
    for level in levels:
        nodes = supply.groupBy(*keys, level).agg(F.sum("__cap").alias("cap")).withColumn("weight", weight_of(F.col(level), weights.get(level, {})))
        # one row, or the level above: a few nodes
        nodes = nodes.crossJoin(given) if above is None else nodes.join(above, keys)
        above = fill(nodes, keys, level)
        keys = [*keys, level]
        above = above.select(*keys, F.col("budget").alias("given"))
    return supply.drop("__cap").join(above.withColumnRenamed("given", "budget"), levels)


def mix(docs: DataFrame, weights: dict[str, dict[str, int]] | None = None, share: int = SHARE, epochs: int = EPOCHS, seed: int = SEED, text: str = "text", key: str = "doc_id", lang: str = "lang", source: str = "source", domain: Column | None = None) -> DataFrame:
    """A row for each document and epoch taken: key, domain, lang, source, epoch, tokens, take_tokens."""
    weights = {"domain": DOMAIN_WEIGHTS, "lang": LANG_WEIGHTS} if weights is None else weights
    rows = docs.select(
        F.col(key).alias("id"), (domain_of(F.col(source)) if domain is None else domain).alias("domain"), F.coalesce(F.col(lang), F.lit("-")).alias("lang"), F.coalesce(F.col(source), F.lit("-")).alias("source"),
        F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("tokens"),
    )
    rows = written(rows, "mix-tokens")
    leaves = written(budgets(rows.groupBy(*LEVELS).agg(F.sum("tokens").alias("supply")), weights, share, epochs), "mix-budgets")
    planned = leaves.select(*LEVELS, F.expr("case when supply > 0 then budget div supply when open then 1 else 0 end").alias("full"), F.expr("case when supply > 0 then budget % supply else 0 end").alias("rest"))
    rows = rows.join(planned, list(LEVELS))

    whole = rows.filter("full > 0").withColumn("epoch", F.explode(F.sequence(F.lit(1).cast("long"), F.col("full")))).withColumn("take_tokens", F.col("tokens"))
    part = rows.filter("rest > 0").withColumn("epoch", F.col("full") + 1)
    part = part.withColumn("order", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("epoch").cast("string"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"))).withColumn("bucket", F.substring("order", 1, 3))
    part = written(part, "mix-part")
    over = W.partitionBy(*LEVELS).orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    sums = part.groupBy(*LEVELS, "bucket", "rest").agg(F.sum("tokens").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(over), F.lit(0).cast("long"))).filter("before < rest")
    part = part.drop("rest").join(sums, [*LEVELS, "bucket"])
    inside = part.filter("before + n <= rest").withColumn("take_tokens", F.col("tokens"))
    inner = W.partitionBy(*LEVELS, "bucket").orderBy("order", "id", "tokens").rowsBetween(W.unboundedPreceding, -1)
    edge = part.filter("before + n > rest").withColumn("at", F.col("before") + F.coalesce(F.sum("tokens").over(inner), F.lit(0).cast("long"))).filter("at < rest").withColumn("take_tokens", F.least(F.col("tokens"), F.col("rest") - F.col("at")))
    out = [F.col("id").alias(key), "domain", "lang", "source", "epoch", "tokens", "take_tokens"]
    return whole.select(*out).unionByName(inside.select(*out)).unionByName(edge.select(*out))


def _level(name: str, keys: str, parent: str, weights: dict[str, int]) -> str:
    part = f"PARTITION BY {parent}" if parent else ""
    w = "CASE " + " ".join(f"WHEN {name} = '{k}' THEN {v}" for k, v in weights.items()) + " ELSE 1 END" if weights else "1"
    given = f"(SELECT (coalesce(sum(supply), 0) * {SHARE} // 100)::BIGINT FROM leaves)" if not parent else "p.budget"
    join = "" if not parent else f"JOIN {parent.split(', ')[-1]}_budget p USING ({parent})"
    cond = "cap * weights <= (given - filled) * weight"
    return f"""
{name}_nodes AS (SELECT {keys}, (sum(supply) * {EPOCHS})::BIGINT AS cap, ({w})::BIGINT AS weight FROM leaves GROUP BY {keys}),
{name}_a AS (SELECT n.*, {given} AS given FROM {name}_nodes n {join}),
{name}_b AS (SELECT *, coalesce(sum(cap) OVER ({part} ORDER BY cap / weight, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS filled, (sum(weight) OVER ({part} ORDER BY cap / weight, {name} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS weights FROM {name}_a),
{name}_c AS (SELECT *, min(({cond})::INT) OVER ({part} ORDER BY cap / weight, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS whole FROM {name}_b),
{name}_d AS (SELECT *, max(given - filled) FILTER (whole = 0) OVER ({part}) AS first_rest, max(weights) FILTER (whole = 0) OVER ({part}) AS shares FROM {name}_c),
{name}_budget AS (SELECT {keys}, CASE WHEN whole = 1 THEN cap ELSE least(cap, (first_rest * weight) // shares) END AS budget FROM {name}_d)"""


SQL = f"""
WITH docs AS (SELECT doc_id, CASE WHEN regexp_matches(source, '[0-9]{{1,6}}$') THEN 'd' || (regexp_extract(source, '([0-9]{{1,6}})$', 1)::INT % 4) ELSE '-' END AS domain, coalesce(lang, '-') AS lang, coalesce(source, '-') AS source, coalesce(length(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS tokens FROM documents),
leaves AS (SELECT domain, lang, source, sum(tokens)::BIGINT AS supply FROM docs GROUP BY ALL),
{_level("domain", "domain", "", DOMAIN_WEIGHTS)},
{_level("lang", "domain, lang", "domain", LANG_WEIGHTS)},
{_level("source", "domain, lang, source", "domain, lang", {})},
planned AS (SELECT *, CASE WHEN supply > 0 THEN budget // supply ELSE 1 END AS epochs, CASE WHEN supply > 0 THEN budget % supply ELSE 0 END AS rest FROM source_budget JOIN leaves USING (domain, lang, source)),
taken AS (SELECT * FROM docs JOIN planned USING (domain, lang, source)),
part AS (SELECT *, epochs + 1 AS epoch, coalesce(sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5('{SEED}:' || (epochs + 1) || ':' || doc_id), doc_id, tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spot FROM taken WHERE rest > 0)
SELECT doc_id, domain, lang, source, e.epoch::BIGINT AS epoch, tokens, tokens AS take_tokens FROM taken, LATERAL (SELECT unnest(generate_series(1, epochs)) AS epoch) e
UNION ALL SELECT doc_id, domain, lang, source, epoch::BIGINT, tokens, least(tokens, rest - spot)::BIGINT FROM part WHERE spot < rest
"""

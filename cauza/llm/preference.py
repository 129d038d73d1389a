"""Preference pairs from conversations. DataFrame functions only.

Each pair has a chosen and a rejected conversation. Their longest common prefix of turns (equal role and text) is
rendered once, as the prompt; what follows is rendered as two completions. The loss mask of a completion is run-length
text: ``n:1`` for n characters that are learned from (what an assistant says, with its end mark) and ``n:0`` for the
rest (headers and other roles), in order, adding up to the completion's length.

Turns are ordered by turn, then role, then text; a turn row that is repeated as a whole counts once. Null roles are
``unknown``, null texts empty; ``<|`` in a text becomes ``< |`` so that no text can open a header.

Defined cases: a missing conversation counts as one without turns, so that prompt and its completion are empty; equal
conversations leave two empty completions; rows without a conversation identifier belong to no pair; an empty table
gives no rows; other columns of the input are not read. A pair is one output row, so a single task holds it.

The conversations table holds no pairs. branches() makes them: the rejected conversation is the chosen one up to the
middle of its turns, and goes on from there as another conversation does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, CLOSE, END = "<|", "|>\n", "<|end|>"


def render(turns: Column) -> Column:
    """Text of an array of (role, text)."""
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(START), t["role"], F.lit(CLOSE), t["text"], F.lit(END + "\n"))), "")


def mask(turns: Column, role: str) -> Column:
    """Run lengths of what render() writes: header, body with its end mark, line end."""

    def runs(t: Column) -> Column:
        head = (F.length(t["role"]) + len(START + CLOSE)).cast("string")
        body = (F.length(t["text"]) + len(END)).cast("string")
        return F.concat(head, F.lit(":0,"), body, F.when(t["role"] == role, F.lit(":1")).otherwise(F.lit(":0")), F.lit(",1:0"))

    return F.array_join(F.transform(turns, runs), ",")


def sides(turns: DataFrame, pair: Column, chosen: Column, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(pair_id, c, r): the turns of the chosen and of the rejected conversation, in order. pair: the pair that a row belongs to; chosen: whether it is of the chosen conversation."""
    rows = turns.filter(F.col(conv).isNotNull()).select(pair.alias("pair_id"), F.struct((~chosen).alias("rejected"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("unknown")).alias("role"), F.replace(F.coalesce(F.col(text), F.lit("")), F.lit("<|"), F.lit("< |")).alias("text"), F.col(conv).alias("conv")).alias("t"))
    both = rows.groupBy("pair_id").agg(F.array_sort(F.collect_set("t")).alias("all"))
    of = lambda rejected: F.filter("all", lambda t: t["rejected"] == rejected)
    return both.select("pair_id", of(False).alias("c"), of(True).alias("r"))


def format_sides(pairs: DataFrame, chosen_id: Column, rejected_id: Column, learn: str = "assistant") -> DataFrame:
    """A row for each pair of sides()."""
    shorter = F.least(F.size("c"), F.size("r"))
    same = F.transform(F.slice("c", F.lit(1), shorter), lambda t, i: (t["role"] == F.get("r", i)["role"]) & (t["text"] == F.get("r", i)["text"]))
    differs = F.array_position(same, False)
    pairs = pairs.withColumn("n", F.when(differs > 0, differs - 1).otherwise(shorter).cast("int"))
    rest = lambda side: F.slice(side, F.col("n") + 1, F.greatest(F.size(side) - F.col("n"), F.lit(0)))
    return pairs.select(
        "pair_id", chosen_id.alias("chosen_id"), rejected_id.alias("rejected_id"), F.col("n").cast("long").alias("n_common"), F.size("c").cast("long").alias("n_chosen"), F.size("r").cast("long").alias("n_rejected"),
        render(F.slice("c", F.lit(1), F.col("n"))).alias("prompt"), render(rest("c")).alias("chosen_completion"), render(rest("r")).alias("rejected_completion"), mask(rest("c"), learn).alias("chosen_mask"), mask(rest("r"), learn).alias("rejected_mask"),
    )


def _first(side: str) -> Column:
    return F.get(side, F.lit(0))["conv"]


def format_pairs(turns: DataFrame, pair: Column, chosen: Column, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", learn: str = "assistant") -> DataFrame:
    """A row for each pair of conversations, of which turns hold the rows."""
    return format_sides(sides(turns, pair, chosen, conv, turn, role, text), _first("c"), _first("r"), learn)


def branches(conversations: DataFrame) -> DataFrame:
    """Conversation 2k as chosen; as rejected the first half of its turns (rounded down), then the turns of conversation 2k + 1 behind as many."""
    found = sides(conversations, F.shiftright("conv_id", 1), F.col("conv_id").bitwiseAND(1) == 0).withColumns({"chosen_id": _first("c"), "rejected_id": _first("r")})
    half = (F.size("c") / 2).cast("int")
    tail = F.slice("r", half + 1, F.greatest(F.size("r") - half, F.lit(0)))
    return format_sides(found.withColumn("r", F.concat(F.slice("c", F.lit(1), half), tail)), F.col("chosen_id"), F.col("rejected_id"))


def _runs(side: int) -> str:
    return f"coalesce(string_agg(runs, ',' ORDER BY spot) FILTER (side = {side} AND spot > n), '')"


SQL = f"""
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS role, replace(coalesce(text, ''), '<|', '< |') AS text FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT *, conv_id >> 1 AS pair_id, conv_id & 1 AS side, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS spot,
  '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS shown, (length(role) + 5) || ':0,' || (length(text) + 7) || CASE WHEN role = 'assistant' THEN ':1' ELSE ':0' END || ',1:0' AS runs FROM t),
ids AS (SELECT pair_id, min(conv_id) FILTER (side = 0) AS chosen_id, min(conv_id) FILTER (side = 1) AS rejected_id, count(*) FILTER (side = 0) // 2 AS half FROM o GROUP BY 1),
b AS (SELECT pair_id, 0 AS side, spot, role, text, shown, runs FROM o WHERE side = 0
  UNION ALL SELECT pair_id, 1, spot, role, text, shown, runs FROM o JOIN ids USING (pair_id) WHERE side = 0 AND spot <= half
  UNION ALL SELECT pair_id, 1, spot, role, text, shown, runs FROM o JOIN ids USING (pair_id) WHERE side = 1 AND spot > half),
p AS (SELECT coalesce(c.pair_id, r.pair_id) AS pair_id, min(coalesce(c.spot, r.spot)) FILTER (c.role IS DISTINCT FROM r.role OR c.text IS DISTINCT FROM r.text) - 1 AS n, count(c.spot) AS n_chosen, count(r.spot) AS n_rejected
  FROM (SELECT * FROM b WHERE side = 0) c FULL JOIN (SELECT * FROM b WHERE side = 1) r ON c.pair_id = r.pair_id AND c.spot = r.spot GROUP BY 1),
k AS (SELECT pair_id, coalesce(n, n_chosen) AS n, n_chosen, n_rejected FROM p)
SELECT pair_id, any_value(chosen_id) AS chosen_id, any_value(rejected_id) AS rejected_id, n::BIGINT AS n_common, n_chosen, n_rejected,
  coalesce(string_agg(shown, '' ORDER BY spot) FILTER (side = 0 AND spot <= n), '') AS prompt,
  coalesce(string_agg(shown, '' ORDER BY spot) FILTER (side = 0 AND spot > n), '') AS chosen_completion, coalesce(string_agg(shown, '' ORDER BY spot) FILTER (side = 1 AND spot > n), '') AS rejected_completion,
  {_runs(0)} AS chosen_mask, {_runs(1)} AS rejected_mask
FROM b JOIN k USING (pair_id) JOIN ids USING (pair_id) GROUP BY pair_id, n, n_chosen, n_rejected
"""

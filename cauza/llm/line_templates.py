"""Line deduplication by a fixed-depth tree of line templates. DataFrame functions only.

Every line is cut into tokens at white space; tokens with a digit become ``<*>``. The tree has a level for the number
of tokens and one for each of the first ``depth`` tokens; its leaves hold lines that may share templates. A leaf has
as many templates as its lines need: among the distinct lines of a node, a token that more than half of them have at its
position is constant, any other is a variable field. Leading tokens are the same in the whole leaf and say nothing
about likeness, so a line follows the node's template if at least ``similar`` of its positions behind them hold
constants. The lines that do not are dealt out to nodes below, each by the most frequent of its tokens that are not
constant (two lines at least; ties go to the first position), where the same is done again, ``levels`` times in all. A
line that follows none is a template of its own. A template that occurs in at least ``least_docs`` documents recurs: the
document with the smallest identifier keeps such lines, all others lose them.

Lines travel as digests; texts only of leaves with more than one distinct line. Where all lines of a leaf together have
at most ``SMALL`` characters, its distinct lines meet in one task by one exchange, and all levels of the tree are windows
inside it; larger leaves are dealt out by token, level by level, with the same result. Counts are partial sums before
each shuffle; joins on hot lines are sort-merge joins of two plain exchanges, which Spark splits where a key is hot.
Texts of documents without dropped lines are not shuffled.

Defined cases: null text counts as empty, and stays an empty line; lines of white space are kept and have no template;
a document is a row's identifier and text, so rows repeated as a whole count as one and get the same result; a line of
no more than ``depth`` tokens is alone in its leaf; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import LINE_BITS, among, discard, split_by_filter, written

DEPTH, SIMILAR, LEAST_DOCS, LEVELS = 3, 0.5, 3, 3
#: Characters of a leaf that is one task's: rows and copies counted.
SMALL = 8 << 20
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]"


def canonical(line: Column) -> Column:
    """Tokens joined by one space, those with a digit masked. Regular expressions run only on lines that need them."""
    odd = line.startswith(" ") | line.endswith(" ") | line.contains("  ")
    for c in "\t\x0b\x0c\r":
        odd = odd | line.contains(c)
    even = F.when(odd, F.trim(F.regexp_replace(line, f"{SPACE}+", " "))).otherwise(line)
    return F.when(even.rlike("[0-9]"), F.regexp_replace(even, f"{WORD}*[0-9]{WORD}*", "<*>")).otherwise(even)


def _lines(docs: DataFrame, depth: int, text: str, key: str) -> DataFrame:
    """(id, th, pos, text, leaf, line) of each line with a token; digests of the path in the tree and of the masked line."""
    # inside the array, so that it is computed once for a line: above it, Spark would copy it into each use
    every = F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1), canonical)
    rows = docs.select(F.col(key).alias("id"), F.xxhash64(text).alias("th"), F.posexplode(every).alias("pos", "text")).filter("text != ''")
    n = F.length("text") - F.length(F.replace("text", F.lit(" "), F.lit(""))) + 1
    path = F.concat_ws(" ", n.cast("string"), F.substring_index("text", " ", depth))
    return rows.select("id", "th", "pos", "text", F.unhex(F.md5(path.cast("binary"))).alias("leaf"), F.unhex(F.md5(F.col("text").cast("binary"))).alias("line"))


def _name(*parts: Column) -> Column:
    return F.unhex(F.md5(F.concat_ws(" ", *parts).cast("binary")))


def templates_within(leaves: DataFrame, depth: int = DEPTH, similar: float = SIMILAR, levels: int = LEVELS) -> DataFrame:
    """templates() of leaves (leaf, texts: its distinct lines) whose lines fit a task. Everything is grouped by leaf and more, so that rows stay where the leaf is."""
    lines = leaves.filter(F.size("texts") > 1).select("leaf", F.explode("texts").alias("text")).withColumn("line", F.unhex(F.md5(F.col("text").cast("binary"))))
    tokens = F.split("text", " ")
    parts = F.filter(F.transform(tokens, lambda t, j: F.struct(j.alias("j"), t.alias("token"))), lambda p: p["j"] >= depth)
    now = lines.select("leaf", F.col("leaf").alias("node"), "line", F.size(tokens).alias("n"), F.lit(None).cast("binary").alias("template"), parts.alias("parts"))
    for _ in range(levels):
        # lines with a template or without a node below have no parts and stay one row
        of = now.withColumn("of", F.count(F.lit(1)).over(W.partitionBy("leaf", "node")))
        at = of.select("leaf", "node", "line", "n", "template", "of", F.explode_outer("parts").alias("p")).select("*", F.col("p.j").alias("j"), F.col("p.token").alias("token")).drop("p")
        at = at.withColumn("k", F.count(F.lit(1)).over(W.partitionBy("leaf", "node", "j", "token")))
        mark = F.when(F.col("j").isNotNull() & (F.col("k") > 1), F.struct("k", (-F.col("j")).alias("j"), "token", (2 * F.col("k") > F.col("of")).alias("constant")))
        held = at.groupBy("leaf", "node", "line").agg(*(F.first(c).alias(c) for c in ("n", "template")), F.collect_list(mark).alias("marks"))
        fixed = F.size(F.filter("marks", lambda m: m["constant"]))
        pick = F.array_max(F.filter("marks", lambda m: ~m["constant"]))
        held = held.select("leaf", "node", "line", "n", "template", "marks", ((F.size("marks") > 0) & (fixed >= similar * (F.col("n") - depth))).alias("follows"), pick.alias("pick"))
        goes = ~F.col("follows") & F.col("pick").isNotNull()
        below = F.when(goes, _name(F.hex("node"), F.col("pick.j").cast("string"), F.col("pick.token")))
        # a token that is alone in its node is alone below it too
        left = F.when(goes, F.transform("marks", lambda m: F.struct((-m["j"]).alias("j"), m["token"].alias("token"))))
        now = held.select("leaf", below.alias("node"), "line", "n", F.when(F.col("follows"), _name(F.lit("template"), F.hex("node"))).otherwise(F.col("template")).alias("template"), left.alias("parts"))
    return now.filter(F.col("template").isNotNull()).select("line", "template")


def templates(members: DataFrame, depth: int = DEPTH, similar: float = SIMILAR, levels: int = LEVELS) -> DataFrame:
    """(line, template) of the distinct lines members (leaf, line, tokens) that follow one."""
    now, found = members.select(F.col("leaf").alias("node"), "line", "tokens"), []
    for _ in range(levels):
        at = now.select("node", "line", F.size("tokens").alias("n"), F.posexplode("tokens").alias("j", "token")).filter(F.col("j") >= depth)
        counts = at.groupBy("node", "j", "token").agg(F.count(F.lit(1)).alias("k")).filter("k > 1")
        sizes = now.groupBy("node").agg(F.count(F.lit(1)).alias("of"))
        marks = written(counts.join(sizes, "node").select("node", "j", "token", "k", (2 * F.col("k") > F.col("of")).alias("constant")), "line-marks")
        pick = F.max(F.when(~F.col("constant"), F.struct("k", (-F.col("j")).alias("j"), "token")))
        held = written(at.join(marks, ["node", "j", "token"]).groupBy("node", "line").agg(F.first("n").alias("n"), F.sum(F.col("constant").cast("int")).alias("fixed"), pick.alias("pick")), "line-scores")
        follows = F.col("fixed") >= similar * (F.col("n") - depth)
        found.append(held.filter(follows).select("line", _name(F.lit("template"), F.hex("node")).alias("template")))
        below = held.filter(~follows & F.col("pick").isNotNull()).select("line", _name(F.hex("node"), F.col("pick.j").cast("string"), F.col("pick.token")).alias("node"))
        now = written(now.drop("node").join(below, "line"), "line-rest")
        discard(marks)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def dropped_lines(docs: DataFrame, depth: int = DEPTH, similar: float = SIMILAR, least_docs: int = LEAST_DOCS, text: str = "text", key: str = "doc_id", levels: int = LEVELS, small: int = SMALL) -> DataFrame:
    """(id, th, pos) of the lines that are dropped."""
    lines = written(_lines(docs, depth, text, key), "lines")
    size = F.sum(F.length("text").cast("long"))
    several = written(lines.groupBy("leaf").agg(F.min("line").alias("a"), F.max("line").alias("b"), size.alias("size")).filter("a != b").select("leaf", "size"), "line-leaves")
    # a leaf with one line that the filter lets through gives no template
    shared, large = split_by_filter(lines.select("leaf", "line", "text"), {"leaf": F.col("leaf")}, several, LINE_BITS)[1], several.filter(F.col("size") > small)
    spread = not large.isEmpty()
    if spread:
        shared, members = split_by_filter(shared, {"leaf": F.col("leaf")}, large, LINE_BITS)
        # copies of a line meet in its task first
        members = members.groupBy("leaf", "line").agg(F.first("text").alias("text"))
        members = written(members.select("leaf", "line", F.split("text", " ").alias("tokens")), "line-members")
    follows = templates_within(shared.groupBy("leaf").agg(F.collect_set("text").alias("texts")), depth, similar, levels)
    if spread:
        follows = follows.unionByName(templates(members, depth, similar, levels))
    follows = written(follows, "line-templates")
    alone, asked = split_by_filter(lines.select("id", "th", "pos", "line"), {"line": F.col("line")}, follows, LINE_BITS)
    named = asked.join(follows, "line", "left").select("id", "th", "pos", F.coalesce("template", "line").alias("template"))
    named = written(named.unionByName(alone.withColumnRenamed("line", "template")), "line-names")
    recurring = named.groupBy("template", "id", "th").agg(F.lit(1).alias("one")).groupBy("template").agg(F.count(F.lit(1)).alias("docs"), F.min("id").alias("first_id")).filter(F.col("docs") >= least_docs).select("template", "first_id")
    recurring = written(recurring, "line-recurring")
    discard(lines, several, follows, *([members] if spread else []))
    return among(named, recurring, {"template": F.col("template")}, LINE_BITS).filter(~F.col("id").eqNullSafe(F.col("first_id"))).select("id", "th", "pos")


def line_dedup(docs: DataFrame, depth: int = DEPTH, similar: float = SIMILAR, least_docs: int = LEAST_DOCS, text: str = "text", key: str = "doc_id", levels: int = LEVELS) -> DataFrame:
    """(key, n_lines, n_dropped, kept_text) for each row of docs."""
    drops = written(dropped_lines(docs, depth, similar, least_docs, text, key, levels).groupBy("id", "th").agg(F.collect_set("pos").alias("drops")), "line-drops")
    rows = docs.select(F.col(key).alias("id"), F.xxhash64(text).alias("th"), F.col(text).alias("text"))
    whole, asked = split_by_filter(rows, {"id": F.col("id"), "th": F.col("th")}, drops, LINE_BITS)
    both = asked.alias("a").join(drops.alias("b"), F.col("a.id").eqNullSafe(F.col("b.id")) & (F.col("a.th") == F.col("b.th")), "left").select("a.*", "drops")
    both = both.unionByName(whole.withColumn("drops", F.lit(None).cast("array<int>"))).select("id", F.split(F.coalesce("text", F.lit("")), "\n").alias("lines"), "drops")
    kept = F.when(F.col("drops").isNull(), F.col("lines")).otherwise(F.filter("lines", lambda line, i: ~F.array_contains("drops", i)))
    both = both.select(F.col("id").alias(key), F.size("lines").cast("long").alias("n_lines"), kept.alias("kept"))
    return both.select(key, "n_lines", (F.col("n_lines") - F.size("kept")).alias("n_dropped"), F.array_join("kept", "\n").alias("kept_text"))


def _level(i: int) -> str:
    """One level of the tree: nodes of the lines that are left, tokens and their counts, followers, and the lines' next nodes."""
    return f"""
spots{i} AS (SELECT * FROM (SELECT node, line, n, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS j FROM rest{i}) WHERE j > {DEPTH}),
marks{i} AS (SELECT node, j, token, k, 2 * k > total AS constant FROM (SELECT node, j, token, count(*) AS k FROM spots{i} GROUP BY ALL) JOIN (SELECT node, count(*) AS total FROM rest{i} GROUP BY node) USING (node) WHERE k > 1),
both{i} AS (SELECT * FROM spots{i} JOIN marks{i} USING (node, j, token)),
picks{i} AS (SELECT line, j, token FROM both{i} WHERE NOT constant QUALIFY row_number() OVER (PARTITION BY line ORDER BY k DESC, j) = 1),
follows{i} AS (SELECT node, line FROM both{i} GROUP BY node, line HAVING count(*) FILTER (constant) >= {SIMILAR} * (any_value(n) - {DEPTH})),
rest{i + 1} AS (SELECT r.node || chr(10) || p.j || ' ' || p.token AS node, r.line, r.n, r.tokens FROM rest{i} r JOIN picks{i} p USING (line) WHERE r.line NOT IN (SELECT line FROM follows{i}))"""


SQL = f"""
WITH docs AS (SELECT DISTINCT doc_id, coalesce(text, '') AS text FROM documents),
raw AS (SELECT doc_id, text, u.pos - 1 AS pos, u.raw FROM docs, LATERAL (SELECT unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS pos) u),
cut AS (SELECT doc_id, text, pos, list_filter(regexp_split_to_array(regexp_replace(raw, '{WORD}*[0-9]{WORD}*', '<*>', 'g'), '{SPACE}+'), lambda t: t != '') AS tokens FROM raw),
lines AS (SELECT doc_id, text, pos, tokens, len(tokens) AS n, array_to_string(tokens, ' ') AS line, len(tokens) || ' ' || array_to_string(tokens[1:{DEPTH}], ' ') AS leaf FROM cut WHERE len(tokens) > 0),
rest0 AS (SELECT leaf AS node, line, any_value(n) AS n, any_value(tokens) AS tokens FROM lines WHERE leaf IN (SELECT leaf FROM lines GROUP BY leaf HAVING min(line) != max(line)) GROUP BY leaf, line),
{",".join(map(_level, range(LEVELS)))},
follows AS ({" UNION ALL ".join(f"SELECT line, 'node ' || node AS template FROM follows{i}" for i in range(LEVELS))}),
named AS (SELECT l.*, coalesce(f.template, 'line ' || l.line) AS template FROM lines l LEFT JOIN follows f ON f.line = l.line),
recurring AS (SELECT template, min(doc_id) AS first_id FROM (SELECT DISTINCT template, doc_id, text FROM named) GROUP BY template HAVING count(*) >= {LEAST_DOCS}),
drops AS (SELECT doc_id, text, pos FROM named JOIN recurring USING (template) WHERE doc_id != first_id),
kept AS (SELECT r.doc_id, r.text, count(*) AS n_lines, count(d.pos) AS n_dropped, coalesce(string_agg(r.raw, chr(10) ORDER BY r.pos) FILTER (d.pos IS NULL), '') AS kept_text FROM raw r LEFT JOIN drops d ON d.doc_id = r.doc_id AND d.text = r.text AND d.pos = r.pos GROUP BY r.doc_id, r.text)
SELECT d.doc_id, n_lines, n_dropped, sha256(kept_text) AS kept_sha256 FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents) d JOIN kept k ON k.doc_id = d.doc_id AND k.text = d.text
"""

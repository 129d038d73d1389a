"""Queries of causal graphs over tables: edges from region over nation to market segment, search, beliefs, attribution."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import factors as X
from ..operators import graph as G
from ..operators.belief import Attribution, GraphInferModel
from ..operators.discovery import CausalSearchDiscovery, node_order
from ..session import table
from ..sources.shared import new_path
from .discrete import DISC, NODES, disc

CAP = 3


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(parent, child, weight): regions to nations, nations to the segments of their customers, by number of customers."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    c = table(spark, sf_dir, "customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 rows
    down = c.groupBy(F.col("n_name").alias("parent"), F.col("c_mktsegment").alias("child")).agg(F.count(F.lit(1)).cast("double").alias("weight"))
    up = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("parent"), F.col("n_name").alias("child"), F.lit(1.0).alias("weight"))
    return up.unionByName(down)


EDGES = """edges AS (SELECT r_name AS parent, n_name AS child, 1.0::DOUBLE AS weight FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT n_name, c_mktsegment, count(*)::DOUBLE FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL)"""
_REACH = "SELECT child AS node, parent AS ancestor FROM {e} UNION SELECT up.node, e.parent FROM up JOIN {e} e ON e.child = up.ancestor"


def graph_ancestors(spark, sf_dir):
    return G.ancestors(edges(spark, sf_dir))


def graph_is_cyclic(spark, sf_dir):
    """Of the edges, and with one from each segment back to the regions."""
    own = edges(spark, sf_dir)
    back = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("parent")).distinct().crossJoin(F.broadcast(table(spark, sf_dir, "region").select(F.col("r_name").alias("child")))).withColumn("weight", F.lit(1.0))  # five rows each
    return G.is_cyclic(own).withColumn("graph", F.lit("edges")).unionByName(G.is_cyclic(own.unionByName(back)).withColumn("graph", F.lit("with back edges")))


def graph_merge_edges(spark, sf_dir):
    """Edges of customers' segments and of suppliers' nations as one graph."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    s = table(spark, sf_dir, "supplier").select("s_nationkey").distinct().join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey"))
    other = s.join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("parent"), F.col("n_name").alias("child"))
    return G.merge_edges(edges(spark, sf_dir), other)


def graph_topk_parents(spark, sf_dir):
    return G.top_parents(edges(spark, sf_dir), 2)


def _graph(spark, sf_dir, back: bool = False) -> G.CausalGraph:
    """The edges in a graph object, heaviest first, at most CAP parents a node; back: then each edge of the graph the other way round, all of which close a cycle."""
    rows = [(r.parent, r.child) for r in edges(spark, sf_dir).orderBy(F.desc("weight"), "parent", "child").collect()]  # 25 nations by five segments
    out = G.CausalGraph(sorted({x for r in rows for x in r}))
    taken = [(parent, child) for parent, child in rows if out.add_edge(parent, child, CAP)]
    if back and any(out.add_edge(child, parent) for parent, child in taken):
        raise RuntimeError("an edge that closes a cycle was taken")
    return out


def graph_store(spark, sf_dir):
    """A graph built edge by edge, without some edges, written by name and by index, and loaded again."""
    graph = _graph(spark, sf_dir, back=True).copy()
    for child in graph.names:
        for parent in list(graph.parents[child]):
            if parent.startswith("A"):
                graph.remove_edge(parent, child)
    by_name, by_index = new_path(spark, "graph"), new_path(spark, "graph-index")
    graph.save(spark, by_name)
    graph.save(spark, by_index, by_index=True)
    loaded, numbers = G.CausalGraph.load(spark, by_name), G.CausalGraph.load(spark, by_index)
    named = [(graph.names[int(p)], graph.names[int(c)]) for p, c in numbers.edges()]
    if sorted(named) != sorted(loaded.edges()):
        raise RuntimeError("the two files hold unlike graphs")
    return loaded.frame(spark)


def graph_merged(spark, sf_dir):
    """A graph merged with an empty one, all edges kept, no mutation; its parents are within the cap."""
    graph = _graph(spark, sf_dir)
    return graph.merge(G.CausalGraph(graph.names), 1.0, 1.0, 0.0, CAP).frame(spark)


KEPT = f"WITH {EDGES}, kept AS (SELECT parent, child FROM (SELECT parent, child, row_number() OVER (PARTITION BY child ORDER BY weight DESC, parent) AS i FROM edges) WHERE i <= {CAP})"

# search: quantity and line number, each with a coarser copy of itself
SEARCH = ["fine", "coarse", "line", "late"]
ORDER_SEED, GAIN = 5, 20.0


def _search_frame(spark, sf_dir) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.ceil(F.col("l_quantity") / 10).cast("int").alias("fine"), (F.col("l_quantity") > 25).cast("int").alias("coarse"), F.col("l_linenumber").cast("int").alias("line"), (F.col("l_linenumber") > 3).cast("int").alias("late"))


def k2_search(spark, sf_dir):
    """Edges that the search finds."""
    graph, _ = CausalSearchDiscovery(edge_gain=GAIN, seed=ORDER_SEED).fit(_search_frame(spark, sf_dir)).get_result()
    return graph.frame(spark)


def k2_search_score(spark, sf_dir):
    _, score = CausalSearchDiscovery(edge_gain=GAIN, seed=ORDER_SEED).fit(_search_frame(spark, sf_dir), target_name="late").get_result()
    return spark.createDataFrame([(round(float(score), 3),)], "score double")


def k2_search_jobs(spark, sf_dir):
    """Edges of the search with and without families counted ahead, and the jobs that each took over the distinct rows."""
    rows = []
    for counted in (2, 0):
        own = CausalSearchDiscovery(edge_gain=GAIN, seed=ORDER_SEED, counted=counted).fit(_search_frame(spark, sf_dir))
        rows += [(p, c, counted, own.jobs == 1) for p, c in own.get_result()[0].edges()]
    return spark.createDataFrame(rows, "parent string, child string, counted int, one_job boolean")


def _family(node: str, parents: list[str]) -> str:
    group = f"GROUP BY {', '.join(parents)}" if parents else ""
    cells = f"SELECT {', '.join([*parents, node])}, count(*) AS n FROM base GROUP BY ALL"
    return f"SELECT '{node}' AS node, '{','.join(parents)}' AS pa, (SELECT sum(lgamma(r) - lgamma(r + n_pa) + cell) FROM (SELECT sum(n) AS n_pa, sum(lgamma((n + 1)::DOUBLE)) AS cell FROM ({cells}) {group}), (SELECT count(DISTINCT {node})::DOUBLE AS r FROM base)) AS score"


def _search_sql(target: str | None, out: str) -> str:
    """Greedy search, one CTE group for each step: parents so far, what reaches what, candidates, the best one."""
    names, limit = sorted(SEARCH), max(1, len(SEARCH) // 2)
    families = [(n, sorted(p)) for n in names for k in range(limit + 1) for p in combinations([m for m in names if m != n], k)]
    ctes = ["base AS (SELECT ceil(l_quantity / 10)::INT AS fine, (l_quantity > 25)::INT AS coarse, l_linenumber::INT AS line, (l_linenumber > 3)::INT AS late FROM lineitem)", f"fam AS ({' UNION ALL '.join(_family(*f) for f in families)})", "e0 AS (SELECT NULL::VARCHAR AS parent, NULL::VARCHAR AS child WHERE FALSE)"]
    k = 0
    for node in node_order(SEARCH, ORDER_SEED, target):
        for _ in range(limit):
            barred = f"AND m.name != '{target}'" if target else ""
            ctes += [
                f"now{k} AS (SELECT coalesce(list(parent ORDER BY parent), []::VARCHAR[]) AS pa FROM e{k} WHERE child = '{node}')",
                f"reach{k} AS (SELECT child AS node, parent AS anc FROM e{k} UNION SELECT r.node, e.parent FROM reach{k} r JOIN e{k} e ON e.child = r.anc)",
                f"try{k} AS (SELECT m.name AS parent, array_to_string(list_sort(list_append(pa, m.name)), ',') AS pa, array_to_string(pa, ',') AS own FROM (VALUES {', '.join(f"('{n}')" for n in names if n != node)}) m(name), now{k} WHERE NOT list_contains(pa, m.name) AND m.name NOT IN (SELECT r.node FROM reach{k} r WHERE r.anc = '{node}') {barred})",
                f"best{k} AS (SELECT t.parent, f.score - o.score AS gain FROM try{k} t JOIN fam f ON f.node = '{node}' AND f.pa = t.pa JOIN fam o ON o.node = '{node}' AND o.pa = t.own ORDER BY round(f.score, 6) DESC, t.parent LIMIT 1)",
                f"e{k + 1} AS (SELECT * FROM e{k} UNION ALL SELECT parent, '{node}' FROM best{k} WHERE gain > {GAIN})",
            ]
            k += 1
    ctes.append(f"found AS (SELECT * FROM e{k})")
    return f"WITH RECURSIVE {', '.join(ctes)} {out}"


K2_SCORE = "SELECT round(sum(f.score), 3) AS score FROM (SELECT n.name, coalesce((SELECT string_agg(parent, ',' ORDER BY parent) FROM found WHERE child = n.name), '') AS pa FROM (VALUES " + ", ".join(f"('{n}')" for n in SEARCH) + ") n(name)) x JOIN fam f ON f.node = x.name AND f.pa = x.pa"

BELIEF = {"x0": ["x1"], "x3": ["x2"], "x4": ["x3"], "x5": ["x0"]}
RULES = {"x0": ["x1", "x3"]}
DO, LABEL, THRESHOLD = 5, 1, 0.3345


def _model(parents: dict, treatment: str, label: str, **options) -> GraphInferModel:
    graph = G.CausalGraph(NODES)
    for child, found in parents.items():
        for p in found:
            graph.add_edge(p, child)
    return GraphInferModel(graph=graph, treatment_name=treatment, label_name=label, **options)


def graph_do_belief_tables(spark, sf_dir):
    """The same beliefs by joins of message tables, nothing but them collected."""
    return graph_do_belief(spark, sf_dir, most_cells=0)


def graph_do_belief(spark, sf_dir, **options):
    """Beliefs of all nodes after x3 is set to 5, given x2 = 1."""
    beliefs = _model(BELIEF, "x3", "x4", **options).fit(disc(spark, sf_dir)).estimate({"x2": 1}, DO)
    return spark.createDataFrame([(n, int(v), round(float(s), 5)) for n, (values, scores) in beliefs.items() for v, s in zip(values, scores)], "node string, value int, belief double")


def _joint(names: list[str]) -> str:
    """Smoothed joint frequencies of observed combinations."""
    product = " * ".join(f"(SELECT count(DISTINCT {n}) FROM disc)" for n in names)
    return f"f_{'_'.join(names)} AS (SELECT {', '.join(names)}, (1 + count(*)) / ({product} + (SELECT count(*) FROM disc))::DOUBLE AS s FROM disc GROUP BY ALL)"


def _share(node: str, source: str) -> str:
    return f"SELECT '{node}' AS node, {node} AS value, sum(s) / (SELECT sum(s) FROM {source}) AS belief FROM {source} GROUP BY {node}"


BELIEF_SQL = f"""WITH {DISC}, {_joint(['x1'])}, {_joint(['x0', 'x1'])}, {_joint(['x5', 'x0'])}, {_joint(['x4', 'x3'])},
chain AS (SELECT x0, x1, x5, a.s * b.s * c.s AS s FROM f_x1 a JOIN f_x0_x1 b USING (x1) JOIN f_x5_x0 c USING (x0)), tail AS (SELECT x4, s FROM f_x4_x3 WHERE x3 = {DO}),
seen AS ({_share('x0', 'chain')} UNION ALL {_share('x1', 'chain')} UNION ALL {_share('x5', 'chain')} UNION ALL {_share('x4', 'tail')}
  UNION ALL SELECT DISTINCT 'x2', x2, (x2 = 1)::INT::DOUBLE FROM disc UNION ALL SELECT DISTINCT 'x3', x3, (x3 = {DO})::INT::DOUBLE FROM disc)
SELECT n.node, n.value, round(coalesce(s.belief, 0), 5) AS belief FROM ({" UNION ALL ".join(f"SELECT DISTINCT '{n}' AS node, {n} AS value FROM disc" for n in NODES)}) n LEFT JOIN seen s USING (node, value)"""


def attribution_rules(spark, sf_dir):
    """Rules of one and two conditions under which x0 = 1 reaches the threshold once x3 is set."""
    rules = Attribution(THRESHOLD, max_step=2, inferencer=_model(RULES, "x3", "x0")).attribute(disc(spark, sf_dir), DO, LABEL)
    return spark.createDataFrame([(", ".join(f"{k} = {v}" for k, v in sorted(rule.items())), round(score, 6)) for rule, score in rules], "rule string, score double")


_FREE = [n for n in NODES if n not in ("x0", "x3")]
RULES_SQL = f"""WITH {DISC}, {_joint(['x1'])}, {_joint(['x0', 'x1', 'x3'])}, j AS (SELECT x0, x1, a.s * b.s AS s FROM f_x0_x1_x3 a JOIN f_x1 b USING (x1) WHERE x3 = {DO}),
own AS (SELECT x1, sum(s) FILTER (x0 = {LABEL}) / sum(s) AS score FROM j GROUP BY x1), whole AS (SELECT sum(s) FILTER (x0 = {LABEL}) / sum(s) AS score FROM j),
singles AS (SELECT 'x1' AS node, x1 AS value, round(score, 9) AS score FROM own UNION ALL {" UNION ALL ".join(f"SELECT DISTINCT '{n}', {n}, round(w.score, 9) FROM disc, whole w" for n in _FREE if n != 'x1')}),
grown AS (SELECT s.node, s.value, o.node AS other, o.value AS more FROM singles s JOIN singles o ON o.node != s.node WHERE s.score < {THRESHOLD} QUALIFY row_number() OVER (PARTITION BY s.node, s.value ORDER BY o.score DESC, o.node, o.value) = 1),
pairs AS (SELECT DISTINCT CASE WHEN node < other THEN node ELSE other END AS n1, CASE WHEN node < other THEN value ELSE more END AS v1, CASE WHEN node < other THEN other ELSE node END AS n2, CASE WHEN node < other THEN more ELSE value END AS v2 FROM grown),
scored AS (SELECT p.*, CASE WHEN n1 = 'x1' THEN (SELECT score FROM own WHERE x1 = v1) WHEN n2 = 'x1' THEN (SELECT score FROM own WHERE x1 = v2) ELSE (SELECT score FROM whole) END AS score FROM pairs p)
SELECT node || ' = ' || value AS rule, round(score, 6) AS score FROM singles WHERE score >= {THRESHOLD} UNION ALL SELECT n1 || ' = ' || v1 || ', ' || n2 || ' = ' || v2, round(score, 6) FROM scored WHERE score >= {THRESHOLD}"""


def factor_rows(spark, sf_dir):
    """The rows of a factor in the order of x5, with what they stand for."""
    f = X.sort_factor(X.factor(disc(spark, sf_dir), "x0", ["x1", "x5"]), "x5")
    return f.select(X.row_names(["x0", "x1", "x5"]).alias("name"), F.round("score", 9).alias("score"))


FACTOR_ROWS = f"WITH {DISC}, {_joint(['x0', 'x1', 'x5'])} SELECT 'x0 = ' || x0 || ' x1 = ' || x1 || ' x5 = ' || x5 AS name, round(s, 9) AS score FROM f_x0_x1_x5 ORDER BY x5, x0, x1"

MERGE = f"WITH {EDGES} SELECT DISTINCT parent, child FROM (SELECT parent, child FROM edges UNION ALL SELECT r_name, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"
TOPK = f"WITH {EDGES} SELECT * FROM (SELECT parent, child, weight, row_number() OVER (PARTITION BY child ORDER BY weight DESC, parent)::INT AS place FROM edges) WHERE place <= 2"
ANCESTORS = f"WITH RECURSIVE {EDGES}, up AS ({_REACH.format(e='edges')}) SELECT node, ancestor FROM up"
CYCLIC = f"WITH RECURSIVE {EDGES}, more AS (SELECT parent, child FROM edges UNION ALL SELECT DISTINCT c_mktsegment, r_name FROM customer, region), up AS ({_REACH.format(e='more')}) SELECT count(*) FILTER (node = ancestor) > 0 AS is_cyclic, 'with back edges' AS graph FROM up UNION ALL SELECT count(*) FILTER (node = ancestor) > 0, 'edges' FROM ({ANCESTORS})"

QUERIES = {
    "graph_ancestors": (graph_ancestors, ANCESTORS), "graph_is_cyclic": (graph_is_cyclic, CYCLIC), "graph_merge_edges": (graph_merge_edges, MERGE), "graph_topk_parents": (graph_topk_parents, TOPK),
    "graph_store": (graph_store, f"{KEPT} SELECT parent, child FROM kept WHERE parent NOT LIKE 'A%'"), "graph_merged": (graph_merged, f"{KEPT} SELECT parent, child FROM kept"),
    "k2_search": (k2_search, _search_sql(None, "SELECT parent, child FROM found")), "k2_search_jobs": (k2_search_jobs, _search_sql(None, "SELECT parent, child, k::INT AS counted, k = 2 AS one_job FROM found, (VALUES (2), (0)) v(k)")), "k2_search_score": (k2_search_score, _search_sql("late", K2_SCORE)),
    "graph_do_belief": (graph_do_belief, BELIEF_SQL), "graph_do_belief_tables": (graph_do_belief_tables, BELIEF_SQL), "attribution_rules": (attribution_rules, RULES_SQL), "factor_rows": (factor_rows, FACTOR_ROWS),
}

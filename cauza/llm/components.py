"""Connected components of an edge table, without collecting any of it."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, lean, written


#: Links that a task contracts together, and nodes that it remembers at once.
TOGETHER, REMEMBERED = 250_000, 500_000


def stars(edges: DataFrame, remembered: int = REMEMBERED) -> DataFrame:
    """(a, b): for the edges (a, b) that each task reads, every node with the least one that it hangs together with there. Of more nodes than are remembered, a task starts anew, and so gives more stars."""

    def run(batches):
        up: dict[int, int] = {}

        def root(x: int) -> int:
            while (y := up.get(x, x)) != x:
                up[x] = x = up.get(y, y)
            return x

        def found():
            nodes = list(up)
            for at in range(0, len(nodes), 100_000):
                some = nodes[at : at + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(map(root, some), pa.int64())], ["a", "b"])

        for batch in batches:
            for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x, y = root(x), root(y)
                if x != y:
                    up[max(x, y)] = min(x, y)
            if len(up) > remembered:
                yield from found()
                up = {}
        yield from found()

    return edges.mapInArrow(lean(run), "a bigint, b bigint")


def components(edges: DataFrame, together: int = TOGETHER, remembered: int = REMEMBERED) -> DataFrame:
    """(node, root) for each node of edges (a, b): root is the smallest node of its component.

    First tasks of ``together`` links or so contract what they read to stars; where all links are one task's, that is the
    result. Else two steps alternate (Kiveris et al., 2014): each node hands its larger neighbours to its least neighbour,
    then its smaller ones. Components shrink to stars in about log^2 of their size in rounds, and rounds go on until
    nothing changes. Least neighbours are aggregates with partial sums before the shuffle, and the joins with them are
    split by Spark where a hub is hot. The table of a round goes when the next one is written.
    """
    found = written(edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    n = found.count()
    tasks = max(1, -(-n // together))
    now = written(stars(found.coalesce(tasks), remembered), "links")
    discard(found)
    if tasks == 1 and 2 * n <= remembered:
        return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b"), F.col("b"))).distinct()
    seen = None
    while True:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").filter("b != m").select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b"))
        before, now = now, written(small.union(low.select("a", F.col("m").alias("b"))).filter("a != b").distinct(), "links")
        discard(before)
        state = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == seen:
            break
        seen = state
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b"), F.col("b"))).distinct()

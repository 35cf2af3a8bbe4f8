"""Connected components of an edge table by random star contraction.

Each round every node picks, among itself and its neighbours, the node with the
smallest per-round hash, and the graph is contracted along these picks: edges
move to the picked nodes, inner edges vanish. Random priorities shrink any
graph (also long chains) by a constant factor a round, so the number of rounds
grows with the logarithm of the largest component. Picks are grouped minima
with map-side combine and the moves are joins that Spark can split, so a node
with very many links loads no single task. Nothing but the number of edges left
reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.llm.common import materialise


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of ``edges`` (long columns a, b); all nodes of a
    component, and only they, share a root. Loops and repeated edges are fine;
    an empty table gives an empty result."""
    both = lambda e: e.select("a", "b").union(e.select("b", "a"))
    e = materialise(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
                    .distinct(), "components-edges")
    levels: list[DataFrame] = []
    while not e.isEmpty():
        seed = len(levels)
        rank = lambda c: F.struct(F.xxhash64(F.lit(seed), F.col(c)).alias("h"), F.col(c).alias("n"))
        pick = (both(e).groupBy("a").agg(F.min(rank("b")).alias("m"))
                .select(F.col("a").alias("node"), F.least(rank("a"), F.col("m"))["n"].alias("up")))
        pick = materialise(pick, "components-level")
        levels.append(pick)
        moved = (e.join(pick.withColumnsRenamed({"node": "a", "up": "x"}), "a")
                 .join(pick.withColumnsRenamed({"node": "b", "up": "y"}), "b")
                 .where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        e = materialise(moved, "components-edges")
    if not levels:
        return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = levels[-1].withColumnRenamed("up", "root")
    for pick in reversed(levels[:-1]):
        later = out.withColumnsRenamed({"node": "up", "root": "r"})
        out = materialise(pick.join(later, "up", "left").select("node", F.coalesce("r", "up").alias("root")),
                          "components-level")
    return out

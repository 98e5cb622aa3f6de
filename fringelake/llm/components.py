"""Connected components of an edge table by random contraction.

Every round each node moves to the neighbour (or itself) that a hash of the round puts
first; edges are carried to the new nodes, loops and repeats go. In expectation
a constant share of the nodes of every component goes per round, whatever its shape.
Tables are written between rounds; only their row counts reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fringelake.llm.common import forget, save


def components(edges: DataFrame) -> DataFrame:
    """Edges (a, b) of any number, both directions allowed, to (node, comp): one row per node that
    has an edge, comp being a node of the same component."""
    edges, at = save(edges.select("a", "b").filter("a <> b").distinct(), "edges")
    labels, labels_at, turn = None, None, 0
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        order = F.xxhash64(F.lit(turn), "n")
        ranked = both.select("a", F.col("b").alias("n")).union(both.select("a", F.col("a").alias("n")))
        moves, moves_at = save(ranked.groupBy("a").agg(F.min(F.struct(order.alias("o"), "n"))
                                                       .alias("m")).select("a", "m.n"), "moves")
        if labels is None:
            new = moves.select(F.col("a").alias("node"), F.col("n").alias("comp"))
        else:
            new = (labels.join(moves, labels.comp == moves.a, "left")
                   .select("node", F.coalesce("n", "comp").alias("comp")))
        new, new_at = save(new, "labels")
        one = edges.join(moves, "a").select(F.col("n").alias("a"), "b")
        two = one.join(moves.withColumnRenamed("a", "b"), "b").select("a", F.col("n").alias("b"))
        two = two.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        next_edges, next_at = save(two.distinct(), "edges")
        forget(edges.sparkSession, at, moves_at, *([labels_at] if labels_at else []))
        edges, at, labels, labels_at, turn = next_edges, next_at, new, new_at, turn + 1
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("comp"))
    return labels

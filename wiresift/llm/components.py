"""Connected components of an edge table, by alternating large and small stars.

Each round hangs every node's neighbours on the smallest of them, first those
that are larger than the node, then the smaller ones. Edges never grow in number,
rounds are few (they follow the logarithm of the longest path), and every round
is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from wiresift.llm.common import stored

ROUNDS = 60


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("_b")).select("a", F.least("a", "_b").alias("root"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("root").alias("b")).where("a != b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("root"))
    hung = down.join(least, "a").select(F.col("b").alias("a"), F.col("root").alias("b")).where("a != b")
    return hung.union(least.select("a", F.col("root").alias("b"))).distinct()


def _mark(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0)).alias("x")).first()
    return row["n"], row["x"]


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that an edge (a, b) touches; the root is the smallest node that it is connected to.

    Loops from a node to itself and repeated edges change nothing; an empty table gives no rows.
    """
    edges = stored(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = _mark(edges)
    for _ in range(ROUNDS):
        edges = stored(_small_star(_large_star(edges)), "edges")
        before, mark = mark, _mark(edges)
        if mark == before:
            break
    else:
        raise RuntimeError("the components did not settle")
    roots = edges.select(F.col("b").alias("node")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots.select("node", F.col("node").alias("root")))

"""Connected components of an edge table, by joins and checkpoints only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _small_star(e: DataFrame) -> DataFrame:
    """Each node keeps its smallest smaller neighbour and hands the others on to it.

    A node's smaller neighbours are as few as the links found for it.
    """
    low = e.groupBy("v").agg(F.min("u").alias("m"))
    return (e.join(low, "v")
            .select(F.explode(F.array(F.struct(F.col("v"), F.col("m").alias("u")),
                                      F.struct(F.col("u").alias("v"), F.col("m").alias("u")))).alias("x"))
            .select("x.v", "x.u").where("v <> u").distinct())


def _large_star(e: DataFrame) -> DataFrame:
    """Each node's larger neighbours move to the smallest node beside it.

    The smallest nodes are a table, so that the join splits a hub with very many
    larger neighbours, which is never gathered.
    """
    both = e.select(F.col("u").alias("n"), F.col("v").alias("w")).unionByName(e.select(F.col("v").alias("n"), F.col("u").alias("w")))
    least = materialize(both.groupBy("n").agg(F.least(F.col("n"), F.min("w")).alias("m")), "least")
    return e.join(least, e["u"] == least["n"]).select("v", F.col("m").alias("u")).distinct()


def _unfinished(e: DataFrame) -> bool:
    """Whether some node has two parents, or a parent that has one itself."""
    ends = e.select(F.col("v").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        e.select(F.col("u").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    seen = ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return not seen.where("up > 1 OR up = 1 AND down = 1").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b: long); root is the smallest node reachable.

    Small and large stars take turns until every node hangs on its root; the
    number of rounds grows with the logarithm of a chain's length (a chain of 800
    takes about 11). Every round is a table in the shared folder, so nothing is
    held by an executor alone.
    """
    e = edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).where("v <> u").distinct()
    e = materialize(_small_star(materialize(e, "edges")), "edges")
    while _unfinished(e):
        e = materialize(_small_star(materialize(_large_star(e), "edges")), "edges")
    roots = e.select(F.col("u").alias("node")).distinct().withColumn("root", F.col("node"))
    return e.select(F.col("v").alias("node"), F.col("u").alias("root")).unionByName(roots)

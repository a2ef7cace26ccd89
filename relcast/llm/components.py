"""Connected components by contraction, on Spark tables only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, shared_table


TASK_EDGES = 100_000  # edges that one task writes


def components(edges: DataFrame) -> DataFrame:
    """(a, b) edges -> (node, component) for every node of an edge; component is its smallest node.

    Each round points every node at its smallest neighbour's smallest neighbour and replaces edges by
    the edges between those; the edge list shrinks until none is left.  Rounds end in shared tables, written by as many
    tasks as the edges of the round are worth."""
    with Scratch(edges.sparkSession) as scratch:
        some = edges.sparkSession.sparkContext.defaultParallelism
        write = lambda df, name, n: shared_table(df.coalesce(max(some, n // TASK_EDGES)), name)
        given = shared_table(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b"), "links")
        n = given.count()
        left = write(given.distinct(), "edges", n)
        label = left.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("component", F.col("node"))
        first = n
        while n:
            near = (left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
                    .groupBy("a").agg(F.min("b").alias("p")).select(F.col("a").alias("u"), F.least("a", "p").alias("p")))
            near = write(near, "parents", n)
            jump = near.join(near.select(F.col("u").alias("p"), F.col("p").alias("q")), "p").select("u", "q")
            jump = write(jump, "jumps", n)
            label = write(label.join(jump, label["component"] == jump["u"], "left")
                          .select("node", F.coalesce("q", "component").alias("component")), "labels", first)
            nxt = (left.join(jump.select(F.col("u").alias("a"), F.col("q").alias("qa")), "a")
                   .join(jump.select(F.col("u").alias("b"), F.col("q").alias("qb")), "b")
                   .select(F.least("qa", "qb").alias("a"), F.greatest("qa", "qb").alias("b")).where("a < b").distinct())
            left = write(nxt, "edges", n)
            n = left.count()
        return scratch.keep(label.coalesce(max(some, first // TASK_EDGES)), "components")

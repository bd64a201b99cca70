"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tacit.scratch import materialize


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)``: the smallest node of each component, for all other nodes of the edges.

    ``edges`` holds ``(a, b)``; repeated edges, loops and either direction may occur.  Large and
    small stars in turn: every node hands its larger neighbours to its smallest one, then all its
    smaller neighbours.  Nodes are never gathered; a node of very many edges is split by the
    joins.  The loop ends when no node is left that is not a leaf or the smallest of its star.
    """
    both = F.explode(
        F.array(
            F.struct(F.col("a").alias("u"), F.col("b").alias("v")),
            F.struct(F.col("b").alias("u"), F.col("a").alias("v")),
        )
    )
    edges = edges.where("a != b").select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    )
    edges = materialize(edges.distinct(), "edges")
    while True:
        sides = edges.select(both.alias("e")).select("e.u", "e.v")
        least = materialize(
            sides.groupBy("u").agg(
                F.least(F.min("v"), F.col("u")).alias("m"),
                F.count_if(F.col("v") < F.col("u")).alias("smaller"),
                F.count_if(F.col("v") > F.col("u")).alias("larger"),
            ),
            "edges-min",
        )
        if least.where("smaller > 1 or (smaller = 1 and larger > 0)").isEmpty():
            return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
        least = least.select("u", "m")
        large = sides.where("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b"))
        large = materialize(large.distinct(), "edges-large")
        small = materialize(
            large.groupBy("b").agg(F.min("a").alias("m")).select("b", "m"), "edges-min"
        )
        joined = large.join(small, "b")
        edges = materialize(
            joined.select(F.col("m").alias("a"), F.col("b"))
            .unionByName(joined.where("a != m").select(F.col("m").alias("a"), F.col("a").alias("b")))
            .distinct(),
            "edges",
        )

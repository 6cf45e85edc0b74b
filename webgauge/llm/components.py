"""Connected components as Spark jobs over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def components(edges: DataFrame) -> DataFrame:
    """(id, root) of every vertex of edges(a, b) that isn't the root of its component; root is the smallest id.

    Rounds: each vertex with a smaller neighbour points to the smallest one; pointers are doubled until they reach
    their roots; edges are drawn between roots.  At least every second vertex goes in a round.  Each step is
    written to the shared folder.  A vertex with very many neighbours makes one long key in joins only, which
    adaptive execution splits; aggregates combine before they shuffle.
    """
    edges = materialize(_between(edges))
    labels = None
    while edges.head(1):
        up = _to_roots(materialize(edges.groupBy("a").agg(F.min("b").alias("up"))))
        if labels is None:
            labels = up.select(F.col("a").alias("id"), F.col("up").alias("root"))
        else:
            moved = labels.join(up.hint("shuffle_merge"), labels["root"] == up["a"], "left").select("id", F.coalesce("up", "root").alias("root"))
            labels = moved.unionByName(up.select(F.col("a").alias("id"), F.col("up").alias("root")))
        labels = materialize(labels)
        edges = materialize(_between(relabel(edges, up.select(F.col("a").alias("id"), F.col("up").alias("root")))))
    if labels is None:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("root"))
    return labels


def relabel(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Edges with both ends replaced by their roots."""
    for end in ("a", "b"):
        side = roots.select(F.col("id").alias(f"id_{end}"), F.col("root").alias(f"root_{end}")).hint("shuffle_merge")
        edges = edges.join(side, edges[end] == side[f"id_{end}"], "left").withColumn(end, F.coalesce(f"root_{end}", end)).drop(f"id_{end}", f"root_{end}")
    return edges


def _between(edges: DataFrame) -> DataFrame:
    return edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()


def _to_roots(up: DataFrame) -> DataFrame:
    while True:
        above = up.select(F.col("a").alias("mid"), F.col("up").alias("top")).hint("shuffle_merge")
        stepped = materialize(up.join(above, up["up"] == above["mid"], "left").select("a", F.coalesce("top", "up").alias("up"), F.col("top").isNotNull().alias("moved")))
        up = stepped.drop("moved")
        if not stepped.where("moved").head(1):
            return up

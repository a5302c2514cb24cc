"""Connected components of a link table, as joins and groupings only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import materialize, release


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every id in links(a, b): component is the smallest id that can be reached.

    In a round every component hooks onto its smallest neighbour; the pointers are then doubled until they end at roots. At
    least half of the components that still have links go in a round, whatever the graph's shape, so the number of rounds
    is the logarithm of its size. NULL ends and self links are left out; repeated links do no harm.
    """
    links = links.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    edges = materialize(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    nodes = edges.select(F.col("a").alias("id")).union(edges.select("b")).distinct()
    label = materialize(nodes.withColumn("component", F.col("id")), "labels")
    while edges.take(1):
        # every component is linked to a smaller one or a local minimum; pointers lead downwards only
        parent = materialize(edges.groupBy("a").agg(F.min("b").alias("p"), F.lit(True).alias("moved")), "parents")
        while parent.where("moved").take(1):
            up = parent.select(F.col("a").alias("p"), F.col("p").alias("q"))
            doubled = materialize(parent.select("a", "p").join(up, "p", "left").select("a", F.coalesce("q", "p").alias("p"), F.col("q").isNotNull().alias("moved")), "parents")
            release(parent)
            parent = doubled
        root = parent.select(F.col("a").alias("old"), F.col("p").alias("new"))
        ends = edges.join(root.select(F.col("old").alias("a"), F.col("new").alias("x")), "a", "left").join(root.select(F.col("old").alias("b"), F.col("new").alias("y")), "b", "left")
        ends = ends.select(F.coalesce("x", "a").alias("x"), F.coalesce("y", "b").alias("y")).where(F.col("x") != F.col("y"))
        after = (
            materialize(label.join(root, F.col("component") == F.col("old"), "left").select("id", F.coalesce("new", "component").alias("component")), "labels"),
            materialize(ends.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct(), "links"),
        )
        release(parent, label, edges)
        label, edges = after
    release(edges)
    return label

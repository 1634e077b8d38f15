"""Connected components of a table of links, without gathering links anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._store import stored


def connected_components(links: DataFrame) -> DataFrame:
    """(v, label) for each vertex of `links` (a, b); label is one vertex of its component.

    Each round hooks every vertex to its least neighbour and contracts the
    links; a link (v, least neighbour of v) turns into (least neighbour, its own
    least neighbour), so nothing is cut.  The number of vertices at least halves
    each round.  Minima are combined before shuffles, so a hub is no hot key.
    """
    links = stored(links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    hooks = stored(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("v"), F.least("a", "m").alias("label")), "labels")
    labels, last = hooks, hooks
    while True:
        left, right = last.select(F.col("v").alias("a"), F.col("label").alias("x")), last.select(F.col("v").alias("b"), F.col("label").alias("y"))
        links = links.join(left, "a").join(right, "b").filter("x <> y")
        links = stored(links.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "links")
        if links.isEmpty():
            return labels
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        last = stored(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("v"), F.least("a", "m").alias("label")), "hooks")
        step = last.select(F.col("v").alias("label"), F.col("label").alias("next"))
        labels = stored(labels.join(step, "label", "left").select("v", F.coalesce("next", "label").alias("label")), "labels")

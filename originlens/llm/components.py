"""Connected components of a table of links, by large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from originlens.session import materialise


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node, root: the smallest node of each linked node's component. ``links``: a, b (long, not NULL).

    Each round joins every node's neighbours to the smallest one, in groupings that Spark pre-aggregates
    (the minimum) and joins (the neighbours), so no neighbour list is collected. Tables are written to
    the shared folder after each round; the rounds end when no row changes, about the logarithm of the
    longest path. Links of a node with itself are left out; an empty table gives no rows.
    """
    edges = materialise(
        links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links"
    )
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        # large star: neighbours above a node go to its smallest neighbour
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialise(large.filter("u <> v").distinct(), "large-star")
        # small star: a node and its neighbours below go to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(least.select("u", F.col("m").alias("v")))
        after = materialise(small.filter("u <> v").distinct(), "small-star")
        same = after.count() == edges.count() and not after.join(edges, ["u", "v"], "left_anti").head(1)
        edges = after
        if same:
            return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
    raise RuntimeError(f"components not found in {max_rounds} rounds")

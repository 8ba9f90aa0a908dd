"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, materialize


def _star(pairs: DataFrame) -> DataFrame:
    """(u, v, m): each pair with the least of u and its neighbours."""
    least = pairs.groupBy("u").agg(F.min("v").alias("_m")).select("u", F.least("u", "_m").alias("m"))
    return pairs.join(least, "u")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the undirected `edges` (a, b): root is the component's least node.

    Each round does a large-star step (every node links its larger neighbours to its least one), then
    a small-star step (every node links its smaller neighbours and itself to the least of them), and
    stores the edges; it ends when a round leaves the edges as they were. Counts and a checksum are
    all that the driver sees, and a node's neighbours are only ever summed up, not gathered.
    """
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    mark = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    seen = now.agg(F.count("*"), mark).first()
    while seen[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = _star(large)
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        after = materialize(small, "edges")
        got = after.agg(F.count("*"), mark).first()
        discard(now)
        now = after
        if got == seen:
            break
        seen = got
    roots = now.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)

"""Connected components by joins: labels fall to the least neighbour, then jump to their label's label."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def components(links: DataFrame) -> DataFrame:
    """node, root (the smallest node of its component) for links with long columns a and b.

    Alternates large-star and small-star rounds, each a min-aggregation and a join that splits the edges of hubs; every round
    is written to the shared folder, and rounds end when no edge changes. Rounds grow with the logarithm of the longest
    chain. No links: no rows.
    """
    edges = common.written(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before, total = None, edges.count()
    while True:
        # large star: neighbours above a node join the least of its neighbourhood
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = common.written(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n"), "least")
        large = common.salted_join(both.where("v > u"), least, "u", total, F.xxhash64("v")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = common.written(large, "large")
        # small star: a node and its lower neighbours join the least of them
        low = common.written(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "low")
        joined = common.salted_join(large, low, "u", total, F.xxhash64("v"))
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct()
        after = common.written(small, "edges")
        state = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        for done in (edges, least, large, low):
            common.discard(done)
        edges, total = after, state[0]
        if state == before:
            break
        before = state
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)

"""Connected components by alternating star contraction, with lineage cut each round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.session import forget, written


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component): component is the least node id that is reachable. Nodes without an edge are not returned.

    Large-star and small-star steps alternate until the edge set is a forest of stars. Each step takes a minimum per node, which is
    pre-aggregated before its shuffle, and joins it back; edges never multiply, whatever the shape of the graph. Null and
    self edges are ignored, repeated edges count once. Rounds go on until a step changes nothing; their number grows with the logarithm of the
    longest path.
    """
    e = edges.select(F.least(src, dst).alias("v"), F.greatest(src, dst).alias("u")).where("u <> v").distinct()
    held = written(e, "edges")
    before = None
    while True:
        # large star: all larger neighbours of u go to the least of u and its neighbours
        both = held.select(F.col("u").alias("a"), F.col("v").alias("b")).union(held.select(F.col("v").alias("a"), F.col("u").alias("b")))
        least = written(both.groupBy("a").agg(F.min("b").alias("b0")).select("a", F.least("a", "b0").alias("m")), "least")  # a plain table, so that a hub's rows can be split in the join
        large = both.join(least, "a").where("b > a").select(F.col("m").alias("v"), F.col("b").alias("u")).where("u <> v").distinct()
        # small star: u and its smaller neighbours go to the least of these
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("m").alias("v"), F.explode(F.array("u", "v")).alias("u")).where("u <> v").distinct()
        now = written(small, "edges")
        forget(held)
        forget(least)
        held = now
        state = held.agg(F.count("*").alias("n"), F.countDistinct("u").alias("d"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if before == state:
            break
        before = state
    leaves = held.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component")
    roots = held.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return leaves.union(roots)

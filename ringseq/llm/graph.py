"""Connected components of a link table, by rounds of large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, save


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Return (node, root): the smallest node reachable, for each node that has a link to another node.

    Every round replaces the links at a node by links to its smallest neighbour, so the number of links never grows.
    Minima are aggregated before they are shuffled, and written before they are joined back: then both sides of the join are
    exchanges of their own, and adaptive execution can split a node with very many links. A round's tables are dropped once
    the next are written. Self-links, repeated links and nulls are ignored; an empty table gives an empty result.
    """
    e = edges.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).where("u < v").distinct()
    e = save(e, "links")
    before = None
    for _ in range(max_rounds):
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = save(both.groupBy("u").agg(F.min("v").alias("m0")).select("u", F.least("u", "m0").alias("m")), "minima")
        # large star: each larger neighbour is linked to the smallest
        large = save(both.where("v > u").join(low, "u").select(F.col("m").alias("u"), "v").where("u < v").distinct(), "links")
        drop(e, low)
        # small star: all not larger neighbours are linked to the smallest
        down = save(large.groupBy(F.col("v").alias("w")).agg(F.min("u").alias("m")), "minima")
        small = large.withColumnRenamed("v", "w").join(down, "w")
        e = save(
            small.select(F.col("m").alias("u"), F.col("u").alias("v")).where("u < v").union(down.select(F.col("m").alias("u"), F.col("w").alias("v"))).distinct(),
            "links",
        )
        drop(large, down)
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now == before or now["n"] == 0:
            break
        before = now
    else:
        raise RuntimeError("the components have not settled")
    leaf = e.select(F.col("v").alias("node"), F.col("u").alias("root"))
    return leaf.union(e.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())

"""Connected components of a link table, by large and small stars.

Each round rewrites the links so that every node points at smaller ones until all
nodes of a component point at its smallest. A hot node (a third of all links) is no
group in one task: the minimum over a node's links combines map-side, is written,
and joined back to the links, where AQE splits the hot node's rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _least(links: DataFrame) -> DataFrame:
    """Per node ``u`` the smallest of itself and its neighbours."""
    return links.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``node, component`` for every node in ``links (a, b)``; the component is its
    smallest node. Links to itself and repeated links do no harm; nulls are dropped."""
    links = (links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
             .distinct())
    links = written(links, "links")
    for _ in range(max_rounds):
        # large star: a node's larger neighbours go to its smallest neighbour (or itself)
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(_least(both), "star")
        big = (both.where("v > u").join(least, "u").where("v <> m")
               .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        big = written(big, "large-star")
        # small star: a node and its smaller neighbours go to the smallest of them
        least = written(big.groupBy("u").agg(F.min("v").alias("m")), "star")
        pulled = big.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = written(pulled.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "links")
        # settled: every node has one link, and what it points at has none
        again = links.groupBy("u").count().where("count > 1")
        inner = links.select("v").distinct().join(links.select(F.col("u").alias("v")), "v", "left_semi")
        if again.isEmpty() and inner.isEmpty():
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    root = links.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        root.join(links.select(F.col("u").alias("node")), "node", "left_anti"))

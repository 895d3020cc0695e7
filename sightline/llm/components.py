"""Connected components of a graph of links, by alternating star operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged

#: Links that a file of a round holds; a file for each task would mean many tiny ones where links are few.
LINKS_PER_FILE = 200_000


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node links its larger neighbours to the smallest one around it."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node links its smaller neighbours and itself to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    linked = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges (u, v) of longs → node, root: the smallest node of its component, for every node of an edge.

    Every round is written to the shared folder, so lost executors cost one round. Nothing but a count
    and a checksum comes to the driver. No edges: empty.
    """
    edges = staged(edges.where("u <> v").select("u", "v").distinct(), "links")
    state = None
    while True:
        found = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum")).first()
        if not found.n or (found.n, found.sum) == state:
            break
        state = (found.n, found.sum)
        # a round never makes more links than there were
        files = 1 + found.n // LINKS_PER_FILE
        edges = staged(_small_star(_large_star(edges)).coalesce(files), "links")
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()

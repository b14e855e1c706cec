"""Connected components of an edge table by alternating stars, in joins and aggregates only."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import forget, keep

#: A node with more edges is a hub; of E edges' nodes at most 2 * E / HUB are, and so many hubs are broadcast at most.
HUB, MOST_HUBS = 1000, 500_000


def _beside_least(rows: DataFrame, least: DataFrame, hub: int) -> DataFrame:
    """The rows (u, v) beside u's least neighbour m. Hubs' least ones are broadcast, so no hub's rows meet in one task."""
    hubs = F.broadcast(least.filter(F.col("n") > hub).select(F.col("u").alias("h"), F.col("m").alias("of_hub")))
    marked = rows.join(hubs, F.col("u") == F.col("h"), "left").drop("h")
    others = marked.filter("of_hub is null").select("u", "v").join(least.filter(F.col("n") <= hub).select("u", "m"), "u")
    return marked.filter("of_hub is not null").select("u", "v", F.col("of_hub").alias("m")).unionByName(others)


def _large_star(edges: DataFrame, hub: int) -> DataFrame:
    both = edges.union(edges.select("v", "u"))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    return _beside_least(both.filter("v > u"), least, hub).select(F.col("v").alias("u"), F.least("u", "m").alias("v"))


def _small_star(edges: DataFrame, hub: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    return _beside_least(down, least, hub).select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node in an edge: the component is its smallest node.

    ``edges`` has two columns of one orderable type; null ends, loops and repeated edges
    are of no effect. A hub is never gathered: each round takes its least neighbour by a
    map-side minimum, and hubs' least neighbours, few by the bound on hubs, are broadcast.
    Rounds grow as the logarithm of the longest path, and each is kept in the shared folder.
    """
    a, b = edges.columns
    now = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v").distinct()
    now = keep(now.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    sign = F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    seen = now.agg(*sign).first()
    while seen[0]:
        hub = max(HUB, 2 * seen[0] // MOST_HUBS)
        large = keep(_large_star(now, hub).filter("u <> v").distinct(), "edges")
        forget(now)
        now = keep(_small_star(large, hub).filter("u <> v").distinct(), "edges")
        forget(large)
        was, seen = seen, now.agg(*sign).first()
        if was == seen:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())

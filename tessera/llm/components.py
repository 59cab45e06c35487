"""Connected components of a distributed graph, by alternating large and small stars.

Every round rewrites the edges so that each node points at lesser ones, until
each points at the least of its component. Edges and components stay in Spark;
each round's edges are written to the shared folder, which cuts their lineage.

Stars (many members linked with a hub) are contracted first: rounds run over hubs
alone, of which a group of any size has few. Members take the label of one hub in a
join of two tables as they stand, where Spark can split a hub with many members.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import written
from tessera.sources.storage import dropped


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """edges: u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    linked = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_000_007)).first())


def components(edges: DataFrame, u: str, v: str) -> DataFrame:
    """(node, root) for every node of an edge; root is the least node of its component."""
    spark = edges.sparkSession
    now, path = written(spark, edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).filter("u <> v").distinct(), "edges")
    state = _state(now)
    while state[0]:
        following, at = written(spark, _small_star(_large_star(now)), "edges")
        reached = _state(following)
        dropped(spark, path)
        now, path = following, at
        if reached == state:
            break
        state = reached
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def components_of_stars(links: DataFrame, hub: str, member: str) -> DataFrame:
    """components() of links (hub, member); members may be hubs of others."""
    spark = links.sparkSession
    links = links.select(F.col(hub).alias("h"), F.col(member).alias("m"))
    parents, at_parents = written(spark, links.groupBy("m").agg(F.min("h").alias("p")), "parents")
    hubs, at_hubs = written(spark, links.select("h").distinct(), "hubs")
    # Hubs that meet at a member, and hubs that have one themselves, are of one component.
    meeting = links.join(parents, "m").filter("h <> p").select(F.col("h").alias("u"), F.col("p").alias("v"))
    nested = parents.join(hubs, F.col("m") == F.col("h"), "left_semi").filter("m <> p").select(F.col("m").alias("u"), F.col("p").alias("v"))
    among = components(meeting.unionByName(nested).distinct(), "u", "v")
    least = parents.groupBy("p").agg(F.min("m").alias("least"))
    of_hub = hubs.join(among.withColumnRenamed("node", "h"), "h", "left").withColumn("root", F.coalesce("root", "h")).join(least, F.col("h") == F.col("p"), "left")
    of_hub = of_hub.select("h", "root", F.least(F.col("h"), F.coalesce("least", "h")).alias("least"))
    lowest = of_hub.groupBy("root").agg(F.min("least").alias("lowest"))
    named, _ = written(spark, of_hub.join(lowest, "root").select(F.col("h").alias("node"), F.col("lowest").alias("root")), "named")
    members = parents.join(hubs, F.col("m") == F.col("h"), "left_anti").join(named.withColumnRenamed("node", "p"), "p").select(F.col("m").alias("node"), "root")
    found, _ = written(spark, named.unionByName(members), "labels")
    dropped(spark, at_parents, at_hubs)
    return found

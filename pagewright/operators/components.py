"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.sources.tables import settle


def _stars(links: DataFrame, salts: int) -> DataFrame:
    """(node, entity) links as edges towards a leader of each entity, in two salted steps.

    Rows of a hot entity first follow the least node of their own salt; only these leaders meet under
    the entity itself, so no task sees a whole hot entity and each node sends one edge per entity.
    """
    salted = links.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(salts)).cast("int"))
    local = salted.groupBy("entity", "salt").agg(F.min("node").alias("head"))
    heads = local.groupBy("entity").agg(F.min("head").alias("top"))
    near = salted.join(local, ["entity", "salt"]).select(F.col("node").alias("u"), F.col("head").alias("v"))
    far = local.join(heads, "entity").select(F.col("head").alias("u"), F.col("top").alias("v"))
    return near.unionByName(far).filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


#: A node with more than one in so many edges, and more than so many at least, is hot: there are at most 2 x HOT_ONE_OF of them.
HOT_ONE_OF, HOT_LEAST = 500, 10_000


def _with_least(edges: DataFrame, least: DataFrame, hot: DataFrame | None) -> DataFrame:
    """``edges(u, v)`` with ``m`` of ``least(u, m)``.

    Edges of hot nodes stay where they are and meet the few hot rows by broadcast, so no task gathers the edges of one node.
    """
    if hot is None:
        return edges.join(least, "u")
    few = F.broadcast(least.join(F.broadcast(hot), "u", "left_semi"))
    many = edges.join(F.broadcast(hot), "u", "left_anti").join(least, "u")
    return edges.join(few, "u").unionByName(many)


def _hot(counted: DataFrame, total: int) -> DataFrame | None:
    """The nodes of ``counted(u, n)`` that hold a large share of ``total`` edges, if any."""
    found = counted.filter(F.col("n") > max(HOT_LEAST, 2 * total // HOT_ONE_OF)).select("u").collect()
    return counted.sparkSession.createDataFrame(found, counted.select("u").schema) if found else None


def connected_components(links: DataFrame, salts: int = 32, max_rounds: int = 60) -> DataFrame:
    """``links(node bigint, entity string)`` -> ``(node, component)``, the least node of each component.

    Nodes that share an entity, directly or through others, get one component; a node
    with a null entity is a component of its own; null nodes are dropped; repeated links count once.
    Each round is two aggregations by minimum with a map-side combine and two joins on node; nodes of very many edges are
    joined by broadcast, of which there can be no more than 1,000. The rounds grow with the logarithm of the longest chain. The edges are
    written between rounds, so lost executors never restart the chain.
    """
    nodes = links.select("node").dropna().distinct()
    edges = settle(_stars(links.dropna().distinct(), salts), "edges")
    total, last = edges.count(), None
    for _ in range(max_rounds):
        # large-star: every larger neighbour of a node links to the least of its neighbours and itself
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        hot = _hot(least, total) if total > HOT_LEAST else None
        large = settle(_with_least(both.filter("v > u"), least.select("u", "m"), hot).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct(), "large")
        # small-star: every smaller neighbour of a node, and the node, link to the least of them
        small_least = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        hot = _hot(small_least, total) if total > HOT_LEAST else None
        small = (
            _with_least(large, small_least.select("u", "m"), hot)
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(small_least.select("u", F.col("m").alias("v")))
            .filter("u != v")
            .distinct()
        )
        edges = settle(small, "edges")
        state = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == last:
            break
        total, last = state[0], state
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return nodes.join(edges.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left").select(
        "node", F.coalesce("component", "node").alias("component")
    )

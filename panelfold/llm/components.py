"""Connected components of a link table: the smallest member of each."""

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from panelfold.session import materialize


def _smallest(pairs: DataFrame, name: str) -> DataFrame:
    """Each node's smallest neighbour, or itself; written, so that the join that
    follows shuffles both sides plainly and Spark may split a node with many links."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    return materialize(least.select("u", F.least("u", "m").alias("m")), name)


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"),
                                                        F.col("u").alias("v")))
    least = _smallest(both, "large_star")
    return (both.join(least, "u").where("v > u")
            .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    least = _smallest(edges, "small_star")
    joined = edges.join(least, "u")
    parts = [joined.select(F.col("v").alias("u"), F.col("m").alias("v")),
             least.select("u", F.col("m").alias("v"))]
    return reduce(DataFrame.unionAll, parts).where("u > v").distinct()


def components(links: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``links`` (u, v); component is the
    smallest node reachable.

    Alternating large and small stars (Kiveris et al. 2014) until the edges are
    stars around their smallest node. The driver sees three numbers a round.
    Null ends and links of a node with itself are dropped; no links, no rows.
    """
    edges = materialize(
        links.where("u is not null and v is not null and u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    while True:
        seen = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")),
                         F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == before or seen[0] == 0:
            break
        before = seen
        edges = materialize(_small_star(materialize(_large_star(edges), "edges")), "edges")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(roots)

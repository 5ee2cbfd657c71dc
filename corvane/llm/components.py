"""Connected components of a link table, by alternating star contractions on DataFrames.

Nothing but a row count and a checksum comes to the driver. Each round is two grouped minima and two joins; Spark
may split the skewed partitions of a hub. Rounds are written to the shared folder, so an executor's loss costs a
re-run of one round's tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, union_all, with_broadcast


def connected_components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) of every node of ``links`` (a, b): the smallest node reachable. Self-links and repeats don't matter."""
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = scratch.keep(edges, "edges")
    seen = _state(edges)
    while seen[0]:
        # Large star: every neighbour above u is led to the least of u and its neighbours.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: u and its neighbours below it are led to the least of them.
        low = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), "m")
        small = large.join(low, F.col("u") == F.col("w")).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        new = scratch.keep(small, "edges")
        state = _state(new)
        scratch.drop(edges)
        edges = new
        if state == seen:
            break
        seen = state
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def forest_roots(parents: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) of every node of a forest: b's only parent is a, so a component is its root.

    Every round doubles how far a node has climbed, and a node that has met its root takes no part in the next one.
    """
    up, done = scratch.keep(parents.select(F.col("b").alias("node"), F.col("a").alias("top")), "up"), []
    while up.limit(1).count():
        above = with_broadcast(union_all([up, *done]).select(F.col("node").alias("w"), F.col("top").alias("m")))
        climbed = scratch.keep(up.join(above, F.col("top") == F.col("w"), "left").select("node", F.coalesce("m", "top").alias("top"), F.col("m").isNull().alias("met")), "up")
        done.append(climbed.where("met").select("node", "top"))
        up = climbed.where("not met").select("node", "top")
    found = union_all([up, *done])
    return found.select("node", F.col("top").alias("component")).unionByName(found.select(F.col("top").alias("node"), F.col("top").alias("component")).distinct())


def lifted(links: DataFrame, known: DataFrame) -> DataFrame:
    """``links`` (a, b) with the components (node, component) of their ends as ca and cb, where these differ. A node that isn't known is its own component."""
    side = with_broadcast(known)
    for x in ("a", "b"):
        links = links.join(side.select(F.col("node").alias(f"n{x}"), F.col("component").alias(f"c{x}")), F.col(x) == F.col(f"n{x}"), "left")
    return links.select("a", "b", F.coalesce("ca", "a").alias("ca"), F.coalesce("cb", "b").alias("cb")).where("ca <> cb")


def merged(known: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """Components (node, component) after further links (a, b). Only the components that these join are contracted, not what is linked within them."""
    over = lifted(links, known).select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    upper = scratch.keep(connected_components(over, scratch), "upper").select(F.col("node").alias("n"), F.col("component").alias("m"))
    old = known.join(with_broadcast(upper), F.col("component") == F.col("n"), "left").select("node", F.coalesce("m", "component").alias("component"))
    new = upper.join(with_broadcast(known.select("node")), F.col("n") == F.col("node"), "left_anti")
    return old.unionByName(new.select(F.col("n").alias("node"), F.col("m").alias("component")))


def _state(edges: DataFrame) -> tuple[int, int]:
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return int(r.n), int(r.h or 0)

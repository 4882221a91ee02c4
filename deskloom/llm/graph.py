"""Connected components of a table of links, without collecting any of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def extended(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Components (id, component) after more links (a, b): only the graph of components is worked on."""
    ends = links.select("a", "b")
    for end in ("a", "b"):
        known = nodes.select(F.col("id").alias(end), F.col("component").alias("_known"))
        ends = ends.join(known, end, "left").withColumn(f"c{end}", F.coalesce("_known", end)).drop("_known")
    ends = common.stage(ends, "links-ends")
    above = components(ends.select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct())
    above = common.stage(above.select(F.col("id").alias("component"), F.col("component").alias("top")), "links-above")
    every = ends.select(F.col("a").alias("id"), F.col("ca").alias("component"))
    every = every.union(ends.select("b", "cb")).union(nodes.select("id", "component")).distinct()
    return every.join(above, "component", "left").select("id", F.coalesce("top", "component").alias("component"))


def components(links: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable, for every id in the links (a, b).

    Each round, every node joins its neighbour of the smallest hash and the graph
    is contracted, which removes a share of the nodes in any graph; the hash
    differs by round. A chain of rounds is then read backwards. Every round is
    written to the shared folder, so its plan doesn't grow.
    """
    links = common.stage(links.filter("a <> b").select("a", "b"), "links")
    steps = []
    left = links
    while not left.isEmpty():
        both = left.union(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        ranked = both.select("a", F.struct(F.xxhash64("b", F.lit(len(steps))).alias("h"), "b").alias("to"))
        own = F.struct(F.xxhash64("a", F.lit(len(steps))).alias("h"), F.col("a").alias("b"))
        step = ranked.groupBy("a").agg(F.min("to").alias("to")).select("a", F.least("to", own)["b"].alias("to"))
        step = common.stage(step, "links-step")
        steps.append(step)
        left = (
            left.join(step, "a")
            .select(F.col("to").alias("x"), F.col("b").alias("a"))
            .join(step, "a")
            .select(F.least("x", "to").alias("a"), F.greatest("x", "to").alias("b"))
            .filter("a <> b")
            .distinct()
        )
        left = common.stage(left, "links-left")
    nodes = None
    for step in reversed(steps):
        if nodes is None:
            nodes = step.select(F.col("a").alias("id"), F.col("to").alias("root"))
            continue
        above = nodes.select(F.col("id").alias("to"), "root")
        nodes = step.join(above, "to", "left").select(
            F.col("a").alias("id"), F.coalesce("root", "to").alias("root")
        )
    if nodes is None:
        return links.select(F.col("a").alias("id"), F.col("b").alias("component"))
    least = nodes.groupBy("root").agg(F.min("id").alias("component"))
    return nodes.join(least, "root").select("id", "component")

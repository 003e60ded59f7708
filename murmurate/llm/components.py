"""Connected components of links by alternating large-star and small-star steps over staged tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import drop_staged, hot_join, stage


def _stars(pairs: DataFrame, large: bool) -> DataFrame:
    """One step over pairs (u, v): every neighbour of u is tied to the smallest of them (or to u itself)."""
    if large:
        pairs = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    tied = pairs.join(least, "u")
    if large:
        tied = tied.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        tied = tied.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
    return tied.where("u > v").distinct()


def components(links: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """``node`` and ``comp`` (the smallest node reachable) of every node that has a link to another.

    Null ends and self-links are ignored; repeated links count once. Links stay distributed: each
    round writes its pairs to the shared folder, and the rounds grow with the logarithm of a
    component's width. A node with very many links is met by partial minima and by the skew
    handling of the shuffled join.
    """
    pairs = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull()).where("u > v").distinct()
    pairs = stage(pairs, "links")
    seen = None
    for _ in range(rounds):
        new = stage(_stars(_stars(pairs, True), False), "stars")
        now = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop_staged(pairs)
        pairs = new
        if tuple(now) == seen:
            break
        seen = tuple(now)
    else:
        raise RuntimeError("components did not settle")
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(pairs.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())


def with_component_ids(meta: DataFrame, comp: DataFrame) -> DataFrame:
    """``meta`` (``doc_id``, ``node`` and more) with ``component_id``: the smallest ``doc_id`` of the node's component.

    ``comp`` has ``node`` and ``comp`` of the nodes that are linked with another. Rows without a node have
    a null ``component_id``, and so have components of null ids. ``meta`` and ``comp`` are read several times.
    """
    total = meta.count()
    nodes = meta.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows"))
    named = nodes.join(comp, "node").groupBy("comp").agg(F.min("least").alias("component_id"), F.count("*").alias("size"))
    # A component may be most of the input, but not most of its distinct nodes' rows in one key: see hot_join.
    far = hot_join(comp, named.withColumnRenamed("comp", "key").select("key", "component_id", "size").withColumnRenamed("key", "comp"), "comp", "size", total).select("node", "component_id")
    nodes = stage(nodes.join(far, "node", "left").select("node", F.coalesce("component_id", "least").alias("component_id"), "rows"), "named")
    return hot_join(meta, nodes, "node", "rows", total)

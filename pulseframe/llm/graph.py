"""Connected components over distributed edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One contraction. ``edges`` holds each link once as (hi, lo) with hi > lo.

    Large: every larger neighbour of a node joins the node's smallest neighbour (or the node itself);
    small: a node and its smaller neighbours join the smallest of them. Minima are partial
    aggregates, and a hub's edges are split by the skew join."""
    if large:
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(
            edges.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
        )
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        out = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
    else:
        least = edges.groupBy("hi").agg(F.min("lo").alias("m"))
        joined = edges.join(least, "hi")
        out = joined.where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).union(
            least.select("hi", F.col("m").alias("lo"))
        )
    return out.where("hi <> lo").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): for each node with a link the smallest node reachable from it.

    Alternating large-star and small-star contraction, O(log n) rounds, checkpointed each round in the
    shared folder. Ends when the edges are stars around their smallest node and no longer change.
    No edges: an empty frame. Null ends and self links are ignored."""
    now = held(
        edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo"))
        .distinct()
    )
    sign = None
    while True:
        new = held(_star(_star(now, True), False))
        seen = new.agg(
            F.count("*"), F.bit_xor(F.xxhash64("hi", "lo")), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)"))
        ).first()
        now = new
        if seen == sign:
            break
        sign = seen
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(
        now.select(F.col("lo").alias("node"), F.col("lo").alias("component"))
    ).distinct()

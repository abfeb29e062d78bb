"""Connected components of links, by rounds of large and small stars. Nothing but counts reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def stars(links: DataFrame, large: bool) -> DataFrame:
    """links (a, b), a > b. Large: a node gives its least neighbour to its greater ones; small: to its lesser ones and itself."""
    both = links.union(links.select("b", "a")) if large else links
    least = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
    # Written tables on both sides: a hub's rows can be split by adaptive execution.
    met = both.join(least, "a")
    new = met.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")) if large else met.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    out = materialize(new.where("a <> b").distinct(), "stars")
    discard(least)
    return out


def components(links: DataFrame) -> DataFrame:
    """links (a, b) of longs, in any direction, repeated or not. Returns (a, b): every linked node but the roots, and its
    root, the least node of its component."""
    now = materialize(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    while not settled(now):
        for large in (True, False):
            then, now = now, stars(now, large)
            discard(then)
    return now


def settled(links: DataFrame) -> bool:
    """Whether every greater node has one link, and no lesser node has a link to a lesser one still: then each link ends in a root."""
    ends = links.select(F.col("a").alias("v"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(links.select("b", F.lit(0), F.lit(1)))
    return ends.groupBy("v").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up + down > 1").isEmpty()

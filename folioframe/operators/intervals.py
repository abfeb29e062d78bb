"""Overlaps of intervals within a group, without a pairwise join of the group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def overlaps(left: DataFrame, right: DataFrame, by: list[str], width: int) -> DataFrame:
    """left: by, start, end and more; right: by, r_start, r_end and more (integers, [start, end)). Each pair that overlaps, once,
    with from and to of what it shares. Both sides go to bins of the width; a pair is kept in the bin where its overlap
    begins. Take a width near the usual length: longer intervals are copied to each bin that they touch."""
    bins = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / width), F.floor((F.col(b) - 1) / width)))
    cut_l = left.where("start < end").withColumn("__bin", bins("start", "end"))
    cut_r = right.where("r_start < r_end").withColumn("__bin", bins("r_start", "r_end"))
    met = cut_l.join(cut_r, [*by, "__bin"]).where("start < r_end AND r_start < end").withColumn("from", F.greatest("start", "r_start")).withColumn("to", F.least("end", "r_end"))
    return met.where(F.floor(F.col("from") / width) == F.col("__bin")).drop("__bin")


def containing(points: DataFrame, pieces: DataFrame, by: list[str], width: int) -> DataFrame:
    """points: by, at and more; pieces: by, start, end and more. Each point with the piece that holds it."""
    cut = pieces.where("start < end").withColumn("__bin", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("end") - 1) / width))))
    return points.withColumn("__bin", F.floor(F.col("at") / width)).join(cut, [*by, "__bin"]).where("at >= start AND at < end").drop("__bin")

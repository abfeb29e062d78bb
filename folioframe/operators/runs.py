"""Text runs: merging neighbours, script segments, splitting at offsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import fonts


def merge_adjacent(runs: DataFrame, by: list[str], order: str, same: list[str], text: str) -> DataFrame:
    """Neighbours alike in the columns of ``same`` (null equal to null) as one run: by, run (from 0), same, text, n."""
    w = Window.partitionBy(*by).orderBy(order)
    changed = F.lit(False)
    for c in same:
        changed = changed | ~F.col(c).eqNullSafe(F.lag(c).over(w))
    first = F.row_number().over(w) == 1
    islands = runs.withColumn("__new", F.when(first | changed, 1).otherwise(0)).withColumn("run", F.sum("__new").over(w) - 1)
    parts = F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t")))), lambda s: s["t"])
    return islands.groupBy(*by, "run", *same).agg(F.array_join(parts, "").alias(text), F.count("*").alias("n"))


def script_segments(texts: DataFrame, style: fonts.Style, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Where the typeface of texts changes: doc_id, segment, script, family, start, end (UTF-16 units), text. Each text is cut
    inside its row; nothing is shuffled."""
    cut = texts.withColumn("__segments", fonts.segments(F.col(text_col), style))
    found = cut.select(F.col(id_col).alias("doc_id"), F.posexplode("__segments").alias("segment", "s"))
    return found.select("doc_id", "segment", "s.script", "s.family", "s.start", "s.end", "s.text")


def split_at(runs: DataFrame, by: list[str], order: str, text: str, offset: Column) -> DataFrame:
    """Runs cut at a text offset of their group: each run with side left or right, a run across the offset as two."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    placed = runs.withColumn("__at", F.coalesce(F.sum(F.length(text)).over(w), F.lit(0))).withColumn("__cut", F.greatest(F.lit(0), F.least(offset - F.col("__at"), F.length(text))).cast("int"))
    left = F.struct(F.lit("left").alias("side"), F.col(text).substr(F.lit(1), F.col("__cut")).alias("piece"))
    right = F.struct(F.lit("right").alias("side"), F.col(text).substr(F.col("__cut") + 1, F.length(text)).alias("piece"))
    return placed.withColumn("__s", F.explode(F.array(left, right))).where("__s.piece <> ''").select(*[c for c in runs.columns if c != text], F.col("__s.side").alias("side"), F.col("__s.piece").alias(text))

"""Layout as folds over ordered blocks: heights, simple pagination, page ranges, break rules, fitting rows."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Scale of a heading's lines by level 1 to 6 (fixed values).
HEADING_SCALE = (2.15, 1.75, 1.45, 1.28, 1.15, 1.05)


@dataclass(frozen=True)
class Page:
    """Page geometry in pixels (fixed default values)."""

    height: float = 1056
    margin: float = 72
    min_line: float = 22
    gap: float = 8
    cell_padding: float = 8
    table_extra: float = 10


def round_half_up(c: Column) -> Column:
    return F.floor(c + 0.5)


def heading_scale(level: Column) -> Column:
    scales = F.array(*map(F.lit, HEADING_SCALE))
    return F.when(level.between(1, 6), F.element_at(scales, F.least(F.greatest(level, F.lit(1)), F.lit(6)).cast("int"))).otherwise(1.0)


def run_height(points: Column, image_height: Column | None = None, floating: Column | None = None) -> Column:
    """A run's height: text by its size (12 points without one), images by their height (96 without), floating ones none."""
    text = round_half_up(F.coalesce(points, F.lit(12.0)) * 1.6)
    if image_height is None:
        return text
    image = F.coalesce(image_height, F.lit(96.0))
    return F.when(floating, 0.0).when(image_height.isNotNull(), image).otherwise(text)


def line_height(tallest: Column, level: Column, page: Page = Page()) -> Column:
    """Block height from its tallest run and heading level."""
    return F.greatest(F.lit(page.min_line), round_half_up(F.greatest(F.lit(12.0), tallest) * heading_scale(level)))


def block_gap(level: Column, is_table: Column | None = None, page: Page = Page()) -> Column:
    """Space behind a block: more behind headings and tables."""
    text = F.when(level.isNotNull(), page.gap + F.greatest(F.lit(4.0), (7 - level) * 2.0)).otherwise(page.gap)
    return text if is_table is None else F.when(is_table, page.gap + page.table_extra).otherwise(text)


def paginate(blocks: DataFrame, page: Page = Page()) -> DataFrame:
    """blocks: doc_id, node_index, height, gap. Returns doc_id, node_index, page (from 1), y: each block goes below the
    one before, or onto a new page when it would pass the bottom margin of a page that has blocks already.

    One streaming pass over blocks sorted by document and place: a document of any length needs three numbers. (As a fold over
    an array, its output would be copied with each block.) page_counts has the pages alone, natively."""
    bottom, top = page.height - page.margin, float(page.margin)
    kind = blocks.schema["doc_id"].dataType.simpleString()

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, number, y, filled = object(), 1, top, False
        for frame in frames:
            pages, tops = [], []
            for doc, height, gap in zip(frame["doc_id"].tolist(), frame["height"].tolist(), frame["gap"].tolist(), strict=True):
                if doc != last:
                    last, number, y, filled = doc, 1, top, False
                if filled and y + height > bottom:
                    number, y = number + 1, top
                pages.append(number)
                tops.append(y)
                y, filled = y + height + gap, True
            yield pd.DataFrame({"doc_id": frame["doc_id"], "node_index": frame["node_index"], "page": pages, "y": tops})

    rows = blocks.select("doc_id", F.col("node_index").cast("int").alias("node_index"), F.col("height").cast("double").alias("height"), F.col("gap").cast("double").alias("gap"))
    return rows.repartition("doc_id").sortWithinPartitions("doc_id", "node_index").mapInPandas(place, f"doc_id {kind}, node_index int, page int, y double")


def page_counts(blocks: DataFrame, page: Page = Page()) -> DataFrame:
    """Pages of each document, without keeping its blocks' places: doc_id, pages."""
    bottom = page.height - page.margin
    items = F.sort_array(F.collect_list(F.struct("node_index", F.col("height").cast("double").alias("height"), F.col("gap").cast("double").alias("gap"))))
    zero = F.struct(F.lit(1).alias("page"), F.lit(float(page.margin)).alias("y"), F.lit(0).alias("on_page"))

    def step(s: Column, b: Column) -> Column:
        turn = (s["y"] + b["height"] > bottom) & (s["on_page"] > 0)
        y = F.when(turn, float(page.margin)).otherwise(s["y"])
        return F.struct((s["page"] + turn.cast("int")).alias("page"), (y + b["height"] + b["gap"]).alias("y"), F.when(turn, 1).otherwise(s["on_page"] + 1).alias("on_page"))

    return blocks.groupBy("doc_id").agg(F.aggregate(items, zero, step, lambda s: s["page"]).alias("pages"))


def page_ranges(breaks: DataFrame, lengths: DataFrame) -> DataFrame:
    """breaks: doc_id, node_index; lengths: doc_id, n. The ranges [start, end) between a document's distinct breaks inside
    it, numbered from 0; a document without nodes has none."""
    inside = breaks.join(lengths, "doc_id").where("node_index > 0 AND node_index < n").select("doc_id", F.col("node_index").alias("start"), "n")
    starts = lengths.where("n > 0").select("doc_id", F.lit(0).alias("start"), "n").unionByName(inside).distinct()
    w = Window.partitionBy("doc_id").orderBy("start")
    return starts.select("doc_id", (F.row_number().over(w) - 1).alias("page"), "start", F.coalesce(F.lead("start").over(w), "n").alias("end"))


def hard_breaks(nodes: DataFrame) -> DataFrame:
    """nodes: doc_id, node_index, break_before, break_inside. Distinct doc_id, node_index of breaks inside the document: at a
    node that asks for one before it, and behind a node that holds one."""
    w = Window.partitionBy("doc_id").orderBy("node_index")
    flagged = nodes.select("doc_id", "node_index", (F.coalesce("break_before", F.lit(False)) | F.coalesce(F.lag("break_inside").over(w), F.lit(False))).alias("hit"), F.row_number().over(w).alias("nth"))
    return flagged.where("hit AND nth > 1").select("doc_id", "node_index")


def fit_rows(rows: DataFrame, available: float, by: str = "table_id", order: str = "row", height: str = "height", tolerance: float = 2, at_least_one: bool = True) -> DataFrame:
    """How many leading rows of each table fit into the height (with a tolerance): by, rows_fit, used."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    summed = rows.select(by, F.greatest(F.lit(1.0), F.col(height)).alias("h"), F.sum(F.greatest(F.lit(1.0), F.col(height))).over(w).alias("upto"), F.row_number().over(Window.partitionBy(by).orderBy(order)).alias("nth"))
    fits = F.col("upto") <= available + tolerance
    if at_least_one:
        fits = fits | (F.col("nth") == 1)
    return summed.groupBy(by).agg(F.count_if(fits).alias("rows_fit"), F.coalesce(F.max(F.when(fits, F.col("upto"))), F.lit(0.0)).alias("used"))


def break_hint_limit(height: Column, ratio: float = 0.18, low: float = 42, high: float = 120) -> Column:
    """The remaining height up to which a rendered-break hint counts."""
    return F.greatest(F.lit(low), F.least(F.lit(high), round_half_up(height * ratio)))


def score_breaks(pages: DataFrame, stored: DataFrame) -> DataFrame:
    """pages, stored: doc_id, ordinal, start. A document's score: for each break both have, 25 when equal, else -100 for each
    node between; -1000 where the page has no start."""
    met = stored.select("doc_id", "ordinal", F.col("start").alias("want")).join(pages, ["doc_id", "ordinal"])
    points = F.when(F.col("start").isNull(), -1000).when(F.col("start") == F.col("want"), 25).otherwise(-100 * F.abs(F.col("start") - F.col("want")))
    return met.groupBy("doc_id").agg(F.sum(points).cast("bigint").alias("score"))


def scaled_height(height: Column, scale: Column) -> Column:
    return F.when(F.abs(scale - 1) < 0.001, height.cast("double")).otherwise(F.greatest(F.lit(120.0), round_half_up(height * scale)).cast("double"))


def best_scale(candidates: DataFrame) -> DataFrame:
    """candidates: doc_id, target, scale, page_count. The scale with the nearest count, then nearest to 1, then least; a document
    more than three pages off at scale 1 keeps it."""
    key = F.struct(F.abs(F.col("page_count") - F.col("target")).alias("off"), F.abs(F.col("scale") - 1).alias("from_one"), F.col("scale").alias("scale"))
    best = candidates.groupBy("doc_id").agg(F.min_by(F.struct("scale", "page_count"), key).alias("best"), F.min(F.when(F.col("scale") == 1.0, F.struct(F.abs(F.col("page_count") - F.col("target")).alias("off"), "page_count"))).alias("own"))
    keep = F.col("own.off") > 3
    return best.select("doc_id", F.when(keep, 1.0).otherwise(F.col("best.scale")).alias("scale"), F.when(keep, F.col("own.page_count")).otherwise(F.col("best.page_count")).alias("page_count"))

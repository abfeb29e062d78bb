"""Pages after layout: fields that depend on them, header and footer reserves, columns, what an edit leaves valid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numbers import label_number


def page_numbers(pages: DataFrame, kind: str = "page_format", restart: str = "page_start") -> DataFrame:
    """pages: doc_id, page (from 0), section_index, page_start, page_format. Adds number and shown: numbers go on from page to
    page and start anew at the first page of a section that names a first number."""
    w = Window.partitionBy("doc_id").orderBy("page")
    first = ~F.col("section_index").eqNullSafe(F.lag("section_index").over(w))
    anew = F.coalesce(first, F.lit(True)) & F.col(restart).isNotNull()
    marked = pages.withColumn("__at", F.when(anew, F.struct("page", F.col(restart).alias("n"))))
    last = F.last("__at", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    numbered = marked.withColumn("__l", last).withColumn("number", F.when(F.col("__l").isNull(), F.col("page") + 1).otherwise(F.col("page") - F.col("__l.page") + F.col("__l.n")).cast("bigint"))
    return numbered.withColumn("shown", label_number(F.col("number"), F.coalesce(kind, F.lit("decimal")))).drop("__at", "__l")


def style_references(pages: DataFrame, headings: DataFrame) -> DataFrame:
    """pages: doc_id, page; headings: doc_id, page, node_index, text. The first heading on a page, else the last one before it."""
    on = headings.groupBy("doc_id", "page").agg(F.min_by("text", "node_index").alias("__first"), F.max_by("text", "node_index").alias("__last"))
    w = Window.partitionBy("doc_id").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    met = pages.join(on, ["doc_id", "page"], "left").withColumn("__before", F.last("__last", ignorenulls=True).over(w))
    return met.withColumn("reference", F.coalesce("__first", "__before")).drop("__first", "__last", "__before")


def body_height(page_height: Column, top: Column, bottom: Column, header: Column, header_height: Column, footer: Column, footer_height: Column, least: float = 120) -> Column:
    """Room for the body: what headers and footers need beyond the margins is taken from it."""
    over = lambda margin, distance, height: F.greatest(margin, distance + F.coalesce(height, F.lit(0.0)))
    return F.greatest(F.lit(float(least)), page_height - over(top, header, header_height) - over(bottom, footer, footer_height))


def in_columns(segments: DataFrame, columns: Column) -> DataFrame:
    """Segments paginated at the height of a column: page and column from the running number of columns."""
    return segments.withColumn("column", F.col("page") % columns).withColumn("page", F.floor(F.col("page") / columns).cast("int"))


def letterhead_sides(paragraphs: DataFrame, short: int = 60, indent_twips: int = 1440, near: int = 8) -> DataFrame:
    """paragraphs: doc_id, node_index, text, left_twips, right_twips, framed (whether it has a frame). With side: left for short
    or blank paragraphs that a right indent holds to the left, right for those that a left indent holds to the right,
    where a framed paragraph is near; null for body text."""
    around = Window.partitionBy("doc_id").orderBy("node_index").rowsBetween(-near, near)
    left, right = F.coalesce("left_twips", F.lit(0)), F.coalesce("right_twips", F.lit(0))
    column = (F.length("text") <= short) & F.max("framed").over(around)
    return paragraphs.withColumn("side", F.when(column & (right >= indent_twips) & (right > left), "left").when(column & (left >= indent_twips), "right"))


def retained_pages(before: DataFrame, after: DataFrame) -> DataFrame:
    """before: doc_id, page, node_index, signature; after: doc_id, node_index, signature. How many leading pages of each document
    hold no block that changed or moved: doc_id, retained."""
    joined = before.join(after.withColumnRenamed("signature", "__new"), ["doc_id", "node_index"], "left")
    dirty = joined.groupBy("doc_id").agg(F.min(F.when(~F.col("signature").eqNullSafe(F.col("__new")), F.col("page"))).alias("d"), F.max("page").alias("m"))
    return dirty.select("doc_id", F.coalesce("d", F.col("m") + 1).cast("int").alias("retained"))


def signature(*columns: str) -> Column:
    """A 64-bit change key of columns of any type."""
    return F.xxhash64(F.to_json(F.struct(*columns)))


def overlap_rects(fragments: DataFrame, selections: DataFrame) -> DataFrame:
    """fragments: doc_id, node_index, start, end, x, y, width, height; selections: doc_id, node_index, from, to. The part of each
    line that is selected, its x by the share of characters."""
    met = fragments.join(selections, ["doc_id", "node_index"]).where("`from` < end AND `to` > start AND end > start")
    a, b, n = F.greatest("from", "start"), F.least("to", "end"), F.col("end") - F.col("start")
    return met.select("doc_id", "node_index", "y", "height", (F.col("x") + F.col("width") * (a - F.col("start")) / n).alias("x"), (F.col("width") * (b - a) / n).alias("width"))


def nearest_fragment(points: DataFrame, fragments: DataFrame) -> DataFrame:
    """points: doc_id, page, px, py; fragments: doc_id, page, node_index, start, end, x, y, width, height. The node and offset under
    each point, or nearest to it on its page."""
    met = points.withColumn("__id", F.monotonically_increasing_id()).join(fragments, ["doc_id", "page"])
    away = lambda p, lo, size: F.greatest(F.col(lo) - F.col(p), F.col(p) - F.col(lo) - F.col(size), F.lit(0.0))
    dx, dy = away("px", "x", "width"), away("py", "y", "height")
    share = F.when(F.col("width") > 0, F.least(F.greatest((F.col("px") - F.col("x")) / F.col("width"), F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    offset = F.col("start") + F.floor(share * (F.col("end") - F.col("start")) + 0.5).cast("int")
    best = F.min_by(F.struct("node_index", offset.alias("offset")), F.struct((dx * dx + dy * dy).alias("d"), "node_index", "start"))
    return met.groupBy("__id", "doc_id", "page", "px", "py").agg(best.alias("b")).select("doc_id", "page", "px", "py", "b.node_index", "b.offset")


def caret_rects(targets: DataFrame, fragments: DataFrame) -> DataFrame:
    """targets: doc_id, node_index, offset; fragments: doc_id, page, node_index, start, end, x, y, width, height and, where they are
    known, advances (the width of the first n characters, for n from 0). Of the first fragment that holds the offset, the place
    of the caret: by the advances, else its left or (at its end) right edge."""
    met = targets.join(fragments, ["doc_id", "node_index"]).where("offset BETWEEN start AND end")
    edge = F.when(F.col("offset") >= F.col("end"), F.col("x") + F.col("width")).otherwise(F.col("x"))
    x = F.coalesce(F.col("x") + F.get("advances", (F.col("offset") - F.col("start")).cast("int")), edge) if "advances" in fragments.columns else edge
    first = F.min_by(F.struct("page", x.alias("x"), "y", F.lit(1.0).alias("width"), "height"), F.struct("page", "y", "start", "x"))
    return met.groupBy("doc_id", "node_index", "offset").agg(first.alias("c")).select("doc_id", "node_index", "offset", "c.*")


def with_fragments(fragments: DataFrame, new: DataFrame) -> DataFrame:
    """fragments with those of each doc_id, page and node_index that new has taken from new."""
    keys = ["doc_id", "page", "node_index"]
    return fragments.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def line_slices(lines: DataFrame, ranges: DataFrame) -> DataFrame:
    """lines: doc_id, node_index, line, y, line_height; ranges: doc_id, node_index, from, to. The lines of each range, the first at y 0,
    with the number of lines and the height of the slice."""
    keys = ["doc_id", "node_index", "from", "to"]
    w = Window.partitionBy(*keys)
    kept = lines.join(ranges, ["doc_id", "node_index"]).where("line >= `from` AND line < `to`").withColumn("y", F.col("y") - F.min("y").over(w))
    return kept.withColumn("line_count", F.count("*").over(w)).withColumn("height", F.max("y").over(w) + F.greatest(F.lit(1.0), F.round(F.max("line_height").over(w))))


def snapshot_states(operations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """operations: snapshot_id, seq, kind (set-selection, set-floating-draft or clear-floating-draft), target_key, value. (the selection
    of each snapshot, the drafts that stand): the last operation on each counts."""
    last = lambda rows, *keys: rows.groupBy("snapshot_id", *keys).agg(F.max_by(F.struct("kind", "value"), "seq").alias("l"))
    chosen = last(operations.where("kind = 'set-selection'")).select("snapshot_id", F.col("l.value").alias("selection"))
    drafts = last(operations.where("kind IN ('set-floating-draft', 'clear-floating-draft')"), "target_key").where("l.kind = 'set-floating-draft'")
    return chosen, drafts.select("snapshot_id", "target_key", F.col("l.value").alias("draft"))


def page_starts(segments: DataFrame) -> DataFrame:
    """segments: doc_id, page, ord, node_index. The first node of each page that has one."""
    return segments.where("node_index IS NOT NULL").groupBy("doc_id", "page").agg(F.min_by("node_index", "ord").alias("node_index"))


def layout_nodes(blocks: DataFrame, containers: tuple[str, ...] = ("word/document.xml",)) -> DataFrame:
    """Blocks (as model.blocks gives them) as a layout takes them: doc_id, node_index, kind, text, and the style's keeps, breaks and
    distances in pixels; text in header and footer parts is laid out apart."""
    px = lambda c: F.greatest(F.floor(F.coalesce(F.col(f"style.{c}"), F.lit(0)) / 15 + 0.5), F.lit(0)).cast("double")
    on = lambda c: F.coalesce(F.col(f"style.{c}"), F.lit(False))
    return blocks.where(F.col("container").isin(*containers)).select(
        "doc_id", "node_index", "kind", "text", px("before_twips").alias("before_px"), px("after_twips").alias("after_px"), on("keep_next").alias("keep_next"), on("keep_lines").alias("keep_lines"), on("page_break_before").alias("page_break_before"),
        F.coalesce("break_inside", F.lit(False)).alias("hard_break"), (F.col("section_xml").isNotNull()).alias("ends_section"),
    )

"""Full pagination: blocks onto pages, with lines and table rows split, kept chains, and breaks.

A fold with look-ahead, so one Python pass over each document's blocks in order. Heights are input columns.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOLERANCE, MIN_LINE, MIN_PAGE = 2, 14, 120
#: Room at a page's end that a part of a table row is put into.
MIN_SLICE = 2 * MIN_LINE
#: Room that a part of a paragraph needs besides its lines: above a continued part, for descenders, for safety (fixed values).
TOP_BLEED, DESCENDER, SAFETY, SAFETY_LINES = 22, 6, 24, 0.9
#: Input columns with their defaults.
COLUMNS = {
    "kind": ("string", "paragraph"), "height_px": ("double", 1.0), "line_height_px": ("double", 1.0), "line_count": ("int", 1), "before_px": ("double", 0.0), "after_px": ("double", 0.0), "keep_next": ("boolean", False), "keep_lines": ("boolean", False), "widow_control": ("boolean", True),
    "page_break_before": ("boolean", False), "hard_break": ("boolean", False), "rendered_break": ("boolean", False), "spacer": ("boolean", False), "visible": ("boolean", True), "heading_level": ("int", None), "numbered": ("boolean", False), "text_length": ("int", 0),
    "row_heights_px": ("array<double>", None), "row_breaks": ("array<int>", None), "row_splits": ("array<boolean>", None), "row_edges": ("array<array<double>>", None), "page_height_px": ("double", None),
}
SEGMENT = "page int, ord int, node_index int, row_start int, row_end int, line_start int, line_end int, slice_start_px double, slice_px double"


@dataclass
class Block:
    node_index: int
    values: dict = field(repr=False, default_factory=dict)

    def __getattr__(self, name: str):
        return self.values[name]


def whole_pixels(x: float | None) -> int:
    return max(1, math.floor(x + 0.5)) if x is not None and math.isfinite(x) and x > 0 else 1


def reserve(start: int, end: int, total: int, line: float) -> int:
    """Room besides the lines start..end of a paragraph; none for all of it."""
    if start == 0 and end >= total:
        return 0
    return (TOP_BLEED if start else 0) + DESCENDER + max(SAFETY, math.ceil(SAFETY_LINES * line))


def hint_counts(used: float, height: float) -> bool:
    """Whether a break that was rendered before a paragraph counts: only where little of the page is left."""
    limit = max(3 * MIN_LINE, min(120, math.floor(height * 0.18 + 0.5)))
    return used > 0 and height > 0 and max(0, math.floor(height + 0.5) - math.floor(used + 0.5)) <= limit


class Paginator:
    """Puts the blocks of one document on pages."""

    def __init__(self, blocks: list[Block], page_height: float, overrides: dict[int, float] | None = None, split_lines: bool = True, honor_rendered: bool = False):
        self.blocks, self.default, self.overrides, self.split_lines, self.honor_rendered = blocks, page_height, overrides or {}, split_lines, honor_rendered
        self.page, self.filled, self.used, self.after, self.kept_until = 0, 0, 0.0, 0.0, -1
        self.out: list[tuple] = []
        self.limit = 0.0

    def own_height(self, b: Block) -> int:
        return max(MIN_PAGE, math.floor((b.page_height_px or self.default) + 0.5))

    def open_page(self, b: Block) -> None:
        o = self.overrides.get(self.page)
        self.limit = max(MIN_PAGE, math.floor(o + 0.5)) if o is not None and math.isfinite(o) and o > 0 else self.own_height(b)

    def turn(self, b: Block) -> None:
        self.page, self.filled, self.used, self.after = self.page + 1, 0, 0.0, 0.0
        self.open_page(b)

    def turn_if_filled(self, b: Block, when: bool = True) -> None:
        if when and self.filled:
            self.turn(b)

    def put(self, b: Block, height: float, after: float = 0.0, rows: tuple | None = None, lines: tuple | None = None, part: tuple | None = None) -> None:
        self.out.append((self.page, self.filled, b.node_index, *(rows or (None, None)), *(lines or (None, None)), *(part or (None, None))))
        self.filled, self.used, self.after = self.filled + 1, self.used + height, after

    def run(self) -> list[tuple]:
        if self.blocks and not (math.isfinite(self.default) and self.default > 0):
            return [(0, k, b.node_index, *[None] * 6) for k, b in enumerate(self.blocks)]
        for k, b in enumerate(self.blocks):
            if k == 0:
                self.open_page(b)
            self.turn_if_filled(b, b.hard_break)
            if b.kind == "table":
                self.table(b)
            elif b.spacer:
                self.after = 0.0
            else:
                self.paragraph(k, b)
        return self.out

    def paragraph(self, k: int, b: Block) -> None:
        self.turn_if_filled(b, b.page_break_before)
        self.turn_if_filled(b, self.honor_rendered and b.rendered_break and hint_counts(self.used, self.limit))
        height, line, lines = whole_pixels(b.height_px), whole_pixels(b.line_height_px), max(1, b.line_count or 1)
        too_tall = height > self.own_height(b) + TOLERANCE
        chained = b.node_index <= self.kept_until
        self.turn_if_filled(b, too_tall and (b.keep_lines or b.keep_next) and not chained and self.used > 0)
        overlap = min(self.after, b.before_px) if self.used > 0 else 0.0
        least = 2 if b.widow_control else 1
        free = lines > 1 and (too_tall or not (b.keep_lines or b.keep_next))
        if self.split_lines and free and (lines > 3 or not b.widow_control):
            self.in_lines(b, lines, line, least, overlap)
            return
        need = max(1, height - overlap)
        end = -1
        if b.keep_next and b.visible and not chained:
            more, end = self.chain(k)
            need += more
        self.turn_if_filled(b, self.used > 0 and need > self.limit - self.used + TOLERANCE)
        if self.used == 0 and end > b.node_index:
            self.kept_until = end  # the chain begins a page: its members are not pushed again
        self.put(b, max(1, height - overlap) if self.used > 0 else height, b.after_px)

    def chain(self, k: int) -> tuple[float, int]:
        """Height of what must stay with block k, and the last block of its chain."""
        more, after = 0.0, self.blocks[k].after_px
        while k + 1 < len(self.blocks):
            b, following = self.blocks[k], self.blocks[k + 1]
            if b.kind == "table" or not (b.keep_next and b.visible) or following.hard_break:
                break
            if following.kind == "table":
                rows = [max(MIN_LINE, whole_pixels(h)) for h in following.row_heights_px or []] or [whole_pixels(following.height_px)]
                more += sum(rows) if sum(rows) <= self.own_height(following) + TOLERANCE else rows[0]
                break
            more += max(1, whole_pixels(following.height_px) - min(after, following.before_px))
            if b.heading_level is not None and (following.numbered or following.text_length >= 80):
                share, floor = (1.0, 10) if following.numbered else (0.5, 6)
                more += max(floor, math.floor(following.line_height_px * share + 0.5))
            after, k = following.after_px, k + 1
        return more, self.blocks[k].node_index

    def in_lines(self, b: Block, total: int, line: int, least: int, overlap: float) -> None:
        at = 0
        while at < total:
            left, room = total - at, max(0.0, self.limit - self.used)
            top = 0.0 if at else max(0.0, b.before_px - overlap) if self.used > 0 else b.before_px
            rest = top + left * line + (b.after_px if left <= least else 0.0)
            if rest + reserve(at, total, total, line) <= room:
                self.put(b, rest, b.after_px, lines=(at, total))
                return
            most = max(0, left - least)
            space = max(0.0, room - top - reserve(at, at + most, total, line))
            fit = min(most, math.floor(space / line))
            if fit < least:
                if self.filled:
                    self.turn(b)
                    continue
                fit = max(1, min(most or left, max(1, math.floor(max(1.0, space) / line))))
            self.put(b, top + fit * line, 0.0, lines=(at, at + fit))
            at += fit
            if at < total:
                self.turn(b)

    def table(self, b: Block) -> None:
        rows = [max(1.0, h if h is not None else MIN_LINE) for h in b.row_heights_px or []]
        if not rows:
            self.put(b, 0.0)
            return
        breaks = sorted(set(b.row_breaks or []))
        self.turn_if_filled(b, 0 in breaks)
        splits, edges = b.row_splits or [], b.row_edges or []
        at = 0
        while at < len(rows):
            room, end, height = max(0.0, self.limit - self.used) + TOLERANCE, at, 0.0
            while end < len(rows) and height + rows[end] <= room:
                height, end = height + rows[end], end + 1
            if end == at and self.slices(rows, splits, at):
                self.turn_if_filled(b, not (at < len(splits) and splits[at]))  # a row that is cut only since no page holds it begins a page
                self.in_slices(b, at, rows[at], edges[at] if at < len(edges) else None)
                at += 1
                continue
            if end == at and self.used <= 0:
                end = at + 1
            forced = next((r for r in breaks if r > at), None)
            if forced is not None:
                end = min(end, forced)
            elif end - at > 1 and len(rows) - end == 1 and not self.slices(rows, splits, end, height):
                end -= 1  # no single row alone on the next page
            if end == at:
                if self.filled:
                    self.turn(b)
                    continue
                end = at + 1
            whole = at == 0 and end == len(rows)
            self.put(b, sum(rows[at:end]), rows=None if whole else (at, end))
            at = end
            if at < len(rows) and (at in breaks or not (at < len(splits) and splits[at] and self.slices(rows, splits, at))):
                self.turn(b)

    def slices(self, rows: list[float], splits: list, row: int, more: float = 0.0) -> bool:
        """Whether a row is cut into parts where it stands: no page holds it, or it may be cut and there is room for a part."""
        if row >= len(rows):
            return False
        roomy = self.limit - self.used - more >= MIN_SLICE
        return rows[row] > self.limit + TOLERANCE or (row < len(splits) and bool(splits[row]) and roomy)

    def in_slices(self, b: Block, row: int, total: float, edges: list[float] | None) -> None:
        """Parts of a row, as tall as there is room; each ends at an edge of what stands in the row, if there is one."""
        at = 0.0
        self.turn_if_filled(b, self.limit - self.used < MIN_SLICE)
        while at < total:
            size = min(max(1.0, self.limit - self.used), total - at)
            if at + size < total:
                size = max((e for e in (() if edges is None else edges) if at < e <= at + size), default=at + size) - at
            self.put(b, size, rows=(row, row + 1), part=(at, size))
            at += size
            if at < total:
                self.turn(b)


def paginate_blocks(blocks: DataFrame, page_height: float, split_lines: bool = True, honor_rendered: bool = False) -> DataFrame:
    """blocks: doc_id, node_index and any of COLUMNS. Segments: doc_id and SEGMENT (pages from 0). Rows go through one Python
    pass a partition, sorted by document and place; a document's blocks are held while it is paginated."""
    have = [c for c in COLUMNS if c in blocks.columns]
    rows = blocks.select("doc_id", F.col("node_index").cast("int").alias("node_index"), *[F.col(c).cast(COLUMNS[c][0]).alias(c) for c in have])
    kind = rows.schema["doc_id"].dataType.simpleString()

    def value(c: str, v):
        if isinstance(v, (list, tuple)) or hasattr(v, "tolist") and getattr(v, "ndim", 0):
            return list(v)
        return COLUMNS[c][1] if v is None or v != v else v

    def one(doc, held: list[Block]) -> pd.DataFrame:
        found = Paginator(held, page_height, split_lines=split_lines, honor_rendered=honor_rendered).run()
        out = pd.DataFrame(found, columns=[x.split()[0] for x in SEGMENT.split(", ")], dtype=object)
        out.insert(0, "doc_id", doc)
        return out

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        doc, held = None, []
        for frame in frames:
            for r in frame.to_dict("records"):
                if held and r["doc_id"] != doc:
                    yield one(doc, held)
                    held = []
                doc = r["doc_id"]
                values = {c: d for c, (_, d) in COLUMNS.items()} | {c: value(c, r[c]) for c in have}
                held.append(Block(int(r["node_index"]), values))
        if held:
            yield one(doc, held)

    return rows.repartition("doc_id").sortWithinPartitions("doc_id", "node_index").mapInPandas(fold, f"doc_id {kind}, {SEGMENT}")


def letterhead_groups(segments: DataFrame) -> DataFrame:
    """segments: doc_id, page, ord, side (left, right or null). Maximal runs of sided segments with both sides: doc_id, page,
    start, end (behind the last)."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("doc_id", "page").orderBy("ord")
    islands = segments.withColumn("g", F.sum((F.col("side").isNull() | F.lag("side").over(w).isNull()).cast("int")).over(w)).where("side IS NOT NULL")
    both = islands.groupBy("doc_id", "page", "g").agg(F.min("ord").alias("start"), (F.max("ord") + 1).alias("end"), F.count_if(F.col("side") == "left").alias("l"), F.count_if(F.col("side") == "right").alias("r"))
    return both.where("l > 0 AND r > 0").select("doc_id", "page", "start", "end")

"""Page counts brought to the number a document has stored, by scaling the height of its pages."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .segmentation import COLUMNS, MIN_PAGE, Block, Paginator

#: Scales that are tried in turn for more and for fewer pages, steps between two of them, and the largest difference mended.
LOWER, HIGHER, STEPS, MAX_DIFFERENCE = [1 - 0.02 * k for k in range(1, 41)], [1 + 0.02 * k for k in range(1, 16)], 10, 3


def search(count_at: Callable[[float], int], initial: int, target: int, max_difference: int = MAX_DIFFERENCE) -> tuple[float, int]:
    """(scale, pages). Scales go outwards from 1 until one gives the target; between it and the one before, the tenth nearest to 1
    that gives it too is taken. Where none does: the nearest count when pages were missing, else the scale stays 1."""
    target = max(1, target)
    if initial == target or abs(initial - target) > max_difference:
        return 1.0, initial
    more, before, best = initial < target, 1.0, (abs(initial - target), 0.0, 1.0, initial)
    for scale in LOWER if more else HIGHER:
        pages = count_at(scale)
        if pages == target:
            for k in range(1, STEPS + 1):
                tenth = before + (scale - before) * k / STEPS
                if count_at(tenth) == target:
                    return tenth, target
            return scale, target
        best = min(best, (abs(pages - target), abs(scale - 1), scale, pages))
        before = scale
    return (best[2], best[3]) if more else (1.0, initial)


def reconcile(blocks: DataFrame, targets: DataFrame, page_height: float) -> DataFrame:
    """blocks as for segmentation.paginate_blocks; targets: doc_id, target. doc_id, initial, target, scale, pages."""
    have = [c for c in COLUMNS if c in blocks.columns]
    rows = blocks.join(targets.select("doc_id", F.col("target").cast("int").alias("target")), "doc_id").select("doc_id", "target", F.col("node_index").cast("int").alias("node_index"), *[F.col(c).cast(COLUMNS[c][0]).alias(c) for c in have])
    kind = rows.schema["doc_id"].dataType.simpleString()

    def clean(c: str, v):
        if hasattr(v, "tolist") and getattr(v, "ndim", 0):
            return list(v)
        return COLUMNS[c][1] if v is None or v != v else v

    def one(doc, target: int, held: list[Block]) -> tuple:
        own = [b.page_height_px for b in held]

        def count_at(scale: float) -> int:
            for b, h in zip(held, own, strict=True):
                b.values["page_height_px"] = None if h is None else max(MIN_PAGE, h * scale)
            found = Paginator(held, max(MIN_PAGE, page_height * scale)).run()
            return found[-1][0] + 1 if found else 0

        initial = count_at(1.0)
        scale, pages = search(count_at, initial, target)
        return doc, initial, target, scale, pages

    def apply(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        doc, target, held = None, 0, []
        columns = ["doc_id", "initial", "target", "scale", "pages"]
        for frame in frames:
            for r in frame.to_dict("records"):
                if held and r["doc_id"] != doc:
                    yield pd.DataFrame([one(doc, target, held)], columns=columns)
                    held = []
                doc, target = r["doc_id"], int(r["target"])
                held.append(Block(int(r["node_index"]), {c: d for c, (_, d) in COLUMNS.items()} | {c: clean(c, r[c]) for c in have}))
        if held:
            yield pd.DataFrame([one(doc, target, held)], columns=columns)

    return rows.repartition("doc_id").sortWithinPartitions("doc_id", "node_index").mapInPandas(apply, f"doc_id {kind}, initial int, target int, scale double, pages int")


def reduction_allowed(estimated: Column, target: Column, has_hints: Column, hint_pages: Column, overlap: Column) -> Column:
    """Whether a document may be brought to fewer pages than estimated: not where its own rendered breaks say otherwise, and with
    measured overlaps only where they say so."""
    whole = lambda c: F.greatest(F.lit(1), F.floor(c + 0.5))
    supported = F.coalesce(has_hints & (whole(target) >= whole(hint_pages)), F.lit(False))
    hinted = F.coalesce(has_hints, F.lit(False))
    return F.when(whole(target) >= whole(estimated), True).when(F.coalesce(overlap, F.lit(False)) | hinted, supported).otherwise(True)


def latched(overlap: Column, pages: Column, target: Column) -> Column:
    """A measured overlap holds while there are no more pages than stored."""
    return F.coalesce(overlap & (F.greatest(F.lit(1), pages) <= F.greatest(F.lit(1), target)), F.lit(False))


def measured_or_estimated(documents: DataFrame, measured: DataFrame, estimated: DataFrame) -> DataFrame:
    """documents: doc_id, edited (undo or redo is possible), has_measured. measured, estimated: a row for each segment with doc_id, page
    and split (whether it is part of a paragraph). doc_id, use_estimated: for documents as they were read, whose measured pages
    hold nothing but parts of paragraphs, the estimate counts if its pages do too and are fewer."""

    def shape(segments: DataFrame, name: str) -> DataFrame:
        return segments.groupBy("doc_id").agg(F.countDistinct("page").alias(f"{name}_pages"), F.bool_and("split").alias(f"{name}_split"))

    met = documents.join(shape(measured, "m"), "doc_id", "left").join(shape(estimated, "e"), "doc_id", "left")
    use = ~F.col("edited") & F.col("has_measured") & F.col("m_split") & F.col("e_split") & (F.col("e_pages") < F.col("m_pages"))
    return met.select("doc_id", F.coalesce(use, F.lit(False)).alias("use_estimated"))

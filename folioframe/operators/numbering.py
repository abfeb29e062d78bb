"""List labels: counters by level, and level texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numbers import label_number


def counters(items: DataFrame, list_id: str, order: str, levels: int, level: str = "ilvl", starts: Column | None = None, restarts: Column | None = None) -> DataFrame:
    """items with ``counts``: for each level down to the item's own, the number its counter shows (null below).

    A level's counter starts anew after an item of any level above. restarts (array by level) changes that: 0 never, n only
    after an item of the n-th level from the top; null and numbers that don't name a level above stand for the rule.
    starts: array of first numbers by level (1 without it). Windows only: the items of a level are counted within the
    stretch that nothing interrupts.
    """
    w = Window.partitionBy(list_id).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = items
    for k in range(levels):
        anew = F.col(level) < k
        if restarts is not None:
            r = F.try_element_at(restarts, F.lit(k + 1))
            anew = F.when(r == 0, F.lit(False)).when(r.between(1, k), F.col(level) == r - 1).otherwise(anew)
        out = out.withColumn(f"__g{k}", F.sum(anew.cast("int")).over(w))
    counts = []
    for k in range(levels):
        within = Window.partitionBy(list_id, f"__g{k}").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        first = F.coalesce(F.try_element_at(starts, F.lit(k + 1)), F.lit(1)) if starts is not None else F.lit(1)
        n = F.sum((F.col(level) == k).cast("int")).over(within)
        # A deeper item before any of this level shows the level's first number.
        counts.append(F.when(F.col(level) >= k, F.greatest(n, F.lit(1)) + first - 1 if starts is not None else n))
    return out.withColumn("counts", F.array(*counts)).drop(*[f"__g{k}" for k in range(levels)])


def level_text(pattern: Column, counts: Column, formats: Column, levels: int = 9) -> Column:
    """A level text like "%1.%2)" with each %n replaced by the counter of level n in its format."""
    places = F.array(*[F.lit(k + 1) for k in range(levels)])
    shown = F.transform(places, lambda k: F.coalesce(label_number(F.try_element_at(counts, k).cast("bigint"), F.coalesce(F.try_element_at(formats, k), F.lit("decimal"))), F.lit("")))
    pairs = F.zip_with(places, shown, lambda k, v: F.struct(F.concat(F.lit("%"), k.cast("string")).alias("k"), v.alias("v")))
    return F.aggregate(pairs, pattern, lambda text, p: F.replace(text, p["k"], p["v"]))


def paragraph_lists(paragraphs: DataFrame, styles: DataFrame) -> DataFrame:
    """paragraphs (doc_id, style_id, num_id, ilvl, has_num) with the list that holds: a direct level without a list keeps the
    style's list, a direct list 0 takes the paragraph out. styles: doc_id, style_id, style_num_id, style_ilvl (inherited)."""
    joined = paragraphs.join(styles, ["doc_id", "style_id"], "left")
    own = F.when(F.col("num_id") == 0, F.lit(None)).otherwise(F.coalesce("num_id", "style_num_id"))
    return joined.select(*[c for c in paragraphs.columns if c not in ("num_id", "ilvl")], own.alias("num_id"), F.coalesce("ilvl", "style_ilvl", F.lit(0)).alias("ilvl"))


def labels(paragraphs: DataFrame, levels: DataFrame, nums: DataFrame, max_levels: int = 9) -> DataFrame:
    """paragraphs (doc_id, node_index, num_id, ilvl) with label. levels: doc_id, abstract_num_id, ilvl, start, format, lvl_text,
    restart, is_lgl; nums: doc_id, num_id, abstract_num_id, start_overrides (map of level text to start). Items of all nums of
    one abstract definition share its counters, unless a num overrides a start: then it counts on its own."""
    entry = F.struct("ilvl", "start", "format", "lvl_text", "restart", "is_lgl")
    defs = levels.groupBy("doc_id", "abstract_num_id").agg(F.sort_array(F.collect_list(entry)).alias("__d"))
    listed = paragraphs.join(nums, ["doc_id", "num_id"]).join(defs, ["doc_id", "abstract_num_id"])
    at = lambda k, f: F.get(F.filter("__d", lambda d: d["ilvl"] == k), F.lit(0))[f]
    own = F.get(F.filter("__d", lambda d: d["ilvl"] == F.col("ilvl")), F.lit(0))
    start = F.array(*[F.coalesce(F.element_at("start_overrides", F.lit(str(k))), at(k, "start"), F.lit(1)).cast("bigint") for k in range(max_levels)])
    formats = F.array(*[F.when(F.coalesce(own["is_lgl"], F.lit(False)), "decimal").otherwise(F.coalesce(at(k, "format"), F.lit("decimal"))) for k in range(max_levels)])
    apart = F.when(F.size("start_overrides") > 0, F.col("num_id"))
    listed = listed.withColumn("__starts", start).withColumn("__restarts", F.array(*[at(k, "restart") for k in range(max_levels)])).withColumn("__formats", formats).withColumn("__text", own["lvl_text"])
    listed = listed.withColumn("__list", F.struct("doc_id", "abstract_num_id", apart.alias("num_id")))
    counted = counters(listed, "__list", "node_index", max_levels, starts=F.col("__starts"), restarts=F.col("__restarts"))
    return counted.select(*paragraphs.columns, level_text(F.col("__text"), F.col("counts"), F.col("__formats"), max_levels).alias("label"))

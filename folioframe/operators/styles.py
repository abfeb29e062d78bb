"""Styles: cascades, toggles, inheritance along basedOn."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def toggle(default: Column, paragraph: Column, character: Column, direct: Column) -> Column:
    """A toggle property: direct formatting wins; set in both styles it is off; else character, paragraph, default."""
    both = F.coalesce(paragraph & character, F.lit(False))
    return F.when(direct.isNotNull(), direct).when(both, False).otherwise(F.coalesce(character, paragraph, default))


def cascade(*strongest_first: Column) -> Column:
    return F.coalesce(*strongest_first)


def merge_structs(fields: list[str], direct: Column, inherited: Column) -> Column:
    """Field by field, direct where it isn't null."""
    return F.struct(*[F.coalesce(direct[f], inherited[f]).alias(f) for f in fields])


def merge_tab_stops(inherited: Column, direct: Column) -> Column:
    """Arrays of struct<pos, align> as one by position, direct over inherited, of each the last of a position, sorted by position."""
    none = F.array().cast("array<struct<pos:bigint,align:string>>")
    last = lambda stops: F.filter(stops, lambda t, i: ~F.exists(F.slice(stops, i + 2, F.size(stops)), lambda u: u["pos"] == t["pos"]))
    own = last(F.coalesce(direct, none))
    places = F.transform(own, lambda t: t["pos"])
    return F.array_sort(F.concat(F.filter(last(F.coalesce(inherited, none)), lambda t: ~F.array_contains(places, t["pos"])), own))


def ancestors(styles: DataFrame, by: list[str], style: str = "style_id", parent: str = "based_on", max_depth: int = 64) -> DataFrame:
    """by, style, ancestor, depth (0: the style itself) along basedOn. A parent that doesn't exist ends a chain, one met again
    cuts it. A sheet's styles become one map, and each chain is climbed inside its row."""
    sheet = styles.where(F.col(style).isNotNull()).groupBy(*by).agg(F.map_from_entries(F.array_distinct(F.collect_list(F.struct(F.col(style).alias("k"), F.coalesce(F.col(parent).cast(styles.schema[style].dataType), F.lit(None)).alias("v"))))).alias("__up"))
    each = sheet.select(*by, "__up", F.explode(F.map_keys("__up")).alias("style_id"))

    def climb(seen: Column, _: Column) -> Column:
        up = F.try_element_at(F.col("__up"), F.element_at(seen, -1))
        more = up.isNotNull() & ~F.array_contains(seen, up) & F.map_contains_key(F.col("__up"), up)
        return F.when(F.coalesce(more, F.lit(False)), F.array_append(seen, up)).otherwise(seen)

    chain = F.aggregate(F.sequence(F.lit(1), F.least(F.lit(max_depth), F.size("__up"))), F.array("style_id"), climb)
    return each.select(*by, "style_id", F.posexplode(chain).alias("depth", "ancestor"))


def effective(styles: DataFrame, by: list[str], fields: list[str], style: str = "style_id", parent: str = "based_on") -> DataFrame:
    """Each style's fields, taken from the nearest style of its chain that has them."""
    values = styles.select(*by, F.col(style).alias("ancestor"), *fields)
    met = ancestors(styles, by, style, parent).join(values, [*by, "ancestor"])
    nearest = [F.min_by(f, F.when(F.col(f).isNotNull(), F.col("depth"))).alias(f) for f in fields]
    return met.groupBy(*by, "style_id").agg(*nearest, F.max("depth").alias("depth"))


def conditional(cells: DataFrame, formats: DataFrame, keys: list[str], fields: list[str], conditions: str = "conditions") -> DataFrame:
    """cells: keys, style_id, conditions (array, the strongest last); formats: style_id, condition and fields. Each cell's fields,
    taken from the strongest condition that has them."""
    each = cells.select(*keys, "style_id", F.posexplode(conditions).alias("__p", "condition"))
    met = each.join(formats, ["style_id", "condition"], "left")
    return met.groupBy(*keys).agg(*[F.max_by(f, F.when(F.col(f).isNotNull(), F.col("__p"))).alias(f) for f in fields])

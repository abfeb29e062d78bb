"""Sections: as-of lookup, inherited references, header and footer variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def as_of(points: DataFrame, starts: DataFrame, by: str, position: str, start: str, *values: str) -> DataFrame:
    """points with the values of the last start at or before the position, within ``by``. One sort of both sides together, no
    range join; a start wins over a point at the same place."""
    left = points.select("*", F.col(position).alias("__at"), F.lit(1).alias("__point"), *[F.lit(None).cast(starts.schema[v].dataType).alias(v) for v in values], F.lit(None).cast("boolean").alias("__hit"))
    right = starts.select(by, F.col(start).alias("__at"), F.lit(0).alias("__point"), *values, F.lit(True).alias("__hit"))
    both = left.unionByName(right, allowMissingColumns=True)
    w = Window.partitionBy(by).orderBy("__at", "__point").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("__hit"), F.struct(*values)), ignorenulls=True).over(w)
    filled = both.withColumn("__last", last).where("__point = 1")
    return filled.select(*points.columns, *[F.col(f"__last.{v}").alias(v) for v in values])


def inherit(sections: DataFrame, by: list[str], order: str, reference: str) -> DataFrame:
    """A section without a reference of its own takes the last one before it, within ``by``."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return sections.withColumn("inherited", F.last(reference, ignorenulls=True).over(w))


def reference_type(value: Column) -> Column:
    """A reference's type; null and blank mean default."""
    t = F.trim(value)
    return F.when(t.isNull() | (t == ""), "default").otherwise(t)


def variant(page_index: Column, title_page: Column, even_enabled: Column, first: Column, even: Column, default: Column) -> Column:
    """The header or footer of a page: the first page of a section with a title page has its own (possibly none), pages with
    an odd index the even one if that is enabled and there; else the default one, else first, even."""
    return (
        F.when((page_index == 0) & F.coalesce(title_page, F.lit(False)), first)
        .when((page_index % 2 == 1) & F.coalesce(even_enabled, F.lit(False)) & even.isNotNull(), even)
        .otherwise(F.coalesce(default, first, even))
    )


def starts_new_page(break_type: Column, columns: Column) -> Column:
    return F.when(break_type == "continuous", False).when(break_type == "nextColumn", F.coalesce(columns, F.lit(1)) <= 1).otherwise(True)

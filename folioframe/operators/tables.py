"""Tables: column cursors, vertical merges, conditional formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def grid_columns(cells: DataFrame, table: str = "table_id", row: str = "row", cell: str = "cell", span: str = "span") -> DataFrame:
    """cells with grid_col, the sum of the spans before them in their row (a span counts 1 at least)."""
    w = Window.partitionBy(table, row).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    return cells.withColumn("grid_col", F.coalesce(F.sum(F.greatest(F.coalesce(F.col(span), F.lit(1)), F.lit(1))).over(w), F.lit(0)))


def vertical_merges(cells: DataFrame, table: str = "table_id", column: str = "grid_col", row: str = "row", merge: str = "v_merge") -> DataFrame:
    """cells (merge: restart, continue or null) with anchor_row and row_span: a restart opens an anchor, each continue below it
    without a gap adds a row; row_span stands at anchors, plain cells and continues without an anchor are their own."""
    w = Window.partitionBy(table, column).orderBy(row)
    opens = F.when(F.col(merge).isNull() | (F.col(merge) != "continue"), 1).otherwise(0)
    grouped = cells.withColumn("__group", F.sum(opens).over(w))
    g = Window.partitionBy(table, column, "__group")
    head = F.first(F.struct(F.col(merge).alias("m"), F.col(row).alias("r"))).over(g.orderBy(row))
    anchored = grouped.withColumn("__head", head)
    merged = (F.col(merge) == "continue") & (F.col("__head.m") == "restart")
    anchor = F.when(merged, F.col("__head.r")).otherwise(F.col(row))
    spans = F.when(F.col(merge) == "restart", F.count("*").over(g)).when(F.coalesce(merged, F.lit(False)), 0).otherwise(1)
    return anchored.select(*cells.columns, anchor.alias("anchor_row"), spans.cast("bigint").alias("row_span"))


def band(index: Column, size: int, header: Column) -> Column:
    """band1 or band2 by the place behind the header rows or columns; null inside them."""
    place = index - header
    return F.when(place >= 0, F.when(F.floor(place / size) % 2 == 0, "band1").otherwise("band2"))


#: Conditions from the weakest to the strongest (fixed values).
CONDITIONS = ("wholeTable", "band1Horz", "band2Horz", "band1Vert", "band2Vert", "firstRow", "lastRow", "firstCol", "lastCol", "nwCell", "neCell", "swCell", "seCell")


def conditions(row: Column, rows: Column, column: Column, columns: Column, first_row=True, last_row=True, first_col=True, last_col=True, h_band=True, v_band=True) -> Column:
    """The conditional formats that hold for a cell, the strongest last."""
    top, bottom = (row == 0) & first_row, (row == rows - 1) & last_row
    left, right = (column == 0) & first_col, (column == columns - 1) & last_col
    hb, vb = band(row, 1, F.lit(int(first_row))), band(column, 1, F.lit(int(first_col)))
    holds = {
        "wholeTable": F.lit(True), "band1Horz": (hb == "band1") & h_band, "band2Horz": (hb == "band2") & h_band, "band1Vert": (vb == "band1") & v_band, "band2Vert": (vb == "band2") & v_band, "firstRow": top, "lastRow": bottom,
        "firstCol": left, "lastCol": right, "nwCell": top & left, "neCell": top & right, "swCell": bottom & left, "seCell": bottom & right,
    }
    return F.array_compact(F.array(*[F.when(holds[c], c) for c in CONDITIONS]))


def column_counts(cells: DataFrame, table: str = "table_id", row: str = "row", span: str = "span") -> DataFrame:
    """Columns of each table: the widest row's sum of spans, one at least."""
    return cells.groupBy(table, row).agg(F.sum(F.greatest(F.col(span), F.lit(1))).alias("n")).groupBy(table).agg(F.greatest(F.max("n"), F.lit(1)).cast("bigint").alias("columns"))


#: Boundaries this close are one (fixed value).
NEAR_TWIPS = 80


def conflicting_grids(cells: DataFrame) -> DataFrame:
    """cells: table_id, row, cell, span, width_twips, continued, grid (array of the declared column widths). table_id of tables whose
    cells contradict their grid: the widest row addresses its columns, and either the grid is uniform and all cells have widths,
    or in most rows with widths most cells are off by over a fifth."""
    span = F.greatest(F.coalesce("span", F.lit(1)), F.lit(1))
    upto = Window.partitionBy("table_id", "row").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    placed = cells.withColumn("__span", span).withColumn("__at", F.coalesce(F.sum("__span").over(upto), F.lit(0)))
    expected = F.aggregate(F.slice("grid", F.least(F.col("__at"), F.size("grid")).cast("int") + 1, F.col("__span").cast("int")), F.lit(0).cast("bigint"), lambda s, x: s + x)
    measured = ~F.col("continued") & (F.col("width_twips") > 0) & (expected > 0)
    rows = placed.groupBy("table_id", "row").agg(
        F.first("grid").alias("grid"), F.sum("__span").alias("spans"), F.count_if(measured).alias("measured"), F.count_if(measured & (F.abs(F.col("width_twips") - expected) * 5 > expected)).alias("off"),
        F.bool_and(F.col("continued") | F.coalesce(F.col("width_twips") > 0, F.lit(False))).alias("full"),
    )
    found = rows.groupBy("table_id").agg(F.first("grid").alias("grid"), F.max("spans").alias("spans"), F.bool_and("full").alias("full"), F.count_if(F.col("measured") > 0).alias("measured"), F.count_if((F.col("measured") > 0) & (F.col("off") * 2 > F.col("measured"))).alias("off"))
    uniform = (F.size("grid") > 1) & F.forall("grid", lambda w: F.abs(w - F.element_at("grid", 1)) <= 1)
    return found.where((F.size("grid") > 0) & (F.col("spans") == F.size("grid")) & (F.col("measured") > 0) & ((uniform & F.col("full")) | (F.col("off") * 2 > F.col("measured")))).select("table_id")


def snapped_grid(cells: DataFrame) -> DataFrame:
    """Cells as for conflicting_grids. Tables that contradict their grid get the union of their rows' boundaries as a new one, those
    within NEAR_TWIPS of the one before merged, and each cell the span it has there; others keep theirs. table_id, row,
    cell, span, grid. A continued cell is as wide as the one above that it continues; a cell without width has its declared columns'."""
    bad = conflicting_grids(cells).withColumn("__bad", F.lit(True))
    span = F.greatest(F.coalesce("span", F.lit(1)), F.lit(1)).cast("int")
    marked = cells.withColumn("span", span).join(bad, "table_id", "left")
    kept = marked.where("__bad IS NULL").select("table_id", "row", "cell", "span", F.col("grid").cast("array<bigint>").alias("grid"))
    upto = Window.partitionBy("table_id", "row").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    wide = marked.where("__bad").withColumn("__at", F.coalesce(F.sum("span").over(upto), F.lit(0)))
    declared = F.aggregate(F.slice("grid", F.least(F.col("__at"), F.size("grid")).cast("int") + 1, F.col("span")), F.lit(0).cast("bigint"), lambda s, x: s + x)
    sized = wide.withColumn("__w", F.when(F.col("width_twips") > 0, F.col("width_twips").cast("bigint")).otherwise(F.greatest(declared, F.lit(1))))
    # One table is one row: its rows' cells in order, folded from the top, since what continues is as wide as what it continues.
    rows = sized.groupBy("table_id", "row").agg(F.transform(F.array_sort(F.collect_list(F.struct("cell", F.col("__w").alias("w"), "continued"))), lambda c: c).alias("cells"))
    tables = rows.groupBy("table_id").agg(F.array_sort(F.collect_list(F.struct("row", "cells"))).alias("rows"))
    bucket = lambda x: F.floor((x + NEAR_TWIPS / 2) / NEAR_TWIPS)
    entry, none = "map<bigint,bigint>", F.create_map().cast("map<bigint,bigint>")
    empty = F.array().cast("array<struct<row:bigint,cell:bigint,a:bigint,b:bigint>>")

    def cell(s, r, c):
        b = bucket(s["at"])
        w = F.when(c["continued"], F.coalesce(F.try_element_at(s["above"], b), c["w"])).otherwise(c["w"])
        above = F.when(c["continued"], s["above"]).otherwise(F.map_concat(F.map_filter(s["above"], lambda k, _: k != b), F.create_map(b, w)))
        out = F.array_append(s["out"], F.struct(r["row"].cast("bigint").alias("row"), c["cell"].cast("bigint").alias("cell"), s["at"].alias("a"), (s["at"] + w).alias("b")))
        return F.struct(above.cast(entry).alias("above"), (s["at"] + w).alias("at"), out.alias("out"))

    zero = F.struct(none.alias("above"), F.lit(0).cast("bigint").alias("at"), empty.alias("out"))
    fold = F.aggregate("rows", zero, lambda s, r: F.aggregate(r["cells"], F.struct(s["above"].alias("above"), F.lit(0).cast("bigint").alias("at"), s["out"].alias("out")), lambda t, c: cell(t, r, c)), lambda s: s["out"])
    placed = tables.select("table_id", fold.alias("placed"))
    ends = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0).cast("bigint")), F.transform("placed", lambda p: p["b"]))))
    merged = F.aggregate(ends, F.array().cast("array<bigint>"), lambda m, x: F.when((F.size(m) > 0) & (x - F.try_element_at(m, F.lit(-1)) <= NEAR_TWIPS), m).otherwise(F.array_append(m, x)))
    lined = placed.withColumn("lines", merged)
    near = lambda x: F.array_min(F.transform(F.col("lines"), lambda v, i: F.struct(F.abs(v - x).alias("d"), i.alias("i"))))["i"]
    each = lined.select("table_id", "lines", F.explode("placed").alias("p")).select("table_id", "p.row", "p.cell", F.greatest(near(F.col("p.b")) - near(F.col("p.a")), F.lit(1)).cast("int").alias("span"), F.when(F.size("lines") > 1, F.transform(F.slice("lines", 2, F.size("lines")), lambda v, i: v - F.element_at("lines", i + 1))).alias("grid"))
    return kept.unionByName(each.select(F.col("table_id"), F.col("row").cast(kept.schema["row"].dataType).alias("row"), F.col("cell").cast(kept.schema["cell"].dataType).alias("cell"), "span", "grid"))

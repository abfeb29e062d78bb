"""Corpus comparison: plans, thresholds, geometry, image metrics, selections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def comparison_plan(reference: DataFrame, viewer: DataFrame, keys: list[str], item: str) -> DataFrame:
    """Per key: items only in the reference, only in the viewer, in both, and whether the sets are equal."""
    r = reference.select(*keys, F.col(item).alias("__item")).distinct().withColumn("__r", F.lit(True))
    v = viewer.select(*keys, F.col(item).alias("__item")).distinct().withColumn("__v", F.lit(True))
    both = r.join(v, [*keys, "__item"], "full")
    out = both.groupBy(*keys).agg(F.count_if(F.col("__v").isNull()).alias("missing"), F.count_if(F.col("__r").isNull()).alias("unexpected"), F.count_if(F.col("__r") & F.col("__v")).alias("paired"))
    return out.withColumn("equal", (F.col("missing") == 0) & (F.col("unexpected") == 0))


def unmatched(rows: DataFrame, others: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(others, keys, "left_anti")


def matched(rows: DataFrame, others: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(others, keys, "left_semi")


def evaluate_thresholds(metrics: DataFrame, by: list[str], limits: dict[str, float]) -> DataFrame:
    """Per group: each metric's largest value, pages that fail (a value strictly above its limit), and whether none does."""
    failed = F.lit(False)
    for name, limit in limits.items():
        failed = failed | F.coalesce(F.col(name) > limit, F.lit(False))
    return metrics.groupBy(*by).agg(*[F.max(m).alias(f"max_{m}") for m in limits], F.count_if(failed).alias("failed_pages"), F.count("*").alias("pages"), F.bool_and(~failed).alias("passed"))


def relative_difference(a: Column, b: Column) -> Column:
    """|a - b| over the larger of both, to six places; 0 where both are 0."""
    top = F.greatest(F.abs(a), F.abs(b))
    return F.when(top == 0, 0.0).otherwise(F.round(F.abs(a - b) / top, 6))


def geometry(pairs: DataFrame, limit: float) -> DataFrame:
    """pairs: ref_width, ref_height, width, height. Adds the differences and fails strictly above the limit."""
    aspect = relative_difference(F.col("ref_width") / F.col("ref_height"), F.col("width") / F.col("height"))
    out = pairs.withColumn("width_diff", relative_difference(F.col("ref_width"), F.col("width"))).withColumn("height_diff", relative_difference(F.col("ref_height"), F.col("height"))).withColumn("aspect_diff", aspect)
    return out.withColumn("failed", (F.col("width_diff") > limit) | (F.col("height_diff") > limit) | (F.col("aspect_diff") > limit))


def nearest_color(color: Column, palette: dict[str, str]) -> Column:
    """The palette name with the least squared distance to a #RRGGBB colour; the first in name order among equals."""
    part = lambda c, i: F.conv(c.substr(2 + 2 * i, 2), 16, 10).cast("int")
    options = F.array(*[F.struct(*[F.lit(int(hexa[1 + 2 * i : 3 + 2 * i], 16)).alias(f"c{i}") for i in range(3)], F.lit(name).alias("name")) for name, hexa in sorted(palette.items())])
    ranked = F.transform(options, lambda o: F.struct(sum(((part(color, i) - o[f"c{i}"]) * (part(color, i) - o[f"c{i}"]) for i in range(3)), F.lit(0)).alias("d"), o["name"].alias("name")))
    return F.array_min(ranked)["name"]


def image_metrics(pixels: DataFrame, by: list[str], tolerance: int) -> DataFrame:
    """pixels: a row for each pixel, channels a0..a2 and b0..b2 (0 to 255). Mean absolute and root mean square difference, as
    shares of 255, and the share of pixels with a channel off by more than the tolerance."""
    diffs = [F.abs(F.col(f"a{i}") - F.col(f"b{i}")) for i in range(3)]
    mean = sum(diffs[1:], diffs[0]) / 3.0 / 255.0
    square = sum((d * d for d in diffs[1:]), diffs[0] * diffs[0]) / 3.0 / (255.0 * 255.0)
    return pixels.groupBy(*by).agg(F.avg(mean).alias("mean_absolute_diff"), F.sqrt(F.avg(square)).alias("root_mean_square_diff"), F.avg((F.greatest(*diffs) > tolerance).cast("double")).alias("mismatch_ratio"))


def band_of(place: Column, size: Column, count: int) -> tuple[Column, Column]:
    """(band, its size) of a row or column, where size of them are cut into count bands as evenly as can be, the larger ones first."""
    small, larger = F.floor(size / count), size % count
    first = larger * (small + 1)
    band = F.when(place < first, F.floor(place / (small + 1))).otherwise(larger + F.floor((place - first) / F.greatest(small, F.lit(1))))
    return band.cast("int"), F.when(place < first, small + 1).otherwise(small)


def band_profile(pixels: DataFrame, by: list[str], axis: str, count: int) -> DataFrame:
    """pixels: a row for each pixel with by, y, x, height, width and ink (boolean). by, band and ink: the share of inked pixels in
    each of count bands along y or x."""
    size, across = ("height", "width") if axis == "y" else ("width", "height")
    band, thick = band_of(F.col(axis), F.col(size), count)
    return pixels.withColumn("band", band).groupBy(*by, "band").agg((F.count_if("ink") / F.max(thick * F.col(across))).alias("ink"))


def structure_metrics(pixels: DataFrame, by: list[str], vertical: int = 12, horizontal: int = 8, columns: int = 6, rows: int = 8) -> DataFrame:
    """pixels: a row for each pixel with by, y, x, height, width, ink_a and ink_b (booleans). How the layouts of two images differ: of
    ink coverage, the outermost inked rows and columns, profiles of bands and of a grid, and all of them weighted as one
    (the edges less where there is little ink)."""
    v, v_size = band_of(F.col("y"), F.col("height"), vertical)
    h, h_size = band_of(F.col("x"), F.col("width"), horizontal)
    r, r_size = band_of(F.col("y"), F.col("height"), rows)
    c, c_size = band_of(F.col("x"), F.col("width"), columns)
    part = lambda kind, i, j, n: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"), n.cast("bigint").alias("n"))
    no, all_ = F.lit(0), F.col("height") * F.col("width")
    parts = F.array(part("all", no, no, all_), part("v", v, no, v_size * F.col("width")), part("h", h, no, h_size * F.col("height")), part("g", r, c, r_size * c_size))
    each = pixels.select(*by, "y", "x", "height", "width", "ink_a", "ink_b", F.explode(parts).alias("p"))
    edges = [f(F.when(F.col(f"ink_{s}"), F.col(at) / F.col(size))).alias(f"{f.__name__}_{at}_{s}") for s in "ab" for at, size in (("y", "height"), ("x", "width")) for f in (F.min, F.max)]
    bands = each.groupBy(*by, "p.kind", "p.i", "p.j", "p.n").agg(F.count_if("ink_a").alias("a"), F.count_if("ink_b").alias("b"), *edges)
    diff = F.abs(F.col("a") - F.col("b")) / F.col("n")
    of = lambda kind, x: F.max(F.when(F.col("kind") == kind, x))
    mean = lambda kind: F.avg(F.when(F.col("kind") == kind, diff))
    one = bands.groupBy(*by).agg(
        of("all", F.col("a") / F.col("n")).alias("coverage_a"), of("all", F.col("b") / F.col("n")).alias("coverage_b"), mean("v").alias("vertical_diff"), mean("h").alias("horizontal_diff"), mean("g").alias("grid_diff"),
        *[F.coalesce(of("all", F.col(f"{f}_{at}_{s}")), F.lit(1.0 if f == "min" else 0.0)).alias(f"{f}_{at}_{s}") for s in "ab" for at in "yx" for f in ("min", "max")],
    )
    edge = {name: F.abs(F.col(f"{f}_{at}_a") - F.col(f"{f}_{at}_b")) for name, f, at in (("top_diff", "min", "y"), ("bottom_diff", "max", "y"), ("left_diff", "min", "x"), ("right_diff", "max", "x"))}
    out = one.withColumns({"coverage_diff": F.abs(F.col("coverage_a") - F.col("coverage_b")), **edge, "edge_weight": F.least(F.lit(1.0), (F.col("coverage_a") + F.col("coverage_b")) / 2 / 0.05)})
    total = F.expr("coverage_diff + vertical_diff + horizontal_diff + grid_diff + edge_weight * (top_diff + bottom_diff + left_diff + right_diff)") / (4 + 4 * F.col("edge_weight"))
    names = ["coverage_a", "coverage_b", "coverage_diff", *edge, "vertical_diff", "horizontal_diff", "grid_diff", "edge_weight"]
    return out.select(*by, *[F.round(n, 6).alias(n) for n in names], F.round(total, 6).alias("layout_structure_diff"))


def fingerprint(records: DataFrame, line: str) -> DataFrame:
    """SHA-256 of the distinct lines in byte order, each with a line feed. For record lists of one machine, not for corpora."""
    lines = F.array_sort(F.collect_set(line))
    return records.agg(F.sha2(F.concat(F.array_join(lines, "\n"), F.lit("\n")), 256).alias("fingerprint"), F.countDistinct(line).alias("lines"))

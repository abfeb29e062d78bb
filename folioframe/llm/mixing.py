"""Mixing sources to target sizes by pivotal dependent rounding (operator 6, native).

Every document of a source should be copied target / source_size times. The fractional part of that is
rounded in pairs: two documents exchange mass (copies times words) until one of them is whole, in a random
direction that keeps both expectations, so the words taken from the source never change. Blocks of some
64 documents are folded this way, the longest first, so that what is left over is a short one: each leaves one fractional document, and those residuals meet in the next
level of a reduction tree, until a
source has one left, which goes to the nearer whole number. Each level is a written table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import column, discard, fresh, let, materialize, text_of, words_of

WEIGHTS = (5, 2, 1)
SHARE, CAP, BLOCK, SEED = 1.5, 2, 64, 20240229
STATE = "struct<source:string,doc_id:string,size:bigint,m:bigint,h:bigint,x:double>"


def numbered(df: DataFrame, *order: Column) -> DataFrame:
    """df with ``number``, 1 for the first in the order: range partitions, each numbered on its own, plus the counts of those before."""
    parts = materialize(df.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ranges")
    before = parts.groupBy("part").count().select("part", (F.sum("count").over(Window.orderBy("part")) - F.col("count")).alias("before"))  # a row for each partition
    own = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    return parts.withColumn("number", own).join(F.broadcast(before), "part").withColumn("number", F.col("number") + F.col("before")).drop("part", "before")


def targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """sources (source, source_size) with weight and target.

    Sources in code point order (null last) weigh 5, 2, 1, 5, ... and share 150% of all sizes; a target stops
    at cap times its source's size, and the excess goes to the others by weight until none is above: target =
    min(cap * source_size, level * weight), with the level found by repeated sums over the sources.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.col("number") - 1) % len(weights) + 1).cast("int"))
    weighed = materialize(numbered(sources, F.col("source").asc_nulls_last()).select("source", "source_size", w.alias("weight")), "sources")
    total = share * (weighed.agg(F.sum("source_size")).first()[0] or 0)
    level = 0.0
    while True:
        full = F.col("source_size") * cap <= F.lit(level) * F.col("weight")
        r = weighed.agg(F.sum(F.when(full, F.col("source_size") * cap)), F.sum(F.when(~full, F.col("weight")))).first()
        if not r[1]:
            break
        risen = (total - (r[0] or 0)) / r[1]
        if risen <= level * (1 + 1e-12):
            break
        level = risen
    return weighed.withColumn("target", F.least(F.col("source_size") * float(cap), F.lit(level) * F.col("weight")))


def coin(*parts: Column) -> Column:
    """A number in [0, 1) that depends on the parts only."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(SEED), *parts), 11).cast("double") / float(1 << 53)


def pivot(block: Column, level: int) -> Column:
    """Folds a sorted array of STATE: struct<rest: STATE, done: array<struct<unit: STATE, up: boolean>>>."""

    def step(acc: Column, b: Column) -> Column:
        a = acc["rest"]
        up_a, down_a = (1 - a["x"]) * a["size"], a["x"] * a["size"]
        up_b, down_b = (1 - b["x"]) * b["size"], b["x"] * b["size"]
        to_a, to_b = F.least(up_a, down_b), F.least(down_a, up_b)
        # To a with a probability that keeps both expectations.
        first = coin(a["h"], b["h"], F.lit(level)) * (to_a + to_b) < to_b
        end_a = F.when(first, up_a <= down_b).otherwise(down_a <= up_b)  # a becomes whole, else b does
        x_a = F.when(first, a["x"] + down_b / a["size"]).otherwise(a["x"] - up_b / a["size"])
        x_b = F.when(first, b["x"] - up_a / b["size"]).otherwise(b["x"] + down_a / b["size"])
        put = lambda s, x: F.struct(*[s[f] for f in ("source", "doc_id", "size", "m", "h")], F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)).alias("x")).cast(STATE)
        whole = F.struct(F.when(end_a, a).otherwise(b).alias("unit"), F.when(end_a, first).otherwise(~first).alias("up"))
        return F.struct(F.when(end_a, put(b, x_b)).otherwise(put(a, x_a)).alias("rest"), F.array_append(acc["done"], whole).alias("done"))

    zero = F.struct(F.element_at(block, 1).alias("rest"), F.array().cast(f"array<struct<unit:{STATE},up:boolean>>").alias("done"))
    return F.aggregate(F.slice(block, 2, F.greatest(F.size(block) - 1, F.lit(0))), zero, step)


def rounded(units: DataFrame, block: int = BLOCK) -> DataFrame:
    """units: columns of STATE, x strictly between 0 and 1, size over 0. Returns source, doc_id, size, up."""
    out, level, rest = [], 0, units
    while True:
        counts = materialize(rest.groupBy("source").agg(F.ceil(F.count("*") / block).alias("blocks")), "block-counts")
        last = (counts.agg(F.max("blocks")).first()[0] or 1) <= 1
        r, c = rest.alias("r"), counts.alias("c")
        dealt = r.join(c, F.col("r.source").eqNullSafe(F.col("c.source"))).select("r.*", F.pmod(F.xxhash64("r.h", F.lit(level)), "c.blocks").alias("block"))
        item = F.struct((-F.col("size")).alias("k"), F.xxhash64("h", F.lit(level), F.lit(1)).alias("k2"), "h", F.struct("source", "doc_id", "size", "m", "h", "x").cast(STATE).alias("s"))
        groups = dealt.groupBy("source", "block").agg(F.transform(F.sort_array(F.collect_list(item)), lambda i: i["s"]).alias("items"))
        folded = materialize(groups.select(pivot(F.col("items"), level).alias("f")), f"level{level}")
        out.append(folded.select(F.explode("f.done").alias("d")).select("d.unit.source", "d.unit.doc_id", "d.unit.size", "d.up"))
        rest = folded.select("f.rest.*")
        if last:
            out.append(rest.select("source", "doc_id", "size", (F.col("x") >= 0.5).alias("up")))
            break
        level += 1
    result = out[0]
    for x in out[1:]:
        result = result.unionByName(x)
    return result


def decide(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP, block: int = BLOCK) -> DataFrame:
    """sizes: written table (row_id, doc_id string, source, size). Returns it with source_size, target and copies.

    Rows alike in source, doc_id and size are one unit: all but a fraction below one of its copies are fixed, the
    rest is one candidate in the rounding, so a hot unit never meets itself in a fold.
    """
    units = materialize(sizes.groupBy("source", "doc_id", "size").agg(F.count("*").alias("m")), "units")
    sources = materialize(targets(units.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).alias("source_size")), weights, share, cap), "targets")
    u, s = units.alias("u"), sources.alias("s")
    per = F.when(F.col("s.source_size") > 0, F.col("s.target") / F.col("s.source_size")).otherwise(F.lit(0.0))
    planned = u.join(s, F.col("u.source").eqNullSafe(F.col("s.source"))).select("u.*", "s.source_size", "s.target", F.floor(per).alias("base"), (per - F.floor(per)).alias("f"))
    planned = planned.withColumn("whole", F.floor(F.col("m") * F.col("f"))).withColumn("x", F.col("m") * F.col("f") - F.col("whole"))
    planned = materialize(planned, "planned")
    open_ = planned.where("x > 0 and size > 0").select("source", "doc_id", "size", "m", F.xxhash64("source", "doc_id", "size").alias("h"), "x")
    ups = materialize(rounded(open_, block).where("up").select("source", "doc_id", "size", F.lit(1).cast("bigint").alias("up")), "ups")
    key = F.struct("source", "doc_id", "size")
    extra = planned.withColumn("unit", key).join(ups.select(key.alias("unit"), "up"), "unit", "left")
    extra = materialize(extra.select("unit", "m", "source_size", "target", "base", (F.col("whole") + F.coalesce("up", F.lit(0))).alias("more")), "copies")
    rows = sizes.withColumn("unit", key).join(extra, "unit")
    one = rows.where("m = 1").withColumn("nth", F.lit(1).cast("bigint"))
    # Rows of a repeated unit are told apart by their place; each block of row ids is numbered on its own.
    many = rows.where("m > 1").withColumn("part", F.shiftright("row_id", 33))
    before = many.groupBy("unit", "part").count().withColumn("before", F.sum("count").over(Window.partitionBy("unit").orderBy("part")) - F.col("count"))
    before = before.select("unit", "part", "before")
    many = many.withColumn("own", F.row_number().over(Window.partitionBy("unit", "part").orderBy("row_id"))).join(before, ["unit", "part"])
    many = many.withColumn("nth", F.col("own") + F.col("before")).drop("own", "before", "part")
    copies = F.col("base") + (F.col("nth") <= F.col("more")).cast("bigint")
    return one.unionByName(many).select("row_id", "doc_id", "source", "size", "source_size", "target", copies.alias("copies"))


def measured(docs: DataFrame, id_col: str, text_col: str, source_col: str, row: Column) -> DataFrame:
    size = F.size(words_of(text_of(text_col))).cast("bigint")
    return materialize(docs.select(row.alias("row_id"), column(id_col).cast("string").alias("doc_id"), column(source_col).cast("string").alias("source"), size.alias("size")), "sizes")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """One row per input row: row_id, doc_id, source, size, source_size, target, copies, taken.

    size: words of the text (null: 0). target: of the row's source. taken: words the mix takes, copies * size;
    copies is at most cap rounded up. The words taken of a source differ from its target by half of one document at most.
    A null source is a source of its own, the last. Decisions depend on doc_id, source and size only, so reruns
    agree, whatever the files; repeated rows share the copies of their unit. Empty texts and sources take 0.
    """
    sizes = measured(docs, id_col, text_col, source_col, F.monotonically_increasing_id())
    kind = docs.schema[id_col].dataType
    out = decide(sizes, weights, share, cap).withColumn("doc_id", F.col("doc_id").cast(kind))
    return out.withColumn("taken", F.col("copies") * F.col("size"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of docs, each as often as the mix takes it (a document without words, of which any number is no word, once)."""
    row = fresh(docs, "row_id")
    keyed = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "keyed")
    copies = materialize(decide(measured(keyed, id_col, text_col, source_col, column(row))).select(F.col("row_id").alias(row), F.when(F.col("size") > 0, F.col("copies")).otherwise(1).cast("int").alias("copies")), "taken")
    n = fresh(keyed, "copies")
    # Texts meet their copies by a shuffle at every size: the copies grow with the input, so they are no broadcast side.
    taken = keyed.hint("merge").join(copies.withColumnRenamed("copies", n), row).where(F.col(n) > 0)
    return taken.withColumn(n, F.explode(F.array_repeat(F.lit(1), F.col(n)))).select(*[column(c) for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")

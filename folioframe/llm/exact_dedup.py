"""Exact deduplication by content-defined chunk recipes (operator 10, native).

A text without its white space is cut at places that its own characters define, so equal texts give
equal chunks wherever they stand. A chunk's identifier is its XXH64. One pass moves every distinct
chunk once (equal chunks collapse before the shuffle) and verifies that an identifier stands for one
chunk text only; an identifier that does not is replaced by the SHA-256 of the chunk. After that,
texts are compared by their ordered identifier lists alone, and no long text moves again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, column, fresh, materialize, release, text_of

MIN_CHUNK, MAX_CHUNK = 512, 4096
#: A chunk ends after such a pair of characters, or at MAX_CHUNK.
CUT = "[bdgkpvwzBDGKPVWZ0-9][aeouAEOU]"


def chunks_of(normal: Column, low: int = MIN_CHUNK, high: int = MAX_CHUNK) -> Column:
    """The content-defined chunks of a normalised text, in order. Their concatenation is the text."""
    return F.regexp_extract_all(normal, F.lit(f"(?s).{{{low},{high - 2}}}?{CUT}|.{{{high}}}|.+"), F.lit(0))


def normalized(text: Column) -> Column:
    return F.regexp_replace(text, SPACE, "")


def collisions(chunks: DataFrame, identifier=F.xxhash64) -> DataFrame:
    """id: identifiers that stand for two or more chunk texts. chunks: one array column ``chunks``. A written table, empty
    unless a 64-bit hash collides."""
    each = chunks.select(F.explode("chunks").alias("chunk")).select(identifier(F.col("chunk")).alias("id"), "chunk")
    return materialize(each.distinct().groupBy("id").count().where("count > 1").select("id"), "collisions")


def recipes(cut: DataFrame, collided: DataFrame, identifier=F.xxhash64) -> DataFrame:
    """cut (text_sha256, chunks, ...) with recipe, the ordered list of verified identifiers, in place of chunks: a chunk's hash, or
    where that collides the chunk's SHA-256. Chunks move for neither."""
    plain = lambda c: identifier(c).cast("string")
    if collided.isEmpty():
        return cut.withColumn("recipe", F.transform("chunks", plain)).drop("chunks")
    each = cut.select("text_sha256", F.posexplode("chunks").alias("place", "chunk")).select("text_sha256", "place", identifier(F.col("chunk")).alias("id"), F.sha2("chunk", 256).alias("own"))
    exact = each.join(collided, "id").groupBy("text_sha256", "place").agg(F.min("own").alias("own")).groupBy("text_sha256").agg(F.map_from_entries(F.collect_list(F.struct("place", "own"))).alias("exact"))
    slim = cut.withColumn("recipe", F.transform("chunks", plain)).drop("chunks").join(exact, "text_sha256", "left")
    return slim.withColumn("recipe", F.transform("recipe", lambda c, i: F.coalesce(F.try_element_at("exact", i), c))).drop("exact")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None, identifier=F.xxhash64) -> DataFrame:
    """One row per input row: row_id, doc_id, keep_id, group_size, kept, text_sha256, n_chunks.

    Texts are equal when identical without the characters ``[\\x20\\x09-\\x0D]``; a null text counts as empty.
    Of equal texts the row with the most code points stays, then the smallest doc_id (null last), then,
    among repeated rows, the one read first; exactly one row of a group stays. An empty table gives an
    empty result. Other columns of docs are not read. row_col: a column that identifies rows, if docs has one.
    """
    row = column(row_col) if row_col else F.monotonically_increasing_id()
    source = docs.select(row.alias("row_id"), column(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    plain = source.select("row_id", "doc_id", F.length("text").alias("n_points"), normalized(F.col("text")).alias("normal"))
    cut = plain.select("row_id", "doc_id", "n_points", F.sha2("normal", 256).alias("text_sha256"), chunks_of(F.col("normal")).alias("chunks"))
    collided = collisions(cut.select("chunks"), identifier)
    release()
    digest = materialize(recipes(cut, collided, identifier), "recipes")
    rank = F.struct((-F.col("n_points")).alias("a"), F.col("doc_id").isNull().alias("b"), F.col("doc_id").alias("id"), F.col("row_id").alias("row"))
    # As a table, both sides of the join below are plain exchanges, whose hot keys adaptive execution can split.
    groups = materialize(digest.groupBy("recipe").agg(F.count("*").alias("group_size"), F.min(rank).alias("first")), "recipe-groups")
    return digest.join(groups, "recipe").select(
        "row_id", "doc_id", F.col("first.id").alias("keep_id"), "group_size", (F.col("row_id") == F.col("first.row")).alias("kept"), "text_sha256",
        F.size("recipe").cast("long").alias("n_chunks"),
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns. See exact_groups for ties, nulls and repeated rows."""
    row = fresh(docs, "row_id")
    keyed = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "keyed")
    gone = materialize(exact_groups(keyed, id_col, text_col, row).where("not kept").select(F.col("row_id").alias(row)), "gone")
    return keyed.join(gone, row, "left_anti").drop(row)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return exact_groups(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t FROM documents
)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY t) AS group_size,
       row_number() OVER w = 1 AS kept,
       sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t ORDER BY n DESC, doc_id NULLS LAST)
"""

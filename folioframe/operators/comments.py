"""Comments, notes and form fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def threads(comments: DataFrame, extended: DataFrame) -> DataFrame:
    """comments: doc_id, id, author, date, text, para_ids; extended: doc_id, para_id, done, parent_para_id. Adds resolved (of the
    comment's last paragraph; null where nothing is said) and parent_id (of the comment that has the parent paragraph)."""
    last = comments.withColumn("__last", F.try_element_at("para_ids", F.lit(-1)))
    ext = extended.select("doc_id", F.col("para_id").alias("__last"), F.col("done").alias("resolved"), F.col("parent_para_id").alias("__parent"))
    owners = comments.select("doc_id", F.explode("para_ids").alias("__parent"), F.col("id").alias("parent_id"))
    owners = owners.groupBy("doc_id", "__parent").agg(F.min("parent_id").alias("parent_id"))
    return last.join(ext, ["doc_id", "__last"], "left").join(owners, ["doc_id", "__parent"], "left").select(*comments.columns, "resolved", "parent_id")


def thread_roots(replies: DataFrame, by: str, item: str, parent: str) -> DataFrame:
    """The thread start of each item where parents precede their replies directly: forward fill of items without parent."""
    w = Window.partitionBy(by).orderBy(item).rowsBetween(Window.unboundedPreceding, 0)
    return replies.withColumn("root", F.last(F.when(F.col(parent).isNull(), F.col(item)), ignorenulls=True).over(w))


def notes(rows: DataFrame) -> DataFrame:
    """rows: doc_id, id, type, node_index, text. Notes without a type and with an id of 0 or more: their non-blank paragraphs,
    right-trimmed, joined, trimmed, and freed of a leading [n]; empty notes go."""
    from ..functions.markup import strip_leading_index

    kept = rows.where("type IS NULL AND id >= 0").withColumn("text", F.regexp_replace("text", r"\s+$", "")).where("text <> ''")
    parts = F.transform(F.sort_array(F.collect_list(F.struct("node_index", "text"))), lambda s: s["text"])
    joined = kept.groupBy("doc_id", "id").agg(F.array_join(parts, "\n").alias("text"))
    return joined.withColumn("text", strip_leading_index(F.regexp_replace("text", r"^\s+|\s+$", ""))).where("text <> ''")


def next_comment_id(comments: DataFrame) -> DataFrame:
    return comments.groupBy("doc_id").agg((F.coalesce(F.max("id"), F.lit(-1)) + 1).alias("next_id"))


def field_text(kind: Column, checked: Column, default_checked: Column, value: Column, default_text: Column, on: Column | None = None, off: Column | None = None) -> Column:
    """What a form field shows."""
    on, off = (F.coalesce(x, F.lit(s)) if x is not None else F.lit(s) for x, s in ((on, "☒"), (off, "☐")))
    box = F.when(F.coalesce(checked, default_checked, F.lit(False)), on).otherwise(off)
    return F.when(kind == "checkbox", box).when(kind == "text", F.coalesce(value, default_text, F.lit(""))).otherwise(F.coalesce(value, F.lit("")))

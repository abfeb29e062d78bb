"""Blocks of documents: texts and markup as ordered rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def text_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per line: doc_id, node_index (from 0), text."""
    return docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(F.col(text_col), "\n", -1)).alias("node_index", "text"))


def nonempty_blocks(blocks: DataFrame) -> DataFrame:
    """Blocks with anything but white space, numbered anew."""
    kept = blocks.where(F.col("text").rlike(r"\S"))
    return kept.withColumn("node_index", (F.row_number().over(Window.partitionBy("doc_id").orderBy("node_index")) - 1).cast("int"))


def joined_text(rows: DataFrame, by: str, position: str, text: str, separator: str = "\n") -> DataFrame:
    """Texts of a group in order, joined."""
    parts = F.transform(F.sort_array(F.collect_list(F.struct(F.col(position), F.col(text)))), lambda s: s[text])
    return rows.groupBy(by).agg(F.array_join(parts, separator).alias("text"))


def duplicates(rows: DataFrame, *keys: str) -> DataFrame:
    """Keys that stand more than once, with their count."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def renumbered(rows: DataFrame, by: str, *order: Column, name: str = "node_index") -> DataFrame:
    return rows.withColumn(name, (F.row_number().over(Window.partitionBy(by).orderBy(*order)) - 1).cast("int"))


def insert_rows(rows: DataFrame, new: DataFrame, by: str = "doc_id", name: str = "node_index") -> DataFrame:
    """new: the columns of rows, ``name`` being the place before which a row goes (beyond the end: last)."""
    both = rows.withColumn("__new", F.lit(1)).unionByName(new.withColumn("__new", F.lit(0)))
    return renumbered(both, by, F.col(name), F.col("__new"), name=name).drop("__new")


def remove_rows(rows: DataFrame, gone: Column, by: str = "doc_id", name: str = "node_index") -> DataFrame:
    """Without the rows of gone, numbered anew; a group's first row stays, emptied of nothing, when all would go."""
    w = Window.partitionBy(by)
    flagged = rows.withColumn("__gone", F.coalesce(gone, F.lit(False))).withColumn("__left", F.min(F.when(~F.col("__gone"), F.col(name))).over(w)).withColumn("__first", F.min(name).over(w))
    kept = flagged.where(~F.col("__gone") | (F.col("__left").isNull() & (F.col(name) == F.col("__first"))))
    return renumbered(kept.drop("__gone", "__left", "__first"), by, F.col(name), name=name)


def duplicate_rows(rows: DataFrame, twice: Column, by: str = "doc_id", name: str = "node_index") -> DataFrame:
    """Each row of twice followed by its copy, numbered anew."""
    copies = rows.withColumn("__copy", F.explode(F.when(twice, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    return renumbered(copies, by, F.col(name), F.col("__copy"), name=name).drop("__copy")


def replace_first(text: Column, search: str, replacement: str) -> Column:
    """The first place of a literal search text replaced; a text without it stays."""
    at = F.locate(search, text)
    return F.when(at > 0, F.concat(text.substr(F.lit(1), at - 1), F.lit(replacement), text.substr(at + len(search), F.length(text)))).otherwise(text)

"""Parts of packages from model relations: bodies, headers, footers, comments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.markup import escape_text
from .packages import DEFAULT_SECTION, DOCUMENT_OPEN, upsert_parts

HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
NAMES = DOCUMENT_OPEN[len("<w:document") : -1]


def paragraph_markup(text: Column) -> Column:
    """A plain paragraph of a text; tabs and line feeds become elements."""
    inner = F.replace(F.replace(escape_text(text), F.lit("\t"), F.lit('</w:t><w:tab/><w:t xml:space="preserve">')), F.lit("\n"), F.lit('</w:t><w:br/><w:t xml:space="preserve">'))
    return F.concat(F.lit('<w:p><w:r><w:t xml:space="preserve">'), inner, F.lit("</w:t></w:r></w:p>"))


def body_parts(blocks: DataFrame, section_xml: DataFrame | None = None) -> DataFrame:
    """blocks: doc_id, container, node_index, source_xml and text. The part of each container: blocks in order, as they stand in
    source_xml or else as plain paragraphs; documents end with section_xml (doc_id, xml) or the default section."""
    markup = F.coalesce("source_xml", paragraph_markup(F.coalesce("text", F.lit(""))))
    inner = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("node_index", markup.alias("x")))), lambda s: s["x"]), "")
    joined = blocks.groupBy("doc_id", "container").agg(inner.alias("inner"))
    if section_xml is not None:
        joined = joined.join(section_xml.select("doc_id", F.col("xml").alias("sect")), "doc_id", "left")
    else:
        joined = joined.withColumn("sect", F.lit(None).cast("string"))
    root = F.when(F.col("container").rlike("/header[0-9]*\\.xml$"), "hdr").when(F.col("container").rlike("/footer[0-9]*\\.xml$"), "ftr")
    whole = F.concat(F.lit(f"{HEAD}{DOCUMENT_OPEN}<w:body>"), "inner", F.coalesce("sect", F.lit(DEFAULT_SECTION)), F.lit("</w:body></w:document>"))
    part = F.when(root.isNull(), whole).otherwise(F.concat(F.lit(f"{HEAD}<w:"), root, F.lit(f"{NAMES}>"), "inner", F.lit("</w:"), root, F.lit(">")))
    return joined.select("doc_id", F.col("container").alias("name"), F.lit(True).alias("is_text"), part.alias("content"), F.lit(None).cast("binary").alias("bytes"), F.lit(None).cast("string").alias("error"))


def comment_parts(comments: DataFrame) -> DataFrame:
    """comments: doc_id, id, author, date, text, para_id, resolved, parent_para_id. The comments part and the extended one, in the
    order of ids; lines of a text are paragraphs, the last with the para id."""
    attribute = lambda name, c: F.coalesce(F.concat(F.lit(f' {name}="'), F.replace(escape_text(c.cast("string")), F.lit('"'), F.lit("&quot;")), F.lit('"')), F.lit(""))
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    last = F.concat(F.lit("<w:p"), attribute("w14:paraId", F.col("para_id")), F.lit('><w:r><w:t xml:space="preserve">'), escape_text(F.element_at(lines, -1)), F.lit("</w:t></w:r></w:p>"))
    before = F.array_join(F.transform(F.slice(lines, 1, F.size(lines) - 1), paragraph_markup), "")
    one = F.concat(F.lit("<w:comment"), attribute("w:id", F.col("id")), attribute("w:author", F.col("author")), attribute("w:date", F.col("date")), F.lit(">"), before, last, F.lit("</w:comment>"))
    done = F.when(F.col("resolved"), "1").when(~F.col("resolved"), "0")
    more = F.concat(F.lit("<w15:commentEx"), attribute("w15:paraId", F.col("para_id")), attribute("w15:paraIdParent", F.col("parent_para_id")), attribute("w15:done", done), F.lit("/>"))
    inner = lambda x: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("id", x.alias("x")))), lambda s: s["x"]), "")
    joined = comments.groupBy("doc_id").agg(inner(one).alias("a"), inner(more).alias("b"))
    wrap = lambda name, root, c: F.struct(F.lit(name).alias("name"), F.concat(F.lit(f"{HEAD}<{root}{NAMES}>"), c, F.lit(f"</{root}>")).alias("content"))
    rows = joined.select("doc_id", F.explode(F.array(wrap("word/comments.xml", "w:comments", F.col("a")), wrap("word/commentsExtended.xml", "w15:commentsEx", F.col("b")))).alias("p"))
    return rows.select("doc_id", "p.name", F.lit(True).alias("is_text"), "p.content", F.lit(None).cast("binary").alias("bytes"), F.lit(None).cast("string").alias("error"))


def document_parts(base: DataFrame, blocks: DataFrame, comments: DataFrame | None = None, section_xml: DataFrame | None = None) -> DataFrame:
    """base's parts with those that the model gives in their place."""
    out = upsert_parts(base, body_parts(blocks, section_xml))
    return out if comments is None else upsert_parts(out, comment_parts(comments))

"""Editing intents: what an input event means, and what it makes of a text and its selection.

Places count characters (code points). All expressions work inside their row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fonts import let

INTENT = "struct<kind:string,text:string,direction:string,unit:string>"
#: Input types by what they mean: kind, direction and unit of deletions (fixed values).
INSERTS, TRANSFERS, REPLACES = ("insertText", "insertFromYank", "insertFromPasteAsQuotation"), ("insertFromPaste", "insertFromDrop"), ("insertReplacementText", "insertTranspose")
COMPOSITION, RANGES = ("insertCompositionText", "deleteCompositionText"), ("deleteContent", "deleteByCut", "deleteByDrag")
DELETES = {
    "deleteContentBackward": ("backward", "character"), "deleteContentForward": ("forward", "character"), "deleteWordBackward": ("backward", "word"), "deleteWordForward": ("forward", "word"), "deleteSoftLineBackward": ("backward", "line"),
    "deleteHardLineBackward": ("backward", "line"), "deleteSoftLineForward": ("forward", "line"), "deleteHardLineForward": ("forward", "line"), "deleteEntireSoftLine": ("backward", "entire-line"),
}
PLAIN = ("insertParagraph", "insertLineBreak", "historyUndo", "historyRedo")


def intent(input_type: Column, data: Column, transferred: Column) -> Column:
    """INTENT of an input event; null for composition, blocked for what no edit of the model says."""
    none, blank = F.lit(None).cast("string"), F.lit("")
    make = lambda kind, text=none, direction=none, unit=none: F.struct(kind.alias("kind"), text.alias("text"), direction.alias("direction"), unit.alias("unit")).cast(INTENT)
    at = lambda i: F.try_element_at(F.create_map(*[F.lit(x) for t, pair in DELETES.items() for x in (t, pair[i])]), input_type)
    return (
        F.when(input_type.isin(*COMPOSITION), F.lit(None).cast(INTENT))
        .when(input_type.isin(*INSERTS), make(F.lit("insertText"), F.coalesce(data, transferred, blank)))
        .when(input_type.isin(*TRANSFERS), make(F.lit("insertText"), F.coalesce(transferred, data, blank)))
        .when(input_type.isin(*REPLACES), make(F.lit("replaceText"), F.coalesce(data, transferred, blank)))
        .when(input_type.isin(*PLAIN), make(input_type))
        .when(input_type.isin(*DELETES), make(F.lit("deleteContent"), none, at(0), at(1)))
        .when(input_type.isin(*RANGES), make(F.lit("deleteRange")))
        .otherwise(make(F.lit("blocked")))
    )


def intent_class(kind: Column) -> Column:
    """insert or delete for intents that merge into one step of the history; null for others."""
    return F.when(kind.isin("insertText", "insertLineBreak", "replaceText"), "insert").when(kind.isin("deleteContent", "deleteRange"), "delete")


def applied(text: Column, start: Column, end: Column, todo: Column) -> Column:
    """struct<text, caret> after an intent at the selection [start, end); null where it changes nothing in this paragraph: an empty
    insertion, a deletion at its edge, an intent of another kind."""
    size = F.length(text)
    a = F.greatest(F.lit(0), F.least(start, size)).cast("int")
    b = F.greatest(a, F.least(end, size)).cast("int")

    def edit(s: Column) -> Column:
        a, b = s["a"], s["b"]
        head, tail = F.substring(text, F.lit(1), a), F.substring(text, a + 1, size)
        put = lambda lo, hi, new: F.struct(F.concat(F.substring(text, F.lit(1), lo), new, F.substring(text, hi + 1, size)).alias("text"), (lo + F.length(new)).cast("int").alias("caret"))
        cut = lambda lo, hi: F.when(hi > lo, put(lo, hi, F.lit("")))
        new = F.regexp_replace(todo["text"], "\r\n?", "\n")
        line_start = F.length(head) - F.length(F.substring_index(head, "\n", -1))
        line_end = a + F.length(F.substring_index(tail, "\n", 1))
        unit, kind = todo["unit"], todo["kind"]
        before = F.when(unit == "character", a - 1).when(unit == "word", F.length(F.regexp_replace(head, r"(?U)\S*+\s*+\z", ""))).otherwise(line_start)
        # A caret right before a line break deletes the break.
        after = F.when(unit == "character", a + 1).when(unit == "word", a + F.length(F.regexp_extract(tail, r"(?U)\A\s*\S*", 0))).otherwise(F.when(F.startswith(tail, F.lit("\n")), a + 1).otherwise(line_end))
        one = F.when(unit == "entire-line", cut(line_start, line_end)).when(todo["direction"] == "backward", F.when(a > 0, cut(before.cast("int"), a))).otherwise(F.when(a < size, cut(a, F.least(after, size).cast("int"))))
        return (
            F.when(kind.isin("insertText", "replaceText"), F.when((F.length(new) > 0) | (a < b), put(a, b, new)))
            .when(kind == "insertLineBreak", put(a, b, F.lit("\n")))
            .when(kind == "deleteRange", cut(a, b))
            .when(kind == "deleteContent", F.when(a < b, cut(a, b)).otherwise(one))
        )

    return let(F.struct(a.alias("a"), b.alias("b")), edit)


def coalesces(key: Column, caret_before: Column, at: Column, last_key: Column, last_caret: Column, last_at: Column, window_ms: int = 1000) -> Column:
    """Whether a text commit goes on with the last one: same key, its caret where that left it, not long after."""
    return F.coalesce((key == last_key) & (at >= last_at) & (at - last_at <= window_ms) & (caret_before == last_caret), F.lit(False))


def merged_cell(texts: Column, boundary: Column) -> Column:
    """A cell's text when the paragraph at a boundary joins the one before, and the caret at the seam: struct<text, paragraph, offset>
    (in the paragraphs that the text splits to); null where there is none before."""
    good = (boundary > 0) & (boundary < F.size(texts))
    head, tail = F.slice(texts, F.lit(1), boundary), F.slice(texts, boundary + 1, F.size(texts))
    before = F.array_join(head, "\n")
    place = F.struct(F.concat(before, F.array_join(tail, "\n")).alias("text"), (F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit("")))).cast("int").alias("paragraph"), F.length(F.substring_index(before, "\n", -1)).cast("int").alias("offset"))
    return F.when(good, place)


def paragraph_at(selections: DataFrame, blocks: DataFrame) -> DataFrame:
    """selections: doc_id, kind, node_index; blocks: doc_id, node_index, kind. The paragraphs that paragraph selections are in."""
    chosen = selections.where("kind = 'paragraph'").select("doc_id", "node_index")
    return chosen.join(blocks.where("kind = 'paragraph'"), ["doc_id", "node_index"])


#: Paragraphs and runs of the clipboard. Both are read one by one, so that an odd one among them spoils no other.
CLIPBOARD_PARAGRAPH = "type string, style string, sourceXml string, children array<string>"
CLIPBOARD_RUN = (
    "type string, text string, link string, style string, src string, alt string, widthPx double, heightPx double, partName string, contentType string, data array<int>, syntheticTextBox boolean, textBoxText string, fieldType string, tag string, title string, "
    "placeholder string, checked boolean, value string, options array<struct<displayText:string,value:string>>"
)


def clipboard_runs(texts: DataFrame, text: str = "text") -> DataFrame:
    """The rows of texts with the runs of the paragraphs that a clipboard text (JSON) holds: paragraph, run, kind and the fields of its
    kind. Entries that are no paragraphs, and runs of unknown kinds, are left out; another text gives no rows."""
    paragraphs = F.filter(F.transform(F.from_json(text, "array<string>"), lambda p: F.from_json(p, CLIPBOARD_PARAGRAPH)), lambda p: (p["type"] == "paragraph") & p["children"].isNotNull())
    each = texts.select(*texts.columns, F.posexplode(paragraphs).alias("paragraph", "__p"))
    runs = F.filter(F.transform("__p.children", lambda r: F.from_json(r, CLIPBOARD_RUN)), lambda r: ((r["type"] == "text") & r["text"].isNotNull()) | r["type"].isin("image", "form-field"))
    out = each.select(*texts.columns, "paragraph", F.col("__p.style").alias("paragraph_style"), F.posexplode_outer(runs).alias("run", "__r"))
    options = F.filter("__r.options", lambda o: F.length(o["displayText"]) > 0)
    kind = lambda k, c: F.when(F.col("__r.type") == k, F.col(f"__r.{c}"))
    return out.select(
        *texts.columns, "paragraph", "paragraph_style", "run", F.col("__r.type").alias("kind"), F.col("__r.text").alias("run_text"), kind("text", "link").alias("link"), F.col("__r.style").alias("style"),
        *[kind("image", c).alias(n) for c, n in (("src", "src"), ("alt", "alt"), ("widthPx", "width_px"), ("heightPx", "height_px"), ("partName", "part"), ("contentType", "content_type"), ("textBoxText", "box_text"))],
        F.when(F.col("__r.type") == "image", image_bytes(F.col("__r.data"))).alias("bytes"), *[kind("form-field", c).alias(n) for c, n in (("fieldType", "field"), ("tag", "tag"), ("title", "title"), ("checked", "checked"), ("value", "value"))],
        F.when(F.col("__r.type") == "form-field", options).alias("options"),
    )


def image_bytes(numbers: Column) -> Column:
    """The bytes of an array of numbers, which is how pictures come in JSON; each modulo 256."""
    return F.unhex(F.array_join(F.transform(numbers, lambda n: F.lpad(F.hex(F.pmod(n, F.lit(256))), 2, "0")), ""))


def large_raster(src: Column, least: int = 32_768) -> Column:
    """Whether a picture's source is embedded raster data of so many characters, which a smaller copy would shrink."""
    return F.coalesce((F.length(src) >= least) & F.startswith(src, F.lit("data:image/")) & ~F.startswith(src, F.lit("data:image/svg")), F.lit(False))

"""The document model as DataFrames, from rows of parts (see packages.read_parts).

Every function takes parts and returns one relation. Each part is read once in a Python pass over its own text; what
belongs together across parts (styles, relationships, media types) is joined by doc_id.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import markup
from . import properties as props
from .xmltree import Node, balanced, parse

RUN = f"container string, node_index int, cell_path array<struct<row:int,cell:int>>, paragraph int, run_index int, kind string, text string, link_rid string, link string, note_kind string, note_id bigint, style {props.struct_type(props.RUN_STYLE)}, image {props.struct_type(props.IMAGE)}, field {props.struct_type(props.FIELD)}"
BLOCK = f"container string, node_index int, kind string, text string, style {props.struct_type(props.PARAGRAPH_STYLE)}, source_xml string, section_xml string, break_inside boolean, rendered_break boolean"
CELL = "container string, node_index int, path array<struct<row:int,cell:int>>, row int, cell int, grid_col int, grid_span int, v_merge string, width_twips bigint, shading string, v_align string, text string"


def extract(parts: DataFrame, where, schema: str, rows: Callable[[str, str], Iterator[dict]]) -> DataFrame:
    """rows(name, content) for each text part of the condition, with doc_id in front."""
    chosen = parts.where(F.col("is_text") & where).select("doc_id", "name", "content")
    full = f"doc_id string, {schema}"
    columns = list(parts.sparkSession.createDataFrame([], full).columns)

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for doc, name, content in zip(frame["doc_id"], frame["name"], frame["content"], strict=True):
                out = [[doc, *(r.get(c) for c in columns[1:])] for r in rows(name, content or "")]
                if out:
                    yield pd.DataFrame(out, columns=columns, dtype=object)

    return chosen.mapInPandas(read, full)


# ---- package level, native


def content_types(parts: DataFrame) -> DataFrame:
    """doc_id, kind (default or override), key (extension or part name), type."""
    tags = parts.where(F.col("name") == "[Content_Types].xml").select("doc_id", F.explode(F.regexp_extract_all("content", F.lit(r"(?i)<(?:Default|Override)\s[^>]*>"), F.lit(0))).alias("tag"))
    override = F.col("tag").rlike("(?i)^<Override")
    key = F.when(override, F.ltrim(markup.attribute(F.col("tag"), "PartName"), F.lit("/"))).otherwise(F.lower(markup.attribute(F.col("tag"), "Extension")))
    return tags.select("doc_id", F.when(override, "override").otherwise("default").alias("kind"), key.alias("key"), markup.attribute(F.col("tag"), "ContentType").alias("type")).where("key IS NOT NULL AND type IS NOT NULL")


def part_types(parts: DataFrame) -> DataFrame:
    """doc_id, name, type: by part name, else by extension, else what the extension is known for."""
    types = content_types(parts)
    pick = lambda kind, key, out: types.where(F.col("kind") == kind).groupBy("doc_id", F.col("key").alias(key)).agg(F.max("type").alias(out))
    named = parts.where("name IS NOT NULL").select("doc_id", "name", markup.extension(F.col("name")).alias("ext"))
    joined = named.join(pick("override", "name", "own"), ["doc_id", "name"], "left").join(pick("default", "ext", "by_ext"), ["doc_id", "ext"], "left")
    return joined.select("doc_id", "name", F.coalesce("own", "by_ext", markup.media_type(F.col("name"))).alias("type"))


def relationships(parts: DataFrame) -> DataFrame:
    """doc_id, part, rid, target (resolved), type, external. Of equal ids in a part the last one stands."""
    rels = parts.where(F.col("name").rlike(r"(^|/)_rels/[^/]+\.rels$")).select("doc_id", F.regexp_replace("name", r"(^|/)_rels/([^/]+)\.rels$", "$1$2").alias("part"), F.posexplode(F.regexp_extract_all("content", F.lit(r"(?i)<Relationship\s[^>]*>"), F.lit(0))).alias("at", "tag"))
    tag = F.col("tag")
    rows = rels.select("doc_id", "part", "at", markup.attribute(tag, "Id").alias("rid"), markup.attribute(tag, "Target").alias("raw"), F.regexp_extract(markup.attribute(tag, "Type"), "([^/]*)$", 1).alias("type"), F.coalesce(F.lower(markup.attribute(tag, "TargetMode")) == "external", F.lit(False)).alias("external"))
    target = F.when(F.col("external"), markup.decode_entities(F.col("raw"))).otherwise(markup.resolve_path(F.col("part"), F.col("raw")))
    return rows.where("rid IS NOT NULL").groupBy("doc_id", "part", "rid").agg(F.max_by(F.struct(target.alias("target"), "type", "external"), "at").alias("r")).select("doc_id", "part", "rid", "r.target", "r.type", "r.external")


def metadata(parts: DataFrame) -> DataFrame:
    """doc_id, page_count (of the properties, positive only), background, six compatibility switches, even_and_odd."""
    switches = ("useFELayout", "balanceSingleByteDoubleByteWidth", "doNotExpandShiftReturn", "suppressSpBfAfterPgBrk", "suppressTopSpacing", "allowSpaceOfSameStyleInTable")
    app, settings, doc = (parts.where(F.col("name") == n).select("doc_id", F.col("content").alias("x")) for n in ("docProps/app.xml", "word/settings.xml", "word/document.xml"))
    pages = F.regexp_extract("x", r"<Pages>\s*([0-9]+)\s*</Pages>", 1).try_cast("bigint")
    a = app.select("doc_id", F.when(pages > 0, pages).alias("page_count"))
    compat = F.regexp_extract("x", r"(?s)<w:compat(?:\s[^>]*)?>(.*?)</w:compat>", 1)
    s = settings.select("doc_id", *[markup.on_off(compat, f"w:{n}").alias(n) for n in switches], markup.on_off(F.col("x"), "w:evenAndOddHeaders").alias("even_and_odd"))
    b = doc.select("doc_id", markup.hex_color(markup.attribute(markup.opening_tag(F.col("x"), "w:background"), "w:color")).alias("background"))
    return b.join(a, "doc_id", "left").join(s, "doc_id", "left")


def theme(parts: DataFrame) -> DataFrame:
    """doc_id, fonts (major or minor with latin, ea, cs), colors (name to #hex)."""

    def rows(_: str, content: str) -> Iterator[dict]:
        root = parse(content)
        fonts = {f"{k}.{s}": n.child(f"a:{s}").get("typeface") for k in ("major", "minor") if (n := root.first(f"a:{k}Font")) is not None for s in ("latin", "ea", "cs") if n.child(f"a:{s}") is not None and n.child(f"a:{s}").get("typeface")}
        scheme, colors = root.first("a:clrScheme"), {}
        for c in scheme.nodes() if scheme is not None else []:
            rgb, system = c.child("a:srgbClr"), c.child("a:sysClr")
            v = props.color(rgb.get("val")) if rgb is not None else props.color(system.get("lastClr")) if system is not None else None
            if v:
                colors[c.name.rpartition(":")[2]] = v
        yield {"fonts": fonts, "colors": colors}

    return extract(parts, F.col("name").rlike(r"^word/theme/theme[0-9]*\.xml$"), "fonts map<string,string>, colors map<string,string>", rows)


# ---- styles and numbering


def style_sheet(parts: DataFrame) -> DataFrame:
    """doc_id, style_id, kind, based_on, name, is_default, heading, run and paragraph styles as written (not inherited)."""

    def rows(_: str, content: str) -> Iterator[dict]:
        root = parse(content)
        defaults = root.first("w:docDefaults")
        if defaults is not None:
            yield {"style_id": "", "kind": "defaults", "run": props.run_style(defaults.child("w:rPrDefault", "w:rPr")), "paragraph": props.paragraph_style(defaults.child("w:pPrDefault", "w:pPr"))}
        for s in root.walk("w:style"):
            name = props.val(s, "w:name")
            heading = re.search(r"heading\s*([1-6])", name or "", re.I)
            yield {
                "style_id": s.get("styleId"), "kind": s.get("type"), "based_on": props.val(s, "w:basedOn"), "name": name, "is_default": s.get("default") in ("1", "true"), "heading": int(heading[1]) if heading else None,
                "run": props.run_style(s.child("w:rPr")), "paragraph": props.paragraph_style(s.child("w:pPr")),
            }

    return extract(parts, F.col("name") == "word/styles.xml", f"style_id string, kind string, based_on string, name string, is_default boolean, heading int, run {props.struct_type(props.RUN_STYLE)}, paragraph {props.struct_type(props.PARAGRAPH_STYLE)}", rows)


def numbering_levels(parts: DataFrame) -> DataFrame:
    """doc_id, abstract_num_id, ilvl, start, format, lvl_text, restart, is_lgl, suffix; abstracts that only link to a style take
    the levels of the abstract that defines it."""

    def rows(_: str, content: str) -> Iterator[dict]:
        root = parse(content)
        abstracts = list(root.walk("w:abstractNum"))
        by_style = {props.val(a, "w:styleLink"): a for a in abstracts if props.val(a, "w:styleLink")}
        for a in abstracts:
            source = a if a.nodes("w:lvl") else by_style.get(props.val(a, "w:numStyleLink"), a)
            for lvl in source.nodes("w:lvl"):
                start = props.integer(props.val(lvl, "w:start"))
                yield {
                    "abstract_num_id": props.integer(a.get("abstractNumId")), "ilvl": props.integer(lvl.get("ilvl")), "start": start if start is not None else 1, "format": props.val(lvl, "w:numFmt") or "decimal", "lvl_text": props.val(lvl, "w:lvlText") or "",
                    "restart": props.integer(props.val(lvl, "w:lvlRestart")), "is_lgl": props.switch(lvl, "w:isLgl"), "suffix": props.val(lvl, "w:suff") or "tab",
                }

    return extract(parts, F.col("name") == "word/numbering.xml", "abstract_num_id bigint, ilvl int, start bigint, format string, lvl_text string, restart int, is_lgl boolean, suffix string", rows)


def numbering_instances(parts: DataFrame) -> DataFrame:
    """doc_id, num_id, abstract_num_id, start_overrides (level as text to first number)."""

    def rows(_: str, content: str) -> Iterator[dict]:
        for n in parse(content).walk("w:num"):
            over = {o.get("ilvl"): s for o in n.nodes("w:lvlOverride") if (s := props.integer(props.val(o, "w:startOverride"))) is not None and s >= 0 and o.get("ilvl")}
            yield {"num_id": props.integer(n.get("numId")), "abstract_num_id": props.integer(props.val(n, "w:abstractNumId")), "start_overrides": over}

    return extract(parts, F.col("name") == "word/numbering.xml", "num_id bigint, abstract_num_id bigint, start_overrides map<string,bigint>", rows)


# ---- bodies


def body_of(root: Node) -> Node:
    return next((n for n in (root.first("w:body"), root.first("w:hdr"), root.first("w:ftr")) if n is not None), root)


def top_blocks(body: Node) -> list[Node]:
    """Paragraphs and tables of a body, content controls looked through; paragraphs that only hold the caret's bookmark go."""
    out, stack = [], list(reversed(body.nodes()))
    while stack:
        n = stack.pop()
        if n.name in ("w:p", "w:tbl"):
            caret = n.name == "w:p" and any(b.get("name") == "_GoBack" for b in n.walk("w:bookmarkStart")) and n.first("w:r", "w:drawing") is None
            if not caret:
                out.append(n)
        elif n.name not in ("w:sectPr", "w:pPr", "w:del", "w:moveFrom"):
            stack.extend(reversed(n.nodes()))
    return out


def runs_of(p: Node) -> Iterator[dict]:
    """The runs of a paragraph in order: text (tabs and breaks as characters), images, form fields; links of hyperlink elements
    come before those of fields, and the shown text of a field is all of it that is a run."""
    depth: list[dict] = []  # open fields: instruction, whether its result began, form data
    link_rid = link = None

    def run(r: Node) -> Iterator[dict]:
        style, text = props.run_style(r.child("w:rPr")), []
        base = {"link_rid": link_rid, "link": link or next((f["link"] for f in reversed(depth) if f["shown"] and f["link"]), None), "style": style}

        def flush() -> Iterator[dict]:
            if text:
                yield base | {"kind": "text", "text": "".join(text)}
                text.clear()

        for c in r.nodes():
            if c.name == "w:fldChar":
                kind = c.get("fldCharType")
                if kind == "begin":
                    data = c.child("w:ffData")
                    depth.append({"code": "", "shown": False, "link": None, "form": props.legacy_field(data) if data is not None else None, "text": ""})
                elif kind == "separate" and depth:
                    f = depth[-1]
                    f["shown"], f["link"] = True, field_link(f["code"])
                elif kind == "end" and depth:
                    f = depth.pop()
                    if f["form"] is not None:
                        yield from flush()
                        form = f["form"] | ({"value": f["text"] or f["form"]["value"]} if f["form"]["kind"] != "checkbox" else {})
                        yield base | {"kind": "field", "field": form}
            elif c.name == "w:instrText" and depth:
                depth[-1]["code"] += c.text()
            elif depth and (not depth[-1]["shown"] or depth[-1]["form"] is not None):
                if depth[-1]["form"] is not None and c.name == "w:t":
                    depth[-1]["text"] += c.text()
            elif c.name in ("w:t", "a:t", "w:delText"):
                text.append(c.text())
            elif c.name == "w:tab":
                text.append("\t")
            elif c.name in ("w:br", "w:cr"):
                text.append("\n")
            elif c.name in ("w:footnoteReference", "w:endnoteReference") and (props.integer(c.get("id")) or 0) > 0:
                yield from flush()
                yield base | {"kind": "note", "note_kind": c.name[2:-9], "note_id": props.integer(c.get("id")), "text": ""}
            elif c.name in ("w:drawing", "w:pict", "w:object", "mc:AlternateContent"):
                chosen = c.child("mc:Choice") or c
                found = props.image(chosen)
                if found is not None:
                    yield from flush()
                    yield base | {"kind": "image", "text": "", "image": found}
        yield from flush()

    def walk(node: Node) -> Iterator[dict]:
        nonlocal link_rid, link
        for c in node.nodes():
            if c.name == "w:r":
                yield from run(c)
            elif c.name == "w:hyperlink":
                link_rid, link = c.get("r:id"), f"#{c.get('w:anchor')}" if c.get("w:anchor") else None
                yield from walk(c)
                link_rid = link = None
            elif c.name == "w:sdt":
                form = props.form_field(c)
                if form is not None:
                    yield {"kind": "field", "field": form, "style": props.run_style(c.first("w:rPr"))}
                elif c.child("w:sdtContent") is not None:
                    yield from walk(c.child("w:sdtContent"))
            elif c.name not in ("w:pPr", "w:del", "w:moveFrom"):
                yield from walk(c)

    found = list(walk(p))
    if not found:
        found = [{"kind": "text", "text": "", "style": props.run_style(p.child("w:pPr", "w:rPr"))}]
    for i, r in enumerate(found):
        yield {"run_index": i, **r}


def field_link(code: str) -> str | None:
    if not re.match(r"\s*HYPERLINK\b", code, re.I):
        return None
    url, anchor = re.search(r'HYPERLINK\s+"([^"]*)"', code, re.I), re.search(r'\\l\s+"([^"]*)"', code, re.I)
    u, a = (m[1] if m and m[1] else None for m in (url, anchor))
    return (u if "#" in u else f"{u}#{a}") if u and a else u or (f"#{a}" if a else None)


def shown(run: dict) -> str:
    if run["kind"] != "field":
        return run.get("text") or ""
    f = run["field"]
    return ("☒" if f["checked"] else "☐") if f["kind"] == "checkbox" else f["value"] or (f["placeholder"] if f["kind"] == "text" else None) or ""


def paragraph_text(p: Node) -> str:
    return "".join(map(shown, runs_of(p)))


def cell_paragraphs(tc: Node) -> list[Node]:
    """Paragraphs of a cell and of the tables in it, in order."""
    out, stack = [], list(reversed(tc.nodes()))
    while stack:
        n = stack.pop()
        if n.name == "w:p":
            out.append(n)
        elif n.name not in ("w:tcPr", "w:tblPr", "w:trPr"):
            stack.extend(reversed(n.nodes()))
    return out


def bodies():
    return F.col("name").rlike(r"^word/(document|header[0-9]*|footer[0-9]*)\.xml$")


def blocks(parts: DataFrame) -> DataFrame:
    """Blocks of the body, headers and footers (container: the part's name), see BLOCK; a body without any is one empty paragraph."""

    def rows(name: str, content: str) -> Iterator[dict]:
        found = top_blocks(body_of(parse(content)))
        for i, n in enumerate(found or [None]):
            if n is None:
                yield {"container": name, "node_index": 0, "kind": "paragraph", "text": "", "style": props.paragraph_style(None), "break_inside": False, "rendered_break": False}
                continue
            ppr = n.child("w:pPr") if n.name == "w:p" else None
            sect = ppr.child("w:sectPr") if ppr is not None else None
            yield {
                "container": name, "node_index": i, "kind": "paragraph" if n.name == "w:p" else "table", "text": paragraph_text(n) if n.name == "w:p" else "\n".join(map(paragraph_text, cell_paragraphs(n))), "style": props.paragraph_style(ppr), "source_xml": n.xml,
                "section_xml": sect.xml if sect is not None else None, "break_inside": any(b.get("type") == "page" for b in n.walk("w:br")), "rendered_break": n.first("w:lastRenderedPageBreak") is not None,
            }

    return extract(parts, bodies(), BLOCK, rows)


def runs(parts: DataFrame) -> DataFrame:
    """Runs of all paragraphs, those in table cells with the path of their cell; link holds the address, resolved."""

    def rows(name: str, content: str) -> Iterator[dict]:
        for i, n in enumerate(top_blocks(body_of(parse(content)))):
            places = [([], k, p) for k, p in enumerate([n])] if n.name == "w:p" else [(path, k, p) for path, tc in cells_of(n) for k, p in enumerate(tc.nodes("w:p"))]
            for path, k, p in places:
                for r in runs_of(p):
                    yield {"container": name, "node_index": i, "cell_path": [{"row": a, "cell": b} for a, b in path], "paragraph": k, **r}

    found = extract(parts, bodies(), RUN, rows)
    rels = relationships(parts).select("doc_id", F.col("part").alias("container"), F.col("rid").alias("link_rid"), "target")
    joined = found.join(rels, ["doc_id", "container", "link_rid"], "left")
    anchor = F.regexp_extract("link", "^#(.*)$", 1)
    own = markup.hyperlink(F.col("target"), markup.blank_to_null(anchor))
    return joined.withColumn("link", F.when(F.col("link_rid").isNotNull(), own).otherwise(F.col("link"))).select(*found.columns)


def cells_of(table: Node, path: tuple = ()) -> Iterator[tuple[list[tuple[int, int]], Node]]:
    """(path, cell) of a table and of the tables in its cells."""
    for r, row in enumerate(table.nodes("w:tr")):
        for c, tc in enumerate(row.nodes("w:tc")):
            here = (*path, (r, c))
            yield list(here), tc
            for nested in tc.nodes("w:tbl"):
                yield from cells_of(nested, here)


def cells(parts: DataFrame) -> DataFrame:
    """Cells of all tables, see CELL; grid_col is the sum of the spans before the cell in its row."""

    def rows(name: str, content: str) -> Iterator[dict]:
        for i, n in enumerate(top_blocks(body_of(parse(content)))):
            column: dict[tuple, int] = {}
            for path, tc in cells_of(n) if n.name == "w:tbl" else ():
                p = tc.child("w:tcPr")
                span = max(1, props.integer(props.val(p, "w:gridSpan")) or 1)
                merge = p.child("w:vMerge") if p is not None else None
                row_key = (*map(tuple, path[:-1]), path[-1][0])
                at = column.get(row_key, 0)
                column[row_key] = at + span
                yield {
                    "container": name, "node_index": i, "path": [{"row": a, "cell": b} for a, b in path], "row": path[-1][0], "cell": path[-1][1], "grid_col": at, "grid_span": span, "v_merge": (merge.get("val") or "continue") if merge is not None else None,
                    "width_twips": props.integer(props.val(p, "w:tcW", "w")), "shading": props.color(props.val(p, "w:shd", "fill")), "v_align": props.val(p, "w:vAlign"), "text": "\n".join(paragraph_text(x) for x in tc.nodes("w:p")),
                }

    return extract(parts, bodies(), CELL, rows)


def sections(parts: DataFrame) -> DataFrame:
    """doc_id, section_index, start_node_index, xml, layout, refs (kind, type, rid): each section begins behind the block that
    ends the one before; sections without blocks of their own are dropped, but the last stays."""

    def rows(_: str, content: str) -> Iterator[dict]:
        body = body_of(parse(content))
        found, start = [], 0
        for i, n in enumerate(top_blocks(body)):
            sect = n.child("w:pPr", "w:sectPr") if n.name == "w:p" else None
            if sect is not None:
                found.append((start, sect))
                start = i + 1
        last = body.nodes("w:sectPr")
        found.append((start, last[-1] if last else None))
        kept = [f for k, f in enumerate(found) if k == len(found) - 1 or f[0] != found[k + 1][0]]
        for k, (at, sect) in enumerate(kept):
            refs = [{"kind": r.name[2:8], "type": r.get("type") or "default", "rid": r.get("r:id")} for r in sect.nodes("w:headerReference", "w:footerReference")] if sect is not None else []
            yield {"section_index": k, "start_node_index": at, "xml": sect.xml if sect is not None else None, "layout": props.section(sect), "refs": refs}

    return extract(parts, F.col("name") == "word/document.xml", f"section_index int, start_node_index int, xml string, layout {props.struct_type(props.SECTION)}, refs array<struct<kind:string,type:string,rid:string>>", rows)


def section_references(parts: DataFrame) -> DataFrame:
    """doc_id, section_index, kind (header or footer), type, part: references joined to relationships; a section without one of a
    type has the last one before it."""
    each = sections(parts).select("doc_id", "section_index", F.explode("refs").alias("r")).select("doc_id", "section_index", "r.kind", "r.type", "r.rid")
    rels = relationships(parts).where("part = 'word/document.xml'").select("doc_id", "rid", F.col("target").alias("part"))
    own = each.join(rels, ["doc_id", "rid"]).groupBy("doc_id", "section_index", "kind", "type").agg(F.min("part").alias("part"))
    all_ = sections(parts).select("doc_id", "section_index").join(own.select("doc_id", "kind", "type").distinct(), "doc_id")
    w = Window.partitionBy("doc_id", "kind", "type").orderBy("section_index").rowsBetween(Window.unboundedPreceding, 0)
    filled = all_.join(own, ["doc_id", "section_index", "kind", "type"], "left").withColumn("part", F.last("part", ignorenulls=True).over(w))
    return filled.where("part IS NOT NULL")


def note_paragraphs(parts: DataFrame) -> DataFrame:
    """doc_id, kind (footnote or endnote), id, type, node_index, text: input of comments.notes."""

    def rows(name: str, content: str) -> Iterator[dict]:
        kind = "footnote" if "footnotes" in name else "endnote"
        for n in parse(content).walk(f"w:{kind}"):
            for k, p in enumerate(cell_paragraphs(n)):
                yield {"kind": kind, "id": props.integer(n.get("id")), "type": n.get("type"), "node_index": k, "text": paragraph_text(p)}

    return extract(parts, F.col("name").isin("word/footnotes.xml", "word/endnotes.xml"), "kind string, id bigint, type string, node_index int, text string", rows)


def comment_rows(parts: DataFrame) -> DataFrame:
    """doc_id, id, author, initials, date, text, para_ids: input of comments.threads."""

    def rows(_: str, content: str) -> Iterator[dict]:
        for c in parse(content).walk("w:comment"):
            ps = c.nodes("w:p")
            yield {"id": props.integer(c.get("id")), "author": c.get("author"), "initials": c.get("initials"), "date": c.get("date"), "text": "\n".join(map(paragraph_text, ps)), "para_ids": [p.get("paraId") for p in ps if p.get("paraId")]}

    return extract(parts, F.col("name") == "word/comments.xml", "id bigint, author string, initials string, date string, text string, para_ids array<string>", rows)


def comment_states(parts: DataFrame) -> DataFrame:
    """doc_id, para_id, done, parent_para_id of the extended comments."""

    def rows(_: str, content: str) -> Iterator[dict]:
        for c in parse(content).walk("w15:commentEx"):
            done = c.get("done")
            yield {"para_id": c.get("paraId"), "done": None if done is None else done.lower() not in props.OFF, "parent_para_id": c.get("paraIdParent")}

    return extract(parts, F.col("name") == "word/commentsExtended.xml", "para_id string, done boolean, parent_para_id string", rows)


def comment_anchors(parts: DataFrame) -> DataFrame:
    """doc_id, id, text: the body's text between a comment's range marks, paragraphs joined by line feeds; comments without a
    range in the body have no row."""

    def rows(_: str, content: str) -> Iterator[dict]:
        open_: dict[int, list[str]] = {}
        for k, p in enumerate(body_of(parse(content)).walk("w:p")):
            for parts_ in open_.values() if k else ():
                parts_.append("\n")
            stack = list(reversed(p.nodes()))
            while stack:
                n = stack.pop()
                i = props.integer(n.get("id"))
                if n.name == "w:commentRangeStart" and i is not None:
                    open_[i] = []
                elif n.name == "w:commentRangeEnd" and i in open_:
                    yield {"id": i, "text": "".join(open_.pop(i))}
                elif n.name == "w:t":
                    for parts_ in open_.values():
                        parts_.append(n.text())
                else:
                    stack.extend(reversed(n.nodes()))

    return extract(parts, F.col("name") == "word/document.xml", "id bigint, text string", rows)


def revisions(parts: DataFrame) -> DataFrame:
    """doc_id, node_index, ord, kind, author, date, text of tracked changes in the body's blocks."""
    kinds = {"w:ins": "insert", "w:del": "delete", "w:moveFrom": "move_from", "w:moveTo": "move_to", "w:rPrChange": "run_format", "w:pPrChange": "paragraph_format"}

    def rows(_: str, content: str) -> Iterator[dict]:
        for i, n in enumerate(top_blocks(body_of(parse(content)))):
            for k, c in enumerate(n.walk(*kinds)):
                yield {"node_index": i, "ord": k, "kind": kinds[c.name], "id": c.get("id"), "author": c.get("author"), "date": c.get("date"), "text": "".join(t.text() for t in c.walk("w:t", "w:delText"))}

    return extract(parts, F.col("name") == "word/document.xml", "node_index int, ord int, kind string, id string, author string, date string, text string", rows)


def charts(parts: DataFrame) -> DataFrame:
    """doc_id, part, kind, title, series, series_name, idx, category, value: chart points in long form. Missing values are 0,
    blank categories "Item n", unnamed series "Series n"; series without values are dropped."""

    def rows(name: str, content: str) -> Iterator[dict]:
        root = parse(content)
        kind = next((k for t, k in (("c:barChart", "bar"), ("c:lineChart", "line"), ("c:pieChart", "pie"), ("c:doughnutChart", "doughnut")) if root.first(t) is not None), None)
        if kind is None:
            return
        head = root.first("c:title")
        title = " ".join("".join(t.text() for t in head.walk("a:t")).split()) if head is not None else None
        points = lambda node: {props.integer(p.get("idx")) or 0: p.child("c:v").text().strip() for p in node.walk("c:pt") if p.child("c:v") is not None} if node is not None else {}
        value = lambda v: x if (x := props.number(v.replace(",", ""))) is not None else 0.0
        found = [s for s in root.walk("c:ser") if points(s.child("c:val"))]
        length = max((max(points(s.child(c)), default=-1) + 1 for s in found for c in ("c:val", "c:cat")), default=0)
        categories = next((c for s in found if (c := points(s.child("c:cat")))), {})
        for k, s in enumerate(found):
            own, label = points(s.child("c:val")), points(s.child("c:tx"))
            for i in range(length):
                yield {"part": name, "kind": kind, "title": title or None, "series": k, "series_name": label.get(0) or f"Series {k + 1}", "idx": i, "category": categories.get(i) or f"Item {i + 1}", "value": value(own.get(i, "0"))}

    return extract(parts, F.col("name").rlike(r"^word/charts/chart[0-9]*\.xml$"), "part string, kind string, title string, series int, series_name string, idx int, category string, value double", rows)


def balanced_blocks(texts: DataFrame, column: str, *names: str) -> DataFrame:
    """texts with start, end, tag and block of each outermost element of the names, one row for each."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema)

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(*values, s, e, t, x[s:e]) for *values, x in zip(*(frame[c].tolist() for c in frame.columns), frame[column].tolist(), strict=True) if isinstance(x, str) for s, e, t in balanced(x, *names)]
            if rows:
                yield pd.DataFrame(rows, columns=[*frame.columns, "start", "end", "tag", "block"], dtype=object)

    return texts.mapInPandas(read, f"{schema}, start int, end int, tag string, block string")

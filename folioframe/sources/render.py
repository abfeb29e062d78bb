"""Markup of document parts from their model: runs, paragraphs, tables, bodies, and upserts into parts."""

from __future__ import annotations

import re

from .xmltree import Node, encode, parse

#: Characters of a paragraph's markup that a mere change of text must not touch (fixed values).
UNSAFE = ("<w:ins", "<w:del", "<w:movefrom", "<w:moveto", "<w:fldsimple", "<w:fldchar", "<w:instrtext", "<w:sdt", "<w:drawing", "<w:pict", "<w:object", "<w:commentrange", "<w:commentreference", "<w:bookmark", "<w:footnotereference", "<w:endnotereference", "<mc:alternatecontent", "<w:hyperlink")


def tag(name: str, **attributes) -> str:
    kept = "".join(f' w:{k}="{encode(str(v), True)}"' for k, v in attributes.items() if v is not None)
    return f"<w:{name}{kept}/>"


def run_properties(style: dict | None) -> str:
    """w:rPr of a run style; switches are written when true only."""
    s = style or {}
    fonts = {"ascii": s.get("font_ascii"), "hAnsi": s.get("font_hansi"), "eastAsia": s.get("font_east_asia"), "cs": s.get("font_cs")}
    out = [tag("rStyle", val=s["style_id"])] if s.get("style_id") else []
    out += [tag("rFonts", **fonts)] if any(fonts.values()) else []
    out += [tag(t) for t, f in (("b", "bold"), ("i", "italic"), ("caps", "caps"), ("smallCaps", "small_caps"), ("strike", "strike"), ("dstrike", "double_strike"), ("vanish", "hidden")) if s.get(f)]
    out += [tag("color", val=s["color"].lstrip("#"))] if s.get("color") else []
    out += [tag("spacing", val=s["spacing_twips"])] if s.get("spacing_twips") is not None else []
    out += [tag("w", val=s["scale_percent"])] if s.get("scale_percent") is not None else []
    out += [tag("position", val=s["position_half_pt"])] if s.get("position_half_pt") is not None else []
    if s.get("size_pt") is not None:
        half = int(s["size_pt"] * 2 + 0.5)
        out += [tag("sz", val=half), tag("szCs", val=half)]
    out += [tag("highlight", val=s["highlight"])] if s.get("highlight") else []
    out += [tag("u", val=s["underline"])] if s.get("underline") else []
    out += [tag("shd", val="clear", color="auto", fill=s["shading"].lstrip("#"))] if s.get("shading") else []
    out += [tag("vertAlign", val=s["vertical"])] if s.get("vertical") else []
    out += [tag("rtl")] if s.get("rtl") else []
    out += [tag("lang", val=s["lang"])] if s.get("lang") else []
    return f"<w:rPr>{''.join(out)}</w:rPr>" if out else ""


def paragraph_properties(style: dict | None) -> str:
    """w:pPr of a paragraph style, in the order of the schema."""
    s = style or {}
    out = [tag("pStyle", val=s["style_id"])] if s.get("style_id") else []
    for t, f in (("keepNext", "keep_next"), ("keepLines", "keep_lines"), ("pageBreakBefore", "page_break_before"), ("widowControl", "widow_control")):
        if s.get(f) is not None:
            out.append(tag(t) if s[f] else tag(t, val="0"))
    if s.get("num_id") is not None:
        out.append(f"<w:numPr>{tag('ilvl', val=s.get('ilvl') or 0)}{tag('numId', val=s['num_id'])}</w:numPr>")
    if s.get("borders"):
        edge = lambda side, v: tag(side, val=v.split()[0], sz=v.split()[1], color=v.split()[2].lstrip("#"))
        out.append("<w:pBdr>" + "".join(edge(k, s["borders"][k]) for k in ("top", "left", "bottom", "right", "between", "bar") if k in s["borders"]) + "</w:pBdr>")
    out += [tag("shd", val="clear", color="auto", fill=s["shading"].lstrip("#"))] if s.get("shading") else []
    if s.get("tab_stops"):
        out.append("<w:tabs>" + "".join(tag("tab", val=t["align"], leader=t.get("leader"), pos=t["pos"]) for t in s["tab_stops"]) + "</w:tabs>")
    if s.get("bidi"):
        out.append(tag("bidi"))
    spacing = {"before": s.get("before_twips"), "after": s.get("after_twips"), "line": s.get("line"), "lineRule": s.get("line_rule")}
    out += [tag("spacing", **spacing)] if any(v is not None for v in spacing.values()) else []
    indent = {"left": s.get("left_twips"), "right": s.get("right_twips"), "firstLine": s.get("first_line_twips"), "hanging": s.get("hanging_twips")}
    out += [tag("ind", **indent)] if any(v is not None for v in indent.values()) else []
    out += [tag("contextualSpacing")] if s.get("contextual_spacing") else []
    out += [tag("jc", val={"justify": "both"}.get(s["align"], s["align"]))] if s.get("align") else []
    out += [tag("outlineLvl", val=s["outline_level"])] if s.get("outline_level") is not None else []
    return f"<w:pPr>{''.join(out)}</w:pPr>" if out else ""


def run(r: dict) -> str:
    """One run; tabs and line feeds of its text become elements."""
    head = run_properties(r.get("style"))
    if r.get("kind") == "note":
        return f"<w:r>{head}{tag(r['note_kind'] + 'Reference', id=r['note_id'])}</w:r>"
    body = []
    for piece in re.split(r"([\t\n])", r.get("text") or ""):
        if piece == "\t":
            body.append("<w:tab/>")
        elif piece == "\n":
            body.append("<w:br/>")
        elif piece:
            body.append(f'<w:t xml:space="preserve">{encode(piece)}</w:t>')
    return f"<w:r>{head}{''.join(body) or '<w:t/>'}</w:r>"


def paragraph(style: dict | None, runs: list[dict]) -> str:
    return f"<w:p>{paragraph_properties(style)}{''.join(map(run, runs)) or '<w:r><w:t/></w:r>'}</w:p>"


def table(rows: list[list[dict]], grid: list[int] | None = None) -> str:
    """rows of cells: text or paragraphs (markup), grid_span, v_merge, width_twips, shading."""

    def cell(c: dict) -> str:
        p = [tag("tcW", w=c["width_twips"], type="dxa")] if c.get("width_twips") is not None else []
        p += [tag("gridSpan", val=c["grid_span"])] if (c.get("grid_span") or 1) > 1 else []
        p += [tag("vMerge", val="restart") if c["v_merge"] == "restart" else tag("vMerge")] if c.get("v_merge") else []
        p += [tag("shd", val="clear", color="auto", fill=c["shading"].lstrip("#"))] if c.get("shading") else []
        inner = c.get("paragraphs") or [paragraph(None, [{"text": t}]) for t in (c.get("text") or "").split("\n")]
        return f"<w:tc>{'<w:tcPr>' + ''.join(p) + '</w:tcPr>' if p else ''}{''.join(inner)}</w:tc>"

    columns = grid or [None] * max((sum(c.get("grid_span") or 1 for c in r) for r in rows), default=1)
    return f"<w:tbl><w:tblPr/><w:tblGrid>{''.join(tag('gridCol', w=g) for g in columns)}</w:tblGrid>{''.join('<w:tr>' + ''.join(map(cell, r)) + '</w:tr>' for r in rows)}</w:tbl>"


def document(blocks: list[str], section_xml: str | None = None) -> str:
    from .packages import DEFAULT_SECTION, DOCUMENT_OPEN

    return f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?>{DOCUMENT_OPEN}<w:body>{"".join(blocks)}{section_xml or DEFAULT_SECTION}</w:body></w:document>'


def safe_text_patch(xml: str) -> bool:
    low = xml.lower()
    return not any(m in low for m in UNSAFE)


def patch_text(xml: str, texts: list[str]) -> str | None:
    """A paragraph's markup with the texts of its runs replaced; null where that could change more than text."""
    if not safe_text_patch(xml):
        return None
    runs = list(parse(xml).walk("w:r"))
    if len(runs) != len(texts) or any(len(r.nodes("w:t")) != 1 or len(r.nodes()) > 2 for r in runs):
        return None
    for r, text in reversed(list(zip(runs, texts, strict=True))):
        t = r.nodes("w:t")[0]
        xml = f'{xml[: t.start]}<w:t xml:space="preserve">{encode(text)}</w:t>{xml[t.end :]}'
    return xml


def upsert(xml: str, element: str, key: str, new: dict[str, str]) -> str:
    """Elements put in place of those with the same key attribute; the others before the root's end, in key order."""
    root = parse(xml)
    left = dict(new)
    for n in sorted(root.walk(element), key=lambda n: -n.start):
        k = n.get(key)
        if k in left:
            xml = xml[: n.start] + left.pop(k) + xml[n.end :]
    top = next((n for n in parse(xml).children if isinstance(n, Node) and not n.name.startswith("?")), None)
    if top is None or not left:
        return xml
    order = sorted(left, key=lambda k: (not k.isdigit(), int(k) if k.isdigit() else 0, k))
    end = xml.rfind("</", top.start, top.end)
    added = "".join(left[k] for k in order)
    if end < 0:  # an empty root
        cut = xml.rfind("/>", top.start, top.end)
        return f"{xml[:cut]}>{added}</{top.name}>{xml[top.end :]}"
    return xml[:end] + added + xml[end:]


def next_relationship(ids: list[str]) -> int:
    """One more than the largest n of ids rIdn, one at least."""
    return max((int(m[1]) for i in ids if (m := re.fullmatch(r"rId([0-9]+)", i))), default=0) + 1

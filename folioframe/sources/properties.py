"""Property elements of runs, paragraphs, tables, sections and drawings as plain dictionaries."""

from __future__ import annotations

import math
import re

from .xmltree import Node

OFF = {"0", "false", "none", "off"}
#: Fields of a run's style, of a paragraph's style and of a section, with their Spark types.
RUN_STYLE = {
    "style_id": "string", "bold": "boolean", "italic": "boolean", "strike": "boolean", "double_strike": "boolean", "caps": "boolean", "small_caps": "boolean", "hidden": "boolean", "underline": "string", "vertical": "string", "color": "string", "theme_color": "string",
    "highlight": "string", "shading": "string", "size_pt": "double", "font_ascii": "string", "font_hansi": "string", "font_east_asia": "string", "font_cs": "string", "theme_font": "string", "spacing_twips": "bigint", "scale_percent": "bigint", "position_half_pt": "bigint", "lang": "string",
    "rtl": "boolean",
}
PARAGRAPH_STYLE = {
    "style_id": "string", "align": "string", "before_twips": "bigint", "after_twips": "bigint", "line": "bigint", "line_rule": "string", "left_twips": "bigint", "right_twips": "bigint", "first_line_twips": "bigint", "hanging_twips": "bigint", "num_id": "bigint", "ilvl": "int",
    "keep_next": "boolean", "keep_lines": "boolean", "page_break_before": "boolean", "widow_control": "boolean", "contextual_spacing": "boolean", "bidi": "boolean", "outline_level": "int", "shading": "string", "tab_stops": "array<struct<pos:bigint,align:string,leader:string>>",
    "borders": "map<string,string>", "drop_cap": "string", "drop_cap_lines": "int",
}
SECTION = {
    "break_type": "string", "width_px": "double", "height_px": "double", "orientation": "string", "top_px": "double", "right_px": "double", "bottom_px": "double", "left_px": "double", "header_px": "double", "footer_px": "double", "gutter_px": "double", "columns": "int",
    "column_gap_px": "double", "title_page": "boolean", "grid_pitch_px": "double", "page_start": "bigint", "page_format": "string", "borders": "map<string,string>",
}


def struct_type(fields: dict[str, str]) -> str:
    return "struct<" + ",".join(f"{k}:{t}" for k, t in fields.items()) + ">"


def integer(value: str | None) -> int | None:
    try:
        return int(value) if value is not None else None
    except ValueError:
        return None


def number(value: str | None) -> float | None:
    try:
        x = float(value) if value is not None else None
    except ValueError:
        return None
    return x if x is not None and math.isfinite(x) else None


def pixels(twips: str | None) -> float | None:
    n = integer(twips)
    return None if n is None else float(max(0, math.floor(n / 15 + 0.5)))


def val(node: Node | None, name: str, attribute: str = "val") -> str | None:
    c = node.child(name) if node is not None else None
    return c.get(attribute) if c is not None else None


def switch(node: Node | None, name: str) -> bool | None:
    """Null without the tag; true for the tag alone; false for 0, false, none and off."""
    c = node.child(name) if node is not None else None
    if c is None:
        return None
    v = c.get("val")
    return True if v is None else v.lower() not in OFF


def color(value: str | None) -> str | None:
    m = re.fullmatch(r"#?([0-9A-Fa-f]{6})", value.strip()) if value else None
    return f"#{m[1].upper()}" if m else None


def edges(node: Node | None) -> dict[str, str] | None:
    """Border edges as "style size color" by side."""
    found = {c.name.rpartition(":")[2]: " ".join([c.get("val") or "single", c.get("sz") or "0", color(c.get("color")) or "auto"]) for c in node.nodes()} if node is not None else {}
    return found or None


def run_style(rpr: Node | None) -> dict:
    fonts, spacing = (rpr.child("w:rFonts"), rpr.child("w:spacing")) if rpr is not None else (None, None)
    half, size = val(rpr, "w:sz"), None
    if number(half) is not None:
        size = number(half) / 2
    font = lambda a: fonts.get(a) if fonts is not None else None
    underline = val(rpr, "w:u")
    if rpr is not None and rpr.child("w:u") is not None and underline is None:
        underline = "single"
    return {
        "style_id": val(rpr, "w:rStyle"), "bold": switch(rpr, "w:b"), "italic": switch(rpr, "w:i"), "strike": switch(rpr, "w:strike"), "double_strike": switch(rpr, "w:dstrike"), "caps": switch(rpr, "w:caps"), "small_caps": switch(rpr, "w:smallCaps"), "hidden": switch(rpr, "w:vanish"),
        "underline": underline, "vertical": val(rpr, "w:vertAlign"), "color": color(val(rpr, "w:color")), "theme_color": val(rpr, "w:color", "themeColor"), "highlight": val(rpr, "w:highlight"), "shading": color(val(rpr, "w:shd", "fill")), "size_pt": size,
        "font_ascii": font("w:ascii"), "font_hansi": font("w:hAnsi"), "font_east_asia": font("w:eastAsia"), "font_cs": font("w:cs"), "theme_font": font("w:asciiTheme"), "spacing_twips": integer(spacing.get("val")) if spacing is not None else None,
        "scale_percent": integer(val(rpr, "w:w")), "position_half_pt": integer(val(rpr, "w:position")), "lang": val(rpr, "w:lang"), "rtl": switch(rpr, "w:rtl"),
    }


def paragraph_style(ppr: Node | None) -> dict:
    get = lambda name, *attributes: next((v for a in attributes if (v := val(ppr, name, a)) is not None), None)
    num_id, ilvl = None, None
    num = ppr.child("w:numPr") if ppr is not None else None
    if num is not None:
        num_id, ilvl = integer(val(num, "w:numId")), integer(val(num, "w:ilvl"))
        num_id = num_id if num_id is not None and num_id > 0 else None
        ilvl = ilvl if ilvl is not None and ilvl >= 0 else (0 if num_id else None)
    tabs = ppr.child("w:tabs") if ppr is not None else None
    stops = [{"pos": integer(t.get("pos")), "align": t.get("val") or "left", "leader": t.get("leader")} for t in tabs.nodes("w:tab") if integer(t.get("pos")) is not None] if tabs is not None else None
    frame = ppr.child("w:framePr") if ppr is not None else None
    drop = frame.get("dropCap") if frame is not None else None
    outline = integer(val(ppr, "w:outlineLvl"))
    return {
        "style_id": val(ppr, "w:pStyle"), "align": {"both": "justify", "start": "left", "end": "right"}.get(val(ppr, "w:jc") or "", val(ppr, "w:jc")), "before_twips": integer(get("w:spacing", "before")), "after_twips": integer(get("w:spacing", "after")),
        "line": integer(get("w:spacing", "line")), "line_rule": get("w:spacing", "lineRule"), "left_twips": integer(get("w:ind", "left", "start")), "right_twips": integer(get("w:ind", "right", "end")), "first_line_twips": integer(get("w:ind", "firstLine")),
        "hanging_twips": integer(get("w:ind", "hanging")), "num_id": num_id, "ilvl": ilvl, "keep_next": switch(ppr, "w:keepNext"), "keep_lines": switch(ppr, "w:keepLines"), "page_break_before": switch(ppr, "w:pageBreakBefore"), "widow_control": switch(ppr, "w:widowControl"),
        "contextual_spacing": switch(ppr, "w:contextualSpacing"), "bidi": switch(ppr, "w:bidi"), "outline_level": outline if outline is not None and 0 <= outline <= 8 else None, "shading": color(val(ppr, "w:shd", "fill")), "tab_stops": stops,
        "borders": edges(ppr.child("w:pBdr")) if ppr is not None else None, "drop_cap": drop if drop in ("drop", "margin") else None, "drop_cap_lines": integer(frame.get("lines")) if drop in ("drop", "margin") else None,
    }


def section(sect: Node | None) -> dict:
    size, margin, cols, grid, pages = (sect.child(n) if sect is not None else None for n in ("w:pgSz", "w:pgMar", "w:cols", "w:docGrid", "w:pgNumType"))
    of = lambda node, a: pixels(node.get(a)) if node is not None else None
    width, height = of(size, "w") or 816.0, of(size, "h") or 1056.0
    orient = size.get("orient") if size is not None else None
    if orient == "landscape" and height > width:
        width, height = height, width
    gridded = grid is not None and grid.get("type") in ("lines", "linesAndChars", "snapToChars")
    edge = lambda a, default: v if (v := of(margin, a)) is not None else default
    return {
        "break_type": val(sect, "w:type") or "nextPage", "width_px": width, "height_px": height, "orientation": orient or "portrait", "top_px": edge("top", 96.0), "right_px": edge("right", 96.0), "bottom_px": edge("bottom", 96.0), "left_px": edge("left", 96.0),
        "header_px": edge("header", 48.0), "footer_px": edge("footer", 48.0), "gutter_px": edge("gutter", 0.0), "columns": max(1, integer(cols.get("num")) or len(cols.nodes("w:col")) or 1) if cols is not None else 1, "column_gap_px": of(cols, "space"),
        "title_page": switch(sect, "w:titlePg"), "grid_pitch_px": of(grid, "linePitch") if gridded else None, "page_start": integer(pages.get("start")) if pages is not None else None, "page_format": pages.get("fmt") if pages is not None else None,
        "borders": edges(sect.child("w:pgBorders")) if sect is not None else None,
    }


def table_look(tblpr: Node | None) -> dict[str, bool]:
    """Which conditional formats a table takes: attributes of its own over the bits of the mask."""
    look = tblpr.child("w:tblLook") if tblpr is not None else None
    mask = 0
    if look is not None and look.get("val"):
        try:
            mask = int(look.get("val"), 16)
        except ValueError:
            mask = 0
    bits = {"firstRow": 0x20, "lastRow": 0x40, "firstColumn": 0x80, "lastColumn": 0x100, "noHBand": 0x200, "noVBand": 0x400}
    return {n: (look.get(n).lower() not in OFF) if look is not None and look.get(n) is not None else bool(mask & b) for n, b in bits.items()}


def emu(value: str | None) -> float | None:
    n = number(value)
    return None if n is None else round(n / 9525, 3)


def image(drawing: Node) -> dict | None:
    """A drawing's or picture's relationship, size, crop and anchor; vector pictures before their raster stand-ins."""
    svg, blip, old = drawing.first("asvg:svgBlip"), drawing.first("a:blip"), drawing.first("v:imagedata")
    rid = next((n.get(a) for n, a in ((svg, "r:embed"), (blip, "r:embed"), (blip, "r:link"), (old, "r:id")) if n is not None and n.get(a)), None)
    extent, anchor, props, crop = drawing.first("wp:extent"), drawing.first("wp:anchor"), drawing.first("wp:docPr"), drawing.first("a:srcRect")
    chart = drawing.first("c:chart")
    if rid is None and chart is not None:
        rid = chart.get("r:id")
    if rid is None:
        return None
    sides = {k: min(1.0, max(0.0, (number(crop.get(k)) or 0) / 100000)) for k in "ltrb"} if crop is not None else {}
    offset = lambda axis: emu(p.text()) if anchor is not None and (p := anchor.child(f"wp:position{axis}", "wp:posOffset")) is not None else None
    wrap = next((c.name[7:] for c in anchor.nodes() if c.name.startswith("wp:wrap")), None) if anchor is not None else None
    return {
        "rid": rid, "kind": "chart" if chart is not None else "image", "width_px": emu(extent.get("cx")) if extent is not None else None, "height_px": emu(extent.get("cy")) if extent is not None else None, "alt": props.get("descr") if props is not None else None,
        "crop": sides if any(v > 0 for v in sides.values()) else None, "floating": anchor is not None, "x_px": offset("H"), "y_px": offset("V"), "wrap": wrap, "behind": (anchor.get("behindDoc") == "1") if anchor is not None else None,
        "z": integer(anchor.get("relativeHeight")) if anchor is not None else None,
    }


IMAGE = {
    "rid": "string", "kind": "string", "width_px": "double", "height_px": "double", "alt": "string", "crop": "map<string,double>", "floating": "boolean", "x_px": "double", "y_px": "double", "wrap": "string", "behind": "boolean", "z": "bigint",
}


def form_field(sdt: Node) -> dict | None:
    """A content control as a form field; null for controls of other kinds."""
    p, content = sdt.child("w:sdtPr"), sdt.child("w:sdtContent")
    if p is None:
        return None
    shown = content.text() if content is not None else ""
    holder = p.child("w:showingPlcHdr") is not None
    base = {"tag": val(p, "w:tag"), "title": val(p, "w:alias"), "value": None if holder else shown or None, "placeholder": shown if holder else None, "checked": None, "options": None}
    box = p.first("w14:checkbox")
    if box is not None:
        v = val(box, "w14:checked")
        return base | {"kind": "checkbox", "checked": v is not None and v.lower() not in OFF}
    for tag, kind in (("w:date", "date"), ("w:dropDownList", "dropdown"), ("w:comboBox", "dropdown"), ("w:text", "text")):
        c = p.child(tag)
        if c is not None:
            options = [i.get("displayText") or i.get("value") or "" for i in c.nodes("w:listItem")]
            return base | {"kind": kind, "options": options or None}
    return None


def legacy_field(data: Node) -> dict | None:
    """A legacy form field from its w:ffData."""
    base = {"tag": val(data, "w:name"), "title": None, "value": None, "placeholder": None, "checked": None, "options": None}
    box, text, drop = data.child("w:checkBox"), data.child("w:textInput"), data.child("w:ddList")
    if box is not None:
        own, default = switch(box, "w:checked"), switch(box, "w:default")
        return base | {"kind": "checkbox", "checked": own if own is not None else bool(default)}
    if text is not None:
        return base | {"kind": "text", "placeholder": val(text, "w:default")}
    if drop is not None:
        options = [e.get("val") or "" for e in drop.nodes("w:listEntry")]
        at = integer(val(drop, "w:result")) or 0
        return base | {"kind": "dropdown", "options": options or None, "value": options[at] if 0 <= at < len(options) else None}
    return None


FIELD = {"kind": "string", "tag": "string", "title": "string", "value": "string", "placeholder": "string", "checked": "boolean", "options": "array<string>"}

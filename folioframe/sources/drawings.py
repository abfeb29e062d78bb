"""Drawings of packages: floating places, filters, text boxes, picture bullets, embedded check boxes."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import HORIZONTAL, VERTICAL, data_uri
from . import properties as props
from .model import bodies, body_of, extract, paragraph_text, part_types, relationships, top_blocks
from .xmltree import Node, parse

ANCHOR = {
    "x_px": "double", "y_px": "double", "horizontal_align": "string", "vertical_align": "string", "horizontal_from": "string", "vertical_from": "string", "left_px": "double", "right_px": "double", "top_px": "double", "bottom_px": "double", "wrap": "string",
    "wrap_text": "string", "behind": "boolean", "z": "bigint",
}
#: Ways of text around a drawing, as drawings and as vector shapes name them (fixed values).
WRAPS = {"wp:wrapNone": "none", "wp:wrapSquare": "square", "wp:wrapTight": "tight", "wp:wrapThrough": "through", "wp:wrapTopAndBottom": "topAndBottom"}
VML_WRAPS = {"square": "square", "tight": "tight", "through": "through", "topandbottom": "topAndBottom", "top-and-bottom": "topAndBottom", "topbottom": "topAndBottom", "none": "none", "inline": "none"}
SIDES = {"both": "bothSides", "bothsides": "bothSides", "left": "left", "right": "right", "largest": "largest"}
VML_FROM = {"page": "page", "margin": "margin", "column": "column", "paragraph": "paragraph", "line": "line", "text": "paragraph", "char": "line", "character": "line"}
#: Pixels of a unit, and what effects of pictures look like (fixed values).
UNITS = {"px": 1.0, "pt": 96 / 72, "in": 96.0, "cm": 96 / 2.54, "mm": 96 / 25.4}
PASTELS = ("saturate(0.76)", "contrast(0.94)", "brightness(1.04)")
COLD, WARM = ("hue-rotate(-6deg)", "saturate(1.04)"), ("sepia(0.1)", "saturate(1.02)")
DUOTONE = ("grayscale(1)", "sepia(0.55)", "hue-rotate(35deg)", "saturate(1.55)", "brightness(0.9)")


def known(value: str | None, names) -> str | None:
    low = (value or "").strip().lower()
    return low if low in names else None


def half_up(x: float) -> float:
    return math.copysign(math.floor(abs(x) + 0.5), x)


def css(style: str | None) -> dict[str, str]:
    """The declarations of a style text; the last of a name stands."""
    pairs = (d.split(":", 1) for d in (style or "").split(";") if ":" in d)
    return {k.strip().lower(): v.strip() for k, v in pairs if k.strip() and v.strip()}


def css_pixels(value: str | None) -> float | None:
    m = re.search(r"(-?[0-9]+(?:\.[0-9]+)?)\s*(px|pt|in|cm|mm)\b", value or "", re.I)
    return half_up(float(m[1]) * UNITS[m[2].lower()]) if m else None


def css_points(style: str | None, name: str) -> int | None:
    """A property's positive number of points in pixels; null in another unit."""
    m = re.search(rf"{name}\s*:\s*([0-9.]+)pt", style or "", re.I)
    n = props.number(m[1]) if m else None
    return int(half_up(n * 96 / 72)) if n is not None and n > 0 else None


def anchor(drawing: Node) -> dict | None:
    """Where a floating drawing stands; null for one in its line."""
    a = drawing.first("wp:anchor")
    if a is None:
        return None
    h, v = a.child("wp:positionH"), a.child("wp:positionV")
    inside = lambda p, tag: p.child(tag).text() if p is not None and p.child(tag) is not None else None
    place = lambda p: props.emu(t) if re.fullmatch(r"-?[0-9]+", t := inside(p, "wp:posOffset") or "") else None
    away = lambda name: max(0.0, n) if (n := props.emu(a.get(name))) is not None else None
    wrap = next((c for c in a.nodes() if c.name in WRAPS), None)
    z = props.number(a.get("relativeHeight"))
    found = {
        "x_px": place(h), "y_px": place(v), "horizontal_align": known(inside(h, "wp:align"), HORIZONTAL), "vertical_align": known(inside(v, "wp:align"), VERTICAL), "horizontal_from": h.get("relativeFrom") if h is not None else None,
        "vertical_from": v.get("relativeFrom") if v is not None else None, "left_px": away("distL"), "right_px": away("distR"), "top_px": away("distT"), "bottom_px": away("distB"), "wrap": WRAPS[wrap.name] if wrap is not None else None,
        "wrap_text": SIDES.get((wrap.get("wrapText") or "").lower()) if wrap is not None else None, "behind": True if a.get("behindDoc") == "1" else None, "z": None if z is None else int(half_up(z)),
    }
    return found if any(x is not None for x in found.values()) else None


def vml_anchor(picture: Node) -> dict | None:
    """Where a vector shape's style text puts it; null where that says nothing."""
    shape, wrap = picture.first("v:shape"), picture.first("w10:wrap")
    d = css(shape.get("style") if shape is not None else None)
    mode = lambda name, names: known(d.get(name), names)
    first = lambda *names: next((n for x in names if (n := css_pixels(d.get(x))) is not None), None)
    z = props.number(d.get("z-index"))
    found = {
        "x_px": first("left", "margin-left"), "y_px": first("top", "margin-top"), "horizontal_align": mode("mso-position-horizontal", HORIZONTAL), "vertical_align": mode("mso-position-vertical", VERTICAL),
        "horizontal_from": VML_FROM.get((d.get("mso-position-horizontal-relative") or "").lower()), "vertical_from": VML_FROM.get((d.get("mso-position-vertical-relative") or "").lower()),
        **{f"{s}_px": css_pixels(d.get(f"mso-wrap-distance-{s}")) for s in ("left", "right", "top", "bottom")},
        "wrap": (VML_WRAPS.get((wrap.get("type") or "").strip().lower()) if wrap is not None else None) or VML_WRAPS.get((d.get("mso-wrap-style") or "").lower()),
        "wrap_text": SIDES.get((wrap.get("side") or "").strip().lower()) if wrap is not None else None, "z": None if z is None else int(half_up(z)),
    }
    if not d or all(x is None for x in found.values()):
        return None
    return found | {"behind": True if z is not None and half_up(z) < 0 else None}


def css_filter(drawing: Node) -> str | None:
    """A picture's effects as a list of filters; null without any that shows."""
    out: list[str] = []
    if drawing.first("a14:artisticPastelsSmooth") is not None:
        out += PASTELS
    warmth = drawing.first("a14:colorTemperature")
    n = props.number(warmth.get("colorTemp")) if warmth is not None else None
    if n is not None:
        out += COLD if n >= 9000 else WARM if n <= 4500 else ()
    two = drawing.first("a:duotone")
    if two is not None and any(c.get("val") == "accent3" for c in two.walk("a:schemeClr")):
        out += DUOTONE
    return " ".join(out) or None


def opacity(drawing: Node) -> float | None:
    fix = drawing.first("a:alphaModFix")
    n = props.number(fix.get("amt")) if fix is not None else None
    return None if n is None else min(1.0, max(0.0, n / 100000))


def chosen(node: Node) -> Iterator[Node]:
    """A node's drawings and pictures; of alternatives the choice, else the fallback."""
    for c in node.nodes():
        if c.name == "mc:AlternateContent":
            pick = c.child("mc:Choice") or c.child("mc:Fallback")
            yield from chosen(pick) if pick is not None else ()
        elif c.name in ("w:drawing", "w:pict", "w:object"):
            yield c
        else:
            yield from chosen(c)


def drawings(parts: DataFrame) -> DataFrame:
    """Drawings and vector pictures: doc_id, container, node_index, drawing (its number in the block), floating (see ANCHOR), filter,
    opacity and the paragraphs of its text box."""

    def box(d: Node) -> list[dict] | None:
        content = d.first("w:txbxContent")
        found = []
        for p in content.nodes("w:p") if content is not None else ():
            style, run = props.paragraph_style(p.child("w:pPr")), p.first("w:r")
            images = [i["rid"] for x in chosen(p) if (i := props.image(x)) is not None]
            found.append({"text": paragraph_text(p).rstrip("\n"), "style_id": style["style_id"], "align": style["align"], "run": props.run_style(run.child("w:rPr") if run is not None else None), "images": images})
        return found if any(p["text"] or p["images"] for p in found) else None

    def rows(name: str, content: str) -> Iterator[dict]:
        for i, n in enumerate(top_blocks(body_of(parse(content)))):
            for k, d in enumerate(chosen(n)):
                yield {"container": name, "node_index": i, "drawing": k, "floating": anchor(d) or vml_anchor(d), "filter": css_filter(d), "opacity": opacity(d), "paragraphs": box(d)}

    paragraph = f"struct<text:string,style_id:string,align:string,run:{props.struct_type(props.RUN_STYLE)},images:array<string>>"
    return extract(parts, bodies(), f"container string, node_index int, drawing int, floating {props.struct_type(ANCHOR)}, filter string, opacity double, paragraphs array<{paragraph}>", rows)


def picture_bullets(parts: DataFrame) -> DataFrame:
    """doc_id, bullet_id, part, type, width_px, height_px, src (a data URI; null where the picture is missing)."""

    def rows(_: str, content: str) -> Iterator[dict]:
        for b in parse(content).walk("w:numPicBullet"):
            n = props.number(b.get("w:numPicBulletId"))
            shape, image = b.first("v:shape"), b.first("v:imagedata")
            style = shape.get("style") if shape is not None else None
            if n is not None:
                yield {"bullet_id": int(half_up(n)), "rid": image.get("r:id") if image is not None else None, "width_px": css_points(style, "width"), "height_px": css_points(style, "height")}

    found = extract(parts, F.col("name") == "word/numbering.xml", "bullet_id bigint, rid string, width_px bigint, height_px bigint", rows)
    rels = relationships(parts).where("part = 'word/numbering.xml'").select("doc_id", "rid", "target")
    types = part_types(parts).select("doc_id", F.col("name").alias("target"), "type")
    bytes_ = parts.where("bytes IS NOT NULL").select("doc_id", F.col("name").alias("target"), "bytes")
    met = found.join(rels, ["doc_id", "rid"], "left").join(types, ["doc_id", "target"], "left").join(bytes_, ["doc_id", "target"], "left")
    return met.select("doc_id", "bullet_id", F.col("target").alias("part"), "type", "width_px", "height_px", data_uri(F.col("bytes"), F.col("type")).alias("src"))


def check_boxes(parts: DataFrame) -> DataFrame:
    """Check boxes that stand in a text as embedded controls: doc_id, container, node_index, rid, widget (its name), checked. Control,
    its part and the part's binary are joined by their relationships; the binary is markup of 16-bit or 8-bit characters."""

    def rows(name: str, content: str) -> Iterator[dict]:
        for i, n in enumerate(top_blocks(body_of(parse(content)))):
            for o in n.walk("w:object"):
                c = o.first("w:control")
                if c is not None and c.get("r:id"):
                    yield {"container": name, "node_index": i, "rid": c.get("r:id")}

    controls = extract(parts, bodies(), "container string, node_index int, rid string", rows)
    rels = relationships(parts)
    parts_of = controls.join(rels.select("doc_id", F.col("part").alias("container"), "rid", F.col("target").alias("name")), ["doc_id", "container", "rid"])
    ocx = F.regexp_extract("content", r'(?is)<ax:ocx\b[^>]*?\sr:id="([^"]+)"', 1)
    inner = parts_of.join(parts.where("is_text").select("doc_id", "name", ocx.alias("inner")), ["doc_id", "name"]).where("inner <> ''")
    binary = inner.join(rels.select("doc_id", F.col("part").alias("name"), F.col("rid").alias("inner"), "target"), ["doc_id", "name", "inner"])
    data = binary.join(parts.where("length(bytes) > 0").select("doc_id", F.col("name").alias("target"), "bytes"), ["doc_id", "target"])
    # 16-bit text without its zero bytes is 8-bit text as long as it is ASCII, which the markup is.
    wide, narrow = (F.decode(F.unhex(h), "ISO-8859-1") for h in (F.regexp_replace(F.hex("bytes"), "([0-9A-F]{2})00", "$1"), F.hex("bytes")))
    markup = data.withColumn("markup", F.when(wide.rlike(r"(?i)input\s+type="), wide).otherwise(narrow))
    boxes = markup.where(F.col("markup").rlike(r'(?i)input\s+type\s*=\s*"checkbox"'))
    name = F.trim(F.regexp_extract("markup", r'(?i)\bname\s*=\s*"([^"]+)"', 1))
    return boxes.select("doc_id", "container", "node_index", "rid", F.when(name != "", name).alias("widget"), F.col("markup").rlike(r"(?i)\bchecked\b").alias("checked"))

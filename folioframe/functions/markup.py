"""Column expressions over markup: attributes, switches, entities, links, colours, lengths, paths."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Values that switch a property off. The parsing and the layout rules of the format differ (fixed values).
OFF_WHEN_PARSING = ("0", "false", "none", "off")
OFF_IN_LAYOUT = ("0", "false", "off", "no")
#: Media types by extension, used where a package names none (fixed values).
MEDIA_TYPES = {
    "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "bmp": "image/bmp", "svg": "image/svg+xml", "webp": "image/webp", "emf": "image/x-emf", "wmf": "image/x-wmf",
}


def blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def attribute(tag: Column, name: str) -> Column:
    """The value of a (prefixed) attribute in a tag's text; null where it is missing or empty."""
    return blank_to_null(F.regexp_extract(tag, rf'(?i)[\s<]{re.escape(name)}\s*=\s*"([^"]*)"', 1))


def integer_attribute(tag: Column, name: str) -> Column:
    return attribute(tag, name).try_cast("bigint")


def opening_tag(xml: Column, name: str) -> Column:
    """The text of the first <name ...> tag; null without one."""
    return blank_to_null(F.regexp_extract(xml, rf"(?i)<{re.escape(name)}(?:\s[^>]*)?/?>", 0))


def on_off(xml: Column, name: str, off: tuple[str, ...] = OFF_WHEN_PARSING, value_attribute: str = "w:val") -> Column:
    """Null without the tag, true for the tag alone, else false for the values in off and true for all others."""
    tag = opening_tag(xml, name)
    value = F.lower(attribute(tag, value_attribute))
    return F.when(tag.isNotNull(), F.coalesce(~value.isin(*off), F.lit(True)))


def tag_blocks(xml: Column, name: str) -> Column:
    """All <name>...</name> and <name/> blocks in order, for tags that don't nest in themselves."""
    n = re.escape(name)
    return F.regexp_extract_all(xml, F.lit(rf"(?is)<{n}(?:\s[^>]*)?/>|<{n}(?:\s[^>]*)?>.*?</{n}>"), F.lit(0))


def tag_texts(xml: Column, name: str) -> Column:
    """The inner texts of all <name>...</name> blocks that hold no other tag."""
    n = re.escape(name)
    return F.regexp_extract_all(xml, F.lit(rf"(?i)<{n}(?:\s[^>]*)?>([^<]*)</{n}>"), F.lit(1))


def strip_tags(xml: Column) -> Column:
    return F.regexp_replace(xml, "<[^>]*>", "")


def squeeze(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def decode_entities(text: Column) -> Column:
    """The five named entities, the ampersand last, so that what it gives isn't decoded again. See
    sources.xmltree.decode for numeric references."""
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(char))
    return text


def escape_text(text: Column) -> Column:
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(char), F.lit(name))
    return text


def heading_level(name: Column) -> Column:
    """1 to 6 from a style name that has "heading" and a digit after it."""
    return F.regexp_extract(name, r"(?i)heading\s*([1-6])", 1).try_cast("int")


def strip_leading_index(text: Column) -> Column:
    """Without a leading [digits] (none at all allowed) and the white space after it."""
    return F.regexp_replace(text, r"^\[[0-9]*\]\s*", "")


def hyperlink(target: Column, anchor: Column) -> Column:
    """A link's address from a relationship's target and an anchor, each of them nullable."""
    joined = F.when(F.contains(target, F.lit("#")), target).otherwise(F.concat(target, F.lit("#"), anchor))
    return F.when(target.isNotNull() & anchor.isNotNull(), joined).otherwise(F.coalesce(target, F.concat(F.lit("#"), anchor)))


def field_hyperlink(instruction: Column) -> Column:
    """The address in a HYPERLINK "url" \\l "anchor" field instruction; null for other fields."""
    url = blank_to_null(F.regexp_extract(instruction, r'(?i)HYPERLINK\s+"([^"]*)"', 1))
    anchor = blank_to_null(F.regexp_extract(instruction, r'(?i)\\l\s+"([^"]*)"', 1))
    return F.when(instruction.rlike(r"(?i)^\s*HYPERLINK\b"), hyperlink(url, anchor))


def hex_color(value: Column) -> Column:
    """#RRGGBB in capitals from six hex digits with or without #; null for auto and anything else."""
    digits = F.regexp_extract(F.trim(value), r"^#?([0-9A-Fa-f]{6})$", 1)
    return F.when(digits != "", F.concat(F.lit("#"), F.upper(digits)))


def emu_to_pixels(value: Column) -> Column:
    """English metric units to pixels (9525 to one), to three places."""
    return F.round(value.try_cast("double") / 9525, 3)


def twips_to_pixels(value: Column) -> Column:
    """Twentieths of a point to pixels (15 to one), rounded, never below 0."""
    return F.greatest(F.floor(value.try_cast("double") / 15 + 0.5), F.lit(0))


def css_length_to_pixels(value: Column) -> Column:
    """The first number with a unit px, pt, in, cm or mm (a word of its own, in any case), at 96 dots an inch, rounded."""
    pattern = r"(?i)(-?[0-9]+(?:\.[0-9]+)?)\s*(px|pt|in|cm|mm)\b"
    number, unit = F.regexp_extract(value, pattern, 1).try_cast("double"), F.lower(F.regexp_extract(value, pattern, 2))
    exact = F.when(unit == "px", number).when(unit == "pt", number * 96 / 72).when(unit == "in", number * 96).when(unit == "cm", number * 96 / 2.54).when(unit == "mm", number * 96 / 25.4)
    return F.signum(exact) * F.floor(F.abs(exact) + 0.5)


def rels_part(part: Column) -> Column:
    """The relationships part of a part: a/b.xml has a/_rels/b.xml.rels."""
    return F.regexp_replace(part, r"([^/]+)$", r"_rels/$1.rels")


def resolve_path(base_part: Column, target: Column) -> Column:
    """A relationship target as a part name: absolute addresses and #anchors as they are, a leading slash dropped,
    else relative to the folder of base_part, with . and .. folded (.. above the root is dropped)."""
    folder = F.slice(F.split(base_part, "/"), 1, F.size(F.split(base_part, "/")) - 1)
    fold = lambda acc, x: F.when((x == "") | (x == "."), acc).when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.array_append(acc, x))
    start = F.when(F.startswith(target, F.lit("/")), F.array().cast("array<string>")).otherwise(F.filter(folder, lambda x: x != ""))
    path = F.array_join(F.aggregate(F.split(target, "/"), start, fold), "/")
    return F.when(target == "", "").when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:") | F.startswith(target, F.lit("#")), target).otherwise(path)


def extension(part: Column) -> Column:
    return F.lower(F.regexp_extract(part, r"\.([^./]*)$", 1))


def media_type(part: Column) -> Column:
    """The type that a part's extension stands for; null for other extensions."""
    known = F.create_map(*[F.lit(x) for kv in MEDIA_TYPES.items() for x in kv])
    return F.element_at(known, blank_to_null(extension(part)))


def is_text_part(part: Column) -> Column:
    return extension(part).isin("xml", "rels", "txt") | (part == "[Content_Types].xml")


def is_compound_file(head: Column) -> Column:
    """Whether bytes begin with the magic number of compound files."""
    return F.hex(F.substring(head, 1, 8)) == "D0CF11E0A1B11AE1"


def valid_xml_text(text: Column) -> Column:
    """No control characters but tab, LF and CR, and no U+FFFE or U+FFFF."""
    return ~text.rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F\x{FFFE}\x{FFFF}]")


def east_asian(text: Column) -> Column:
    return text.rlike(r"[\x{2E80}-\x{9FFF}\x{3040}-\x{30FF}\x{AC00}-\x{D7AF}]")


def complex_script(text: Column) -> Column:
    return text.rlike(r"[\x{0590}-\x{08FF}\x{FB1D}-\x{FEFC}]")


def chart_number(value: Column) -> Column:
    """A number without its thousands commas; 0 for anything that isn't finite."""
    n = F.replace(F.trim(value), F.lit(","), F.lit("")).try_cast("double")
    return F.when(n.isNull() | F.isnan(n) | (F.abs(n) == float("inf")), 0.0).otherwise(n)


def chart_kind(xml: Column) -> Column:
    out = F.lit(None).cast("string")
    for tag, kind in (("doughnutChart", "doughnut"), ("pieChart", "pie"), ("lineChart", "line"), ("barChart", "bar")):
        out = F.when(xml.rlike(rf"<(?:\w+:)?{tag}\b"), kind).otherwise(out)
    return out


def hsl_to_hex(value: Column) -> Column:
    """#RRGGBB of hsl(hue, saturation%, lightness%): hue modulo 360, the others cut to 0..100."""
    pattern = r"(?i)^\s*hsl\(\s*(-?[0-9.]+)\s*,\s*(-?[0-9.]+)%?\s*,\s*(-?[0-9.]+)%?\s*\)\s*$"
    part = lambda i: F.regexp_extract(value, pattern, i).try_cast("double")
    hue = F.pmod(part(1), F.lit(360.0))
    s, light = (F.greatest(F.least(part(i), F.lit(100.0)), F.lit(0.0)) / 100 for i in (2, 3))
    chroma = s * F.least(light, 1 - light)

    def channel(shift: int) -> Column:
        k = (F.lit(float(shift)) + hue / 30) % 12
        level = light - chroma * F.greatest(F.least(k - 3, 9 - k, F.lit(1.0)), F.lit(-1.0))
        return F.lpad(F.hex(F.round(level * 255).cast("int")), 2, "0")

    return F.when(value.rlike(pattern), F.concat(F.lit("#"), channel(0), channel(8), channel(4)))


def theme_font(token: Column, fonts: Column) -> Column:
    """The typeface of a theme token like majorHAnsi or minorEastAsia, in any case, from a map (major.latin, minor.ea, ...);
    without an own typeface a script has the latin one."""
    low = F.lower(token)
    family = F.when(F.startswith(low, F.lit("major")), "major").when(F.startswith(low, F.lit("minor")), "minor")
    script = F.when(F.contains(low, F.lit("eastasia")), "ea").when(low.rlike("bidi|cs"), "cs").otherwise("latin")
    return F.coalesce(blank_to_null(F.try_element_at(fonts, F.concat(family, F.lit("."), script))), F.try_element_at(fonts, F.concat(family, F.lit(".latin"))))


def theme_color(rgb: Column, scheme: Column, colors: Column) -> Column:
    """A colour of its own, else that of the theme by name (text and background names stand for dark and light ones)."""
    name = F.when(scheme == "tx1", "dk1").when(scheme == "tx2", "dk2").when(scheme == "bg1", "lt1").when(scheme == "bg2", "lt2").otherwise(scheme)
    return F.coalesce(hex_color(rgb), F.element_at(colors, name))


def edit_class(kind: Column) -> Column:
    """insert or delete for the edits that merge into bursts; null for others."""
    return F.when(kind.isin("insertText", "insertFromComposition"), "insert").when(kind.isin("deleteContentBackward", "deleteContentForward"), "delete")

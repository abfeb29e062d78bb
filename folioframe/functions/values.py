"""Small conversions of attribute values, codes and units as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .markup import attribute, blank_to_null, css_length_to_pixels, extension, hex_color, opening_tag

#: Colours and highlight names by the legacy colour index, 1 to 16 (fixed values).
INDEX_COLORS = ("000000", "0000FF", "00FFFF", "00FF00", "FF00FF", "FF0000", "FFFF00", "FFFFFF", "000080", "008080", "008000", "800080", "800000", "808000", "808080", "C0C0C0")
INDEX_HIGHLIGHTS = ("black", "blue", "cyan", "green", "magenta", "red", "yellow", "white", "darkBlue", "darkCyan", "darkGreen", "darkMagenta", "darkRed", "darkYellow", "darkGray", "lightGray")
#: List formats by the legacy number format code (fixed values).
NUMBER_FORMATS = {0: "decimal", 1: "upperRoman", 2: "lowerRoman", 3: "upperLetter", 4: "lowerLetter", 5: "ordinal", 6: "cardinalText", 7: "ordinalText", 22: "decimalZero", 23: "bullet", 47: "chosung"}
#: Colours of the default drawing scheme (fixed values).
SCHEME_COLORS = {
    "bg1": "#ffffff", "bg2": "#f3f4f6", "tx1": "#000000", "tx2": "#1f2937", "dk1": "#000000", "dk2": "#1f2937", "lt1": "#ffffff", "lt2": "#f3f4f6", "accent1": "#4472c4", "accent2": "#ed7d31", "accent3": "#70ad47", "accent4": "#5b9bd5",
    "accent5": "#7030a0", "accent6": "#ffc000", "hlink": "#0563c1", "folhlink": "#954f72", "followedhyperlink": "#954f72",
}
#: Placements of anchored pictures (fixed values).
HORIZONTAL, VERTICAL = ("left", "center", "right", "inside", "outside"), ("top", "center", "bottom", "inside", "outside")


def alignment(value: Column) -> Column:
    """left, center, right or justify; null for anything else."""
    low = F.lower(value)
    return F.when(low.isin("both", "distribute", "thaidistribute"), "justify").when(low.isin("left", "center", "right", "justify"), low)


def three_way(value: Column) -> Column:
    """1, true, on: true; 0, false, off: false; null for anything else (the rule of field attributes)."""
    low = F.lower(F.trim(value))
    return F.when(low.isin("1", "true", "on"), True).when(low.isin("0", "false", "off"), False)


def underline(xml: Column) -> Column:
    """Whether w:u underlines: by its value, true for the bare tag, null where only its colour is named."""
    tag = opening_tag(xml, "w:u")
    value = F.lower(attribute(tag, "w:val"))
    bare = F.regexp_replace(tag, r'(?i)\sw:(color|theme\w*)="[^"]*"', "")
    return F.when(tag.isNull(), F.lit(None).cast("boolean")).when(value.isNotNull(), ~value.isin("0", "false", "none", "off")).when(~F.contains(tag, F.lit("=")), True).when(~F.contains(bare, F.lit("=")), F.lit(None).cast("boolean")).otherwise(True)


def code_point(value: Column) -> Column:
    """The character of a hexadecimal number, with or without 0x; null where there is none."""
    n = F.conv(F.regexp_extract(value, r"^\s*(?:0[xX])?([0-9A-Fa-f]{1,6})\s*$", 1), 16, 10).try_cast("int")
    good = (n > 0) & (n <= 0x10FFFF) & ~n.between(0xD800, 0xDFFF)
    return F.when(good, F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32"))


def is_metafile(content_type: Column, part: Column) -> Column:
    kinds = ("image/x-emf", "image/emf", "application/emf", "image/x-wmf", "image/wmf", "application/x-msmetafile")
    return F.coalesce(F.lower(content_type).isin(*kinds), F.lit(False)) | F.coalesce(extension(part).isin("emf", "wmf"), F.lit(False))


def without_text_boxes(xml: Column) -> Column:
    return F.regexp_replace(xml, r"(?is)<w:txbxContent(?:\s[^>]*)?>.*?</w:txbxContent>", "")


def field_display(value: Column) -> Column:
    """A legacy field's shown text: wide and hard spaces as spaces; null when nothing else is left."""
    plain = F.translate(value, "   ", "   ")
    return F.when(F.trim(plain) != "", plain)


def index_color(index: Column) -> Column:
    return F.when(index.between(1, 16), F.try_element_at(F.array(*map(F.lit, INDEX_COLORS)), index.cast("int")))


def index_highlight(index: Column) -> Column:
    return F.when(index.between(1, 16), F.try_element_at(F.array(*map(F.lit, INDEX_HIGHLIGHTS)), index.cast("int")))


def number_format(code: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in NUMBER_FORMATS.items() for x in kv])
    return F.coalesce(F.try_element_at(known, code.cast("int")), F.lit("decimal"))


def colorref(red: Column, green: Column, blue: Column, flag: Column) -> Column:
    """RRGGBB of a colour's bytes; null where the flag says automatic."""
    two = lambda c: F.lpad(F.hex(c.cast("int")), 2, "0")
    return F.when(flag != 0xFF, F.concat(two(red), two(green), two(blue)))


def scheme_color(name: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in SCHEME_COLORS.items() for x in kv]), F.lower(F.trim(name)))


def drawing_color(xml: Column, colors: Column) -> Column:
    """struct<color, opacity> of a drawing's colour markup: its own colour, else the last shown one of a system colour, else a scheme
    colour by name, from the theme (a map, keys in lower case) before the default scheme; null where it names none."""
    first = lambda tag, name: blank_to_null(F.regexp_extract(xml, rf'(?i)<a:{tag}\b[^>]*\b{name}="([^"]+)"', 1))
    token = F.lower(F.trim(first("schemeClr", "val")))
    color = F.coalesce(hex_color(first("srgbClr", "val")), hex_color(first("sysClr", "lastClr")), F.try_element_at(colors, token), scheme_color(token))
    return F.when(color.isNotNull(), F.struct(color.alias("color"), percent_of_thousandths(first("alpha", "val")).alias("opacity")))


def percent_of_thousandths(value: Column) -> Column:
    """A share from thousandths of a percent, cut to 0..1; null for negative numbers and others."""
    n = value.try_cast("double")
    return F.when((n >= 0) & ~F.isnan(n), F.least(n / 100000, F.lit(1.0)))


def css_property(style: Column, name: str) -> Column:
    return blank_to_null(F.trim(F.regexp_extract(style, rf"(?i)(?:^|;)\s*{name}\s*:\s*([^;]*)", 1)))


def vml_size(style: Column) -> Column:
    """struct<width_px, height_px> of a picture's style text."""
    return F.struct(css_length_to_pixels(css_property(style, "width")).alias("width_px"), css_length_to_pixels(css_property(style, "height")).alias("height_px"))


def shading(xml: Column) -> Column:
    return hex_color(attribute(opening_tag(xml, "w:shd"), "w:fill"))


def data_uri(content: Column, content_type: Column) -> Column:
    return F.concat(F.lit("data:"), content_type, F.lit(";base64,"), F.base64(content))


def body_xml(xml: Column) -> Column:
    """What stands in the body, else the whole text."""
    return F.coalesce(blank_to_null(F.regexp_extract(xml, r"(?is)<w:body(?:\s[^>]*)?>(.*)</w:body>", 1)), xml)


def set_attribute(tag: Column, name: str, value: Column) -> Column:
    """A tag's text with an attribute set: replaced where it stands, else added at the end."""
    clean = F.replace(F.replace(F.replace(value, F.lit("&"), F.lit("&amp;")), F.lit('"'), F.lit("&quot;")), F.lit("<"), F.lit("&lt;"))
    new = F.concat(F.lit(f' {name}="'), clean, F.lit('"'))
    cut = F.regexp_replace(tag, rf'\s{name}="[^"]*"', "")
    return F.concat(F.regexp_extract(cut, r"(?s)^(.*?)\s*/?>$", 1), new, F.regexp_extract(cut, r"(/?>)$", 1))


def viewport(value: Column) -> Column:
    """struct<width, height> of text like 1280x720; null for other texts."""
    pattern = r"^\s*([1-9][0-9]*)\s*[xX]\s*([1-9][0-9]*)\s*$"
    part = lambda i: F.regexp_extract(value, pattern, i).try_cast("int")
    return F.when(value.rlike(pattern), F.struct(part(1).alias("width"), part(2).alias("height")))


def spacing_pixels(twips: Column) -> Column:
    return F.greatest(F.coalesce(F.floor(twips / 15 + 0.5), F.lit(0)), F.lit(0))

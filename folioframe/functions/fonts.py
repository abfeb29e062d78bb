"""Font slots of text: the script of each character, the typeface of each script, and where the typeface changes.

A style is a mapping from names of FIELDS to columns; fields that are missing are null.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

SCRIPTS = ("ascii", "highAnsi", "eastAsia", "complexScript")
FIELDS = (
    "family", "source_family", "ascii", "high_ansi", "east_asia", "complex", "resolved_ascii", "resolved_high_ansi", "resolved_east_asia", "resolved_complex", "theme_ascii", "theme_high_ansi", "theme_east_asia", "theme_complex",
    "hint", "right_to_left", "complex_script", "language_bidi", "language_east_asia",
)
#: Unicode scripts of the two slots that have some (fixed values).
EAST_ASIA = ("Han", "Hiragana", "Katakana", "Hangul", "Bopomofo", "Yi")
COMPLEX = (
    "Arabic", "Hebrew", "Syriac", "Thaana", "Nko", "Samaritan", "Mandaic", "Devanagari", "Bengali", "Gurmukhi", "Gujarati", "Oriya", "Tamil", "Telugu", "Kannada", "Malayalam", "Sinhala", "Thai", "Lao", "Tibetan", "Myanmar", "Khmer",
)
#: Language prefixes that make neutral characters complex or east Asian (fixed values).
COMPLEX_LANGUAGES = ("ar", "ckb", "dv", "fa", "he", "hi", "ks", "ku", "pa-arab", "ps", "sd", "syr", "ug", "ur", "yi")
EAST_ASIA_LANGUAGES = ("ja", "ko", "zh")
#: Where a script's typeface is looked up, first found first.
LOOKUP = {
    "ascii": ("resolved_ascii", "ascii", "resolved_high_ansi", "high_ansi"),
    "highAnsi": ("resolved_high_ansi", "high_ansi", "resolved_ascii", "ascii"),
    "eastAsia": ("resolved_east_asia", "east_asia", "resolved_high_ansi", "high_ansi", "resolved_ascii", "ascii"),
    "complexScript": ("resolved_complex", "complex", "resolved_high_ansi", "high_ansi", "resolved_ascii", "ascii"),
}

_EAST = "".join(rf"\p{{Is{s}}}" for s in EAST_ASIA) + r"\x{3000}-\x{303f}\x{ff00}-\x{ffef}"
_COMPLEX = "".join(rf"\p{{Is{s}}}" for s in COMPLEX)
_NEUTRAL = r"\p{M}\p{Z}\p{P}\x{200c}\x{200d}\x{fe00}-\x{fe0f}"
#: Character classes, no two of which overlap; marks, separators and punctuation beyond ASCII are neutral.
CLASSES = {
    "ascii": r"[\x00-\x7f]", "eastAsia": f"[{_EAST}]", "complexScript": f"[{_COMPLEX}&&[^{_EAST}]]", "neutral": rf"[{_NEUTRAL}&&[^\x00-\x7f{_EAST}{_COMPLEX}]]", "highAnsi": rf"[^\x00-\x7f{_EAST}{_COMPLEX}{_NEUTRAL}]",
}

Style = Mapping[str, Column]


def field(style: Style, name: str, kind: str = "string") -> Column:
    return style[name] if name in style else F.lit(None).cast(kind)


def named(value: Column) -> Column:
    """A typeface's name without white space around it; null where nothing is left."""
    cut = F.regexp_replace(value, r"^\s+|\s+$", "")
    return F.when(cut != "", cut)


def key(family: Column) -> Column:
    """What two names of one typeface have in common: no quotes around, lower case."""
    return F.lower(F.regexp_replace(named(family), r"""^['"]+|['"]+$""", ""))


def forced(style: Style) -> Column:
    """Whether a style makes every character complex script."""
    own = field(style, "complex_script", "boolean")
    return F.coalesce(own, F.lit(False)) | (F.coalesce(field(style, "right_to_left", "boolean"), F.lit(False)) & F.coalesce(own, F.lit(True)))


def script_of(text: Column, style: Style | None = None) -> Column:
    """The script of a text's first character; null for a neutral one and for an empty text."""
    out = F.lit(None).cast("string")
    for name in reversed(SCRIPTS[1:]):  # the more usual ones are tried first
        out = F.when(text.rlike(f"^{CLASSES[name]}"), name).otherwise(out)
    return F.when(F.length(text) > 0, F.when(forced(style or {}), "complexScript").when(F.ascii(text) < 128, "ascii").otherwise(out))


def neutral_script(style: Style) -> Column:
    """The script of neutral characters in a text that has no others."""
    hint = F.lower(F.regexp_replace(F.coalesce(named(field(style, "hint")), F.lit("")), r"[-_\s]", ""))
    speaks = lambda name, languages: F.coalesce(named(field(style, name)), F.lit("")).rlike(f"(?i)^(?:{'|'.join(languages)})(?:-|$)")
    complex_ = hint.isin("cs", "complexscript", "bidi") | F.coalesce(field(style, "right_to_left", "boolean"), F.lit(False)) | speaks("language_bidi", COMPLEX_LANGUAGES)
    return F.when(hint == "eastasia", "eastAsia").when(complex_, "complexScript").when(speaks("language_east_asia", EAST_ASIA_LANGUAGES), "eastAsia").otherwise("highAnsi")


def overridden(style: Style) -> Column:
    """Whether a typeface set later stands for all scripts: another one than the imported one, or one without any by script."""
    now, imported = key(field(style, "family")), key(field(style, "source_family"))
    none = reduce(lambda a, b: a & b, [named(field(style, n)).isNull() for n in ("ascii", "high_ansi", "east_asia", "complex", "theme_ascii", "theme_high_ansi", "theme_east_asia", "theme_complex")])
    return F.when(now.isNull(), False).when(imported.isNotNull(), now != imported).otherwise(none)


def family(style: Style, script: str) -> Column:
    """The typeface of a script."""
    own = named(field(style, "family"))
    return F.when(overridden(style), own).otherwise(F.coalesce(*[named(field(style, n)) for n in LOOKUP[script]], own))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Computes value once for body, which may use it many times."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running_sums(sizes: Column, block: int = 256) -> Column:
    """For each number of an array, the sum of those before it. Arrays are appended to block by block, so that long ones don't
    cost the square of their length."""
    start = F.array().cast("array<bigint>")

    def before(numbers: Column, first: Column) -> Column:
        zero = F.struct(start.alias("out"), first.cast("bigint").alias("at"))
        return F.aggregate(numbers, zero, lambda s, x: F.struct(F.array_append(s["out"], s["at"]).alias("out"), (s["at"] + x).alias("at")), lambda s: s["out"])

    def spread(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0).cast("bigint"), lambda s, x: s + x))
        return F.flatten(F.zip_with(blocks, before(totals, F.lit(0)), before))

    cut = lambda xs: F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / block).cast("int")), lambda b: F.slice(xs, b * block + 1, F.lit(block)))
    return let(sizes, lambda xs: F.when(F.size(xs) > block, let(cut(xs), spread)).when(F.size(xs) > 0, before(xs, F.lit(0))).otherwise(start))


def pattern_of(keys: Mapping[str, Column]) -> Column:
    """The pattern of a text's pieces, by which scripts' typefaces (keys) agree: those are one class."""
    neutral, alternatives = CLASSES["neutral"], []
    for i, s in enumerate(SCRIPTS):
        first = reduce(lambda a, b: a & b, [keys[s] != keys[t] for t in SCRIPTS[:i]], F.lit(True))
        together = F.concat(*[F.lit(CLASSES[s]), *[F.when(keys[t] == keys[s], CLASSES[t]).otherwise("") for t in SCRIPTS[i + 1 :]]])
        alternatives.append(F.when(first, F.concat(F.lit("["), together, F.lit("][["), together, F.lit(f"]{neutral}]*+"))))
    return F.concat(F.lit(rf"(?s)(?:^{neutral}++)?(?:"), F.array_join(F.array_compact(F.array(*alternatives)), "|"), F.lit(rf")|^{neutral}++\z"))


def segments(text: Column, style: Style) -> Column:
    """array<struct<text, start, end, script, family>>: the maximal pieces of one typeface, places in UTF-16 units.

    A neutral character has the script of the one before it, at the text's beginning of the first that has one, else that of
    neutral_script. script is that of a piece's first character. A null or empty text has no pieces.
    """
    families = F.struct(*[family(style, s).alias(s) for s in SCRIPTS])
    about = lambda f: F.struct(f.alias("family"), pattern_of({s: F.coalesce(F.concat(F.lit("="), key(f[s])), F.lit("")) for s in SCRIPTS}).alias("pattern"), forced(style).alias("forced"), neutral_script(style).alias("neutral"))
    units = lambda p: F.when(F.octet_length(p) == F.length(p), F.length(p)).otherwise(F.floor(F.octet_length(F.encode(p, "UTF-16LE")) / 2)).cast("bigint")

    def cut(i: Column) -> Column:
        pieces = F.when(F.coalesce(F.length(text), F.lit(0)) == 0, F.array().cast("array<string>")).when(i["forced"], F.array(text)).otherwise(F.regexp_extract_all(text, i["pattern"], F.lit(0)))
        script = lambda p: F.when(i["forced"], "complexScript").otherwise(F.coalesce(script_of(F.substring(p, 1, 1)), script_of(F.regexp_extract(p, f"(?s)^{CLASSES['neutral']}*+(.)", 1)), i["neutral"]))
        face = lambda s: reduce(lambda out, n: F.when(s == n, i["family"][n]).otherwise(out), SCRIPTS, F.lit(None).cast("string"))
        piece = lambda p, n, at: let(script(p), lambda s: F.struct(p.alias("text"), at.alias("start"), (at + n).alias("end"), s.alias("script"), face(s).alias("family")))
        placed = lambda ps, ns: let(running_sums(ns), lambda at: F.transform(ps, lambda p, k: piece(p, F.get(ns, k), F.get(at, k))))
        return let(pieces, lambda ps: let(F.transform(ps, units), lambda ns: placed(ps, ns)))

    return let(let(families, about), cut)


def text_family(text: Column, style: Style) -> Column:
    """The typeface of the first piece of a text that has one, else the style's."""
    return F.coalesce(F.try_element_at(F.filter(F.transform(segments(text, style), lambda s: s["family"]), lambda f: f.isNotNull()), F.lit(1)), named(field(style, "family")))

"""Formatting of legacy binary documents: property records of characters, paragraphs, sections and table rows, styles, lists,
fonts and pictures, as the published binary format lays them out, folded to dictionaries and written as markup.

A property record is a 16-bit code and an operand; what a code sets is looked up in the tables below. Everything here
works on the bytes of one document.
"""

from __future__ import annotations

import re
import struct
from bisect import bisect_right
from collections.abc import Callable, Iterator

from ..functions.values import INDEX_COLORS, INDEX_HIGHLIGHTS, NUMBER_FORMATS
from .xmltree import encode

NIL = 0x0FFF
#: Places of tables in the file information block, by number (fixed values).
STYLES, SECTIONS, CHARACTERS, PARAGRAPHS, FONTS, PIECES, LISTS, OVERRIDES, BOXES = 1, 6, 12, 13, 15, 33, 73, 74, 56
#: Switches of characters: element by code (fixed values).
TOGGLES = {0x0835: "w:b", 0x0836: "w:i", 0x083B: "w:caps", 0x083A: "w:smallCaps", 0x0837: "w:strike", 0x0838: "w:outline", 0x0839: "w:shadow", 0x0858: "w:emboss", 0x0854: "w:imprint", 0x083C: "w:vanish"}
#: What other codes set, and how their operands are read (fixed values).
CHARACTER = {
    0x4A30: ("style", "u2"), 0x2A53: ("double_strike", "is1"), 0x2A3E: ("underline", "u1"), 0x2A42: ("color_index", "u1"), 0x6870: ("color", "raw"), 0x4A43: ("half_points", "u2"), 0x4845: ("raised", "i2"), 0x2A48: ("script", "u1"),
    0x4A4F: ("font_ascii", "u2"), 0x4A50: ("font_east_asia", "u2"), 0x4A51: ("font_other", "u2"), 0x484B: ("kerning", "u2"), 0x8840: ("spacing", "i2"), 0x852A: ("scale", "u2"), 0x2A0C: ("highlight", "u1"), 0x4866: ("shading", "shade_old"),
    0xCA71: ("shading", "shade"), 0x0855: ("special", "is1"), 0x0856: ("object", "is1"), 0x080A: ("embedded", "is1"), 0x0806: ("data", "is1"), 0x6A03: ("picture", "u4"), 0x6A09: ("symbol", "raw"),
}
PARAGRAPH = {
    0x4600: ("style", "u2"), 0x2403: ("align", "u1"), 0x2461: ("align", "u1"), 0x2405: ("keep_lines", "bool"), 0x2406: ("keep_next", "bool"), 0x2407: ("page_break_before", "bool"), 0x2431: ("widow_control", "bool"), 0x260A: ("level", "u1"),
    0x460B: ("list", "u2"), 0x840F: ("left", "i2"), 0x845E: ("left", "i2"), 0x840E: ("right", "i2"), 0x845D: ("right", "i2"), 0x8411: ("first", "i2"), 0x8460: ("first", "i2"), 0x6412: ("line", "line"), 0xA413: ("before", "u2"), 0xA414: ("after", "u2"),
    0x245B: ("before_auto", "bool"), 0x245C: ("after_auto", "bool"), 0x246D: ("contextual", "bool"), 0x2640: ("outline", "u1"), 0x2441: ("bidi", "bool"), 0x2416: ("in_table", "is1"), 0x2417: ("row_end", "is1"), 0x6649: ("depth", "u4"),
    0x244B: ("inner_cell", "is1"), 0x244C: ("inner_row_end", "is1"), 0x6424: ("top", "border_old"), 0x6425: ("left_border", "border_old"), 0x6426: ("bottom", "border_old"), 0x6427: ("right_border", "border_old"), 0x6428: ("between", "border_old"),
    0xC64E: ("top", "border"), 0xC64F: ("left_border", "border"), 0xC650: ("bottom", "border"), 0xC651: ("right_border", "border"), 0xC652: ("between", "border"), 0x442D: ("shading", "shade_old"), 0xC64D: ("shading", "shade"),
}
SECTION = {
    0x3009: ("break", "u1"), 0x300A: ("title_page", "is1"), 0x500B: ("more_columns", "u2"), 0x900C: ("column_gap", "u2"), 0x3005: ("even_columns", "is1"), 0x300E: ("page_format", "u1"), 0x3011: ("restart", "is1"), 0x501C: ("page_start", "u2"),
    0xB01F: ("width", "u2"), 0xB020: ("height", "u2"), 0x301D: ("orientation", "u1"), 0xB021: ("left", "u2"), 0xB022: ("right", "u2"), 0x9023: ("top", "i2"), 0x9024: ("bottom", "i2"), 0xB025: ("gutter", "u2"), 0xB017: ("header", "u2"),
    0xB018: ("footer", "u2"), 0x5032: ("grid", "u2"), 0x9031: ("line_pitch", "u2"), 0x7030: ("char_space", "u4"),
}
PAGE = {
    "break": 2, "title_page": False, "more_columns": 0, "column_gap": 708, "even_columns": True, "restart": False, "page_start": 1, "width": 12240, "height": 15840, "orientation": 1, "left": 1800, "right": 1800, "top": 1440, "bottom": 1440, "gutter": 0,
    "header": 720, "footer": 720, "grid": 0, "line_pitch": 0, "char_space": 0,
}
#: Names by number: borders, shading patterns, underlines, tab stops, leaders, alignments, breaks, grids (fixed values).
BORDERS = dict(enumerate((
    "single", "thick", "double", "single", "single", "dotted", "dashed", "dotDash", "dotDotDash", "triple", "thinThickSmallGap", "thickThinSmallGap", "thinThickThinSmallGap", "thinThickMediumGap", "thickThinMediumGap", "thinThickThinMediumGap",
    "thinThickLargeGap", "thickThinLargeGap", "thinThickThinLargeGap", "wave", "doubleWave", "dashSmallGap", "dashDotStroked", "threeDEmboss", "threeDEngrave", "outset", "inset",
), 1))
PATTERNS = dict(enumerate((
    "clear", "solid", "pct5", "pct10", "pct20", "pct25", "pct30", "pct40", "pct50", "pct60", "pct70", "pct75", "pct80", "pct90", "horzStripe", "vertStripe", "reverseDiagStripe", "diagStripe", "horzCross", "diagCross",
))) | {35: "pct10"}
UNDERLINES = {
    0: "none", 1: "single", 2: "words", 3: "double", 4: "dotted", 6: "thick", 7: "dash", 9: "dotDash", 10: "dotDotDash", 11: "wave", 20: "dottedHeavy", 23: "dashedHeavy", 25: "dashDotHeavy", 26: "dashDotDotHeavy", 27: "wavyHeavy", 39: "dashLong",
    43: "wavyDouble", 55: "dashLongHeavy",
}
TAB_ALIGNS, LEADERS = {1: "center", 2: "right", 3: "decimal", 4: "bar"}, {1: "dot", 2: "hyphen", 3: "underscore", 4: "heavy", 5: "middleDot"}
ALIGNS, BREAKS, GRIDS = {1: "center", 2: "right", 3: "both", 4: "distribute"}, {0: "continuous", 1: "nextColumn", 3: "evenPage", 4: "oddPage"}, {1: "linesAndChars", 2: "lines", 3: "snapToChars"}
#: Pictures by record type: extension, media type, and the instance that has one identifier (fixed values).
BLIPS = {0xF01D: ("jpeg", "image/jpeg", 0x46A), 0xF02A: ("jpeg", "image/jpeg", 0x6E2), 0xF01E: ("png", "image/png", 0x6E0), 0xF029: ("tiff", "image/tiff", 0x6E4), 0xF01F: ("bmp", "image/bmp", 0x7A8)}


def u2(b: bytes, at: int = 0) -> int:
    return struct.unpack_from("<H", b, at)[0]


def u4(b: bytes, at: int = 0) -> int:
    return struct.unpack_from("<I", b, at)[0]


def records(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(code, operand) of each property record; what is cut off at the end is left out."""
    at = 0
    while at + 2 <= len(data):
        code, start = u2(data, at), at + 2
        size = {0: 1, 1: 1, 2: 2, 3: 4, 4: 2, 5: 2, 7: 3}.get(code >> 13)
        if size is None and code in (0xD608, 0xD606):  # table definitions count in 16 bits, themselves by one less
            if start + 2 > len(data):
                return
            size, start = max(0, u2(data, start) - 1), start + 2
        elif size is None:
            if start >= len(data) or (code == 0xC615 and data[start] == 255):
                return
            size, start = data[start], start + 1
        if start + size > len(data):
            return
        yield code, data[start : start + size]
        at = start + size


# ---- operands


def index_color(i: int) -> str | None:
    return INDEX_COLORS[i - 1] if 1 <= i <= 16 else None


def ref_color(b: bytes) -> str | None:
    return None if len(b) < 4 or b[3] == 0xFF else b[:3].hex().upper()


def border(b: bytes, old: bool) -> dict | None:
    """A border: four bytes with a colour index, or eight with a colour."""
    if len(b) < (4 if old else 8) or (old and b[:4] == b"\xff" * 4):
        return None
    size, kind, color, flags = (b[0], b[1], index_color(b[2]), b[3]) if old else (b[4], b[5], ref_color(b), b[6])
    return None if kind in (0, 255) else {"val": BORDERS.get(kind, "single"), "sz": size, "color": color, "space": flags & 0x1F, "shadow": bool(flags & 0x20)}


def shade(b: bytes, old: bool) -> dict | None:
    """A shading: 16 bits with colour indexes, or ten bytes with colours."""
    if old:
        v = u2(b.ljust(2, b"\0"))
        return None if v == 0xFFFF else {"val": PATTERNS.get(v >> 10, "clear"), "color": index_color(v & 0x1F), "fill": index_color(v >> 5 & 0x1F)}
    return {"val": PATTERNS.get(u2(b, 8), "clear"), "color": ref_color(b[:4]), "fill": ref_color(b[4:8])} if len(b) >= 10 else None


def padded(b: bytes, n: int) -> bytes:
    return b[:n].ljust(n, b"\0")


READERS: dict[str, Callable] = {
    "u1": lambda b: padded(b, 1)[0], "u2": lambda b: u2(padded(b, 2)), "i2": lambda b: struct.unpack("<h", padded(b, 2))[0], "u4": lambda b: u4(padded(b, 4)), "raw": lambda b: b, "is1": lambda b: padded(b, 1)[0] == 1,
    "bool": lambda b: {0: False, 1: True}.get(padded(b, 1)[0]), "line": lambda b: struct.unpack("<hh", b[:4]) if len(b) >= 4 else None, "border_old": lambda b: border(b, True), "border": lambda b: border(b, False), "shade_old": lambda b: shade(b, True),
    "shade": lambda b: shade(b, False),
}


def fold(data: bytes, codes: dict[int, tuple[str, str]], into: dict) -> dict:
    for code, operand in records(data):
        if code in codes:
            name, kind = codes[code]
            into[name] = READERS[kind](operand)
    return into


def toggles(data: bytes, base: dict[str, bool]) -> dict[str, bool]:
    """A style's switches: those of its base, set, cleared or inverted."""
    out = dict(base)
    for code, operand in records(data):
        if code in TOGGLES:
            v, name = padded(operand, 1)[0], TOGGLES[code]
            if v in (0, 1):
                out[name] = bool(v)
            elif v == 0x81:
                out[name] = not out.get(name, False)
    return out


def character(data: bytes, base: dict[str, bool] | None = None) -> dict:
    """A run's properties; switches may be those of its styles (base), or the opposite."""
    out: dict = {"toggles": {}}
    for code, operand in records(data):
        if code in TOGGLES:
            v, name = padded(operand, 1)[0], TOGGLES[code]
            if v in (0, 1):
                out["toggles"][name] = bool(v)
            elif v == 0x80:
                out["toggles"].pop(name, None)
            elif v == 0x81:
                out["toggles"][name] = not (base or {}).get(name, False)
    return fold(data, CHARACTER, out)


def tab_stops(b: bytes, closes: bool) -> tuple[list[int], list[tuple[int, int, int]]]:
    """(places cleared, (place, alignment, leader) set) of a change of tab stops."""
    if not b:
        return [], []
    n = b[0]
    gone = [struct.unpack_from("<h", b, 1 + 2 * i)[0] for i in range(n) if 3 + 2 * i <= len(b)]
    at = 1 + 2 * n * (2 if closes else 1)
    if at >= len(b):
        return gone, []
    m, at = b[at], at + 1
    return gone, [(struct.unpack_from("<h", b, at + 2 * i)[0], b[at + 2 * m + i] & 7, b[at + 2 * m + i] >> 3 & 7) for i in range(m) if at + 2 * m + i < len(b)]


def paragraph(data: bytes, style: int = 0) -> dict:
    """A paragraph's properties; records of tables are kept as they are."""
    out: dict = {"style": style, "cleared": [], "tabs": [], "table": b""}
    at = 0
    for code, operand in records(data):
        size = {0: 1, 1: 1, 2: 2, 3: 4, 4: 2, 5: 2, 7: 3}.get(code >> 13)
        head = 2 if size is not None else 4 if code in (0xD608, 0xD606) else 3
        if code >> 10 & 7 == 5:
            out["table"] += data[at : at + head + len(operand)]
        elif code in (0xC60D, 0xC615):
            gone, new = tab_stops(operand, code == 0xC615)
            out["cleared"] += gone
            out["tabs"] += new
        elif code in PARAGRAPH:
            name, kind = PARAGRAPH[code]
            out[name] = READERS[kind](operand)
        at += head + len(operand)
    return out


def section(data: bytes) -> dict:
    out = fold(data, SECTION, dict(PAGE))
    out["widths"] = [u2(o, 1) for code, o in records(data) if code == 0xF203 and len(o) >= 3]
    return out


def table_row(data: bytes) -> dict:
    """A row's cells (left and right in twentieths of a point, merges, alignment, borders, shading) and properties."""
    out: dict = {"align": 0, "gap_half": 0, "height": 0, "cant_split": False, "header": False, "cells": [], "borders": [None] * 6}
    simple = {0x5400: ("align", "u1"), 0x548A: ("align", "u1"), 0x9602: ("gap_half", "i2"), 0x9407: ("height", "i2"), 0x3403: ("cant_split", "is1"), 0x3404: ("header", "is1")}
    shades: list[dict] = []
    sides = ("top", "left", "bottom", "right")
    for code, o in records(data):
        cells = out["cells"]
        if code in simple:
            out[simple[code][0]] = READERS[simple[code][1]](o)
        elif code == 0xD608 and o and o[0] and len(o) >= 1 + 2 * (o[0] + 1):
            n = o[0]
            edges = struct.unpack_from(f"<{n + 1}h", o, 1)
            out["cells"] = []
            for i in range(n):
                tc = o[1 + 2 * (n + 1) + 20 * i :][:20]
                f = u2(tc) if len(tc) == 20 else 0
                own = {s: border(tc[4 + 4 * k : 8 + 4 * k], True) for k, s in enumerate(sides)} if len(tc) == 20 else dict.fromkeys(sides)
                out["cells"].append({"left": edges[i], "right": edges[i + 1], "first_merged": bool(f & 1), "merged": bool(f & 2), "vertical": bool(f & 4), "backward": bool(f & 8), "v_merge": bool(f & 0x20), "v_restart": bool(f & 0x40), "v_align": f >> 7 & 3, "borders": own, "shading": None})
        elif code == 0xD605:
            out["borders"] = [border(o[4 * i : 4 * i + 4], True) for i in range(min(6, len(o) // 4))] + out["borders"][len(o) // 4 :]
        elif code == 0xD613:
            out["borders"] = [border(o[8 * i : 8 * i + 8], False) or b for i, b in enumerate(out["borders"])]
        elif code == 0xD609:
            shades += [s for i in range(0, len(o) - 1, 2) if (s := shade(o[i : i + 2], True))]
        elif code == 0xD612:
            shades += [s for i in range(0, len(o) - 9, 10) if (s := shade(o[i : i + 10], False))]
        elif code == 0xD620 and len(o) >= 7:
            b = border(o[3:7], True)
            for c in cells[o[0] : o[1]]:
                c["borders"] |= {s: b for k, s in enumerate(sides) if o[2] >> k & 1}
        elif code == 0xD62B and len(o) >= 2 and o[0] < len(cells):
            cells[o[0]] |= {"v_merge": bool(o[1] & 1), "v_restart": bool(o[1] & 2)}
        elif code == 0xD62C and len(o) >= 3:
            for c in cells[o[0] : o[1]]:
                c["v_align"] = o[2]
        elif code in (0x7627, 0x7628) and len(o) >= 4 and (s := shade(o[2:4], True)):
            for c in cells[o[0] : o[1]]:
                c["shading"] = s
    for c, s in zip(out["cells"], shades, strict=False):
        if c["shading"] is None and (s["val"] != "clear" or s["fill"] is not None):
            c["shading"] = s
    return out


# ---- tables of the file


def bins(plc: bytes) -> list[tuple[int, int, int]]:
    """(from, to, page) of a table of property pages."""
    if len(plc) < 4 or (len(plc) - 4) % 8:
        return []
    n = (len(plc) - 4) // 8
    v = struct.unpack(f"<{2 * n + 1}I", plc)
    return [(v[i], v[i + 1], v[n + 1 + i]) for i in range(n)]


def page_runs(word: bytes, number: int, paragraphs: bool) -> list[tuple[int, int, int, bytes]]:
    """(from, to, style, records) of a page of character or paragraph properties; style is 0 for characters."""
    page = word[512 * number : 512 * number + 512]
    if len(page) < 512:
        return []
    n, width = page[511], 13 if paragraphs else 1
    if not n or (n + 1) * 4 + n * width > 511:
        return []
    out = []
    for i in range(n):
        at, style, data = 2 * page[(n + 1) * 4 + i * width], 0, b""
        if at and not paragraphs:
            data = page[at + 1 : at + 1 + page[at]] if at + 1 + page[at] <= 512 else b""
        elif at:
            start, size = (at + 1, 2 * page[at] - 1) if page[at] else (at + 2, 2 * page[min(at + 1, 511)])
            if size >= 2 and start + size <= 512:
                style, data = u2(page, start), page[start + 2 : start + size]
        out.append((u4(page, 4 * i), u4(page, 4 * i + 4), style, data))
    return out


def fonts(data: bytes) -> list[str]:
    """Typefaces by their number."""
    if len(data) < 4:
        return []
    n, at = (u2(data, 2), 6) if u2(data) == 0xFFFF else (u2(data), 4)
    out = []
    for _ in range(n):
        if at >= len(data) or at + 1 + data[at] > len(data):
            break
        name = data[at + 40 : at + 1 + data[at]]
        out.append(name[: len(name) // 2 * 2].decode("utf-16-le", "replace").split("\0")[0])
        at += 1 + data[at]
    return out


def styles(data: bytes) -> list[dict | None]:
    """Styles by their number: type (1 paragraph, 2 character), base, next, name, id, records, and switches with those of the bases."""
    if len(data) < 2:
        return []
    head = data[2 : 2 + u2(data)]
    if len(head) < 4:
        return []
    n, fixed, at = u2(head), u2(head, 2), 2 + u2(data)
    out: list[dict | None] = []
    used: set[str] = set()
    for _ in range(n):
        if at + 2 > len(data):
            break
        size = u2(data, at)
        record, at = data[at + 2 : at + 2 + size], at + 2 + size + size % 2
        one = style(record, fixed) if size and len(record) == size else None
        if one is not None:
            base = "".join(w[:1].upper() + w[1:] for w in re.findall("[A-Za-z0-9]+", one["name"])) or "Style"
            one["id"], k = base, 1
            while one["id"] in used:
                k += 1
                one["id"] = f"{base}{k}"
            used.add(one["id"])
        out.append(one)

    def resolved(i: int, depth: int = 0) -> dict[str, bool]:
        s = out[i] if i < len(out) else None
        if s is None or depth > 16:
            return {}
        if "toggles" not in s:
            s["toggles"] = toggles(s["character"], resolved(s["base"], depth + 1) if s["base"] != NIL else {})
        return s["toggles"]

    for i in range(len(out)):
        resolved(i)
    return out


def style(record: bytes, fixed: int) -> dict | None:
    try:
        a, b, c = struct.unpack_from("<HHH", record)
        size = u2(record, fixed)
        raw = record[fixed + 2 : fixed + 2 + 2 * size]
        if len(raw) < 2 * size:
            return None
        out = {"sti": a & 0xFFF, "type": b & 0xF, "base": b >> 4, "next": c >> 4, "name": raw.decode("utf-16-le", "replace"), "paragraph": b"", "character": b""}
        at = fixed + 2 + 2 * size + 2
        for i in range(c & 0xF):
            at += at % 2
            n = u2(record, at)
            body = record[at + 2 : at + 2 + n]
            if len(body) < n:
                return None
            if out["type"] == 1 and i == 0:
                out["paragraph"] = body[2:]
            elif not out["character"]:
                out["character"] = body
            at += 2 + n
        return out
    except struct.error:
        return None


def level(data: bytes, at: int) -> tuple[dict, int] | None:
    """(list level, where it ends)."""
    try:
        start, kind, flags, follow, nc, np_ = u4(data, at), data[at + 4], data[at + 5], data[at + 15], data[at + 24], data[at + 25]
        p, c, end = data[at + 28 : at + 28 + np_], data[at + 28 + np_ : at + 28 + np_ + nc], at + 28 + np_ + nc
        size = u2(data, end)
        text = struct.unpack_from(f"<{size}H", data, end + 2)
    except (struct.error, IndexError):
        return None
    group = lambda b: next((code >> 10 & 7 for code, _ in records(b)), None)
    if p and group(p) == 2 and group(c) in (1, None):  # some writers put them the other way round
        p, c = c, p
    return {"start": start, "format": kind, "align": flags & 3, "follow": follow, "text": text, "paragraph": p, "character": c}, end + 2 + 2 * size


def lists(data: bytes, overrides: bytes) -> tuple[list[dict], list[dict]]:
    """(lists with id and levels, overrides with the id of their list and levels)."""
    found, over = [], []
    if len(data) >= 2:
        n = u2(data)
        heads = [(u4(data, 2 + 28 * i), data[2 + 28 * i + 26] & 1) for i in range(n) if 2 + 28 * i + 28 <= len(data)]
        at = 2 + 28 * n
        for id_, simple in heads:
            levels = []
            for _ in range(1 if simple else 9):
                one = level(data, at)
                if one is None:
                    break
                levels.append(one[0])
                at = one[1]
            found.append({"id": id_, "levels": levels})
    if len(overrides) >= 4:
        n = u4(overrides)
        heads = [(u4(overrides, 4 + 16 * i), overrides[4 + 16 * i + 12]) for i in range(min(n, len(overrides) // 16))]
        at = 4 + 16 * n
        for id_, count in heads:
            levels = []
            for _ in range(count):
                if at + 8 > len(overrides):
                    break
                start, flags = struct.unpack_from("<II", overrides, at)
                at += 8
                one = level(overrides, at) if flags & 0x20 else None
                at = one[1] if one else at
                levels.append({"level": flags & 0xF, "start": start if flags & 0x10 else None, "own": one[0] if one else None})
            over.append({"id": id_, "levels": levels})
    return found, over


def image(data: bytes, at: int) -> dict | None:
    """The picture at a place of the data stream: bytes, extension, type and size; null for metafiles and what can't be read."""
    try:
        size, head, kind = u4(data, at), u2(data, at + 4), u2(data, at + 6)
        goal_w, goal_h, mx, my = struct.unpack_from("<HHHH", data, at + 28)
    except struct.error:
        return None
    if head < 0x2C or size < head or at + size > len(data) or kind not in (0x64, 0x66):
        return None
    found = blip(data[at + head : at + size])
    emu = lambda goal, share: goal * (share or 1000) // 1000 * 635
    return None if found is None else found | {"width_emu": emu(goal_w, mx), "height_emu": emu(goal_h, my)}


def blip(data: bytes, depth: int = 0) -> dict | None:
    """The first picture in a stream of drawing records."""
    at = 0
    while at + 8 <= len(data) and depth <= 8:
        version, kind, size = struct.unpack_from("<HHI", data, at)
        body = data[at + 8 : at + 8 + size]
        found = None
        if kind in BLIPS:
            extension, media, one = BLIPS[kind]
            raw = body[16 * (1 + (version >> 4 == one + 1)) + 1 :]
            raw = bitmap(raw) if extension == "bmp" else raw
            found = {"bytes": raw, "extension": extension, "type": media} if raw else None
        elif kind == 0xF007 or version & 0xF == 0xF:
            found = blip(body[36:] if kind == 0xF007 else body, depth + 1)
        if found is not None:
            return found
        at += 8 + size
    return None


def bitmap(dib: bytes) -> bytes | None:
    """A bitmap file of a bitmap without its file header."""
    if len(dib) < 40 or u4(dib) < 40 or len(dib) < u4(dib):
        return None
    bits, used = u2(dib, 14), u4(dib, 32)
    palette = used or (1 << bits if bits <= 8 else 0)
    return b"BM" + struct.pack("<III", 14 + len(dib), 0, 14 + u4(dib) + 4 * palette) + dib


def boxes(data: bytes) -> list[tuple[int, int, int]]:
    """(from, to, shape) of the texts of text boxes; the last record only ends the one before."""
    n = (len(data) - 4) // 26
    if n < 2 or (len(data) - 4) % 26:
        return []
    places = struct.unpack_from(f"<{n + 1}I", data)
    out, last = [], 0
    for i in range(n - 1):
        at = 4 * (n + 1) + 22 * i
        if places[i] >= last and places[i + 1] >= places[i] and u2(data, at + 8) == 0:
            out.append((places[i], places[i + 1], u4(data, at + 14)))
        last = places[i + 1]
    return out


# ---- markup


def tag(name: str, **attributes) -> str:
    return f"<{name}" + "".join(f' w:{k.rstrip("_")}="{encode(str(v), True)}"' for k, v in attributes.items() if v is not None) + "/>"


def on_off(name: str, value: bool | None) -> str:
    return "" if value is None else f"<{name}/>" if value else f'<{name} w:val="0"/>'


def border_tag(name: str, b: dict | None) -> str:
    return tag(name, val=b["val"], sz=b["sz"], space=b["space"], color=b["color"] or "auto", shadow="1" if b["shadow"] else None) if b else ""


def shade_tag(s: dict | None) -> str:
    return tag("w:shd", val=s["val"], color=s["color"] or "auto", fill=s["fill"] or "auto") if s else ""


def run_markup(c: dict, faces: list[str], style_id: Callable[[int], str | None]) -> str:
    face = lambda k: faces[c[k]] or None if k in c and c[k] < len(faces) else None
    out = [tag("w:rStyle", val=i) for i in [style_id(c["style"]) if c.get("style", 10) != 10 else None] if i]
    names = {"ascii": face("font_ascii"), "hAnsi": face("font_ascii"), "eastAsia": face("font_east_asia"), "cs": face("font_other")}
    out += [tag("w:rFonts", **names)] if any(names.values()) else []
    out += [on_off(t, c["toggles"].get(t)) for t in TOGGLES.values()] + [on_off("w:dstrike", c.get("double_strike"))]
    color = (ref_color(c["color"]) if "color" in c else None) or index_color(c.get("color_index", 0))
    if color or "color" in c or c.get("color_index") == 0:
        out.append(tag("w:color", val=color or "auto"))
    out += [tag(t, val=c[k]) for t, k in (("w:spacing", "spacing"), ("w:w", "scale"), ("w:kern", "kerning"), ("w:position", "raised"), ("w:sz", "half_points")) if k in c]
    if 1 <= c.get("highlight", 0) <= 16:
        out.append(tag("w:highlight", val=INDEX_HIGHLIGHTS[c["highlight"] - 1]))
    if "underline" in c:
        out.append(tag("w:u", val=UNDERLINES.get(c["underline"], "single")))
    out.append(shade_tag(c.get("shading")))
    if "script" in c:
        out.append(tag("w:vertAlign", val={1: "superscript", 2: "subscript"}.get(c["script"], "baseline")))
    inner = "".join(out)
    return f"<w:rPr>{inner}</w:rPr>" if inner else ""


def paragraph_markup(p: dict, style_id: Callable[[int], str | None], numbers: bool = True) -> str:
    """What stands in a paragraph's properties."""
    sid = style_id(p["style"]) if p["style"] else None
    out = [tag("w:pStyle", val=sid)] if sid else []
    out += [on_off(t, p.get(k)) for t, k in (("w:keepNext", "keep_next"), ("w:keepLines", "keep_lines"), ("w:pageBreakBefore", "page_break_before"), ("w:widowControl", "widow_control"))]
    if numbers and p.get("list"):
        out.append(f"<w:numPr>{tag('w:ilvl', val=p.get('level', 0))}{tag('w:numId', val=p['list'])}</w:numPr>")
    edges = "".join(border_tag(f"w:{k.partition('_')[0]}", p.get(k)) for k in ("top", "left_border", "bottom", "right_border", "between"))
    out += [f"<w:pBdr>{edges}</w:pBdr>" if edges else "", shade_tag(p.get("shading"))]
    stops = "".join([tag("w:tab", val="clear", pos=x) for x in p["cleared"]] + [tag("w:tab", val=TAB_ALIGNS.get(a, "left"), leader=LEADERS.get(lead), pos=x) for x, a, lead in p["tabs"]])
    out += [f"<w:tabs>{stops}</w:tabs>" if stops else "", on_off("w:bidi", p.get("bidi"))]
    line = p.get("line")
    spacing = {"before": p.get("before"), "beforeAutospacing": "1" if p.get("before_auto") else None, "after": p.get("after"), "afterAutospacing": "1" if p.get("after_auto") else None}
    if line:
        spacing |= {"line": abs(line[0]), "lineRule": "auto" if line[1] else "atLeast" if line[0] >= 0 else "exact"}
    out.append(tag("w:spacing", **spacing) if any(v is not None for v in spacing.values()) else "")
    first = p.get("first")
    indent = {"left": p.get("left"), "right": p.get("right"), "firstLine": first if first is not None and first >= 0 else None, "hanging": -first if first is not None and first < 0 else None}
    out.append(tag("w:ind", **indent) if any(v is not None for v in indent.values()) else "")
    out += ["<w:contextualSpacing/>" if p.get("contextual") else "", tag("w:jc", val=ALIGNS.get(p["align"], "left")) if "align" in p else "", tag("w:outlineLvl", val=p["outline"]) if p.get("outline", 9) < 9 else ""]
    return "".join(out)


def section_markup(s: dict) -> str:
    out = [tag("w:type", val=BREAKS[s["break"]]) if s["break"] in BREAKS else "", tag("w:pgSz", w=s["width"], h=s["height"], orient="landscape" if s["orientation"] == 2 else None)]
    out.append(tag("w:pgMar", **{k: s[k] for k in ("top", "right", "bottom", "left", "header", "footer", "gutter")}))
    if "page_format" in s or s["restart"]:
        out.append(tag("w:pgNumType", fmt=NUMBER_FORMATS.get(s["page_format"], "decimal") if "page_format" in s else None, start=s["page_start"] if s["restart"] else None))
    if s["more_columns"]:
        widths = "" if s["even_columns"] else "".join(tag("w:col", w=w, space=s["column_gap"]) for w in s["widths"])
        head = f'<w:cols w:num="{s["more_columns"] + 1}" w:space="{s["column_gap"]}"'
        out.append(f'{head} w:equalWidth="0">{widths}</w:cols>' if widths else f"{head}/>")
    out.append("<w:titlePg/>" if s["title_page"] else "")
    if s["grid"] or s["line_pitch"]:
        out.append(tag("w:docGrid", type=GRIDS.get(s["grid"], "default"), linePitch=s["line_pitch"] or None))
    return f"<w:sectPr>{''.join(out)}</w:sectPr>"


def styles_markup(found: list[dict | None], faces: list[str]) -> str:
    id_of = lambda i: s["id"] if i != NIL and i < len(found) and (s := found[i]) else None
    out = ["<w:docDefaults><w:rPrDefault><w:rPr><w:sz w:val=\"20\"/></w:rPr></w:rPrDefault><w:pPrDefault/></w:docDefaults>"]
    for i, s in enumerate(found):
        if s is None or s["type"] not in (1, 2):
            continue
        base = (found[s["base"]] or {}).get("toggles", {}) if s["base"] != NIL and s["base"] < len(found) else {}
        ppr = paragraph_markup(paragraph(s["paragraph"]), lambda _: None) if s["type"] == 1 and s["paragraph"] else ""
        default = ' w:default="1"' if s["sti"] in (0, 65) else ""
        follow = tag("w:next", val=id_of(s["next"])) if s["next"] != i and id_of(s["next"]) else ""
        out.append(
            f'<w:style w:type="{"paragraph" if s["type"] == 1 else "character"}" w:styleId="{encode(s["id"], True)}"{default}>{tag("w:name", val=s["name"])}{tag("w:basedOn", val=id_of(s["base"])) if id_of(s["base"]) else ""}{follow}'
            f'{f"<w:pPr>{ppr}</w:pPr>" if ppr else ""}{run_markup(character(s["character"], base), faces, lambda _: None) if s["character"] else ""}</w:style>'
        )
    return "<w:styles>" + "".join(out) + "</w:styles>"


def level_markup(i: int, one: dict, faces: list[str]) -> str:
    # A character below nine stands for the number of that level.
    text = "".join(f"%{u + 1}" if u < 9 else chr(u) for u in one["text"])
    kind = "none" if one["format"] == 255 else NUMBER_FORMATS.get(one["format"], "decimal")
    ppr = paragraph_markup(paragraph(one["paragraph"]), lambda _: None, False)
    suffix = {1: "space", 2: "nothing"}.get(one["follow"])
    return (
        f'<w:lvl w:ilvl="{i}">{tag("w:start", val=one["start"])}{tag("w:numFmt", val=kind)}{tag("w:suff", val=suffix) if suffix else ""}{tag("w:lvlText", val=text)}{tag("w:lvlJc", val={1: "center", 2: "right"}.get(one["align"], "left"))}'
        f'{f"<w:pPr>{ppr}</w:pPr>" if ppr else ""}{run_markup(character(one["character"]), faces, lambda _: None)}</w:lvl>'
    )


def numbering_markup(found: list[dict], over: list[dict], faces: list[str]) -> str:
    place = {one["id"]: i for i, one in reversed(list(enumerate(found)))}
    out = [f'<w:abstractNum w:abstractNumId="{i}">{"".join(level_markup(k, x, faces) for k, x in enumerate(one["levels"]))}</w:abstractNum>' for i, one in enumerate(found)]
    for i, o in enumerate(over, 1):
        if o["id"] in place:
            own = "".join(f'<w:lvlOverride w:ilvl="{x["level"]}">{tag("w:startOverride", val=x["start"]) if x["start"] is not None else ""}{level_markup(x["level"], x["own"], faces) if x["own"] else ""}</w:lvlOverride>' for x in o["levels"])
            out.append(f'<w:num w:numId="{i}">{tag("w:abstractNumId", val=place[o["id"]])}{own}</w:num>')
    return "<w:numbering>" + "".join(out) + "</w:numbering>"


def table_markup(rows: list[tuple[dict, list[str]]]) -> str:
    """rows: (row properties, markup of each cell). The grid is the union of the rows' edges."""
    edges = sorted({e for row, _ in rows for c in row["cells"] for e in (c["left"], c["right"])})
    at = {e: i for i, e in enumerate(edges)}
    top = rows[0][0]
    sides = "".join(border_tag(t, b) for t, b in zip(("w:top", "w:left", "w:bottom", "w:right", "w:insideH", "w:insideV"), top["borders"], strict=True))
    align = {1: "center", 2: "right"}.get(top["align"])
    out = [f'<w:tbl><w:tblPr>{tag("w:jc", val=align) if align else ""}{f"<w:tblBorders>{sides}</w:tblBorders>" if sides else ""}</w:tblPr><w:tblGrid>{"".join(tag("w:gridCol", w=b - a) for a, b in zip(edges, edges[1:], strict=False))}</w:tblGrid>']
    for row, cells in rows:
        height = tag("w:trHeight", val=abs(row["height"]), hRule="exact" if row["height"] < 0 else "atLeast") if row["height"] else ""
        props = ("<w:cantSplit/>" if row["cant_split"] else "") + ("<w:tblHeader/>" if row["header"] else "") + height
        out.append("<w:tr>" + (f"<w:trPr>{props}</w:trPr>" if props else ""))
        shapes = row["cells"] or [None] * len(cells)
        i = 0
        while i < max(len(cells), len(row["cells"])):
            c, last = (shapes[i] if i < len(shapes) else None), i
            while c is not None and c["first_merged"] and last + 1 < len(shapes) and shapes[last + 1]["merged"]:
                last += 1  # cells merged to one
            tc = ""
            if c is not None:
                right = shapes[last]["right"]
                span = at[right] - at[c["left"]]
                own = "".join(border_tag(f"w:{s}", b) for s, b in c["borders"].items())
                merge = '<w:vMerge w:val="restart"/>' if c["v_restart"] else "<w:vMerge/>" if c["v_merge"] else ""
                tc = tag("w:tcW", w=right - c["left"], type="dxa") + (tag("w:gridSpan", val=span) if span > 1 else "") + merge + (f"<w:tcBorders>{own}</w:tcBorders>" if own else "") + shade_tag(c["shading"])
                tc += tag("w:vAlign", val={1: "center", 2: "bottom"}[c["v_align"]]) if c["v_align"] in (1, 2) else ""
            body = "".join(cells[i : last + 1]) or "<w:p/>"
            out.append(f"<w:tc><w:tcPr>{tc}</w:tcPr>{body}</w:tc>")
            i = last + 1
        out.append("</w:tr>")
    return "".join(out) + "</w:tbl>"


# ---- a document


class Document:
    """Streams, pieces and property tables of a legacy document."""

    def __init__(self, streams: dict[str, bytes]):
        self.word = word = streams["WordDocument"]
        if u2(word) != 0xA5EC:
            raise ValueError("not a legacy document")
        if u2(word, 2) < 0xC1:
            raise ValueError("a document older than the format")
        if u2(word, 10) & 0x100:
            raise ValueError("an encrypted document")
        self.table = streams["1Table" if u2(word, 10) & 0x200 else "0Table"]
        self.data = streams.get("Data", b"")
        at = 0x22 + 2 * u2(word, 0x20)
        self.counts = struct.unpack_from("<8I", word, at + 2 + 12)
        pairs = at + 2 + 4 * u2(word, at)
        self.pairs = [struct.unpack_from("<II", word, pairs + 2 + 8 * i) for i in range(u2(word, pairs)) if pairs + 10 + 8 * i <= len(word)]
        self.pieces, self.extra = self._pieces()
        self.starts = [p[0] for p in self.pieces]
        self.faces = fonts(self.part(FONTS))
        self.styles = styles(self.part(STYLES))
        self.pages: dict[tuple[int, bool], list] = {}
        self.character_bins, self.paragraph_bins = bins(self.part(CHARACTERS)), bins(self.part(PARAGRAPHS))

    def part(self, number: int) -> bytes:
        at, size = self.pairs[number] if number < len(self.pairs) else (0, 0)
        return self.table[at : at + size]

    def _pieces(self) -> tuple[list[tuple[int, int, int, int, int]], list[bytes]]:
        """((from, to, place in the stream, bytes a character, its record), the records of all)."""
        clx, k, extra = self.part(PIECES), 0, []
        while k < len(clx) and clx[k] == 1:
            extra.append(clx[k + 3 : k + 3 + u2(clx, k + 1)])
            k += 3 + u2(clx, k + 1)
        if k >= len(clx) or clx[k] != 2:
            raise ValueError("no piece table")
        n = (u4(clx, k + 1) - 4) // 12
        places, out = struct.unpack_from(f"<{n + 1}I", clx, k + 5), []
        for i in range(n):
            fc, prm = struct.unpack_from("<IH", clx, k + 5 + 4 * (n + 1) + 8 * i + 2)
            narrow = bool(fc & 0x40000000)
            out.append((places[i], places[i + 1], (fc & 0x3FFFFFFF) // 2 if narrow else fc, 1 if narrow else 2, prm))
        return out, extra

    def text(self, start: int = 0, end: int | None = None) -> str:
        out = []
        for a, b, fc, width, _ in self.pieces:
            a2, b2 = max(a, start), b if end is None else min(b, end)
            if a2 < b2:
                raw = self.word[fc + (a2 - a) * width : fc + (b2 - a) * width]
                out.append(raw.decode("cp1252" if width == 1 else "utf-16-le", "replace").ljust(b2 - a2, "�")[: b2 - a2] if width == 1 else "".join(chr(c) for c in struct.unpack(f"<{len(raw) // 2}H", raw[: len(raw) // 2 * 2])))
        return "".join(out)

    def place(self, cp: int) -> int | None:
        """Where a character stands in the stream."""
        i = bisect_right(self.starts, cp) - 1
        if i < 0 or cp >= self.pieces[i][1]:
            return None
        return self.pieces[i][2] + (cp - self.pieces[i][0]) * self.pieces[i][3]

    def runs_of_page(self, page: int, paragraphs: bool) -> list:
        key = (page, paragraphs)
        if key not in self.pages:
            self.pages[key] = page_runs(self.word, page, paragraphs)
        return self.pages[key]

    def character_runs(self) -> list[tuple[int, int, bytes]]:
        """(from, to, records) of runs with properties, by place in the text; a piece's own records come last."""
        out = []
        for a, b, fc, width, prm in self.pieces:
            end = fc + (b - a) * width
            more = self.extra[prm >> 1] if prm & 1 and prm >> 1 < len(self.extra) else b""
            for lo, hi, page in self.character_bins:
                if hi <= fc or lo >= end:
                    continue
                for s, e, _, data in self.runs_of_page(page, False):
                    s, e = max(s, fc), min(e, end)
                    if s < e:
                        out.append((a + (s - fc) // width, a + -(-(e - fc) // width), data + more))
        return sorted(out, key=lambda r: r[0])

    def paragraph_at(self, cp: int) -> dict:
        fc = self.place(cp)
        page = next((p for s, e, p in self.paragraph_bins if fc is not None and s <= fc < e), self.paragraph_bins[-1][2] if self.paragraph_bins else None)
        runs = self.runs_of_page(page, True) if page is not None else []
        run = next((r for r in runs if fc is not None and r[0] <= fc < r[1]), runs[-1] if runs else None)
        if run is None:
            return paragraph(b"")
        data = run[3]
        huge = next((u4(padded(o, 4)) for code, o in records(data) if code == 0x6646), None)
        if huge is not None and huge + 2 <= len(self.data):
            data = self.data[huge + 2 : huge + 2 + u2(self.data, huge)]
        return paragraph(data, run[2])

    def style_id(self, number: int) -> str | None:
        return s["id"] if number < len(self.styles) and (s := self.styles[number]) else None

    def style_toggles(self, *numbers: int | None) -> dict[str, bool]:
        out: dict[str, bool] = {}
        for n in numbers:
            if n is not None and n < len(self.styles) and self.styles[n]:
                out |= self.styles[n]["toggles"]
        return out

    def section_ends(self) -> list[tuple[int, dict]]:
        """(where it ends, properties) of each section."""
        plc = self.part(SECTIONS)
        n = (len(plc) - 4) // 16
        out = []
        for i in range(n):
            end, at = u4(plc, 4 * i + 4), u4(plc, 4 * (n + 1) + 12 * i + 2)
            data = self.word[at + 2 : at + 2 + u2(self.word, at)] if at + 2 <= len(self.word) else b""
            out.append((end, section(data)))
        return out

    def images(self) -> list[dict]:
        """Pictures in the text, by place."""
        out = []
        for s, _, data in self.character_runs():
            c = character(data)
            found = image(self.data, c["picture"]) if c.get("special") and "picture" in c and not c.get("data") else None
            if found is not None:
                out.append({"place": s, **found})
        return out

    def box_texts(self) -> list[tuple[int, str]]:
        """(shape, text) of text boxes of the main text."""
        base = sum(self.counts[:6])
        return [(shape, self.text(base + a, base + b).rstrip("\r")) for a, b, shape in boxes(self.part(BOXES))]

    def body(self) -> str:
        """The main text as markup: paragraphs with runs, tables, sections."""
        text = self.text(0, self.counts[0])
        runs = self.character_runs()
        starts = [r[0] for r in runs]
        sections = self.section_ends()
        out: list[str] = []
        rows: list[tuple[dict, list[str]]] = []
        cells: list[str] = []
        cell: list[str] = []
        hidden: list[bool] = []

        def pieces(a: int, b: int, style: int) -> str:
            parts, at = [], a
            while at < b:
                i = bisect_right(starts, at) - 1
                inside = i >= 0 and at < runs[i][1]
                end = min(b, runs[i][1] if inside else runs[i + 1][0] if i + 1 < len(runs) else b)
                data = runs[i][2] if inside else b""
                own = next((u2(padded(o, 2)) for code, o in records(data) if code == 0x4A30), None)
                props = character(data, self.style_toggles(style, own))
                inner, shown = [], ""

                def flush(inner=inner):
                    nonlocal shown
                    if shown:
                        inner.append(f'<w:t xml:space="preserve">{encode(shown)}</w:t>')
                        shown = ""

                for c in text[at:end]:
                    if c == "\x13":
                        hidden.append(True)
                    elif c == "\x14" and hidden:
                        hidden[-1] = False
                    elif c == "\x15" and hidden:
                        hidden.pop()
                    elif any(hidden):
                        continue
                    elif c in "\t\x0b\x0c":
                        flush()
                        inner.append({"\t": "<w:tab/>", "\x0b": "<w:br/>", "\x0c": '<w:br w:type="page"/>'}[c])
                    elif c >= " " and not (props.get("special") and "picture" in props):
                        shown += c
                flush()
                if inner:
                    parts.append(f"<w:r>{run_markup(props, self.faces, self.style_id)}{''.join(inner)}</w:r>")
                at = end
            return "".join(parts)

        def close_table() -> None:
            nonlocal cells, cell
            if cell or cells:  # a table without its last row mark
                rows.append((table_row(b""), cells + (["".join(cell)] if cell else [])))
                cells, cell = [], []
            if rows:
                out.append(table_markup(rows))
                rows.clear()

        at, ended = 0, 0
        for m in re.finditer("[\r\x07\x0c]|$", text):
            end = m.start()
            mark = m.group()
            if not mark and end == at:
                break
            section_end = ended < len(sections) - 1 and end + 1 == sections[ended][0]
            if mark == "\x0c" and not section_end:
                continue  # a page break inside its paragraph
            p = self.paragraph_at(end if mark else max(0, end - 1))
            ppr = paragraph_markup(p, self.style_id)
            if section_end:
                ppr += section_markup(sections[ended][1])
                ended += 1
            one = f"<w:p>{f'<w:pPr>{ppr}</w:pPr>' if ppr else ''}{pieces(at, end, p['style'])}</w:p>"
            at = end + 1
            if p.get("in_table") or p.get("depth"):
                if p.get("row_end"):
                    rows.append((table_row(p["table"]), cells + ([*cell] if cell else [])))
                    cells, cell = [], []
                else:
                    cell.append(one)
                    if mark == "\x07":
                        cells.append("".join(cell))
                        cell = []
            else:
                close_table()
                out.append(one)
        close_table()
        return "".join(out) + section_markup(sections[-1][1] if sections else section(b""))

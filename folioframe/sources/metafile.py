"""Enhanced metafiles as vector pictures: paths, polygons, solid pens and brushes, clipping by a path.

The published format is a list of records (type, size, body). A metafile with a record that is neither drawn here nor
without effect on what is drawn gives no picture, rather than a wrong one.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from urllib.parse import quote

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Records that change nothing that is drawn here: modes, text and background settings, comments (fixed values).
SILENT = {13, 17, 18, 20, 21, 22, 24, 25, 28, 58, 70, 98}
#: Colours of the stock brushes 0 to 4 and stock pens 6 and 7 (fixed values).
STOCK_BRUSHES, STOCK_PENS = (0xFFFFFF, 0xC0C0C0, 0x808080, 0x404040, 0), {6: 0xFFFFFF, 7: 0}
STOCK = 0x80000000


class Unsupported(Exception):
    pass


def shown(x: float) -> str:
    """A coordinate to two places, without a point where it is whole."""
    r = (1 if x >= 0 else -1) * int(abs(x) * 100 + 0.5) / 100
    return str(int(r)) if r == int(r) else repr(r)


def css(color: int) -> str:
    return f"#{color & 0xFF:02x}{color >> 8 & 0xFF:02x}{color >> 16 & 0xFF:02x}"


class Drawing:
    """State of a device: how points are mapped, what is selected, the path being built, and what has been drawn."""

    def __init__(self) -> None:
        self.map = {"window": (0.0, 0.0), "window_size": (1.0, 1.0), "view": (0.0, 0.0), "view_size": (1.0, 1.0)}
        self.objects: dict[int, tuple[str, int | None, float]] = {}
        self.brush: int | None = 0xFFFFFF
        self.pen: tuple[int, float] | None = (0, 1.0)
        self.rule = "evenodd"
        self.open: list[str] | None = None  # the path being built
        self.path: str | None = None  # the path that was built last
        self.clips: list[str] = []
        self.clip: int | None = None
        self.out: list[str] = []

    def scale(self, axis: int) -> float:
        size = self.map["window_size"][axis]
        return self.map["view_size"][axis] / size if size else 1.0

    def point(self, x: float, y: float) -> tuple[float, float]:
        return tuple((v - self.map["window"][i]) * self.scale(i) + self.map["view"][i] for i, v in enumerate((x, y)))

    def add(self, steps: str) -> None:
        if self.open is None:
            raise Unsupported
        self.open.append(steps)

    def draw(self, steps: str, fill: bool, stroke: bool) -> None:
        if not steps:
            return
        inside = f'fill="{css(self.brush) if self.brush is not None else "none"}" fill-rule="{self.rule}"' if fill else 'fill="none"'
        line = 'stroke="none"'
        if stroke and self.pen is not None:
            line = f'stroke="{css(self.pen[0])}" stroke-width="{shown(max(0.25, abs(self.pen[1] * self.scale(0))))}"'
        one = f'<path d="{steps}" {inside} {line}/>'
        self.out.append(one if self.clip is None else f'<g clip-path="url(#c{self.clip})">{one}</g>')


def step(letter: str, *points: tuple[float, float]) -> str:
    return letter + " ".join(f"{shown(x)} {shown(y)}" for x, y in points)


def lines(points: list, close: bool) -> str:
    return "".join(step("L" if i else "M", p) for i, p in enumerate(points)) + ("Z" if close and points else "")


def curves(points: list) -> str:
    if len(points) % 3:
        raise Unsupported
    return "".join(step("C", *points[i : i + 3]) for i in range(0, len(points), 3))


def points_of(d: Drawing, body: bytes, at: int, n: int) -> list[tuple[float, float]]:
    raw = struct.unpack_from(f"<{2 * n}h", body, at)
    return [d.point(*raw[i : i + 2]) for i in range(0, 2 * n, 2)]


def one_list(d: Drawing, body: bytes) -> list[tuple[float, float]]:
    return points_of(d, body, 20, struct.unpack_from("<I", body, 16)[0])


def shape(d: Drawing, steps: str, fill: bool) -> None:
    """Adds to the path that is open, else draws at once."""
    if d.open is not None:
        d.add(steps)
    else:
        d.draw(steps, fill, not fill or d.pen is not None)


def many(close: bool) -> Callable[[Drawing, bytes], None]:
    def handle(d: Drawing, body: bytes) -> None:
        n, total = struct.unpack_from("<II", body, 16)
        sizes = struct.unpack_from(f"<{n}I", body, 24)
        if sum(sizes) != total:
            raise Unsupported
        at, steps = 24 + 4 * n, []
        for size in sizes:
            steps.append(lines(points_of(d, body, at, size), close))
            at += 4 * size
        shape(d, "".join(steps), close)

    return handle


def to_map(key: str) -> Callable[[Drawing, bytes], None]:
    return lambda d, body: d.map.__setitem__(key, tuple(map(float, struct.unpack_from("<ii", body))))


def brush(d: Drawing, body: bytes) -> None:
    handle, style, color = struct.unpack_from("<III", body)
    d.objects[handle] = ("brush", None if style == 1 else color, 0.0)


def pen(color_at: int, style_at: int, width_at: int) -> Callable[[Drawing, bytes], None]:
    def handle(d: Drawing, body: bytes) -> None:
        number, style, color = (struct.unpack_from("<I", body, k)[0] for k in (0, style_at, color_at))
        d.objects[number] = ("pen", None if style & 0xFF == 5 else color, max(1.0, float(struct.unpack_from("<i", body, width_at)[0])))

    return handle


def select(d: Drawing, body: bytes) -> None:
    n = struct.unpack_from("<I", body)[0]
    if n & STOCK:
        n &= ~STOCK
        if n <= 5:
            d.brush = STOCK_BRUSHES[n] if n < 5 else None
        elif n in (6, 7, 8):
            d.pen = (STOCK_PENS[n], 1.0) if n != 8 else None
    elif n in d.objects:
        kind, color, width = d.objects[n]
        if kind == "brush":
            d.brush = color
        else:
            d.pen = None if color is None else (color, width)


def end_path(d: Drawing, _: bytes) -> None:
    d.path, d.open = "".join(d.open or []), None


def close_figure(d: Drawing, _: bytes) -> None:
    if d.open is not None:
        d.add("Z")


def move(d: Drawing, body: bytes) -> None:
    if d.open is not None:
        d.add(step("M", d.point(*struct.unpack_from("<ii", body))))


def on_path(make: Callable[[list], str]) -> Callable[[Drawing, bytes], None]:
    def handle(d: Drawing, body: bytes) -> None:
        points = one_list(d, body)
        if points:
            d.add(make(points))

    return handle


def alone(make: Callable[[list], str], fill: bool) -> Callable[[Drawing, bytes], None]:
    def handle(d: Drawing, body: bytes) -> None:
        points = one_list(d, body)
        if points:
            shape(d, make(points), fill)

    return handle


def clip_path(d: Drawing, _: bytes) -> None:
    if d.path is None:
        raise Unsupported
    d.clip = len(d.clips)
    d.clips.append(f'<clipPath id="c{d.clip}" clip-rule="{d.rule}"><path d="{d.path}"/></clipPath>')


def clip_region(d: Drawing, body: bytes) -> None:
    """A region that is reset, or one rectangle, clips nothing."""
    size, mode = struct.unpack_from("<II", body)
    if mode != 5 or (size and len(body) >= 20 and struct.unpack_from("<I", body, 16)[0] > 1):
        raise Unsupported
    d.clip = None


def set_rule(d: Drawing, body: bytes) -> None:
    d.rule = "nonzero" if struct.unpack_from("<I", body)[0] == 2 else "evenodd"


#: What a record does, by its type.
HANDLERS: dict[int, Callable[[Drawing, bytes], None]] = {
    9: to_map("window_size"), 10: to_map("window"), 11: to_map("view_size"), 12: to_map("view"), 19: set_rule, 27: move, 37: select, 38: pen(16, 4, 8), 39: brush, 40: lambda d, body: d.objects.pop(struct.unpack_from("<I", body)[0], None),
    54: lambda d, body: d.add(step("L", d.point(*struct.unpack_from("<ii", body)))), 59: lambda d, _: setattr(d, "open", []), 60: end_path, 61: close_figure, 62: lambda d, _: d.draw(d.path or "", True, False), 63: lambda d, _: d.draw(d.path or "", True, True),
    64: lambda d, _: d.draw(d.path or "", False, True), 67: clip_path, 75: clip_region, 85: alone(lambda p: step("M", p[0]) + curves(p[1:]), False), 86: alone(lambda p: lines(p, True), True), 87: alone(lambda p: lines(p, False), False), 88: on_path(curves),
    89: on_path(lambda p: "".join(step("L", q) for q in p)), 90: many(False), 91: many(True), 95: pen(32, 20, 24),
}


def records(data: bytes) -> Iterator[tuple[int, bytes]]:
    at = struct.unpack_from("<I", data, 4)[0]
    while at + 8 <= len(data):
        kind, size = struct.unpack_from("<II", data, at)
        if size < 8 or at + size > len(data):
            raise Unsupported
        if kind == 14:
            return
        yield kind, data[at + 8 : at + size]
        at += size


def to_svg(data: bytes | None) -> str | None:
    """The metafile as a vector picture; null where it can't be drawn as it is meant."""
    if not data or len(data) < 88 or struct.unpack_from("<I", data)[0] != 1:
        return None
    left, top, right, bottom = struct.unpack_from("<4i", data, 8)
    if right <= left or bottom <= top:
        return None
    d = Drawing()
    try:
        for kind, body in records(data):
            if kind in HANDLERS:
                HANDLERS[kind](d, body)
            elif kind not in SILENT:
                return None
    except (Unsupported, struct.error):
        return None
    defs = f"<defs>{''.join(d.clips)}</defs>" if d.clips else ""
    w, h = right - left, bottom - top
    return f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="{left} {top} {w} {h}" width="{w}" height="{h}" preserveAspectRatio="xMidYMid meet">{defs}{"".join(d.out)}</svg>'


def svg_uri(svg: str | None) -> str | None:
    return None if svg is None else "data:image/svg+xml;charset=utf-8," + quote(svg, safe="-_.~")


def picture_uri(content: Column) -> Column:
    """A data URI of the vector picture that a metafile's bytes draw; null for others. (Raster copies are never made.)"""

    @F.pandas_udf("string")
    def convert(values: pd.Series) -> pd.Series:
        return values.map(lambda v: svg_uri(to_svg(bytes(v) if v is not None else None)))

    return convert(content)

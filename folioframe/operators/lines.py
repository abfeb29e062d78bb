"""Line breaking at given character widths, around rectangles that exclude text."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Row parts narrower than this hold no text.
LEAST = 0.5


def row_parts(container: float, top: float, height: float, exclusions: list[tuple[float, float, float, float]]) -> list[tuple[float, float]]:
    """(x, width) of what the rectangles (x, y, width, height) leave of a row, from left to right."""
    cuts = sorted((max(0.0, x), min(container, x + w)) for x, y, w, h in exclusions if y < top + height and y + h > top and x < container and x + w > 0)
    out, at = [], 0.0
    for a, b in cuts:
        if a - at > LEAST:
            out.append((at, a - at))
        at = max(at, b)
    if container - at > LEAST:
        out.append((at, container - at))
    return out


def break_lines(text: str, container: float, line_height: float, widths: dict[str, float], default: float, exclusions: list[tuple] = ()) -> list[tuple[int, int, float, float]]:
    """(start, end, x, y) of each line part: words go on a part while they fit, a word wider than a whole row is cut, a line
    feed ends a line. Spaces at a line's end take no room. Rows that are all excluded are passed over."""
    wide = lambda s: sum(widths.get(c, default) for c in s)
    out, y, parts = [], 0.0, []
    last = max((e[1] + e[3] for e in exclusions), default=0.0)

    def next_part() -> tuple[float, float]:
        nonlocal y, parts
        while not parts:
            parts = row_parts(container, y, line_height, list(exclusions))
            if not parts:
                if y > last:
                    parts = [(0.0, container)]
                    break
                y += line_height
        return parts.pop(0)

    def end_row() -> None:
        nonlocal y, parts
        if not parts:
            y += line_height

    for m in re.finditer(r"[^\n]*(?:\n|$)", text):
        if m.start() == m.end() and m.start() > 0 and text[m.start() - 1 : m.start()] != "\n":
            continue
        start, line = m.start(), m.group().rstrip("\n")
        end_of = start + len(line)
        if not line:
            x, _ = next_part()
            out.append((start, start, x, y))
            end_row()
            continue
        while start < end_of:
            x, room = next_part()
            at, used, fit = start, 0.0, start
            for w in re.finditer(r"\s*\S+|\s+$", text[start:end_of]):
                used += wide(w.group() if used or not w.group().isspace() else "")
                if used > room + 1e-9:
                    break
                fit = start + w.end()
            if fit == at:
                if room < container - LEAST and (parts or exclusions and y <= last):
                    end_row()  # a narrow part: the word goes further
                    continue
                used = 0.0
                while fit < end_of and (fit == at or used + wide(text[fit]) <= room):
                    used += wide(text[fit])
                    fit += 1
            out.append((at, fit, x, y))
            start = fit
            end_row()
        parts = []
        y = (out[-1][3] if out else y) + line_height
    return out


def line_counts(texts: DataFrame, text: str, container: str, widths: dict[str, float], default: float) -> DataFrame:
    """texts with ``lines``, by one streaming pass."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema)

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(lines=[len(break_lines(t or "", w, 1.0, widths, default)) for t, w in zip(frame[text], frame[container], strict=True)])

    return texts.mapInPandas(count, f"{schema}, lines long")


def estimated_lines(length: Column, average: float, container: Column) -> Column:
    """Lines of a text by its length and an average width: one at least."""
    return F.greatest(F.ceil(length * average / container), F.lit(1))

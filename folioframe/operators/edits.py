"""Edits of documents: texts over runs, revisions, comments, cell texts, styles."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.render import safe_text_patch
from ..sources.xmltree import encode, parse

RESULT = "ok boolean, reason string, xml string"


# ---- texts over runs


def distribute(text: str, runs: list[dict]) -> list[dict]:
    """A paragraph's new text over its runs: what the old and new text share at both ends keeps its runs, what is between
    takes the style of the run before it, else of the one behind; neighbours alike are merged."""
    old = "".join(r["text"] for r in runs)
    head = 0
    while head < min(len(old), len(text)) and old[head] == text[head]:
        head += 1
    tail = 0
    while tail < min(len(old), len(text)) - head and old[-1 - tail] == text[-1 - tail]:
        tail += 1
    out, at, placed, middle = [], 0, False, text[head : len(text) - tail]
    for r in runs:
        start, end = at, at + len(r["text"])
        left, right = old[start : min(end, head)] if start < head else "", old[max(start, len(old) - tail) : end] if end > len(old) - tail else ""
        piece = left
        if not placed and end >= head and (start < head or head == 0):
            piece, placed = piece + middle, True
        out.append({**r, "text": piece + right})
        at = end
    if not placed:
        out.append({"style": None, "text": middle})
    merged: list[dict] = []
    for r in out:
        if not r["text"]:
            continue
        if merged and {k: v for k, v in merged[-1].items() if k != "text"} == {k: v for k, v in r.items() if k != "text"}:
            merged[-1] = {**merged[-1], "text": merged[-1]["text"] + r["text"]}
        else:
            merged.append(r)
    return merged or [{**(runs[0] if runs else {"style": None}), "text": ""}]


def update_texts(runs: DataFrame, texts: DataFrame) -> DataFrame:
    """runs: doc_id, node_index, run_index, text, style (string key); texts: doc_id, node_index, text. Paragraphs with a new text
    that differs get their runs dealt anew, the others stay."""
    changed = runs.join(texts.select("doc_id", "node_index", F.col("text").alias("new_text")), ["doc_id", "node_index"])
    schema = runs.select("doc_id", "node_index", "run_index", "text", "style").schema

    def deal(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("run_index")
        new = distribute(frame["new_text"].iloc[0], frame[["style", "text"]].to_dict("records"))
        return pd.DataFrame({"doc_id": frame["doc_id"].iloc[0], "node_index": frame["node_index"].iloc[0], "run_index": range(len(new)), "text": [r["text"] for r in new], "style": [r["style"] for r in new]})

    dealt = changed.groupBy("doc_id", "node_index").applyInPandas(deal, schema)
    return runs.select(schema.names).join(texts, ["doc_id", "node_index"], "left_anti").unionByName(dealt)


def cell_texts(cells: DataFrame, id_cols: list[str], text: str, paragraphs: str) -> DataFrame:
    """A cell's new text over its paragraphs: one line each, the last takes what is left, lines that are missing are empty.
    paragraphs: the column with their number."""
    lines = F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n", -1)
    place = F.explode(F.sequence(F.lit(0), F.greatest(F.col(paragraphs) - 1, F.lit(0)))).alias("paragraph")
    each = cells.select(*id_cols, lines.alias("__l"), F.col(paragraphs).alias("__n"), place)
    rest = F.array_join(F.slice("__l", F.col("paragraph") + 1, F.greatest(F.size("__l") - F.col("paragraph"), F.lit(0))), "\n")
    own = F.when(F.col("paragraph") == F.col("__n") - 1, rest).otherwise(F.coalesce(F.get("__l", F.col("paragraph")), F.lit("")))
    return each.select(*id_cols, "paragraph", own.alias("text"))


# ---- styles, native


def with_field(style: Column, name: str, value: Column, where: Column) -> Column:
    return F.when(where, style.withField(name, value)).otherwise(style)


def toggle_flag(style: Column, name: str, where: Column) -> Column:
    """A switch of a style turned over (null counts as off)."""
    return with_field(style, name, ~F.coalesce(style[name], F.lit(False)), where)


# ---- revisions


def resolve_revision(xml: str | None, revision: str, accept: bool) -> tuple[bool, str | None, str | None]:
    """A paragraph's markup with one insertion or deletion (by id) accepted or rejected: (ok, reason, markup). The reason is
    stale where the revision isn't there, unsupported for other kinds of changes, unsafe-xml for markup that doesn't close."""
    root = parse(xml or "")
    hits = [n for n in root.walk("w:ins", "w:del", "w:moveFrom", "w:moveTo", "w:rPrChange", "w:pPrChange") if n.get("id") == revision]
    if not hits:
        return False, "stale", xml
    n = hits[0]
    if len(hits) > 1 or n.name not in ("w:ins", "w:del"):
        return False, "unsupported", xml
    if n.end > len(xml) or (not n.xml.endswith("/>") and not n.xml.endswith(f"</{n.name}>")):
        return False, "unsafe-xml", xml
    inner = n.xml[n.xml.index(">") + 1 : n.xml.rfind("</")] if n.xml.endswith(f"</{n.name}>") else ""
    keep = (n.name == "w:ins") == accept
    if keep and n.name == "w:del":
        inner = inner.replace("<w:delText", "<w:t").replace("</w:delText>", "</w:t>")
    return True, None, xml[: n.start] + (inner if keep else "") + xml[n.end :]


def per_row(rows: DataFrame, apply: Callable[..., tuple], *columns: str) -> DataFrame:
    """rows with ok, reason and xml that a Python function gives for the columns."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name not in ("ok", "reason", "xml"))
    keep = [c for c in rows.columns if c not in ("ok", "reason", "xml")]

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [apply(*values) for values in zip(*(frame[c] for c in columns), strict=True)]
            out = frame[keep].copy()
            for k, c in enumerate(("ok", "reason", "xml")):
                out[c] = [f[k] for f in found]
            yield out

    return rows.mapInPandas(read, f"{schema}, {RESULT}")


def resolve_revisions(rows: DataFrame, accept: bool) -> DataFrame:
    """rows: xml, revision_id and more."""
    return per_row(rows, lambda x, r: resolve_revision(x, str(r), accept), "xml", "revision_id")


# ---- comments


def create_comment(xml: str | None, start: int, end: int, comment_id: int) -> tuple[bool, str | None, str | None]:
    """Range marks and a reference for a comment over [start, end) of a plain paragraph's text: (ok, reason, markup)."""
    if xml is None or not safe_text_patch(xml):
        return False, "unsupported", xml
    root = parse(xml)
    p = root.child("w:p")
    runs = [r for r in (p.nodes("w:r") if p is not None else [])]
    texts = ["".join(t.text() for t in r.nodes("w:t")) for r in runs]
    total = sum(map(len, texts))
    if not 0 <= start < end <= total:
        return False, "stale", xml
    if any(c.name not in ("w:t", "w:rPr") for r in runs for c in r.nodes()):
        return False, "unsupported", xml
    open_, close = f'<w:commentRangeStart w:id="{comment_id}"/>', f'<w:commentRangeEnd w:id="{comment_id}"/><w:r><w:commentReference w:id="{comment_id}"/></w:r>'
    out, at, place = [xml[: runs[0].start]], 0, runs[0].start
    for r, text in zip(runs, texts, strict=True):
        out.append(xml[place : r.start])
        head = r.child("w:rPr").xml if r.child("w:rPr") is not None else ""
        cuts = sorted({0, len(text), *(x - at for x in (start, end) if 0 < x - at < len(text))})
        for a, b in zip(cuts, cuts[1:], strict=False):
            out.append(open_ if at + a == start else "")
            out.append(f'<w:r>{head}<w:t xml:space="preserve">{encode(text[a:b])}</w:t></w:r>')
            out.append(close if at + b == end else "")
        at, place = at + len(text), r.end
    return True, None, "".join(out) + xml[place:]


def create_comments(rows: DataFrame) -> DataFrame:
    """rows: xml, start, end, comment_id and more."""
    return per_row(rows, lambda x, a, b, i: create_comment(x, int(a), int(b), int(i)), "xml", "start", "end", "comment_id")


def set_resolved(comments: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """changes: doc_id, id, resolved. (comments with resolved and dirty, changes for comments that aren't there)."""
    new = comments.join(changes.select("doc_id", "id", F.col("resolved").alias("__new")), ["doc_id", "id"], "left")
    value = F.coalesce("__new", "resolved")
    done = new.withColumn("dirty", ~value.eqNullSafe(F.col("resolved"))).withColumn("resolved", value).drop("__new")
    return done, changes.join(comments, ["doc_id", "id"], "left_anti")


def paragraph_ids(requests: DataFrame, taken: DataFrame, tries: int = 16) -> DataFrame:
    """requests: doc_id, comment_id; taken: doc_id, para_id. The first free one of 0xC0000000 + comment_id and the numbers behind
    it, as eight hex digits; null where all tries are taken."""
    options = requests.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(tries - 1))))
    options = options.withColumn("para_id", F.lpad(F.hex(F.lit(0xC0000000) + F.col("comment_id") + F.col("k")), 8, "0"))
    free = options.join(taken.select("doc_id", F.upper("para_id").alias("para_id")), ["doc_id", "para_id"], "left_anti")
    best = free.groupBy("doc_id", "comment_id").agg(F.min_by("para_id", "k").alias("para_id"))
    return requests.join(best, ["doc_id", "comment_id"], "left")

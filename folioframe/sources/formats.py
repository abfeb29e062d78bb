"""Table formats of packages: properties of tables, borders, and the conditional formats of table styles.

What styles.conditional works on comes from table_formats; conditions of a cell come from tables.conditions.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import HORIZONTAL, VERTICAL
from ..operators import styles
from . import properties as props
from .model import body_of, bodies, cells_of, extract, top_blocks
from .xmltree import Node, parse

SPACING = {"top_twips": "bigint", "right_twips": "bigint", "bottom_twips": "bigint", "left_twips": "bigint"}
BORDER = {"type": "string", "size_eighth_pt": "bigint", "color": "string"}
EDGES = {"top": "w:top", "right": "w:right", "bottom": "w:bottom", "left": "w:left", "inside_h": "w:insideH", "inside_v": "w:insideV", "tl2br": "w:tl2br", "tr2bl": "w:tr2bl"}
BORDERS = dict.fromkeys(EDGES, props.struct_type(BORDER))
FLOATING = {
    "x_twips": "bigint", "y_twips": "bigint", "left_from_text_twips": "bigint", "right_from_text_twips": "bigint", "top_from_text_twips": "bigint", "bottom_from_text_twips": "bigint", "horizontal_anchor": "string", "vertical_anchor": "string",
    "horizontal_align": "string", "vertical_align": "string",
}
PROPERTIES = {"width_twips": "bigint", "indent_twips": "bigint", "layout": "string", "cell_spacing_twips": "bigint", "cell_margin": props.struct_type(SPACING), "floating": props.struct_type(FLOATING)}
LOOK = {"first_row": "boolean", "last_row": "boolean", "first_column": "boolean", "last_column": "boolean", "no_h_band": "boolean", "no_v_band": "boolean", "row_band_size": "bigint", "col_band_size": "bigint"}
#: A conditional format's fields; borders are taken over edge by edge, so each edge is a field of its own.
FORMAT = {
    "row_fill": "string", "cell_fill": "string", "align": "string", "run": props.struct_type(props.RUN_STYLE), **{f"table_{e}": t for e, t in BORDERS.items()}, **{f"cell_{e}": t for e, t in BORDERS.items()}, **PROPERTIES, "look": props.struct_type(LOOK),
}


def some(fields: dict) -> dict | None:
    return fields if any(v is not None for v in fields.values()) else None


def box_spacing(node: Node | None) -> dict | None:
    """Distances by side; start and end are left and right."""
    side = lambda *names: next((c for n in names if (c := node.child(n)) is not None), None) if node is not None else None
    width = lambda c: props.integer(c.get("w:w")) if c is not None else None
    return some({"top_twips": width(side("w:top")), "right_twips": width(side("w:right", "w:end")), "bottom_twips": width(side("w:bottom")), "left_twips": width(side("w:left", "w:start"))})


def border(node: Node | None) -> dict | None:
    """An edge's type in lower case, size and colour (automatic is black); null without a type."""
    kind = (node.get("w:val") or "").strip().lower() if node is not None else ""
    if not kind:
        return None
    size, color = props.integer(node.get("w:sz")), node.get("w:color")
    return {"type": kind, "size_eighth_pt": size if size is not None and size >= 0 else None, "color": "#000000" if (color or "").strip().lower() == "auto" else props.color(color)}


def border_set(node: Node | None) -> dict:
    """All eight edges; null for those that are missing."""
    return {e: border(node.child(tag)) if node is not None else None for e, tag in EDGES.items()}


def floating(tblpr: Node | None) -> dict | None:
    """Where a floating table stands; null for one that doesn't float."""
    p = tblpr.child("w:tblpPr") if tblpr is not None else None
    if p is None:
        return None
    n = lambda a: props.integer(p.get(f"w:{a}"))
    one_of = lambda a, known: v if (v := (p.get(f"w:{a}") or "").strip().lower()) in known else None
    return some({
        "x_twips": n("tblpX"), "y_twips": n("tblpY"), "left_from_text_twips": n("leftFromText"), "right_from_text_twips": n("rightFromText"), "top_from_text_twips": n("topFromText"), "bottom_from_text_twips": n("bottomFromText"),
        "horizontal_anchor": p.get("w:horzAnchor"), "vertical_anchor": p.get("w:vertAnchor"), "horizontal_align": one_of("tblpXSpec", HORIZONTAL), "vertical_align": one_of("tblpYSpec", VERTICAL),
    })


def table_properties(tblpr: Node | None) -> dict:
    """Width, indent, layout, cell spacing and margins, floating place; lengths count in twentieths of a point only."""

    def length(tag: str, good) -> int | None:
        c = tblpr.child(tag) if tblpr is not None else None
        n = props.integer(c.get("w:w")) if c is not None and (c.get("w:type") or "").lower() == "dxa" else None
        return n if n is not None and good(n) else None

    layout = (props.val(tblpr, "w:tblLayout", "w:type") or "").lower()
    return {
        "width_twips": length("w:tblW", lambda n: n > 0), "indent_twips": length("w:tblInd", lambda n: n != 0), "layout": layout if layout in ("fixed", "autofit") else None, "cell_spacing_twips": length("w:tblCellSpacing", lambda n: n >= 0),
        "cell_margin": box_spacing(tblpr.child("w:tblCellMar")) if tblpr is not None else None, "floating": floating(tblpr),
    }


def look(tblpr: Node | None) -> dict | None:
    """Which conditions a table takes, and how many rows and columns a band has; null without a look of its own."""
    if tblpr is None or tblpr.child("w:tblLook") is None:
        return None
    size = lambda tag: max(1, props.integer(props.val(tblpr, tag)) or 1)
    return dict(zip(LOOK, [*props.table_look(tblpr).values(), size("w:tblStyleRowBandSize"), size("w:tblStyleColBandSize")], strict=True))


def conditional_format(node: Node) -> dict | None:
    """The format that a style, or one of its conditions, gives; null where it gives none."""
    tbl, ppr, row, cell = (node.child(n) for n in ("w:tblPr", "w:pPr", "w:trPr", "w:tcPr"))
    fill = lambda p: props.color(props.val(p, "w:shd", "w:fill"))
    cell_fill = fill(cell) if cell is not None and cell.child("w:shd") is not None else fill(tbl)
    edges = {f"{kind}_{e}": b for kind, p, tag in (("table", tbl, "w:tblBorders"), ("cell", cell, "w:tcBorders")) for e, b in border_set(p.child(tag) if p is not None else None).items()}
    align = props.paragraph_style(ppr)["align"]
    return some({"row_fill": fill(row), "cell_fill": cell_fill, "align": align, "run": some(props.run_style(node.child("w:rPr"))), **edges, **table_properties(tbl), "look": look(tbl)})


def table_formats(parts: DataFrame) -> DataFrame:
    """doc_id, style_id, based_on, condition and the fields of FORMAT, as written: wholeTable is the style's own format."""

    def rows(_: str, content: str) -> Iterator[dict]:
        for s in parse(content).walk("w:style"):
            if s.get("w:type") != "table":
                continue
            about = {"style_id": s.get("styleId"), "based_on": props.val(s, "w:basedOn")}
            yield about | {"condition": "wholeTable"} | (conditional_format(s) or {})
            for c in s.nodes("w:tblStylePr"):
                own = conditional_format(c)
                if own is not None and c.get("w:type") and c.get("w:type") != "wholeTable":
                    yield about | {"condition": c.get("w:type")} | own

    return extract(parts, F.col("name") == "word/styles.xml", "style_id string, based_on string, condition string, " + ", ".join(f"{k} {t}" for k, t in FORMAT.items()), rows)


def effective_formats(formats: DataFrame) -> DataFrame:
    """table_formats with what styles inherit: of each condition every field from the nearest style of the chain that has it."""
    chain = styles.ancestors(formats.where("condition = 'wholeTable'"), ["doc_id"])
    met = chain.join(formats.withColumnRenamed("style_id", "ancestor"), ["doc_id", "ancestor"])
    nearest = [F.min_by(f, F.when(F.col(f).isNotNull(), F.col("depth"))).alias(f) for f in FORMAT]
    return met.groupBy("doc_id", "style_id", "condition").agg(*nearest)


def tables(parts: DataFrame) -> DataFrame:
    """Tables of the body, headers and footers: doc_id, container, node_index, path (cells above a nested one), style_id, grid (widths of
    its columns), their borders and the fields of PROPERTIES."""

    def rows(name: str, content: str) -> Iterator[dict]:
        for i, n in enumerate(top_blocks(body_of(parse(content)))):
            if n.name != "w:tbl":
                continue
            for path, t in [([], n), *((p, x) for p, tc in cells_of(n) for x in tc.nodes("w:tbl"))]:
                p = t.child("w:tblPr")
                grid = t.child("w:tblGrid")
                widths = [props.integer(c.get("w:w")) or 0 for c in grid.nodes("w:gridCol")] if grid is not None else []
                yield {
                    "container": name, "node_index": i, "path": [{"row": a, "cell": b} for a, b in path], "style_id": props.val(p, "w:tblStyle"), "grid": [w for w in widths if w > 0], "borders": some(border_set(p.child("w:tblBorders") if p is not None else None)),
                    **table_properties(p), "look": look(p),
                }

    schema = f"container string, node_index int, path array<struct<row:int,cell:int>>, style_id string, grid array<bigint>, borders {props.struct_type(BORDERS)}, " + ", ".join(f"{k} {t}" for k, t in PROPERTIES.items())
    return extract(parts, bodies(), f"{schema}, look {props.struct_type(LOOK)}", rows)

"""Table formats and drawings, from packages."""

import pytest
from pyspark.sql import functions as F

from folioframe.operators import styles, tables
from folioframe.sources import drawings, formats, packages

from .test_sources import package

W = 'xmlns:w="w"'
STYLES = f"""<w:styles {W}><w:style w:type="table" w:styleId="Base"><w:rPr><w:b/></w:rPr><w:tblPr><w:tblInd w:w="40" w:type="dxa"/><w:tblBorders><w:top w:val="SINGLE" w:sz="4" w:color="auto"/><w:insideH w:val="dotted" w:sz="-1" w:color="ff0000"/></w:tblBorders>
<w:tblCellMar><w:start w:w="108"/><w:end w:w="109"/></w:tblCellMar></w:tblPr><w:tblStylePr w:type="firstRow"><w:tcPr><w:shd w:fill="AABBCC"/></w:tcPr></w:tblStylePr><w:tblStylePr w:type="lastRow"/></w:style>
<w:style w:type="table" w:styleId="Own"><w:basedOn w:val="Base"/><w:pPr><w:jc w:val="center"/></w:pPr><w:tblPr><w:shd w:fill="010203"/><w:tblBorders><w:top w:val="double"/></w:tblBorders></w:tblPr><w:tblStylePr w:type="firstRow"><w:trPr><w:shd w:fill="111111"/></w:trPr></w:tblStylePr>
<w:tblStylePr w:type="band1Horz"><w:tcPr><w:tcBorders><w:tl2br w:val="single"/></w:tcBorders></w:tcPr></w:tblStylePr></w:style><w:style w:type="paragraph" w:styleId="P"/></w:styles>"""
BODY = f"""<w:document {W}><w:body><w:tbl><w:tblPr><w:tblStyle w:val="Own"/><w:tblW w:w="5000" w:type="dxa"/><w:tblpPr w:tblpX="10" w:tblpYSpec="Center" w:tblpXSpec="odd" w:horzAnchor="page"/><w:tblLayout w:type="Fixed"/><w:tblLook w:val="0420" w:noHBand="1"/>
<w:tblStyleRowBandSize w:val="2"/></w:tblPr><w:tblGrid><w:gridCol w:w="700"/><w:gridCol w:w="0"/><w:gridCol w:w="800"/></w:tblGrid><w:tr><w:tc><w:p/><w:tbl><w:tblPr><w:tblW w:w="50" w:type="pct"/></w:tblPr><w:tr><w:tc><w:p/></w:tc></w:tr></w:tbl></w:tc></w:tr></w:tbl>
<w:p><w:r><w:drawing><wp:anchor behindDoc="1" relativeHeight="251.6" distL="9525"><wp:positionH relativeFrom="page"><wp:align> Right </wp:align></wp:positionH><wp:positionV relativeFrom="margin"><wp:posOffset>-19050</wp:posOffset></wp:positionV><wp:wrapSquare wrapText="bothSides"/>
<a:alphaModFix amt="40000"/><a14:artisticPastelsSmooth/><a14:colorTemperature colorTemp="9500"/></wp:anchor></w:drawing></w:r>
<w:r><w:pict><v:shape style="position:absolute;MARGIN-LEFT:36pt;margin-top:.5in;mso-position-horizontal:absolute;mso-position-vertical:top;mso-position-vertical-relative:text;z-index:-3"><w10:wrap type="topAndBottom" side="left"/></v:shape></w:pict></w:r>
<w:r><mc:AlternateContent><mc:Choice><w:drawing><wps:txbx><w:txbxContent><w:p><w:pPr><w:pStyle w:val="S"/><w:jc w:val="right"/></w:pPr><w:r><w:rPr><w:i/></w:rPr><w:t>boxed</w:t></w:r></w:p></w:txbxContent></wps:txbx></w:drawing></mc:Choice><mc:Fallback><w:pict><v:shape style="left:1px"/></w:pict></mc:Fallback></mc:AlternateContent></w:r>
<w:r><w:object><w:control r:id="c1"/></w:object></w:r><w:r><w:object><w:control r:id="c2"/></w:object></w:r></w:p></w:body></w:document>"""
rel = lambda *pairs: "<Relationships>" + "".join(f'<Relationship Id="{i}" Type="t/x" Target="{t}"/>' for i, t in pairs) + "</Relationships>"
PARTS = {
    "[Content_Types].xml": '<Types><Default Extension="png" ContentType="image/png"/></Types>', "word/document.xml": BODY, "word/styles.xml": STYLES, "word/media/b.png": b"\x89PNG",
    "word/numbering.xml": f'<w:numbering {W}><w:numPicBullet w:numPicBulletId="3"><w:pict><v:shape style="width:9pt;height:12px"><v:imagedata r:id="r1"/></v:shape></w:pict></w:numPicBullet><w:numPicBullet/></w:numbering>', "word/_rels/numbering.xml.rels": rel(("r1", "media/b.png")),
    "word/_rels/document.xml.rels": rel(("c1", "activeX/activeX1.xml"), ("c2", "activeX/activeX2.xml")), "word/activeX/activeX1.xml": '<ax:ocx ax:x="1" r:id="b1"/>', "word/activeX/activeX2.xml": '<ax:ocx r:id="b1"/>',
    "word/activeX/_rels/activeX1.xml.rels": rel(("b1", "activeX1.bin")), "word/activeX/_rels/activeX2.xml.rels": rel(("b1", "activeX2.bin")), "word/activeX/activeX1.bin": '<INPUT TYPE="checkbox" NAME=" agree " checked>'.encode("utf-16-le"), "word/activeX/activeX2.bin": b'<input type="text" name="q">',
}


@pytest.fixture(scope="module")
def parts(spark):
    return packages.read_parts(spark.createDataFrame([("d", bytearray(package(PARTS)))], "path string, content binary")).cache()


def test_table_formats(parts):
    written = {(r.style_id, r.condition): r for r in formats.table_formats(parts).collect()}
    assert set(written) == {("Base", "wholeTable"), ("Base", "firstRow"), ("Own", "wholeTable"), ("Own", "firstRow"), ("Own", "band1Horz")}
    base, own = written["Base", "wholeTable"], written["Own", "wholeTable"]
    assert base.table_top.asDict() == {"type": "single", "size_eighth_pt": 4, "color": "#000000"} and base.table_inside_h.asDict() == {"type": "dotted", "size_eighth_pt": None, "color": "#FF0000"}
    assert base.run.bold and base.indent_twips == 40 and base.cell_margin.asDict() == {"top_twips": None, "right_twips": 109, "bottom_twips": None, "left_twips": 108}
    assert own.cell_fill == "#010203" and own.align == "center" and own.run is None and written["Own", "band1Horz"].cell_tl2br.type == "single"
    got = {(r.style_id, r.condition): r for r in formats.effective_formats(formats.table_formats(parts)).collect()}
    whole, first = got["Own", "wholeTable"], got["Own", "firstRow"]
    assert (whole.table_top.type, whole.table_inside_h.type, whole.indent_twips, whole.run.bold) == ("double", "dotted", 40, True)
    assert (first.row_fill, first.cell_fill) == ("#111111", "#AABBCC") and got["Base", "wholeTable"].align is None


def test_conditional_formats_of_cells(spark, parts):
    """From a package to what its cells look like: the strongest condition that has a field gives it."""
    effective = formats.effective_formats(formats.table_formats(parts))
    cells = spark.createDataFrame([(0, 0), (1, 0), (2, 0)], "row int, column int").withColumn("style_id", F.lit("Own"))
    conditions = tables.conditions(F.col("row"), F.lit(3), F.col("column"), F.lit(1), first_row=True, last_row=False, first_col=False, last_col=False, h_band=True, v_band=False)
    got = {r.row: r for r in styles.conditional(cells.withColumn("conditions", conditions), effective, ["row", "column"], ["cell_fill", "row_fill", "cell_tl2br"]).collect()}
    assert (got[0].cell_fill, got[0].row_fill, got[0].cell_tl2br) == ("#AABBCC", "#111111", None)
    assert (got[1].cell_fill, got[1].cell_tl2br.type) == ("#010203", "single") and got[2].cell_tl2br is None


def test_tables(parts):
    outer, inner = formats.tables(parts).orderBy(F.size("path")).collect()
    assert (outer.style_id, outer.width_twips, outer.layout, outer.grid) == ("Own", 5000, "fixed", [700, 800])
    assert outer.floating.x_twips == 10 and outer.floating.vertical_align == "center" and outer.floating.horizontal_align is None and outer.floating.horizontal_anchor == "page"
    assert outer.look.first_row and outer.look.no_v_band and outer.look.no_h_band and not outer.look.last_row and (outer.look.row_band_size, outer.look.col_band_size) == (2, 1)
    assert [tuple(p) for p in inner.path] == [(0, 0)] and inner.width_twips is None and inner.floating is None and inner.look is None


def test_drawings(parts):
    a, v, box, *rest = drawings.drawings(parts).orderBy("drawing").collect()
    assert (a.floating.horizontal_align, a.floating.horizontal_from, a.floating.y_px, a.floating.left_px, a.floating.wrap, a.floating.wrap_text, a.floating.behind, a.floating.z) == ("right", "page", -2.0, 1.0, "square", "bothSides", True, 252)
    assert a.filter == "saturate(0.76) contrast(0.94) brightness(1.04) hue-rotate(-6deg) saturate(1.04)" and a.opacity == 0.4 and a.paragraphs is None
    assert (v.floating.x_px, v.floating.horizontal_align, v.floating.vertical_align, v.floating.vertical_from, v.floating.wrap, v.floating.wrap_text, v.floating.behind, v.floating.z) == (48.0, None, "top", "paragraph", "topAndBottom", "left", True, -3)
    assert [(p.text, p.style_id, p.align, p.run.italic) for p in box.paragraphs] == [("boxed", "S", "right", True)] and box.floating is None
    assert len(rest) == 2 and all(r.floating is None and r.paragraphs is None for r in rest)


def test_picture_bullets_and_check_boxes(parts):
    (b,) = drawings.picture_bullets(parts).collect()
    assert (b.bullet_id, b.part, b.type, b.width_px, b.height_px, b.src) == (3, "word/media/b.png", "image/png", 12, None, "data:image/png;base64,iVBORw==")
    (c,) = drawings.check_boxes(parts).collect()
    assert (c.node_index, c.rid, c.widget, c.checked) == (1, "c1", "agree", True)

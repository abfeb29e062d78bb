import io
import zipfile

import pytest
from pyspark.sql import functions as F

from folioframe.operators import comments, numbering, styles
from folioframe.sources import compound, model, packages, render
from folioframe.sources.xmltree import balanced, decode, parse

W = 'xmlns:w="w"'
STYLES = f"""<w:styles {W}><w:docDefaults><w:rPrDefault><w:rPr><w:sz w:val="22"/></w:rPr></w:rPrDefault></w:docDefaults>
<w:style w:type="paragraph" w:default="1" w:styleId="Normal"><w:name w:val="Normal"/><w:rPr><w:b/></w:rPr></w:style>
<w:style w:type="paragraph" w:styleId="H1"><w:name w:val="heading 1"/><w:basedOn w:val="Normal"/><w:pPr><w:keepNext/></w:pPr><w:rPr><w:sz w:val="32"/></w:rPr></w:style>
<w:style w:type="paragraph" w:styleId="H2"><w:name w:val="heading 2"/><w:basedOn w:val="H1"/><w:rPr><w:i w:val="0"/></w:rPr></w:style></w:styles>"""
NUMBERING = f"""<w:numbering {W}><w:abstractNum w:abstractNumId="7"><w:lvl w:ilvl="0"><w:start w:val="27"/><w:numFmt w:val="lowerLetter"/><w:lvlText w:val="(%1)"/></w:lvl>
<w:lvl w:ilvl="1"><w:numFmt w:val="upperRoman"/><w:lvlText w:val="%1.%2"/></w:lvl></w:abstractNum><w:num w:numId="1"><w:abstractNumId w:val="7"/></w:num>
<w:num w:numId="2"><w:abstractNumId w:val="7"/><w:lvlOverride w:ilvl="0"><w:startOverride w:val="3"/></w:lvlOverride></w:num></w:numbering>"""
num = lambda i, l: f'<w:pPr><w:numPr><w:ilvl w:val="{l}"/><w:numId w:val="{i}"/></w:numPr></w:pPr>'  # noqa: E731, E741
BODY = f"""<w:document {W}><w:body>
<w:p><w:pPr><w:pStyle w:val="H1"/><w:jc w:val="both"/></w:pPr><w:r><w:t>A &amp;lt; B</w:t></w:r><w:r><w:tab/><w:t>c</w:t><w:br/></w:r></w:p>
<w:p><w:hyperlink r:id="rId5" w:anchor="x"><w:r><w:t>link</w:t></w:r></w:hyperlink><w:r><w:fldChar w:fldCharType="begin"/></w:r><w:r><w:instrText> HYPERLINK "http://a.b" \\l "q" </w:instrText></w:r><w:r><w:fldChar w:fldCharType="separate"/></w:r><w:r><w:t>field</w:t></w:r><w:r><w:fldChar w:fldCharType="end"/></w:r></w:p>
<w:p>{num(1, 0)}<w:r><w:t>one</w:t></w:r></w:p><w:p>{num(1, 1)}<w:r><w:t>sub</w:t></w:r></w:p><w:p>{num(1, 0)}<w:r><w:t>two</w:t></w:r></w:p>
<w:tbl><w:tr><w:tc><w:tcPr><w:gridSpan w:val="2"/><w:vMerge w:val="restart"/></w:tcPr><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>deep</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:tc></w:tr></w:tbl>
<w:p><w:bookmarkStart w:name="_GoBack"/></w:p>
<w:p><w:pPr><w:sectPr><w:headerReference w:type="default" r:id="rId9"/><w:type w:val="continuous"/><w:pgSz w:w="12240" w:h="15840" w:orient="landscape"/><w:titlePg/></w:sectPr></w:pPr><w:commentRangeStart w:id="4"/><w:r><w:t>noted</w:t></w:r><w:commentRangeEnd w:id="4"/><w:ins w:id="8" w:author="Z"><w:r><w:t>new</w:t></w:r></w:ins><w:del w:id="9"><w:r><w:delText>old</w:delText></w:r></w:del><w:r><w:footnoteReference w:id="2"/></w:r></w:p>
<w:sdt><w:sdtPr><w:alias w:val="T"/></w:sdtPr><w:sdtContent><w:p><w:sdt><w:sdtPr><w:tag w:val="k"/><w14:checkbox><w14:checked w14:val="1"/></w14:checkbox></w:sdtPr><w:sdtContent><w:r><w:t>x</w:t></w:r></w:sdtContent></w:sdt></w:p></w:sdtContent></w:sdt>
<w:sectPr><w:pgSz w:w="11906" w:h="16838"/><w:cols w:num="2"/></w:sectPr></w:body></w:document>"""
PARTS = {
    "[Content_Types].xml": '<Types><Default Extension="png" ContentType="image/x-own"/><Override PartName="/word/document.xml" ContentType="main"/></Types>', "word/document.xml": BODY, "word/styles.xml": STYLES, "word/numbering.xml": NUMBERING,
    "word/_rels/document.xml.rels": '<Relationships><Relationship Id="rId5" Type="t/hyperlink" Target="http://c.d/e" TargetMode="External"/><Relationship Id="rId9" Type="t/header" Target="header1.xml"/><Relationship Id="rId5" Type="t/hyperlink" Target="http://c.d/f" TargetMode="External"/></Relationships>',
    "word/header1.xml": f"<w:hdr {W}><w:p><w:r><w:t>head</w:t></w:r></w:p></w:hdr>", "word/footnotes.xml": f'<w:footnotes {W}><w:footnote w:type="separator" w:id="0"><w:p/></w:footnote><w:footnote w:id="2"><w:p><w:r><w:t>[2] note  </w:t></w:r></w:p><w:p/></w:footnote></w:footnotes>',
    "word/comments.xml": f'<w:comments {W}><w:comment w:id="4" w:author="A"><w:p w14:paraId="P1"><w:r><w:t>why</w:t></w:r></w:p></w:comment><w:comment w:id="5"><w:p w14:paraId="P2"><w:r><w:t>so</w:t></w:r></w:p></w:comment></w:comments>',
    "word/commentsExtended.xml": '<w15:commentsEx><w15:commentEx w15:paraId="P1" w15:done="0"/><w15:commentEx w15:paraId="P2" w15:paraIdParent="P1"/></w15:commentsEx>', "docProps/app.xml": "<Properties><Pages>3</Pages></Properties>",
    "word/settings.xml": '<w:settings><w:evenAndOddHeaders/><w:compat><w:suppressTopSpacing w:val="off"/></w:compat></w:settings>', "word/media/i.png": b"\x89PNG",
    "word/charts/chart1.xml": "<c:chart><c:title><a:t>T</a:t></c:title><c:barChart><c:ser><c:cat><c:pt idx='0'><c:v>q</c:v></c:pt></c:cat><c:val><c:pt idx='0'><c:v>1,200</c:v></c:pt><c:pt idx='1'><c:v>x</c:v></c:pt></c:val></c:ser><c:ser><c:val/></c:ser></c:barChart></c:chart>",
}


def package(parts=PARTS, method=zipfile.ZIP_DEFLATED) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", method) as z:
        for name, x in parts.items():
            z.writestr(name, x)
    return out.getvalue()


@pytest.fixture(scope="module")
def parts(spark):
    rows = [("d", bytearray(package())), ("bad", bytearray(b"PK nothing")), ("empty", bytearray()), ("null", None), ("part", bytearray(package({"a.xml": "x"})))]
    return packages.read_parts(spark.createDataFrame(rows, "path string, content binary")).cache()


def test_read_parts(parts):
    errors = {r.doc_id: r.error for r in parts.where("error IS NOT NULL").collect()}
    assert set(errors) == {"bad", "empty", "null", "part"} and errors["empty"] == "empty input" and errors["part"] == "no word/document.xml"
    got = {r.name: r for r in parts.where("doc_id = 'd'").collect()}
    assert set(got) == set(PARTS) and got["word/media/i.png"].bytes == b"\x89PNG" and not got["word/media/i.png"].is_text


def test_round_trip(parts):
    first = packages.write_packages(parts).collect()
    assert [r.doc_id for r in first] == ["d"]
    again = packages.read_parts(parts.sparkSession.createDataFrame([("d", first[0].content)], "path string, content binary"))
    assert {(r.name, r.content, r.bytes) for r in again.collect()} == {(r.name, r.content, r.bytes) for r in parts.where("doc_id = 'd'").collect()}
    assert packages.write_packages(again).collect()[0].content == first[0].content


def test_relations(parts):
    rels = {(r.part, r.rid): r.target for r in model.relationships(parts).collect()}
    assert rels == {("word/document.xml", "rId5"): "http://c.d/f", ("word/document.xml", "rId9"): "word/header1.xml"}
    types = {r.name: r.type for r in model.part_types(parts).where("doc_id = 'd'").collect()}
    assert types["word/document.xml"] == "main" and types["word/media/i.png"] == "image/x-own" and types["word/styles.xml"] is None
    m = model.metadata(parts).collect()[0]
    assert m.page_count == 3 and m.even_and_odd and m.suppressTopSpacing is False and m.suppressSpBfAfterPgBrk is None


def test_blocks_and_runs(parts):
    blocks = {(r.container, r.node_index): r for r in model.blocks(parts).collect()}
    body = [blocks["word/document.xml", i] for i in range(8)]
    assert [b.kind for b in body] == ["paragraph"] * 5 + ["table"] + ["paragraph"] * 2 and len(blocks) == 9
    assert body[0].text == "A &lt; B\tc\n" and body[0].style.align == "justify" and body[0].style.style_id == "H1" and body[7].text == "☒"
    runs = model.runs(parts).orderBy("container", "node_index", "cell_path", "paragraph", "run_index").collect()
    links = [(r.text, r.link) for r in runs if r.link]
    assert links == [("link", "http://c.d/f#x"), ("field", "http://a.b#q")]
    assert [r.note_id for r in runs if r.kind == "note"] == [2]
    deep = next(r for r in runs if r.text == "deep")
    assert [(p.row, p.cell) for p in deep.cell_path] == [(0, 1), (0, 0)]
    field = next(r for r in runs if r.kind == "field")
    assert field.field.kind == "checkbox" and field.field.checked and field.field.tag == "k"


def test_cells_and_sections(parts):
    cells = sorted((len(r.path), r.grid_col, r.grid_span, r.v_merge, r.text) for r in model.cells(parts).collect())
    assert cells == [(1, 0, 2, "restart", "a"), (1, 2, 1, None, "b"), (2, 0, 1, None, "deep")]
    s = model.sections(parts).orderBy("section_index").collect()
    assert [(r.start_node_index, r.layout.break_type, r.layout.columns) for r in s] == [(0, "continuous", 1), (7, "nextPage", 2)]
    assert (s[0].layout.width_px, s[0].layout.height_px, s[0].layout.title_page) == (1056.0, 816.0, True)
    refs = {(r.section_index, r.type): r.part for r in model.section_references(parts).collect()}
    assert refs == {(0, "default"): "word/header1.xml", (1, "default"): "word/header1.xml"}


def test_styles_numbering_notes_comments(parts):
    sheet = model.style_sheet(parts).where("kind = 'paragraph'")
    flat = sheet.select("doc_id", "style_id", "based_on", F.col("run.bold").alias("bold"), F.col("run.size_pt").alias("size"), F.col("run.italic").alias("italic"), "heading")
    got = {r.style_id: (r.bold, r.size, r.italic) for r in styles.effective(flat, ["doc_id"], ["bold", "size", "italic"]).collect()}
    assert got == {"Normal": (True, None, None), "H1": (True, 16.0, None), "H2": (True, 16.0, False)}
    items = model.blocks(parts).where("container = 'word/document.xml'").select("doc_id", "node_index", F.col("style.num_id").alias("num_id"), F.col("style.ilvl").alias("ilvl")).where("num_id IS NOT NULL")
    labels = numbering.labels(items, model.numbering_levels(parts), model.numbering_instances(parts))
    assert {r.node_index: r.label for r in labels.collect()} == {2: "(aa)", 3: "aa.I", 4: "(bb)"}
    notes = comments.notes(model.note_paragraphs(parts).select("doc_id", "id", "type", "node_index", "text")).collect()
    assert [(n.id, n.text) for n in notes] == [(2, "note")]
    threads = {r.id: (r.resolved, r.parent_id, r.text) for r in comments.threads(model.comment_rows(parts), model.comment_states(parts)).collect()}
    assert threads == {4: (False, None, "why"), 5: (None, 4, "so")}
    assert [(r.id, r.text) for r in model.comment_anchors(parts).collect()] == [(4, "noted")]
    assert [(r.kind, r.text) for r in model.revisions(parts).orderBy("ord").collect()] == [("insert", "new"), ("delete", "old")]
    points = model.charts(parts).orderBy("series", "idx").collect()
    assert [(p.kind, p.title, p.series_name, p.category, p.value) for p in points] == [("bar", "T", "Series 1", "q", 1200.0), ("bar", "T", "Series 1", "Item 2", 0.0)]


def test_xml_tree():
    assert decode("&amp;lt; &#65;&#x42; &nope; &#0;") == "&lt; AB &nope; &#0;"
    assert decode("&AMP;", any_case=True) == "&" and decode("&AMP;") == "&AMP;"
    x = "</w:p><w:tbl><w:p>a<w:tbl><w:p/></w:tbl></w:p></w:tbl><W:P q='>'/>"
    assert [(x[s:e], n) for s, e, n in balanced(x, "w:tbl", "w:p")] == [(x[6:-12], "w:tbl"), (x[-12:], "w:p")]
    n = parse('<a:b x="1" y=\'2\'>t<!-- <c> --><c/>u</a:b>').nodes()[0]
    assert (n.get("x"), n.get("y"), n.get("z"), n.text()) == ("1", "2", None, "tu")


def test_balanced_blocks(spark):
    df = spark.createDataFrame([(1, "<b>x<b>y</b></b><b/>"), (2, None), (3, "none")], "id long, x string")
    assert [(r.id, r.block) for r in model.balanced_blocks(df, "x", "b").collect()] == [(1, "<b>x<b>y</b></b>"), (1, "<b/>")]


def test_render_is_read_again(spark):
    style = {"bold": True, "italic": False, "size_pt": 10.5, "color": "#FF0000", "underline": "single", "font_ascii": "X"}
    xml = render.document([render.paragraph({"align": "justify", "keep_next": True, "num_id": 3, "ilvl": 1, "tab_stops": [{"pos": 9, "align": "right", "leader": None}]}, [{"text": "a\tb\nc <&", "style": style}]), render.table([[{"text": "p\nq", "grid_span": 2, "v_merge": "restart"}], [{"text": "r"}, {"text": "s"}]])])
    raw = packages.zip_bytes({"word/document.xml": xml.encode()})
    parts = packages.read_parts(spark.createDataFrame([("x", bytearray(raw))], "path string, content binary")).cache()
    b = model.blocks(parts).orderBy("node_index").collect()
    assert b[0].text == "a\tb\nc <&" and b[0].style.align == "justify" and b[0].style.keep_next and b[0].style.num_id == 3 and b[0].style.tab_stops[0].pos == 9
    r = model.runs(parts).where("node_index = 0").collect()[0].style
    assert (r.bold, r.italic, r.size_pt, r.color, r.underline, r.font_ascii) == (True, None, 10.5, "#FF0000", "single", "X")
    assert [(c.grid_col, c.grid_span, c.text) for c in model.cells(parts).orderBy("row", "cell").collect()] == [(0, 2, "p\nq"), (0, 1, "r"), (1, 1, "s")]


def test_patch_and_upsert():
    p = "<w:p><w:r><w:rPr><w:b/></w:rPr><w:t>a</w:t></w:r><w:r><w:t>b</w:t></w:r></w:p>"
    assert render.patch_text(p, ["x<", "y"]) == '<w:p><w:r><w:rPr><w:b/></w:rPr><w:t xml:space="preserve">x&lt;</w:t></w:r><w:r><w:t xml:space="preserve">y</w:t></w:r></w:p>'
    assert render.patch_text(p, ["x"]) is None and render.patch_text("<w:p><w:ins/></w:p>", []) is None
    x = '<?xml version="1.0"?><w:comments><w:comment w:id="3">c</w:comment></w:comments>'
    new = {"3": '<w:comment w:id="3">d</w:comment>', "10": '<w:comment w:id="10"/>', "9": '<w:comment w:id="9"/>'}
    assert render.upsert(x, "w:comment", "w:id", new) == '<?xml version="1.0"?><w:comments><w:comment w:id="3">d</w:comment><w:comment w:id="9"/><w:comment w:id="10"/></w:comments>'
    assert render.next_relationship(["rId2", "x", "rId10"]) == 11 and render.next_relationship([]) == 1


def compound_file(text: str, chars=(), paragraphs=(), tables=None, data=b"", sections=()) -> bytes:
    """A small compound file with one document stream and one table stream. chars: (from, to, records); paragraphs: (from, to, style,
    records); tables: parts of the table stream by number; sections: (end, records)."""
    import struct

    def page(runs, paragraphs):
        out, width, at = bytearray(512), 13 if paragraphs else 1, 500
        for i, (a, _, *style, grpprl) in enumerate(runs):
            struct.pack_into("<I", out, 4 * i, 0x400 + 2 * a)
            if paragraphs:
                body = struct.pack("<H", style[0]) + grpprl
                body = bytes([(len(body) + 1) // 2]) + body if len(body) % 2 else bytes([0, len(body) // 2]) + body
            else:
                body = bytes([len(grpprl)]) + grpprl
            at = (at - len(body)) // 2 * 2
            out[at : at + len(body)] = body
            out[(len(runs) + 1) * 4 + i * width] = at // 2
        struct.pack_into("<I", out, 4 * len(runs), 0x400 + 2 * runs[-1][1])
        out[511] = len(runs)
        return bytes(out)

    tables = dict(tables or {})
    word = bytearray(0x400) + text.encode("utf-16-le")
    word += b"\0" * (-len(word) % 512)
    for number, runs in ((12, chars), (13, paragraphs)):
        if runs:
            tables[number] = struct.pack("<III", 0x400, 0x400 + 2 * len(text), len(word) // 512)
            word += page(runs, number == 13)
    if sections:
        places, seds = [0, *[e for e, _ in sections]], b""
        for _, grpprl in sections:
            seds += struct.pack("<HIHI", 0, len(word), 0, 0)
            word += struct.pack("<H", len(grpprl)) + grpprl
        tables[6] = struct.pack(f"<{len(places)}I", *places) + seds
    for at, value in ((0, 0xA5EC), (2, 0xC1), (10, 0x200), (0x20, 14), (0x3E, 22), (0x98, 93)):
        struct.pack_into("<H", word, at, value)
    struct.pack_into("<i", word, 76, len(text))
    tables[33] = b"\x02" + struct.pack("<I", 16) + struct.pack("<II", 0, len(text)) + struct.pack("<HIH", 0, 0x400, 0)
    table = b""
    for number, part in tables.items():
        struct.pack_into("<II", word, 0x9A + 8 * number, len(table), len(part))
        table += part
    streams = [("WordDocument", bytes(word).ljust(4096, b"\0")), ("1Table", table.ljust(4096, b"\0"))] + ([("Data", data.ljust(4096, b"\0"))] if data else [])
    sectors, fat, starts = [], [], []
    for _, data in streams:
        data = data.ljust(-(-len(data) // 512) * 512, b"\0")
        n = len(data) // 512
        starts.append(len(sectors))
        fat += [len(sectors) + k + 1 for k in range(n - 1)] + [0xFFFFFFFE]
        sectors += [data[k * 512 : k * 512 + 512] for k in range(n)]

    def entry(name, kind, start, size):
        raw = name.encode("utf-16-le") + b"\0\0"
        return raw.ljust(64, b"\0") + struct.pack("<HBB", len(raw), kind, 1) + struct.pack("<III", 0xFFFFFFFF, 0xFFFFFFFF, 0xFFFFFFFF) + b"\0" * 36 + struct.pack("<IQ", start, size)

    directory = entry("Root Entry", 5, 0xFFFFFFFE, 0) + b"".join(entry(n, 2, s, max(4096, len(d))) for (n, d), s in zip(streams, starts, strict=True))
    dir_at = len(sectors)
    sectors.append(directory.ljust(512, b"\0"))
    fat += [0xFFFFFFFE, 0xFFFFFFFD]
    fat_at = len(sectors)
    sectors.append(struct.pack(f"<{len(fat)}I", *fat).ljust(512, b"\xff"))
    head = packages.MAGIC + b"\0" * 16 + struct.pack("<HHHHH", 0x3E, 3, 0xFFFE, 9, 6) + b"\0" * 6 + struct.pack("<II", 0, 1) + struct.pack("<III", dir_at, 0, 4096) + struct.pack("<II", 0xFFFFFFFE, 0) + struct.pack("<II", 0xFFFFFFFE, 0) + struct.pack("<109I", fat_at, *[0xFFFFFFFF] * 108)
    return head + b"".join(sectors)


def test_legacy_documents(spark):
    raw = compound_file("First\x13 HYPERLINK x\x14shown\x15\rSec\tond\x0cnext\x07cell\r")
    assert set(compound.streams(raw)) == {"WordDocument", "1Table"}
    parts = packages.read_parts(spark.createDataFrame([("l", bytearray(raw)), ("cut", bytearray(raw[:600]))], "path string, content binary")).cache()
    assert [r.doc_id for r in parts.where("error IS NOT NULL").collect()] == ["cut"]
    assert [r.text for r in model.blocks(parts).orderBy("node_index").collect()] == ["Firstshown", "Sec\tond\nnext", "cell"]


def test_legacy_formatting(spark):
    """Runs, paragraphs, a table, sections, styles, lists, typefaces and a picture of a legacy document, read like a package."""
    import struct

    h = lambda code, *operand: struct.pack("<H", code) + bytes(operand)
    w = lambda code, value: struct.pack("<Hh", code, value)
    text = "Bold plain\x01\rItem\rIn cell\x07two\x07\x07\x0cEnd\r"
    cell, end = text.index("In"), text.index("End")
    mark = cell + len("In cell\x07two\x07")
    definition = bytes([2]) + struct.pack("<3h", 0, 1440, 4320) + struct.pack("<H", 0x40) + b"\0" * 2 + bytes([8, 1, 6, 0]) + b"\0" * 12 + struct.pack("<H", 0x80) + b"\0" * 18
    row = h(0x2416, 1) + h(0x2417, 1) + struct.pack("<HH", 0xD608, len(definition) + 1) + definition + h(0x3404, 1) + w(0x9407, -300) + h(0xD609, 4) + struct.pack("<HH", 0xFFFF, 7 << 5)
    face = lambda name: (lambda b: bytes([len(b)]) + b)(b"\0" * 39 + name.encode("utf-16-le") + b"\0\0")

    def std(sti, kind, base, name, papx, chpx):
        upx = [struct.pack("<H", 0) + papx, chpx] if kind == 1 else [chpx]
        out = struct.pack("<HHHHH", sti, kind | base << 4, len(upx) | 0 << 4, 0, 0) + struct.pack("<H", len(name)) + name.encode("utf-16-le") + b"\0\0"
        for u in upx:
            out += b"\0" * (len(out) % 2) + struct.pack("<H", len(u)) + u
        return struct.pack("<H", len(out)) + out + b"\0" * (len(out) % 2)

    head = struct.pack("<HH", 3, 10) + b"\0" * 14
    sheet = struct.pack("<H", len(head)) + head + std(0, 1, 0xFFF, "Normal", b"", h(0x0835, 1)) + std(1, 1, 0, "heading 1", h(0x2406, 1), h(0x0835, 0x81) + w(0x4A43, 32)) + std(66, 2, 0xFFF, "My style!", b"", h(0x0836, 1))
    lvl = struct.pack("<IBB", 3, 4, 2) + b"\0" * 18 + bytes([0, 0, 0, 0]) + struct.pack("<H3H", 3, 40, 0, 41)
    lists = struct.pack("<H", 1) + struct.pack("<I", 77) + b"\0" * 22 + bytes([1, 0]) + lvl
    overrides = struct.pack("<I", 1) + struct.pack("<I", 77) + b"\0" * 8 + bytes([1, 0, 0, 0]) + struct.pack("<II", 9, 0x10)
    png = b"\x89PNG picture"
    blip = struct.pack("<HHI", 0x6E0 << 4, 0xF01E, 17 + len(png)) + b"\0" * 17 + png
    box = struct.pack("<HHI", 0xF, 0xF004, len(blip)) + blip
    data = struct.pack("<IHH", 0x44 + len(box), 0x44, 0x64).ljust(28, b"\0") + struct.pack("<HHHH", 1440, 720, 500, 0)
    data = data.ljust(0x44, b"\0") + box
    raw = compound_file(
        text,
        chars=[(0, 4, h(0x0835, 0x81) + h(0x2A42, 6) + w(0x4A4F, 1)), (4, 10, b""), (10, 11, h(0x0855, 1) + struct.pack("<HI", 0x6A03, 0)), (11, 16, w(0x4A30, 2) + h(0x2A3E, 11)), (16, len(text), b"")],
        paragraphs=[(0, 12, 1, h(0x2461, 1) + w(0x8411, -200) + struct.pack("<Hhh", 0x6412, -240, 0) + h(0xC60D, 7, 1, 0x10, 0, 1, 0, 2, 2 | 1 << 3)), (12, 17, 0, h(0x260A, 0) + w(0x460B, 1)), (cell, mark, 0, h(0x2416, 1)), (mark, mark + 1, 0, row), (mark + 1, len(text), 0, b"")],
        tables={1: sheet, 15: struct.pack("<HH", 2, 0) + face("One") + face("Two & Co"), 73: lists, 74: overrides},
        data=data, sections=[(end, w(0x500B, 1) + h(0x300E, 2) + struct.pack("<HH", 0xB01F, 15840) + h(0x301D, 2)), (len(text), b"")],
    )
    parts = packages.read_parts(spark.createDataFrame([("l", bytearray(raw))], "path string, content binary")).cache()
    assert [r.error for r in parts.collect()] == [None] * 4 and parts.where("name = 'word/media/image1.png'").collect()[0].bytes == png
    blocks = model.blocks(parts).orderBy("node_index").collect()
    assert [(r.kind, r.text) for r in blocks] == [("paragraph", "Bold plain"), ("paragraph", "Item"), ("table", "In cell\ntwo"), ("paragraph", ""), ("paragraph", "End")]
    s = blocks[0].style
    assert (s.style_id, s.align, s.hanging_twips, s.line, s.line_rule) == ("Heading1", "center", 200, 240, "exact")
    assert [(t.pos, t.align, t.leader) for t in s.tab_stops] == [(16, "clear", None), (512, "right", "dot")]
    assert (blocks[1].style.num_id, blocks[1].style.ilvl) == (1, 0)
    first, second, third, *_ = model.runs(parts).where("kind = 'text'").orderBy("node_index", "run_index").collect()
    # The style inverts its base's bold to off, and the run inverts that.
    assert (first.text, first.style.bold, first.style.color, first.style.font_ascii) == ("Bold", True, "#FF0000", "Two & Co") and (second.text, second.style.bold) == (" plain", None)
    assert (third.style.style_id, third.style.underline) == ("MyStyle", "wave")
    sheet_rows = {r.style_id: r for r in model.style_sheet(parts).collect()}
    assert sheet_rows["Normal"].is_default and sheet_rows["Heading1"].based_on == "Normal" and sheet_rows["Heading1"].heading == 1 and sheet_rows["Heading1"].paragraph.keep_next
    assert (sheet_rows["Heading1"].run.bold, sheet_rows["Heading1"].run.size_pt, sheet_rows["MyStyle"].run.italic) == (False, 16.0, True)
    (level,) = model.numbering_levels(parts).collect()
    assert (level.start, level.format, level.lvl_text) == (3, "lowerLetter", "(%1)")
    a, b = model.cells(parts).orderBy("cell").collect()
    assert (a.text, a.v_merge, a.width_twips, a.shading, b.text, b.width_twips, b.v_align) == ("In cell", "restart", 1440, "#FFFF00", "two", 2880, "center")
    one, two = model.sections(parts).orderBy("section_index").collect()
    assert (one.layout.columns, one.layout.page_format, one.layout.orientation, one.layout.width_px) == (2, "lowerRoman", "landscape", 1056.0) and two.layout.columns == 1


def test_legacy_records():
    import struct

    from folioframe.sources import legacy

    h = lambda code, *operand: struct.pack("<H", code) + bytes(operand)
    assert list(legacy.records(h(0x0835, 1) + h(0x4A43, 1, 2) + h(0xCA71, 2, 9, 9) + h(0x6870, 1))) == [(0x0835, b"\1"), (0x4A43, b"\1\2"), (0xCA71, b"\t\t")]
    assert list(legacy.records(h(0xC615, 255, 1) + h(0x0835, 1))) == []
    assert legacy.border(bytes([8, 1, 6, 0x23]), True) == {"val": "single", "sz": 8, "color": "FF0000", "space": 3, "shadow": True} and legacy.border(b"\xff" * 4, True) is None
    assert legacy.border(bytes([1, 2, 3, 0, 4, 3, 0, 0]), False)["color"] == "010203" and legacy.border(bytes([0] * 8), False) is None
    assert legacy.shade(struct.pack("<H", 2 | 7 << 5 | 1 << 10), True) == {"val": "solid", "color": "0000FF", "fill": "FFFF00"} and legacy.shade(b"\xff\xff", True) is None
    assert legacy.toggles(h(0x0835, 0x81) + h(0x0836, 0x80), {"w:b": True}) == {"w:b": False}
    assert legacy.bins(struct.pack("<5I", 1, 2, 3, 10, 11)) == [(1, 2, 10), (2, 3, 11)] and legacy.bins(b"123") == []
    assert legacy.page_runs(b"", 0, False) == [] and legacy.fonts(b"") == [] and legacy.styles(b"") == [] and legacy.lists(b"", b"") == ([], [])
    row = legacy.table_row(struct.pack("<HH", 0xD608, 2 + 6) + bytes([2]) + struct.pack("<3h", -10, 5, 9) + h(0xD62B, 2, 1, 3) + h(0xD620, 7, 0, 2, 1, 8, 1, 0, 0))
    assert [(c["left"], c["right"], c["v_restart"]) for c in row["cells"]] == [(-10, 5, False), (5, 9, True)] and all(c["borders"]["top"]["val"] == "single" and c["borders"]["left"] is None for c in row["cells"])
    dib = struct.pack("<IiiHHIIiiII", 40, 1, 1, 1, 8, 0, 4, 0, 0, 2, 0) + b"\0" * 12
    assert legacy.bitmap(dib)[:2] == b"BM" and struct.unpack_from("<I", legacy.bitmap(dib), 10)[0] == 14 + 40 + 8 and legacy.bitmap(b"") is None
    assert legacy.image(b"", 0) is None and legacy.boxes(struct.pack("<3I", 0, 5, 6) + b"".join(struct.pack("<IIHII", 1, 0, 0, 0, i) + b"\0" * 4 for i in (7, 8))) == [(0, 5, 7)]


def test_serialized_models(spark, parts):
    from folioframe.sources import serialize

    blocks = model.blocks(parts).select("doc_id", "container", "node_index", "source_xml", "text")
    first = blocks.where("container = 'word/document.xml'")
    said = comments.threads(model.comment_rows(parts), model.comment_states(parts)).withColumn("para_id", F.element_at("para_ids", -1)).withColumn("parent_para_id", F.when(F.col("id") == 5, "P1"))
    out = serialize.document_parts(parts.where("doc_id = 'd'"), blocks, said, model.sections(parts).where("start_node_index = 7").select("doc_id", "xml"))
    again = packages.read_parts(packages.write_packages(out), "doc_id").cache()
    texts = lambda p: sorted((r.container, r.node_index, r.text) for r in model.blocks(p).collect())
    assert texts(again) == texts(parts.where("doc_id = 'd'")) and first.count() == 8
    threads = {r.id: (r.resolved, r.parent_id, r.text) for r in comments.threads(model.comment_rows(again), model.comment_states(again)).collect()}
    assert threads == {4: (False, None, "why"), 5: (None, 4, "so")}
    assert [r.layout.columns for r in model.sections(again).orderBy("section_index").collect()] == [1, 2]
    plain = serialize.body_parts(spark.createDataFrame([("p", "word/header2.xml", 0, None, "a\tb\n<c>")], "doc_id string, container string, node_index int, source_xml string, text string"))
    assert [r.text for r in model.blocks(plain).collect()] == ["a\tb\n<c>"]

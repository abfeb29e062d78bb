from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from folioframe.functions import markup, numbers
from folioframe.operators import blocks, comments, compare, edits, history, layout, numbering, quality, runs, sections, segmentation, styles, tables, validation


def column(spark, values, expression, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("v")).alias("x")).collect()]


def test_markup(spark):
    assert column(spark, ["<w:b/>", '<w:b w:val="0"/>', '<w:b w:val="Off"/>', '<w:b w:val="x"/>', "<w:bCs/>", None], lambda x: markup.on_off(x, "w:b")) == [True, False, False, True, None, None]
    assert column(spark, ['<w:b w:val="no"/>'], lambda x: markup.on_off(x, "w:b", markup.OFF_IN_LAYOUT)) == [False]
    assert column(spark, ["Heading 3", "my heading6x", "head 1", None], markup.heading_level) == [3, 6, None, None]
    assert column(spark, ["#ff00aa", "FF00AA", "auto", "12", None], markup.hex_color) == ["#FF00AA", "#FF00AA", None, None, None]
    assert column(spark, ["9525", "4762.5", "x", None], markup.emu_to_pixels) == [1.0, 0.5, None, None]
    assert column(spark, ["1in", "12pt", "2.54 cm", "10mm", "5em", "7px"], markup.css_length_to_pixels) == [96, 16, 96, 38, None, 7]
    assert column(spark, ["../media/i.png", "/x/y.xml", "a/./b", "http://q", "#f", "", "../../../z"], lambda t: markup.resolve_path(F.lit("word/document.xml"), t)) == ["media/i.png", "x/y.xml", "word/a/b", "http://q", "#f", "", "z"]
    assert column(spark, ["word/document.xml", "a.xml"], markup.rels_part) == ["word/_rels/document.xml.rels", "_rels/a.xml.rels"]
    assert column(spark, ["&amp;lt; &lt;"], markup.decode_entities) == ["&lt; <"]
    assert column(spark, [' HYPERLINK "http://x" \\l "y"', 'HYPERLINK \\l "y"', "PAGE"], markup.field_hyperlink) == ["http://x#y", "#y", None]
    assert column(spark, ["1,234.5", "x", "NaN", "Infinity", None], markup.chart_number) == [1234.5, 0.0, 0.0, 0.0, 0.0]
    assert column(spark, ["a.PNG", "b.emf", "c", "d.zip"], markup.media_type) == ["image/png", "image/x-emf", None, None]
    assert column(spark, ["ok\t", "\x01", "￾"], markup.valid_xml_text) == [True, False, False]


def test_number_formats(spark):
    n = [1, 26, 27, 28, 52, 53]
    assert column(spark, n, numbers.letters, "bigint") == ["a", "z", "aa", "bb", "zz", "aaa"]
    assert column(spark, [1, 4, 9, 1994, 3999, 4000, 0], lambda x: numbers.roman(x, True), "bigint") == ["I", "IV", "IX", "MCMXCIV", "MMMCMXCIX", "4000", "0"]
    assert column(spark, [1, 2, 3, 4, 11, 12, 13, 21, 101, 111], numbers.ordinal, "bigint") == ["1st", "2nd", "3rd", "4th", "11th", "12th", "13th", "21st", "101st", "111th"]
    assert column(spark, [0, 7, 19, 20, 42, 100, 101, 999, 12345], numbers.cardinal, "bigint") == ["zero", "seven", "nineteen", "twenty", "forty-two", "one hundred", "one hundred one", "nine hundred ninety-nine", "twelve thousand three hundred forty-five"]
    assert column(spark, [9, 10], lambda x: numbers.label_number(x, F.lit("decimalZero")), "bigint") == ["09", "10"]


def test_numbering_restarts(spark):
    items = spark.createDataFrame([(1, i, l) for i, l in enumerate([0, 1, 1, 0, 1, 2, 0])], "list_id int, at int, ilvl int")
    got = [[c for c in r.counts if c is not None] for r in numbering.counters(items, "list_id", "at", 3).orderBy("at").collect()]
    assert got == [[1], [1, 1], [1, 2], [2], [2, 1], [2, 1, 1], [3]]


def test_numbering_restart_rules(spark):
    items = lambda levels: spark.createDataFrame([(1, i, l) for i, l in enumerate(levels)], "list_id int, at int, ilvl int")  # noqa: E731, E741
    own = lambda rows: [r.counts[r.ilvl] for r in rows.orderBy("at").collect()]
    rule = lambda *r: F.array(*[F.lit(x).cast("int") for x in r])
    assert own(numbering.counters(items([0, 1, 1, 0, 1, 1]), "list_id", "at", 2, restarts=rule(None, 0))) == [1, 1, 2, 2, 3, 4]
    assert own(numbering.counters(items([0, 1, 2, 2, 1, 2, 0, 1, 2]), "list_id", "at", 3, restarts=rule(None, None, 1))) == [1, 1, 1, 2, 2, 3, 2, 1, 1]
    assert own(numbering.counters(items([0, 1, 0, 1]), "list_id", "at", 2, restarts=rule(None, 5))) == [1, 1, 2, 1]


def test_numbering_labels(spark):
    levels = spark.createDataFrame(
        [("d", 0, 0, 1, "upperLetter", "%1.", None, None), ("d", 0, 1, 1, "decimal", "%1.%2", None, True), ("d", 1, 0, 22, "ordinalText", "%1", None, None), ("d", 2, 0, 0, "decimal", "%1)", None, None)],
        "doc_id string, abstract_num_id int, ilvl int, start bigint, format string, lvl_text string, restart int, is_lgl boolean",
    )
    nums = spark.createDataFrame([("d", i + 1, i, {}) for i in range(3)] + [("d", 9, 0, {"0": 5})], "doc_id string, num_id int, abstract_num_id int, start_overrides map<string,bigint>")
    paragraphs = spark.createDataFrame([("d", i, n, l) for i, (n, l) in enumerate([(1, 0), (1, 1), (1, 1), (2, 0), (3, 0), (9, 0), (9, 0), (1, 0)])], "doc_id string, node_index int, num_id int, ilvl int")
    got = [r.label for r in numbering.labels(paragraphs, levels, nums).orderBy("node_index").collect()]
    assert got == ["A.", "1.1", "1.2", "twenty-second", "0)", "E.", "F.", "B."]
    styled = spark.createDataFrame([("d", 0, "L", None, None), ("d", 1, "L", None, 1), ("d", 2, "L", 0, None), ("d", 3, "N", 4, 2)], "doc_id string, node_index int, style_id string, num_id int, ilvl int")
    lists = numbering.paragraph_lists(styled, spark.createDataFrame([("d", "L", 1, 0)], "doc_id string, style_id string, style_num_id int, style_ilvl int"))
    assert [(r.num_id, r.ilvl) for r in lists.orderBy("node_index").collect()] == [(1, 0), (1, 1), (None, 0), (4, 2)]


def test_pages(spark):
    from folioframe.operators import pages

    rows = spark.createDataFrame([("d", 0, 0, 1, "lowerRoman"), ("d", 1, 0, 1, "lowerRoman"), ("d", 2, 1, 1, "decimal"), ("d", 3, 2, None, None)], "doc_id string, page int, section_index int, page_start int, page_format string")
    assert [r.shown for r in pages.page_numbers(rows).orderBy("page").collect()] == ["i", "ii", "1", "2"]
    frames = spark.createDataFrame([("d", 0, 0, 0, 10, 0.0, 0.0, 100.0, 20.0), ("d", 0, 1, 0, 4, 0.0, 20.0, 40.0, 20.0)], "doc_id string, page int, node_index int, start int, end int, x double, y double, width double, height double")
    points = spark.createDataFrame([("d", 0, 52.0, 5.0), ("d", 0, 500.0, 30.0)], "doc_id string, page int, px double, py double")
    assert [(r.node_index, r.offset) for r in pages.nearest_fragment(points, frames).orderBy("px").collect()] == [(0, 5), (0, 10)]
    chosen = spark.createDataFrame([("d", 0, 2, 5), ("d", 1, 9, 12)], "doc_id string, node_index int, from int, to int")
    assert [(r.x, r.width) for r in pages.overlap_rects(frames, chosen).collect()] == [(20.0, 30.0)]


def test_letterheads(spark):
    from folioframe.operators import pages

    def sides(rows):
        df = spark.createDataFrame([("d", i, *r) for i, r in enumerate(rows)], "doc_id string, node_index int, text string, left_twips int, right_twips int, framed boolean")
        found = pages.letterhead_sides(df)
        groups = segmentation.letterhead_groups(found.select("doc_id", F.lit(0).alias("page"), F.col("node_index").alias("ord"), "side")).collect()
        return [r.side for r in found.orderBy("node_index").collect()], [any(g.start <= i < g.end for g in groups) for i in range(len(rows))]

    assert sides([("A NAME", None, 2340, False), ("Office", None, 2340, True)]) == (["left"] * 2, [False] * 2)
    assert sides([("A NAME", None, 2340, False), ("Office", None, 2340, True), ("", None, 2340, False), ("ANOTHER NAME", None, 2250, False)])[0] == ["left"] * 4
    assert sides([("A NAME", 1980, None, False), ("Office", 1980, None, True)])[0] == ["right"] * 2
    rows = [("", None, 2790, False), ("A NAME", None, 2340, False), ("Office", None, 2340, True), *[("", None, 2340, True)] * 3, ("THIRD NAME", 1980, None, False), ("Office", 1980, None, True), ("A date", None, None, False)]
    assert sides(rows) == (["left"] * 6 + ["right"] * 2 + [None], [True] * 8 + [False])
    assert sides([("long text " * 12, 1980, None, True)])[0] == [None]
    assert sides([("A NAME", None, 2340, False), ("B", None, 2340, False)])[0] == [None] * 2


def test_pagination(spark):
    df = spark.createDataFrame([("a", i, 100.0, 8.0) for i in range(20)] + [("b", 0, 5000.0, 8.0), ("b", 1, 10.0, 8.0)], "doc_id string, node_index int, height double, gap double")
    got = {(r.doc_id, r.node_index): (r.page, r.y) for r in layout.paginate(df).collect()}
    assert got["a", 0] == (1, 72.0) and got["a", 7] == (1, 828.0) and got["a", 8] == (2, 72.0) and got["b", 0] == (1, 72.0) and got["b", 1] == (2, 72.0)
    counts = {r.doc_id: r.pages for r in layout.page_counts(df).collect()}
    assert counts == {"a": 3, "b": 2}


def segments(spark, rows, height, **options):
    df = spark.createDataFrame([{"doc_id": "d", "node_index": i, **r} for i, r in enumerate(rows)], "doc_id string, node_index int, " + ", ".join(f"{c} {t}" for c, (t, _) in segmentation.COLUMNS.items()))
    found = segmentation.paginate_blocks(df, height, **options).orderBy("page", "ord").collect()
    pages: dict = {}
    for r in found:
        pages.setdefault(r.page, []).append((r.node_index, *[x for x in (r.row_start, r.row_end, r.line_start, r.line_end) if x is not None]))
    return list(pages.values())


def test_rows_in_slices(spark):
    def table(rows, splits=None, edges=None, first=None, height=120.0):
        blocks = ([{"height_px": first}] if first else []) + [{"kind": "table", "row_heights_px": rows, "row_splits": splits, "row_edges": edges}]
        df = spark.createDataFrame([{"doc_id": "d", "node_index": i, **r} for i, r in enumerate(blocks)], "doc_id string, node_index int, height_px double, kind string, row_heights_px array<double>, row_splits array<boolean>, row_edges array<array<double>>")
        found = segmentation.paginate_blocks(df, height).orderBy("page", "ord").collect()
        return [(r.page, r.row_start, r.row_end, r.slice_start_px, r.slice_px) for r in found if r.node_index == len(blocks) - 1]

    assert table([260.0]) == [(0, 0, 1, 0.0, 120.0), (1, 0, 1, 120.0, 120.0), (2, 0, 1, 240.0, 20.0)]
    assert table([250.0, 80.0]) == [(0, 0, 1, 0.0, 120.0), (1, 0, 1, 120.0, 120.0), (2, 0, 1, 240.0, 10.0), (2, 1, 2, None, None)]
    assert table([70.0, 100.0], [False, True]) == [(0, 0, 1, None, None), (0, 1, 2, 0.0, 50.0), (1, 1, 2, 50.0, 50.0)]
    assert table([70.0, 100.0], [False, True], [[], [40.0, 100.0]]) == [(0, 0, 1, None, None), (0, 1, 2, 0.0, 40.0), (1, 1, 2, 40.0, 60.0)]
    assert table([70.0, 100.0]) == [(0, 0, 1, None, None), (1, 1, 2, None, None)]
    assert table([130.0], first=50.0) == [(1, 0, 1, 0.0, 120.0), (2, 0, 1, 120.0, 10.0)]
    assert table([100.0, 40.0], [False, True]) == [(0, 0, 1, None, None), (1, 1, 2, None, None)]  # too little room for a part


def test_segments(spark):
    plain = {"height_px": 100.0, "line_height_px": 20.0, "line_count": 1}
    assert segments(spark, [plain] * 5, 300.0) == [[(0,), (1,), (2,)], [(3,), (4,)]]
    assert segments(spark, [plain, {**plain, "page_break_before": True}, {**plain, "hard_break": True}], 300.0) == [[(0,)], [(1,)], [(2,)]]
    # A kept heading goes with what follows; a chain that begins a page is not pushed again.
    assert segments(spark, [plain, plain, {**plain, "keep_next": True}, plain], 300.0) == [[(0,), (1,)], [(2,), (3,)]]
    assert segments(spark, [{**plain, "keep_next": True}] * 4 + [plain], 300.0) == [[(0,), (1,), (2,)], [(3,), (4,)]]
    # Margins overlap by the smaller one.
    spaced = {**plain, "before_px": 20.0, "after_px": 30.0}
    assert segments(spark, [spaced, spaced, spaced, plain], 357.0) == [[(0,), (1,), (2,)], [(3,)]]
    assert segments(spark, [spaced, spaced, {**spaced, "before_px": 0.0}, plain], 270.0) == [[(0,), (1,)], [(2,), (3,)]]


def test_segment_lines_and_rows(spark):
    long = {"height_px": 400.0, "line_height_px": 20.0, "line_count": 20}
    got = segments(spark, [long], 300.0)
    assert got == [[(0, 0, 13)], [(0, 13, 20)]]
    two = segments(spark, [{"height_px": 250.0, "line_height_px": 20.0, "line_count": 1}, {**long, "line_count": 6, "height_px": 120.0}], 300.0)
    assert two[0] == [(0,)] and two[1] == [(1, 0, 6)]  # fewer than two lines would fit
    assert segments(spark, [long], 300.0, split_lines=False) == [[(0,)]]
    table = {"kind": "table", "row_heights_px": [100.0] * 4}
    assert segments(spark, [table], 300.0) == [[(0, 0, 2)], [(0, 2, 4)]]  # no single row alone
    assert segments(spark, [{**table, "row_breaks": [1]}], 500.0) == [[(0, 0, 1)], [(0, 1, 4)]]
    assert segments(spark, [{**table, "row_heights_px": [900.0, 50.0]}], 300.0) == [[(0, 0, 1)]] * 3 + [[(0, 1, 2)]]
    assert segments(spark, [{"kind": "table", "row_heights_px": [100.0, 100.0]}], 300.0) == [[(0,)]]
    assert segments(spark, [], 300.0) == []


def test_sections(spark):
    points = spark.createDataFrame([("d", i) for i in range(5)], "doc string, at int")
    starts = spark.createDataFrame([("d", 1, "a"), ("d", 3, None), ("e", 0, "x")], "doc string, start int, v string")
    got = sections.as_of(points, starts, "doc", "at", "start", "v").orderBy("at").collect()
    assert [r.v for r in got] == [None, "a", "a", None, None]
    v = lambda i, t, e, f, ev, d: spark.range(1).select(sections.variant(F.lit(i), F.lit(t), F.lit(e), F.lit(f), F.lit(ev), F.lit(d))).first()[0]
    assert v(0, True, False, "f", "e", "d") == "f" and v(0, True, False, None, "e", "d") is None and v(1, False, True, "f", "e", "d") == "e" and v(1, False, True, "f", None, "d") == "d" and v(2, False, False, "f", None, None) == "f"


def test_tables(spark):
    cells = spark.createDataFrame([("t", r, 0, m) for r, m in enumerate(["continue", "restart", "continue", "continue", None, "restart"])], "table_id string, row int, grid_col int, v_merge string")
    assert [(r.anchor_row, r.row_span) for r in tables.vertical_merges(cells).orderBy("row").collect()] == [(0, 1), (1, 3), (1, 0), (1, 0), (4, 1), (5, 1)]
    got = spark.range(1).select(tables.conditions(F.lit(0), F.lit(3), F.lit(2), F.lit(3))).first()[0]
    assert got == ["wholeTable", "band2Vert", "firstRow", "lastCol", "neCell"]


def test_styles(spark):
    t = lambda *x: spark.range(1).select(styles.toggle(*[F.lit(v).cast("boolean") for v in x])).first()[0]
    assert (t(True, None, None, None), t(None, True, True, None), t(True, True, True, True), t(False, None, True, None), t(None, None, None, None)) == (True, False, True, True, None)
    loop = spark.createDataFrame([(1, "a", "b", None), (1, "b", "a", 5), (1, "c", "zz", 7)], "d int, style_id string, based_on string, v int")
    assert {r.style_id: r.v for r in styles.effective(loop, ["d"], ["v"]).collect()} == {"a": 5, "b": 5, "c": 7}


def test_runs_and_edits(spark):
    assert edits.distribute("abXYef", [{"style": 1, "text": "abc"}, {"style": 2, "text": "def"}]) == [{"style": 1, "text": "abXY"}, {"style": 2, "text": "ef"}]
    assert edits.distribute("Qab", [{"style": 1, "text": "ab"}]) == [{"style": 1, "text": "Qab"}]
    assert edits.distribute("", [{"style": 1, "text": "ab"}]) == [{"style": 1, "text": ""}]
    for old in ([{"style": 1, "text": "aa"}, {"style": 2, "text": "aab"}], [{"style": 1, "text": ""}]):
        for new in ("", "a", "aaab", "baab", "aaaab", "zz"):
            assert "".join(r["text"] for r in edits.distribute(new, old)) == new
    rows = spark.createDataFrame([("d", 0, 0, "abc", "1"), ("d", 0, 1, "def", "2"), ("d", 1, 0, "x", "3")], "doc_id string, node_index int, run_index int, text string, style string")
    got = edits.update_texts(rows, spark.createDataFrame([("d", 0, "abcXdef")], "doc_id string, node_index int, text string")).orderBy("node_index", "run_index").collect()
    assert [(r.text, r.style) for r in got] == [("abcX", "1"), ("def", "2"), ("x", "3")]
    cut = runs.split_at(rows.where("node_index = 0"), ["doc_id"], "run_index", "text", F.lit(4)).orderBy("run_index", "side").collect()
    assert [(r.side, r.text) for r in cut] == [("left", "abc"), ("left", "d"), ("right", "ef")]
    cells = spark.createDataFrame([(1, "a\r\nb\rc", 2), (2, "a", 3)], "id int, t string, n int")
    assert [(r.id, r.paragraph, r.text) for r in edits.cell_texts(cells, ["id"], "t", "n").orderBy("id", "paragraph").collect()] == [(1, 0, "a"), (1, 1, "b\nc"), (2, 0, "a"), (2, 1, ""), (2, 2, "")]


def test_revisions_and_comments(spark):
    x = '<w:p><w:ins w:id="1"><w:r><w:t>a</w:t></w:r></w:ins><w:del w:id="2"><w:r><w:delText>b</w:delText></w:r></w:del></w:p>'
    df = spark.createDataFrame([(x, "1"), (x, "2"), (x, "3"), ('<w:p><w:rPrChange w:id="4"/></w:p>', "4")], "xml string, revision_id string")
    yes, no = ({r.revision_id: (r.ok, r.reason, r.xml) for r in edits.resolve_revisions(df, a).collect()} for a in (True, False))
    assert yes["1"] == (True, None, '<w:p><w:r><w:t>a</w:t></w:r><w:del w:id="2"><w:r><w:delText>b</w:delText></w:r></w:del></w:p>')
    assert no["2"] == (True, None, '<w:p><w:ins w:id="1"><w:r><w:t>a</w:t></w:r></w:ins><w:r><w:t>b</w:t></w:r></w:p>')
    assert yes["3"][:2] == (False, "stale") and yes["4"][:2] == (False, "unsupported")
    ok, _, out = edits.create_comment("<w:p><w:r><w:rPr><w:b/></w:rPr><w:t>hello</w:t></w:r><w:r><w:t> you</w:t></w:r></w:p>", 2, 7, 6)
    from folioframe.sources.xmltree import parse

    assert ok and parse(out).text() == "hello you"
    inside = out[out.index("RangeStart") : out.index("<w:commentRangeEnd")]
    assert "".join(t.text() for t in parse("<x>" + inside[inside.index("/>") + 2 :] + "</x>").walk("w:t")) == "llo y"
    assert edits.create_comment("<w:p><w:r><w:t>a</w:t></w:r></w:p>", 0, 5, 1)[1] == "stale" and edits.create_comment("<w:p><w:ins/></w:p>", 0, 1, 1)[1] == "unsupported"
    taken = spark.createDataFrame([("d", "C0000005")], "doc_id string, para_id string")
    assert edits.paragraph_ids(spark.createDataFrame([("d", 5)], "doc_id string, comment_id long"), taken).first().para_id == "C0000006"
    done, stale = edits.set_resolved(spark.createDataFrame([("d", 1, None), ("d", 2, True)], "doc_id string, id long, resolved boolean"), spark.createDataFrame([("d", 1, True), ("d", 9, True)], "doc_id string, id long, resolved boolean"))
    assert {r.id: (r.resolved, r.dirty) for r in done.collect()} == {1: (True, True), 2: (True, False)} and [r.id for r in stale.collect()] == [9]


def test_history(spark):
    steps = ["commit", "commit", "undo", "undo", "undo", "redo", "commit", "redo", "reset", "redo"]
    df = spark.createDataFrame([("s", i, a) for i, a in enumerate(steps)] + [("t", i, "commit") for i in range(150)], "s string, i int, a string")
    got = history.depths(df, "s", "i", "a").collect()
    assert [(r.undo_depth, r.redo_depth) for r in sorted(got, key=lambda r: (r.s, r.i)) if r.s == "s"] == [(1, 0), (2, 0), (1, 1), (0, 2), (0, 2), (1, 1), (2, 0), (2, 0), (0, 0), (0, 0)]
    assert max(r.undo_depth for r in got) == 100
    t = datetime(2024, 1, 1)
    ev = spark.createDataFrame([("u", t, "a"), ("u", t + timedelta(seconds=1), "a"), ("u", t + timedelta(seconds=1.5), "b"), ("u", t + timedelta(seconds=3), "b")], "u string, ts timestamp, k string")
    assert [r.burst for r in history.bursts(ev, "u", "ts", "k").orderBy("ts").collect()] == [0, 0, 1, 2]


def test_validation(spark):
    paths = ["a/b.png", "", "/a", "a\\b", "C:/x", "http://x", "a//b", "a/../b", "./a", "..", None, "a.b"]
    assert column(spark, paths, validation.portable_path) == [True] + [False] * 10 + [True]
    dates = ["2024-02-29T00:00:00Z", "2023-02-29T00:00:00", "2024-01-01T24:00:00.0", "2024-01-01T24:00:01", "0000-01-01T00:00:00", "2024-01-01T00:00:00+14:00", "2024-01-01T00:00:00+14:01", "12024-12-31T23:59:59.5-00:30", "02024-01-01T00:00:00", None]
    assert column(spark, dates, validation.xml_date_time) == [True, False, True, False, False, True, False, True, False, False]
    pages = spark.createDataFrame([("c", "r", 1, 612.0, 792.0, "p/1.png", "a" * 64), ("c", "r", 3, 0.0, 792.0, "../x", "zz"), ("c", "r", 3, 612.0, None, "p", "a" * 64)], "case_id string, reference_id string, page_number int, width_points double, height_points double, image_path string, image_sha256 string")
    assert sorted(r.rule for r in validation.page_issues(pages).collect()) == ["duplicate-page", "height", "page-gap", "path", "sha256", "width"]
    info = column(spark, ["x\nPage    1 size: 612 x 792 pts (letter)\nPage    2 size: 595.3 x 841.9 pts (A4)\n"], validation.page_sizes)[0]
    assert [(p.page, p.width, p.height) for p in info] == [(1, 612.0, 792.0), (2, 595.3, 841.9)]
    s = spark.createDataFrame([("d", i, g, n) for i, (g, n) in enumerate([("a", 0), ("a", 0), ("b", 0), ("b", 1), ("b", 0), ("b", 0)])], "doc string, i int, sig string, issues int")
    assert [r.ready for r in validation.ready(s, ["doc"], "i", "sig").orderBy("i").collect()] == [False, True, False, False, False, True]


def test_compare(spark):
    px = spark.createDataFrame([("p", 0, 0, 0, 255, 255, 255), ("p", 10, 10, 10, 10, 10, 12)], "p string, a0 int, a1 int, a2 int, b0 int, b1 int, b2 int")
    r = compare.image_metrics(px, ["p"], 5).first()
    assert r.mismatch_ratio == 0.5 and abs(r.mean_absolute_diff - (1 + 2 / 3 / 255) / 2) < 1e-9
    assert column(spark, ["#FF0000", "#010101", "#0000F0"], lambda c: compare.nearest_color(c, {"red": "#FF0000", "black": "#000000", "blue": "#0000FF"})) == ["red", "black", "blue"]
    assert quality.issues(spark.range(2), "id", {"odd": F.col("id") == 1}).collect()[0].asDict() == {"key": "1", "rule": "odd"}


def plain_script(ch):
    import unicodedata

    o, name = ord(ch), unicodedata.name(ch, "")
    if o <= 0x7F:
        return "ascii"
    if 0x3000 <= o <= 0x303F or 0xFF00 <= o <= 0xFFEF or name.startswith(("CJK UNIFIED", "HIRAGANA", "KATAKANA LETTER", "HANGUL", "YI SYLLABLE")):
        return "eastAsia"
    if name.startswith(("ARABIC", "HEBREW", "THAI", "DEVANAGARI")):
        return "complexScript"
    return None if unicodedata.category(ch)[0] in "MZP" or o in (0x200C, 0x200D) else "highAnsi"


FONTS = {"ascii": "Serif", "highAnsi": "'serif' ", "eastAsia": "Song", "complexScript": "Naskh"}


@pytest.mark.parametrize("text", ["abc", "ab 12 \u6f22\u5b57, x \u00e9\u2014y", "...", "", "\u05e9\u05dc\u05d5\u05dd abc", "\u2014\u201c\u6f22 a", "\u2014\u2003", "\u0e01\u0e31 \U00020000\ua000b", "e\u0301\u200d\u06271", "\u6f22a" * 700])
def test_script_segments(spark, text):
    style = {"ascii": F.lit("Serif"), "high_ansi": F.lit("'serif' "), "east_asia": F.lit("Song"), "complex": F.lit("Naskh")}
    got = runs.script_segments(spark.createDataFrame([(1, text)], "doc_id int, text string"), style).orderBy("segment").collect()
    own = [plain_script(c) for c in text]
    strong, want, at = next((s for s in own if s), "highAnsi"), [], 0
    for ch, s in zip(text, own, strict=True):
        strong = s or strong
        key = FONTS[strong].strip(" '").lower()
        size = len(ch.encode("utf-16-le")) // 2
        if want and want[-1][0] == key:
            want[-1] = (key, want[-1][1], want[-1][2], at + size, want[-1][4] + ch)
        else:
            want.append((key, strong, at, at + size, ch))
        at += size
    assert [(r.family.strip("'").lower(), r.script, r.start, r.end, r.text) for r in got] == want


def test_script_fonts(spark):
    from folioframe.functions import fonts

    one = lambda c: spark.range(1).select(c.alias("c")).collect()[0].c
    base = {"family": "Base", "source_family": "Base", "ascii": "A", "high_ansi": "H", "east_asia": "E", "complex": "C"}
    style = lambda **x: {k: F.lit(v) for k, v in (base | x).items()}
    assert [one(fonts.family(style(), s)) for s in fonts.SCRIPTS] == ["A", "H", "E", "C"]
    assert [one(fonts.family(style(family="'New'"), s)) for s in fonts.SCRIPTS] == ["'New'"] * 4
    assert one(fonts.family({"high_ansi": F.lit("H"), "family": F.lit("F")}, "eastAsia")) == "H"
    assert one(fonts.family({"family": F.lit(" F ")}, "ascii")) == "F"
    assert one(fonts.script_of(F.lit("a"), style(right_to_left=True))) == "complexScript" and one(fonts.script_of(F.lit("a"), style(right_to_left=True, complex_script=False))) == "ascii"
    assert [one(fonts.neutral_script(style(**x))) for x in ({}, {"hint": "East-Asia"}, {"language_bidi": "AR-sa"}, {"language_east_asia": "ja"}, {"language_east_asia": "jab"})] == ["highAnsi", "eastAsia", "complexScript", "eastAsia", "highAnsi"]
    assert one(fonts.text_family(F.lit("\u6f22"), style())) == "E" and one(fonts.text_family(F.lit(""), style())) == "Base"


def test_rows(spark):
    rows = spark.createDataFrame([("d", i, f"t{i}") for i in range(3)], "doc_id string, node_index int, text string")
    texts = lambda df: [r.text for r in df.orderBy("node_index").collect()]
    assert texts(blocks.insert_rows(rows, spark.createDataFrame([("d", 1, "n"), ("d", 99, "e")], rows.schema))) == ["t0", "n", "t1", "t2", "e"]
    assert texts(blocks.remove_rows(rows, F.col("node_index") == 1)) == ["t0", "t2"] and texts(blocks.remove_rows(rows, F.lit(True))) == ["t0"]
    assert texts(blocks.duplicate_rows(rows, F.col("node_index") == 1)) == ["t0", "t1", "t1", "t2"]
    assert comments.next_comment_id(spark.createDataFrame([("d", 4)], "doc_id string, id long")).first().next_id == 5


def test_line_breaking():
    from folioframe.operators.lines import break_lines, row_parts

    assert row_parts(100, 0, 10, [(20, 0, 30, 5), (40, 5, 20, 50), (90, 20, 5, 5)]) == [(0.0, 20.0), (60, 40.0)]
    text = "aaa bbb ccc\n\nlongerword x"
    got = break_lines(text, 7, 1, {}, 1.0)
    assert [text[a:b].strip() for a, b, *_ in got] == ["aaa bbb", "ccc", "", "longerw", "ord x"]
    assert [y for *_, y in got] == [0, 1, 2, 3, 4]
    around = break_lines("aa bb cc dd", 10, 1, {}, 1.0, [(3, 0, 4, 1)])
    assert [(x, y) for *_, x, y in around][:2] == [(0.0, 0.0), (7.0, 0.0)]
    assert break_lines("", 10, 1, {}, 1.0) == [(0, 0, 0.0, 0.0)]


def test_conversions(spark):
    assert column(spark, ["hsl(0, 100%, 50%)", "hsl(-240,100%,25%)", "hsl(0,0%,200%)", "red"], markup.hsl_to_hex) == ["#FF0000", "#008000", "#FFFFFF", None]
    fonts = F.create_map(*[F.lit(x) for x in ("major.latin", "L", "minor.latin", "M", "minor.ea", "E", "major.cs", "")])
    assert column(spark, ["majorHAnsi", "minorEastAsia", "majorBidi", "other"], lambda t: markup.theme_font(t, fonts)) == ["L", "E", "L", None]
    colors = F.create_map(F.lit("dk1"), F.lit("#000000"))
    assert column(spark, ["tx1", "zz"], lambda t: markup.theme_color(F.lit(None).cast("string"), t, colors)) == ["#000000", None]


def test_intervals(spark):
    from folioframe.operators import intervals

    left = spark.createDataFrame([(1, i, i + 25) for i in range(0, 100, 20)], "g int, start int, end int")
    right = spark.createDataFrame([(1, 0, 60), (1, 55, 56), (1, 7, 7), (2, 0, 100)], "g int, r_start int, r_end int")
    got = sorted((r.start, r.r_start, r["from"], r.to) for r in intervals.overlaps(left, right, ["g"], 10).collect())
    assert got == [(0, 0, 0, 25), (20, 0, 20, 45), (40, 0, 40, 60), (40, 55, 55, 56)]
    points = spark.createDataFrame([(1, 24), (1, 99), (1, 500)], "g int, at int")
    assert sorted((r.at, r.start) for r in intervals.containing(points, left, ["g"], 10).collect()) == [(24, 0), (24, 20), (99, 80)]


def test_values(spark):
    from folioframe.functions import values

    assert column(spark, ["Both", "start", "LEFT", None], values.alignment) == ["justify", None, "left", None]
    assert column(spark, ["On", "0", " ", "x"], values.three_way) == [True, False, None, None]
    assert column(spark, ["<w:u/>", '<w:u w:val="none"/>', '<w:u w:color="FF0000"/>', '<w:u w:x="1"/>', "<w:b/>"], values.underline) == [True, False, None, True, None]
    assert column(spark, ["0x41", "2612", "0", "zz", "1F600"], values.code_point) == ["A", "☒", None, None, "😀"]
    assert column(spark, ["  x ", " ", None], values.field_display) == ["  x ", None, None]
    assert column(spark, [1, 16, 0, 17], values.index_color, "int") == ["000000", "C0C0C0", None, None]
    assert column(spark, [4, 22, 47, 99, 255], values.number_format, "int") == ["lowerLetter", "decimalZero", "chosung", "decimal", "decimal"]
    assert column(spark, ["accent3", "ACCENT5", "bg2", "followedHyperlink", "x"], values.scheme_color) == ["#70ad47", "#7030a0", "#f3f4f6", "#954f72", None]
    own = F.create_map(F.lit("accent1"), F.lit("#123456"))
    marks = ['<a:srgbClr val="00ff00"><a:alpha val="40000"/></a:srgbClr>', '<a:sysClr val="windowText" lastClr="010203"/>', '<a:schemeClr val=" Accent1 "/>', '<a:schemeClr val="accent2"/>', '<a:schemeClr val="phClr"/>', "<a:noFill/>"]
    found = [tuple(x) if x else None for x in column(spark, marks, lambda c: values.drawing_color(c, own))]
    assert [f and (f[0].lower(), f[1]) for f in found] == [("#00ff00", 0.4), ("#010203", None), ("#123456", None), ("#ed7d31", None), None, None]
    assert column(spark, ["50000", "-1", "900000", "x"], values.percent_of_thousandths) == [0.5, None, 1.0, None]
    assert [(r.width_px, r.height_px) for r in column(spark, ["position:absolute;width:72pt; height:1in"], values.vml_size)] == [(96, 96)]
    assert column(spark, ['<a x="1" b="2"/>', "<a>"], lambda t: values.set_attribute(t, "b", F.lit('q"'))) == ['<a x="1" b="q&quot;"/>', '<a b="q&quot;">']
    assert column(spark, ["a<w:txbxContent>b</w:txbxContent>c"], values.without_text_boxes) == ["ac"]
    assert [tuple(x) if x else None for x in column(spark, ["1280x720", "0x1"], values.viewport)] == [(1280, 720), None]
    assert column(spark, ["<w:body>x</w:body>", "y"], values.body_xml) == ["x", "y"]


def test_transactions(spark):
    t = history.Transactions("a", limit=2)
    for v in "bcd":
        t.commit(v)
    assert (t.value, len(t.past), t.version) == ("d", 2, 3)
    t.undo(), t.undo(), t.undo()
    assert (t.value, len(t.past), len(t.future)) == ("b", 0, 2)
    t.redo()
    assert t.value == "c"
    t.commit("c", caret=3)  # only the caret: redo stays
    assert len(t.future) == 1 and t.caret == 3
    t.commit("x", push=False)
    assert (len(t.future), len(t.past)) == (0, 1)
    rows = [("s", 0, "commit", "a", None), ("s", 1, "commit", "b", None), ("s", 2, "undo", None, None), ("t", 0, "replace", "z", None), ("t", 1, "commit", "y", False)]
    got = {r.session_id: (r.value, r.undo_depth, r.redo_depth) for r in history.replay(spark.createDataFrame(rows, "session_id string, seq int, type string, text string, push boolean")).collect()}
    assert got == {"s": ("a", 1, 1), "t": ("y", 0, 0)}


def test_manifests(spark):
    good = "a" * 64
    cases = spark.createDataFrame([(1, "c1", "a/b.docx", good, 612.0, 792.0), (2, "C 2", "/x", "q", 0.0, 1.0), (1, "c1", "a", good, 1.0, 1.0)], "schema_version int, case_id string, path string, sha256 string, width_points double, height_points double")
    assert sorted((r.key, r.rule) for r in validation.manifest_issues(cases).collect()) == [("C 2", "case-id"), ("C 2", "geometry"), ("C 2", "path"), ("C 2", "schema-version"), ("C 2", "sha256"), ("c1", "duplicate-case")]
    good = [
        '{"type": "select-paragraph", "nodeIndex": 3}', '{"type": "select-table-cell", "tableIndex": 0, "rowIndex": 0, "cellIndex": 1}', '{"type": "set-text-range", "range": null}', '{"type": "toggle-bold", "expect": {}}', '{"type": "set-text-color", "color": "#00ff00"}',
        '{"type": "set-text-range", "range": {"start": {"location": {"kind": "paragraph", "nodeIndex": 1}, "offset": 2}, "end": {"location": {"kind": "paragraph", "nodeIndex": 1}, "offset": 2}}}', '{"type": "set-font-size", "fontSizePt": 10.5}',
        '{"type": "set-alignment", "alignment": null}', '{"type": "toggle-list", "listType": "ordered"}', '{"type": "insert-table-column", "tableIndex": 1, "cellIndex": 0, "direction": "left"}', '{"type": "commit-paragraph-text", "nodeIndex": 0, "text": ""}',
        '{"type": "create-comment", "text": "t", "options": {"author": "a", "initials": "b", "date": "c"}}', '{"type": "set-comment-resolved", "commentId": 4, "resolved": false}', '{"type": "set-highlight", "color": null}', '{"type": "undo"}',
    ]
    bad = [
        ('{"type": "fly"}', "type"), ("not json", "type"), ('{"type": "undo", "nodeIndex": 1}', "fields"), ('{"type": "select-paragraph", "nodeIndex": -1}', "nodeIndex"), ('{"type": "select-paragraph", "nodeIndex": 1000001}', "nodeIndex"),
        ('{"type": "commit-paragraph-text", "nodeIndex": 1}', "text"), ('{"type": "create-comment", "text": " ", "options": {"author": "a", "initials": "b", "date": "c"}}', "text"), ('{"type": "create-comment", "text": "t", "options": {"author": "a"}}', "options"),
        ('{"type": "set-text-color", "color": "#00FF00"}', "color"), ('{"type": "set-font-family", "fontFamily": " x"}', "fontFamily"), ('{"type": "set-font-size", "fontSizePt": 500}', "fontSizePt"), ('{"type": "set-alignment", "alignment": "up"}', "alignment"),
        ('{"type": "insert-table-row", "tableIndex": 1, "rowIndex": 0, "direction": "left"}', "direction-above"), ('{"type": "set-comment-resolved", "commentId": 4, "resolved": 1}', "resolved"), ('{"type": "set-text-range"}', "range"),
        ('{"type": "set-text-range", "range": {"start": {"location": {"kind": "paragraph", "nodeIndex": 1}, "offset": 3}, "end": {"location": {"kind": "paragraph", "nodeIndex": 1}, "offset": 2}}}', "range"),
    ]
    acts = spark.createDataFrame([("g", i, x) for i, x in enumerate(good)] + [("b", i, x) for i, (x, _) in enumerate(bad)] + [("o", 1, good[0])], "scenario_id string, seq int, action string")
    assert sorted((r.key, r.rule) for r in validation.edit_action_issues(acts).collect()) == sorted([(f"b/{i}", rule) for i, (_, rule) in enumerate(bad)] + [("o/1", "order")])
    assert [r.rule for r in validation.edit_action_issues(acts, 15).where("rule = 'length'").collect()] == ["length"]
    expect = spark.createDataFrame([("changed", "a" * 32, "b" * 32), ("changed", "a" * 32, "a" * 32), ("same-as-source", "a" * 32, "b" * 32), ("x", "a" * 32, "b" * 32), ("changed", None, "b" * 32)], "e string, a string, b string")
    assert [r.c for r in expect.select(validation.expectation_issue(F.col("e"), F.col("a"), F.col("b")).alias("c")).collect()] == [None, "unchanged", "changed", "expectation", "digest"]
    assert column(spark, ['{"paragraphCount": 3, "other": 1}'], validation.comparable_summary) == [{"paragraphCount": "3"}]
    done, wrong = validation.edit_results(spark.createDataFrame([("s1", "a/b.docx", "a" * 64), ("s2", "/a", "b")], "scenario_id string, path string, sha256 string"))
    assert done.where("scenario_id = 's1'").collect()[0].source.path == "a/b.docx" and sorted((r.key, r.rule) for r in wrong.collect()) == [("s2", "path"), ("s2", "sha256")]
    scenarios = spark.createDataFrame([("e1", "c1"), ("c1", "zz")], "scenario_id string, case_id string")
    joined, bad = validation.bound_scenarios(scenarios, cases.limit(1))
    assert joined.count() == 1 and sorted((r.key, r.rule) for r in bad.collect()) == [("c1", "id-collision"), ("c1", "unknown-source")]


def test_signatures(spark):
    from folioframe.functions import signature as s

    got = [r[0] for r in spark.createDataFrame([(1, "a"), (1, "a"), (2, None), (1, "x" * 300 + "y" + "x" * 300), (1, "x" * 301 + "y" + "x" * 299)], "n int, t string").select(s.signature(F.struct("n", "t"))).collect()]
    assert got[0] == got[1] and len(set(got)) == 4 and all(len(x) == 32 for x in got)
    meta = column(spark, ['{"sections": [1], "warnings": 5}', '{"sections": [1]}', "{}"], s.metadata_signature)
    assert meta[0] == meta[1] != meta[2]



def test_reconciliation(spark):
    from folioframe.operators import reconcile

    assert reconcile.search(lambda s: round(10 / s), 10, 12)[1] == 12 and 0.8 < reconcile.search(lambda s: round(10 / s), 10, 12)[0] < 0.88
    assert reconcile.search(lambda s: 10, 10, 20) == (1.0, 10) and reconcile.search(lambda s: 10, 10, 9) == (1.0, 10)
    rows = spark.createDataFrame([("d", i, 100.0, 1) for i in range(30)], "doc_id string, node_index int, height_px double, line_count int")
    r = reconcile.reconcile(rows, spark.createDataFrame([("d", 4)], "doc_id string, target int"), 1000.0).first()
    assert (r.initial, r.pages) == (3, 4) and 0.8 < r.scale < 1
    t = lambda *x: spark.range(1).select(reconcile.reduction_allowed(*[F.lit(v) for v in x])).first()[0]
    assert (t(5, 6, False, 1, False), t(5, 4, True, 4, True), t(5, 4, True, 5, False), t(5, 4, False, 1, True), t(5, 4, False, 1, False)) == (True, True, False, False, True)


def test_conflicting_grids(spark):
    from folioframe.operators import tables

    def regrid(grid, rows):
        df = spark.createDataFrame([(1, i, k, span, w, cont, grid) for i, row in enumerate(rows) for k, (span, w, cont) in enumerate(row)], "table_id int, row int, cell int, span int, width_twips int, continued boolean, grid array<bigint>")
        found = tables.snapped_grid(df).orderBy("row", "cell").collect()
        return found[0].grid, [[r.span for r in found if r.row == i] for i in range(len(rows))]

    cell = lambda w, span=1, cont=False: (span, w, cont)
    # A uniform grid yields to widths; rows with other boundaries share their union.
    assert regrid([1000, 1000], [[cell(400), cell(1600)], [cell(1200), cell(800)]]) == ([400, 800, 800], [[1, 2], [2, 1]])
    assert regrid([1000, 1000], [[cell(1000), cell(None)], [cell(1010), cell(990)]]) == ([1000, 1000], [[1, 1], [1, 1]])  # not all measured, no conflict
    assert regrid([500, 1500], [[cell(520), cell(1480)], [cell(300), cell(1700)]]) == ([500, 1500], [[1, 1], [1, 1]])  # one row of two
    assert regrid([500, 1500], [[cell(1400), cell(600)]]) == ([1400, 600], [[1, 1]])
    assert regrid([1000], [[cell(400), cell(1600)]]) == ([1000], [[1, 1]])  # the spans don't address the grid
    # What continues is as wide as what it continues.
    assert regrid([1000, 1000], [[cell(400), cell(1600)], [cell(1000, cont=True), cell(1600)]]) == ([400, 1600], [[1, 1], [1, 1]])
    assert regrid([1000, 1000], [[cell(1000), cell(1000)], [cell(1030), cell(970)]])[1] == [[1, 1], [1, 1]]


def test_structure_metrics(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    a, b = rng.random((29, 23)) < 0.1, rng.random((29, 23)) < 0.02
    rows = [(1, y, x, 29, 23, bool(a[y, x]), bool(b[y, x])) for y in range(29) for x in range(23)] + [(2, y, x, 4, 8, False, x == 3) for y in range(4) for x in range(8)]
    df = spark.createDataFrame(rows, "page int, y int, x int, height int, width int, ink_a boolean, ink_b boolean")
    got = {r.page: r for r in compare.structure_metrics(df, ["page"]).collect()}
    mean = lambda m, n, axis: np.array([x.mean() for x in np.array_split(m, n, axis=axis)])
    grid = lambda m: np.array([c.mean() for r in np.array_split(m, 8, axis=0) for c in np.array_split(r, 6, axis=1)])
    edges = lambda m: [np.where(m.any(axis=k))[0][i] / m.shape[1 - k] for k in (1, 0) for i in (0, -1)]
    parts = [abs(a.mean() - b.mean()), np.abs(mean(a, 12, 0) - mean(b, 12, 0)).mean(), np.abs(mean(a, 8, 1) - mean(b, 8, 1)).mean(), np.abs(grid(a) - grid(b)).mean()]
    weight = min(1.0, (a.mean() + b.mean()) / 2 / 0.05)
    whole = (sum(parts) + weight * sum(abs(x - y) for x, y in zip(edges(a), edges(b), strict=True))) / (4 + 4 * weight)
    r = got[1]
    assert np.allclose([r.coverage_diff, r.vertical_diff, r.horizontal_diff, r.grid_diff, r.edge_weight, r.layout_structure_diff], [*parts, weight, whole], atol=2e-6)
    assert got[2].left_diff == 1 - 3 / 8 and got[2].right_diff == 3 / 8
    profile = compare.band_profile(df.where("page = 1").withColumn("ink", F.col("ink_a")), ["page"], "y", 12).orderBy("band").collect()
    assert np.allclose([r.ink for r in profile], mean(a, 12, 0))

"""Editing intents, carets and manifests."""

import json

import pytest
from pyspark.sql import functions as F

from folioframe.operators import intents, pages, reconcile, validation


def one(spark, column):
    return spark.range(1).select(column.alias("c")).collect()[0].c


@pytest.mark.parametrize(
    ("kind", "data", "pasted", "want"),
    [
        ("insertCompositionText", "x", None, None), ("insertText", "x", "y", ("insertText", "x", None, None)), ("insertFromPaste", "x", "y", ("insertText", "y", None, None)), ("insertFromDrop", None, None, ("insertText", "", None, None)),
        ("insertTranspose", "ab", None, ("replaceText", "ab", None, None)), ("insertParagraph", None, None, ("insertParagraph", None, None, None)), ("deleteEntireSoftLine", None, None, ("deleteContent", None, "backward", "entire-line")),
        ("deleteByCut", None, None, ("deleteRange", None, None, None)), ("formatBold", None, None, ("blocked", None, None, None)),
    ],
)
def test_intents(spark, kind, data, pasted, want):
    got = one(spark, intents.intent(F.lit(kind), F.lit(data).cast("string"), F.lit(pasted).cast("string")))
    assert (tuple(got) if got else None) == want


def test_applied_intents(spark):
    T = "ab cd  ef\nsecond \U0001f600line"
    cases = [
        ("insertText", "x\r\ny\rz", None, None, 2, 2, ("abx\ny\nz cd  ef\nsecond \U0001f600line", 7)), ("insertText", "", None, None, 2, 2, None), ("replaceText", "", None, None, 0, 3, ("cd  ef\nsecond \U0001f600line", 0)), ("insertLineBreak", None, None, None, 99, 99, (T + "\n", 23)),
        ("deleteRange", None, None, None, 3, 3, None), ("deleteRange", None, None, None, 0, 10, ("second \U0001f600line", 0)), ("deleteContent", None, "backward", "word", 1, 4, ("a" + T[4:], 1)), ("deleteContent", None, "backward", "character", 0, 0, None),
        ("deleteContent", None, "backward", "character", 18, 18, (T[:17] + T[18:], 17)), ("deleteContent", None, "forward", "character", 17, 17, (T[:17] + T[18:], 17)), ("deleteContent", None, "backward", "word", 7, 7, ("ab ef\nsecond \U0001f600line", 3)),
        ("deleteContent", None, "forward", "word", 2, 2, ("ab  ef\nsecond \U0001f600line", 2)), ("deleteContent", None, "backward", "line", 13, 13, (T[:10] + T[13:], 10)), ("deleteContent", None, "backward", "line", 10, 10, None),
        ("deleteContent", None, "forward", "line", 3, 3, ("ab \nsecond \U0001f600line", 3)), ("deleteContent", None, "forward", "line", 9, 9, (T[:9] + T[10:], 9)), ("deleteContent", None, "backward", "entire-line", 4, 4, (T[9:], 0)), ("deleteContent", None, "forward", "character", 99, 99, None),
        ("insertParagraph", None, None, None, 1, 1, None), ("deleteContent", None, "forward", "line", 12, 12, (T[:12], 12)),
    ]
    df = spark.createDataFrame([(i, T, c[4], c[5], (*c[:4],)) for i, c in enumerate(cases)], f"i int, t string, a int, b int, todo {intents.INTENT}")
    got = [tuple(r.e) if r.e else None for r in df.withColumn("e", intents.applied(F.col("t"), F.col("a"), F.col("b"), F.col("todo"))).orderBy("i").collect()]
    for case, g in zip(cases, got, strict=True):
        assert g == case[-1], case


def test_bursts_and_merged_cells(spark):
    goes_on = lambda *x: one(spark, intents.coalesces(*map(F.lit, x)))
    assert goes_on("k", 3, 1500, "k", 3, 500) and not goes_on("k", 3, 1501, "k", 3, 500) and not goes_on("k", 2, 600, "k", 3, 500) and not goes_on("j", 3, 600, "k", 3, 500)
    cell = lambda texts, k: one(spark, intents.merged_cell(F.array(*map(F.lit, texts)), F.lit(k)))
    assert tuple(cell(["ab", "cd", "ef"], 1)) == ("abcd\nef", 0, 2) and tuple(cell(["a\nb", "cd", "ef"], 2)) == ("a\nb\ncdef", 2, 2) and cell(["a"], 0) is None and cell(["a", "b"], 2) is None
    assert [one(spark, intents.intent_class(F.lit(k))) for k in ("insertLineBreak", "deleteRange", "historyUndo")] == ["insert", "delete", None]
    selections, blocks = spark.createDataFrame([("d", "paragraph", 1), ("d", "table-cell", 0)], "doc_id string, kind string, node_index int"), spark.createDataFrame([("d", 0, "table"), ("d", 1, "paragraph")], "doc_id string, node_index int, kind string")
    assert [r.node_index for r in intents.paragraph_at(selections, blocks).collect()] == [1]
    assert one(spark, intents.large_raster(F.repeat(F.lit("data:image/png;"), 4000))) and not one(spark, intents.large_raster(F.lit("data:image/png"))) and not one(spark, intents.large_raster(F.repeat(F.lit("data:image/svg"), 4000)))


def test_clipboard(spark):
    held = [
        {"type": "paragraph", "style": {"align": "left"}, "children": [{"type": "text", "text": "a", "link": "u", "style": {"bold": True}}, {"type": "image", "src": "s", "widthPx": 3, "data": [255, 0, 256]}, {"type": "gap"}, None]},
        {"type": "table"}, 5, {"type": "paragraph", "children": [{"type": "form-field", "checked": True, "options": [{"displayText": "x", "value": "1"}, {"displayText": ""}]}]}, {"type": "paragraph"},
    ]
    df = spark.createDataFrame([(1, json.dumps(held)), (2, "no"), (3, "{}")], "i int, text string")
    a, b, c = intents.clipboard_runs(df).orderBy("paragraph", "run").collect()
    assert (a.i, a.kind, a.run_text, a.link, json.loads(a.style), json.loads(a.paragraph_style)) == (1, "text", "a", "u", {"bold": True}, {"align": "left"})
    assert (b.kind, b.src, b.width_px, b.bytes) == ("image", "s", 3.0, b"\xff\x00\x00") and (c.paragraph, c.kind, c.checked, [tuple(o) for o in c.options]) == (1, "form-field", True, [("x", "1")])


def test_carets_and_slices(spark):
    fragments = spark.createDataFrame([("d", 0, 1, 0, 4, 10.0, 0.0, 40.0, 20.0), ("d", 0, 1, 4, 9, 10.0, 20.0, 50.0, 20.0), ("d", 1, 1, 9, 12, 5.0, 0.0, 30.0, 20.0)], "doc_id string, page int, node_index int, start int, end int, x double, y double, width double, height double")
    targets = spark.createDataFrame([("d", 1, o) for o in (0, 4, 6, 12, 13)], "doc_id string, node_index int, offset int")
    got = {r.offset: (r.page, r.x, r.y) for r in pages.caret_rects(targets, fragments).collect()}
    assert got == {0: (0, 10.0, 0.0), 4: (0, 50.0, 0.0), 6: (0, 10.0, 20.0), 12: (1, 35.0, 0.0)}
    measured = fragments.withColumn("advances", F.transform(F.sequence(F.lit(0), F.col("end") - F.col("start")), lambda n: n * 2.0))
    assert {r.offset: r.x for r in pages.caret_rects(targets, measured).collect()}[6] == 14.0
    new = fragments.limit(1).withColumn("x", F.lit(0.0))
    assert sorted((r.page, r.x) for r in pages.with_fragments(fragments, new).collect()) == [(0, 0.0), (1, 5.0)]
    lines = spark.createDataFrame([("d", 0, k, 20.0 * k, 20.0) for k in range(5)], "doc_id string, node_index int, line int, y double, line_height double")
    cut = pages.line_slices(lines, spark.createDataFrame([("d", 0, 2, 4)], "doc_id string, node_index int, from int, to int")).orderBy("line").collect()
    assert [(r.line, r.y, r.line_count, r.height) for r in cut] == [(2, 0.0, 2, 40.0), (3, 20.0, 2, 40.0)]
    ops = spark.createDataFrame([("s", 0, "set-selection", None, "a"), ("s", 1, "set-floating-draft", "t", "1"), ("s", 2, "set-floating-draft", "u", "2"), ("s", 3, "clear-floating-draft", "t", None), ("s", 4, "set-selection", None, "b")], "snapshot_id string, seq int, kind string, target_key string, value string")
    selections, drafts = pages.snapshot_states(ops)
    assert [r.selection for r in selections.collect()] == ["b"] and [(r.target_key, r.draft) for r in drafts.collect()] == [("u", "2")]
    segments = spark.createDataFrame([("d", 0, 0, None), ("d", 0, 1, 7), ("d", 0, 2, 3), ("d", 1, 0, None)], "doc_id string, page int, ord int, node_index int")
    assert [(r.page, r.node_index) for r in pages.page_starts(segments).collect()] == [(0, 7)]


def test_measured_or_estimated(spark):
    docs = spark.createDataFrame([("a", False, True), ("b", True, True), ("c", False, True), ("e", False, True)], "doc_id string, edited boolean, has_measured boolean")
    rows = lambda split, n: [(d, k, split if d != "c" else False) for d in "abc" for k in range(n)]
    schema = "doc_id string, page int, split boolean"
    got = reconcile.measured_or_estimated(docs, spark.createDataFrame(rows(True, 3), schema), spark.createDataFrame(rows(True, 2), schema))
    assert {r.doc_id: r.use_estimated for r in got.collect()} == {"a": True, "b": False, "c": False, "e": False}


def test_capture_manifests(spark):
    refs = spark.createDataFrame([("c1", "r2", "s"), ("c1", "r1", "s"), ("c2", "r1", "t"), ("c2", "r1", "t")], "case_id string, reference_id string, source string")
    groups, bad = validation.capture_targets(refs)
    assert sorted((r.case_id, r.source, r.reference_ids) for r in groups.collect()) == [("c1", "s", ["r1", "r2"]), ("c2", "t", ["r1", "r1"])] and [(r.key, r.rule) for r in bad.collect()] == [("c2/r1", "duplicate")]
    groups, bad = validation.capture_targets(refs, ["c1", "zz"], ["r1"])
    assert [(r.case_id, r.reference_ids) for r in groups.collect()] == [("c1", ["r1"])] and [(r.key, r.rule) for r in bad.collect()] == [("zz", "unknown")]
    assert one(spark, validation.page_path(F.lit("c"), F.lit("r"), F.lit(7))) == "c/r/page-0007.png"
    shots = spark.createDataFrame([("c", "r", n, 10.0, 20.0, f"c/r/page-000{n}.png", "a" * 64) for n in (2, 1)], "case_id string, reference_id string, page_number int, width_points double, height_points double, image_path string, image_sha256 string")
    manifest, wrong = validation.viewer_pages(shots)
    assert [p.page_number for p in manifest.collect()[0].pages] == [1, 2] and wrong.count() == 0
    cases = [("paragraph-text", "x", "y", "x", "1", "2", None), ("paragraph-text", "x", "x", "x", "1", "2", "already"), ("paragraph-text", "x", "y", "z", "1", "2", "unexpected"), ("text-style", "x", "y", "x", "1", "1", "unchanged"), ("selection", "x", "x", "x", None, None, None), ("selection", "x", "x", None, None, None, "not-observed")]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, k string, e string, b string, a string, bd string, ad string, want string").withColumn("got", validation.postcondition_issue(*[F.col(c) for c in ("k", "e", "b", "a", "bd", "ad")]))
    assert all(r.got == r.want for r in df.collect())

"""Laws that hold for any input, on generated ones. No session is needed."""

import io
import zipfile

from hypothesis import given, settings
from hypothesis import strategies as st

from folioframe.operators.edits import create_comment, distribute, resolve_revision
from folioframe.operators.history import History, Transactions
from folioframe.operators.lines import break_lines, row_parts
from folioframe.operators.segmentation import COLUMNS, Block, Paginator
from folioframe.sources import packages, render
from folioframe.sources.xmltree import balanced, decode, encode, parse

TEXT = st.text(st.characters(exclude_categories=["Cs"], exclude_characters="\0\r"), max_size=60)


@given(TEXT)
def test_encoded_text_is_read_again(text):
    assert decode(encode(text)) == text
    assert parse(f'<a b="{encode(text, True)}">{encode(text)}</a>').nodes()[0].text() == text


@given(st.text("<>/ab:=\"' p", max_size=80))
def test_any_markup_parses(text):
    root = parse(text)
    assert all(0 <= n.start <= n.end <= len(text) for n in root.walk())
    found = balanced(text, "a", "p")
    assert all(x[1] <= y[0] for x, y in zip(found, found[1:], strict=False))


@given(TEXT, st.lists(TEXT, max_size=5))
def test_distributed_text_is_the_text(text, old):
    runs = [{"style": i % 2, "text": t} for i, t in enumerate(old)]
    new = distribute(text, runs)
    assert "".join(r["text"] for r in new) == text
    assert distribute("".join(old), runs) == [r for r in distribute("".join(old), runs)]


@given(st.text("abc d", min_size=1, max_size=30), st.data())
def test_comments_keep_the_text(text, data):
    xml = render.paragraph(None, [{"text": text[:3], "style": {"bold": True}}, {"text": text[3:]}] if len(text) > 3 else [{"text": text}])
    start = data.draw(st.integers(0, len(text) - 1))
    end = data.draw(st.integers(start + 1, len(text)))
    ok, _, out = create_comment(xml, start, end, 7)
    assert ok and parse(out).text() == text and out.count("commentRangeStart") == 1 and out.count("commentRangeEnd") == 1


@given(TEXT, TEXT, st.booleans(), st.booleans())
def test_revisions_leave_one_of_two_texts(before, changed, insertion, accept):
    tag, inner = ("w:ins", "w:t") if insertion else ("w:del", "w:delText")
    xml = f'<w:p><w:r><w:t>{encode(before)}</w:t></w:r><{tag} w:id="1"><w:r><{inner}>{encode(changed)}</{inner}></w:r></{tag}></w:p>'
    ok, reason, out = resolve_revision(xml, "1", accept)
    assert ok and reason is None and parse(out).text() == before + (changed if insertion == accept else "") and "delText" not in out


@given(st.lists(st.sampled_from(["commit", "undo", "redo", "reset"]), max_size=60), st.integers(1, 5))
def test_histories_agree(actions, limit):
    h, t = History(limit=limit), Transactions(0, limit)
    for k, a in enumerate(actions):
        h.apply(a)
        if a == "commit":
            t.commit(k + 1)
        elif a == "reset":
            t.replace(-k)
        else:
            getattr(t, a)()
        assert (h.past, h.future) == (len(t.past), len(t.future)) and h.past <= limit


@given(st.floats(1, 500), st.lists(st.tuples(st.floats(-50, 500), st.floats(-20, 60), st.floats(0, 200), st.floats(0, 60)), max_size=6))
def test_row_parts_are_free(container, exclusions):
    parts = row_parts(container, 10, 20, exclusions)
    assert all(x >= 0 and x + w <= container + 1e-6 for x, w in parts)
    for x, y, w, h in exclusions:
        if y < 30 and y + h > 10:
            assert all(px + pw <= x + 1e-6 or px >= x + w - 1e-6 or w <= 0 for px, pw in parts)


@given(st.text("ab \n", max_size=80), st.integers(1, 12))
def test_lines_hold_all_words(text, width):
    got = break_lines(text, width, 1, {}, 1.0)
    assert "".join("".join(text[a:b].split()) for a, b, *_ in got) == "".join(text.split())
    assert all(len(text[a:b].strip(" ")) <= width for a, b, *_ in got)


@settings(max_examples=150)
@given(st.lists(st.tuples(st.sampled_from(["paragraph", "table"]), st.integers(1, 40), st.integers(0, 20), st.booleans(), st.booleans(), st.lists(st.integers(1, 400), max_size=6)), max_size=25), st.integers(120, 500))
def test_pagination_places_everything_once(rows, height):
    held = []
    for i, (kind, lines, gap, keep, apart, heights) in enumerate(rows):
        own = {"kind": kind, "height_px": lines * 20.0 + gap, "line_height_px": 20.0, "line_count": lines, "after_px": float(gap), "keep_next": keep, "page_break_before": apart, "row_heights_px": [float(h) for h in heights] if kind == "table" else None}
        held.append(Block(i, {c: d for c, (_, d) in COLUMNS.items()} | own))
    found = Paginator(held, float(height)).run()
    assert [(p, o) for p, o, *_ in found] == sorted((p, o) for p, o, *_ in found)
    pages = sorted({p for p, *_ in found})
    assert pages == list(range(len(pages)))
    for i, (kind, lines, *_, heights) in enumerate(rows):
        mine = [x for x in found if x[2] == i]
        parts = [(x[3], x[4]) if kind == "table" else (x[5], x[6]) for x in mine]
        total = len(heights) if kind == "table" else lines
        if parts == [(None, None)]:
            continue
        rows_in_parts = {x[3]: [y[7:] for y in mine if y[3] == x[3]] for x in mine if x[7] is not None}
        for row, cut in rows_in_parts.items():  # a row's parts follow each other and are all of it
            assert cut[0][0] == 0 and sum(n for _, n in cut) == max(1, heights[row]) and all(a + n == b for (a, n), (b, _) in zip(cut, cut[1:], strict=False))
        parts = [x for k, x in enumerate(parts) if k == 0 or x != parts[k - 1]]
        assert parts[0][0] == 0 and parts[-1][1] == total and all(a[1] == b[0] for a, b in zip(parts, parts[1:], strict=False))


@given(st.dictionaries(st.text("abc/.", min_size=1, max_size=8).filter(lambda s: not s.endswith("/")), st.binary(max_size=200), min_size=1, max_size=6))
def test_archives_are_deterministic(parts):
    raw = packages.zip_bytes(parts)
    assert raw == packages.zip_bytes(dict(reversed(parts.items())))
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        assert z.testzip() is None and {n: z.read(n) for n in z.namelist()} == parts


@given(st.binary(max_size=600))
def test_any_bytes_give_rows(content):
    assert all(r[4] for r in packages.parts_of(content))
    assert all(r[4] for r in packages.parts_of(packages.MAGIC + content))

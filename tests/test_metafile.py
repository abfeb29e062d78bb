import struct
from urllib.parse import unquote

from folioframe.sources import metafile


def emf(*records, bounds=(0, 0, 100, 50)):
    head = struct.pack("<II4i", 1, 88, *bounds).ljust(88, b"\0")
    return head + b"".join(struct.pack("<II", kind, 8 + len(body)) + body for kind, body in records) + struct.pack("<II", 14, 8)


def points(*xy):
    return b"\0" * 16 + struct.pack("<I", len(xy) // 2) + struct.pack(f"<{len(xy)}h", *xy)


ints = lambda *x: struct.pack(f"<{len(x)}i", *x)


def test_polygons_and_pens():
    svg = metafile.to_svg(emf((9, ints(200, 100)), (11, ints(100, 50)), (39, struct.pack("<III", 1, 0, 0x0000FF)), (37, struct.pack("<I", 1)), (38, struct.pack("<IIiiI", 2, 0, 4, 0, 0x00FF00)), (37, struct.pack("<I", 2)), (86, points(0, 0, 20, 0, 21, 11))))
    assert svg == (
        '<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 100 50" width="100" height="50" preserveAspectRatio="xMidYMid meet"><path d="M0 0L10 0L10.5 5.5Z" fill="#ff0000" fill-rule="evenodd" stroke="#00ff00" stroke-width="2"/></svg>'
    )


def test_paths_clips_and_stock():
    path = [(59, b""), (27, ints(1, 2)), (54, ints(3, 4)), (88, points(1, 1, 2, 2, 3, 3)), (61, b""), (60, b"")]
    svg = metafile.to_svg(emf((19, ints(2)), *path, (67, ints(5)), (37, struct.pack("<I", 0x80000004)), (37, struct.pack("<I", 0x80000008)), *path, (63, b"\0" * 16), (75, ints(0, 5)), (64, b"\0" * 16)))
    d = "M1 2L3 4C1 1 2 2 3 3Z"
    assert f'<defs><clipPath id="c0" clip-rule="nonzero"><path d="{d}"/></clipPath></defs>' in svg
    assert f'<g clip-path="url(#c0)"><path d="{d}" fill="#000000" fill-rule="nonzero" stroke="none"/></g><path d="{d}" fill="none" stroke="none"/>' in svg
    many = b"\0" * 16 + struct.pack("<4I", 2, 4, 2, 2) + struct.pack("<8h", 0, 0, 1, 1, 2, 2, 3, 3)
    assert 'd="M0 0L1 1ZM2 2L3 3Z" fill="#ffffff"' in metafile.to_svg(emf((91, many))) and 'd="M0 0L1 1M2 2L3 3" fill="none"' in metafile.to_svg(emf((90, many)))


def test_what_cannot_be_drawn(spark):
    assert metafile.to_svg(None) is None and metafile.to_svg(b"x" * 100) is None and metafile.to_svg(emf(bounds=(0, 0, 0, 5))) is None
    for record in ((84, b"\0" * 40), (54, ints(1, 1)), (67, ints(5)), (85, points(0, 0, 1, 1)), (75, ints(0, 1)), (86, points(0, 0)[:-2])):
        assert metafile.to_svg(emf(record)) is None, record
    assert metafile.to_svg(emf((70, b"comment!"), (17, ints(8)))) is not None
    df = spark.createDataFrame([(bytearray(emf()),), (bytearray(b"no"),), (None,)], "c binary").select(metafile.picture_uri("c").alias("u"))
    a, b, c = [r.u for r in df.collect()]
    assert unquote(a.partition(",")[2]).startswith("<svg") and a.startswith("data:image/svg+xml;charset=utf-8,%3Csvg") and b is None and c is None

"""Legacy binary documents: streams of a compound file, and what they say as the parts of a package.

Reads what the published binary format describes: file sectors, mini sectors and the directory here, the document in legacy.
"""

from __future__ import annotations

import struct

FREE, END = 0xFFFFFFFF, 0xFFFFFFFE
MAX_SECTORS = 1 << 22


def streams(data: bytes) -> dict[str, bytes]:
    """The streams of a compound file by name."""
    if len(data) < 512 or data[:8] != bytes.fromhex("D0CF11E0A1B11AE1"):
        raise ValueError("not a compound file")
    size, mini = 1 << struct.unpack_from("<H", data, 30)[0], 1 << struct.unpack_from("<H", data, 32)[0]
    first_dir, cutoff, first_mini, first_difat, n_difat = struct.unpack_from("<I", data, 48)[0], *struct.unpack_from("<II", data, 56), *struct.unpack_from("<II", data, 68)
    sector = lambda i: data[(i + 1) * size : (i + 2) * size]
    difat, at = list(struct.unpack_from("<109I", data, 76)), first_difat
    for _ in range(min(n_difat, MAX_SECTORS)):
        if at in (FREE, END):
            break
        more = struct.unpack(f"<{size // 4}I", sector(at))
        difat, at = difat + list(more[:-1]), more[-1]
    fat: list[int] = []
    for i in difat:
        if i < END:
            fat += struct.unpack(f"<{size // 4}I", sector(i).ljust(size, b"\xff"))

    def chain(start: int, table: list[int], get) -> bytes:
        out, seen = [], 0
        while start < END and start < len(table):
            out.append(get(start))
            start, seen = table[start], seen + 1
            if seen > len(table):
                raise ValueError("a sector chain is a loop")
        return b"".join(out)

    directory = chain(first_dir, fat, sector)
    entries = []
    for k in range(0, len(directory) - 127, 128):
        n, kind = struct.unpack_from("<HB", directory, k + 64)
        if kind in (1, 2, 5) and 2 <= n <= 64:
            entries.append((directory[k : k + n - 2].decode("utf-16-le", "replace"), kind, struct.unpack_from("<I", directory, k + 116)[0], struct.unpack_from("<I", directory, k + 120)[0]))
    root = next((e for e in entries if e[1] == 5), None)
    mini_fat_raw = chain(first_mini, fat, sector) if first_mini < END else b""
    mini_fat = list(struct.unpack(f"<{len(mini_fat_raw) // 4}I", mini_fat_raw))
    mini_data = chain(root[2], fat, sector) if root else b""
    out = {}
    for name, kind, start, length in entries:
        if kind == 2:
            small = length < cutoff
            out[name] = chain(start, mini_fat if small else fat, (lambda i: mini_data[i * mini : (i + 1) * mini]) if small else sector)[:length]
    return out


def parts(data: bytes) -> dict[str, str | bytes]:
    """The parts of a package that says the same: text, runs, paragraphs, tables and sections, styles, lists, pictures."""
    from .legacy import LISTS, OVERRIDES, Document, lists, numbering_markup, styles_markup
    from .packages import DOCUMENT_OPEN

    doc = Document(streams(data))
    out: dict[str, str | bytes] = {"word/document.xml": f"{DOCUMENT_OPEN}<w:body>{doc.body()}</w:body></w:document>"}
    if any(doc.styles):
        out["word/styles.xml"] = styles_markup(doc.styles, doc.faces)
    found, over = lists(doc.part(LISTS), doc.part(OVERRIDES))
    if found or over:
        out["word/numbering.xml"] = numbering_markup(found, over, doc.faces)
    for i, picture in enumerate(doc.images(), 1):
        out[f"word/media/image{i}.{picture['extension']}"] = picture["bytes"]
    return out

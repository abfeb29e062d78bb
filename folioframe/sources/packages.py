"""Packages of word-processing documents as rows of parts, and back."""

from __future__ import annotations

import io
import struct
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAGIC = bytes.fromhex("D0CF11E0A1B11AE1")
TEXT = ("xml", "rels", "txt")
PARTS = "name string, is_text boolean, content string, bytes binary, error string"
#: A column's value can't have more bytes; a larger part is an error row of its own.
MAX_PART_BYTES = (1 << 31) - 1
DOCUMENT_OPEN = '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships">'
DEFAULT_SECTION = '<w:sectPr><w:pgSz w:w="12240" w:h="15840"/><w:pgMar w:top="1440" w:right="1440" w:bottom="1440" w:left="1440"/></w:sectPr>'


def is_text(name: str) -> bool:
    return name == "[Content_Types].xml" or "." in name and name.rpartition(".")[2].lower() in TEXT


def parts_of(content: bytes | None) -> list[tuple]:
    """(name, is_text, content, bytes, error) of each part; a package that can't be read is one row with an error."""
    from . import compound

    failed = lambda why: [(None, None, None, None, why)]
    if not content:
        return failed("empty input")
    if content[:8] == MAGIC:
        try:
            return [(n, True, x, None, None) if isinstance(x, str) else (n, False, None, x, None) for n, x in compound.parts(content).items()]
        except (ValueError, IndexError, struct.error, KeyError) as e:
            return failed(f"compound file: {e}")
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            found: dict[str, tuple] = {}
            for info in z.infolist():
                if info.filename.endswith("/"):
                    continue
                if info.compress_type not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
                    return failed(f"compression method {info.compress_type} of {info.filename}")
                if info.file_size > MAX_PART_BYTES:  # the other parts can be read all the same
                    found[info.filename] = (info.filename, is_text(info.filename), None, None, f"{info.filename} has {info.file_size} bytes")
                    continue
                raw = z.read(info)
                text = is_text(info.filename)
                found[info.filename] = (info.filename, text, raw.decode("utf-8", "replace") if text else None, None if text else raw, None)  # the last of a name wins
    except (zipfile.BadZipFile, zlib.error, struct.error, EOFError, NotImplementedError, RuntimeError, OSError) as e:
        return failed(f"zip: {e}")
    return list(found.values()) if "word/document.xml" in found else failed("no word/document.xml")


def read_parts(files: DataFrame, id_col: str = "path", content_col: str = "content") -> DataFrame:
    """files: a row for each package. doc_id, name, is_text, content, bytes, error."""
    rows = files.select(F.col(id_col).cast("string").alias("doc_id"), F.col(content_col).alias("content"))

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for doc, content in zip(frame["doc_id"], frame["content"], strict=True):
                out = pd.DataFrame(parts_of(bytes(content) if content is not None else None), columns=["name", "is_text", "content", "bytes", "error"], dtype=object)
                out.insert(0, "doc_id", doc)
                yield out

    return rows.mapInPandas(read, f"doc_id string, {PARTS}")


def read_packages(spark: SparkSession, path: str) -> DataFrame:
    """Parts of all files below a path."""
    return read_parts(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path))


def zip_bytes(parts: dict[str, bytes]) -> bytes:
    """A stored archive with the parts in name order and no times: the same parts give the same bytes."""
    if not parts:
        raise ValueError("a package needs a part")
    if len(parts) > 65535:
        raise ValueError("a package holds 65535 parts at most")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for name in sorted(parts):
            info = zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0))
            info.flag_bits |= 0x800
            info.create_system = 0
            z.writestr(info, parts[name])
    return out.getvalue()


def write_packages(parts: DataFrame) -> DataFrame:
    """doc_id, content (the package's bytes) from rows of parts. A package is built in one task; its parts must fit there."""
    rows = parts.where("error IS NULL AND name IS NOT NULL").select("doc_id", "name", F.coalesce(F.col("bytes"), F.col("content").cast("binary"), F.lit(b"")).alias("raw"))

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"doc_id": [frame["doc_id"].iloc[0]], "content": [zip_bytes({n: bytes(r) for n, r in zip(frame["name"], frame["raw"], strict=True)})]})

    return rows.groupBy("doc_id").applyInPandas(build, "doc_id string, content binary")


def upsert_parts(base: DataFrame, new: DataFrame) -> DataFrame:
    """base with the parts of new in place of those with the same name."""
    return base.join(new.select("doc_id", "name"), ["doc_id", "name"], "left_anti").unionByName(new)


def minimal_parts(spark: SparkSession, doc_ids: DataFrame, body: str = "<w:p/>") -> DataFrame:
    """The four parts that an empty document needs, for each doc_id."""
    fixed = {
        "[Content_Types].xml": '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>',
        "_rels/.rels": '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>',
        "word/_rels/document.xml.rels": '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"/>',
        "word/document.xml": f'<?xml version="1.0" encoding="UTF-8"?>{DOCUMENT_OPEN}<w:body>{body}{DEFAULT_SECTION}</w:body></w:document>',
    }
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(x).alias("content")) for n, x in fixed.items()]))
    return doc_ids.select(F.col("doc_id").cast("string").alias("doc_id"), each.alias("p")).select(
        "doc_id", "p.name", F.lit(True).alias("is_text"), "p.content", F.lit(None).cast("binary").alias("bytes"), F.lit(None).cast("string").alias("error")
    )


def new_relationships(requests: DataFrame, existing: DataFrame) -> DataFrame:
    """requests: doc_id, part, target, type; existing: doc_id, part, rid, target. The rid of each request: that of a relationship to
    the same target, else the next numbers behind the part's largest rIdn, in target order; is_new says which."""
    from pyspark.sql.window import Window

    wanted = requests.select("doc_id", "part", "target", "type").distinct()
    known = existing.groupBy("doc_id", "part", "target").agg(F.min("rid").alias("__rid"))
    top = existing.groupBy("doc_id", "part").agg(F.max(F.regexp_extract("rid", "^rId([0-9]+)$", 1).try_cast("bigint")).alias("__top"))
    joined = wanted.join(known, ["doc_id", "part", "target"], "left").join(top, ["doc_id", "part"], "left").withColumn("is_new", F.col("__rid").isNull())
    place = F.row_number().over(Window.partitionBy("doc_id", "part", "is_new").orderBy("target", "type"))
    rid = F.coalesce("__rid", F.concat(F.lit("rId"), (F.coalesce("__top", F.lit(0)) + place).cast("string")))
    return joined.select("doc_id", "part", "target", "type", rid.alias("rid"), "is_new")


def clipboard(runs: DataFrame) -> DataFrame:
    """Paragraphs as JSON: doc_id, node_index, payload; notes are left out."""
    kept = runs.where("kind <> 'note'").groupBy("doc_id", "node_index").agg(F.sort_array(F.collect_list(F.struct("run_index", "kind", "text", "style"))).alias("runs"))
    return kept.select("doc_id", "node_index", F.to_json(F.struct("runs")).alias("payload"))

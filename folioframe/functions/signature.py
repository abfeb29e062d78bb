"""Content signatures: change keys of values, equal for equal values in any process and on any machine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Metadata that shows on a page (fixed values).
VISIBLE = ("sections", "headerSections", "footerSections", "numberingDefinitions", "footnotes", "endnotes", "documentBackgroundColor", "compatibility")


def signature(value: Column) -> Column:
    """32 hexadecimal digits over all of a value's JSON text, keys in the order of its schema, null fields left out."""
    return F.md5(F.to_json(value))


def metadata_signature(metadata: Column) -> Column:
    """The signature of what shows on a page of a document's metadata (JSON text); other keys don't count."""
    return F.md5(F.to_json(F.array(*[F.get_json_object(metadata, f"$.{k}") for k in VISIBLE])))

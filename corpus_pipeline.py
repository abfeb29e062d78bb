"""The corpus pipeline: documents whose language is known, without copies and near copies, mixed to target sizes, packed.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept; all but the last return
the columns of documents. run writes each stage to the shared folder and reads it again as the next one's docs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from folioframe.llm.common import delete, discard, materialize, recorded
from folioframe.llm.exact_dedup import exact_dedup
from folioframe.llm.language_id import identified
from folioframe.llm.mixing import mixed
from folioframe.llm.near_dedup import near_dedup
from folioframe.llm.packing import packed

#: For each stage, the scratch tables of its calls whose result may not have been read yet.
_scratch: dict[int, list[list[str]]] = {}


def stage(number: int, apply: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage that first deletes the scratch tables of the stage before, whose written result is this one's docs."""

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if _scratch.get(number - 1):
            delete(spark, _scratch[number - 1].pop())
        with recorded() as made:
            out = apply(docs)
        _scratch.setdefault(number, []).append(made)
        return out

    return run_stage


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    (name, stage(k, f)) for k, (name, f) in enumerate([("language_id", identified), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mixing", mixed), ("packing", packed)])
]

#: Rounding by hashed coins, tokenizers and retrieval have no SQL; tests hold the stages against plain Python instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of packed sequences (see packing.pack) that documents of sf_dir give."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, apply in STAGES[:-1]:
        docs = materialize(apply(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)

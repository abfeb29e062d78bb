"""Shared plumbing of the training-data operators: shared scratch tables, row ids, column names."""

from __future__ import annotations

import contextlib
import gc
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.scratch import scratch_path

#: The white space of the operator contracts: ASCII space, tab, LF, VT, FF, CR.
SPACE = r"[\x20\x09-\x0D]"
TRIM = " \t\n\x0b\x0c\r"
#: Bytes of a bucket of a bucketed table, and how many buckets Spark allows.
BUCKET_BYTES, MAX_BUCKETS = 64 << 20, 100_000


_recording: list[list[str]] = []


@contextlib.contextmanager
def recorded() -> Iterator[list[str]]:
    """Collects the paths of the tables materialized inside."""
    made: list[str] = []
    _recording.append(made)
    try:
        yield made
    finally:
        _recording.remove(made)


def delete(spark: SparkSession, paths: list[str]) -> None:
    """Deletes materialized tables by path; one that is gone already is no error."""
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back.

    This cuts the lineage with files that outlive any executor; localCheckpoint would not. What nobody deletes
    before goes when the driver ends.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    for made in _recording:
        made.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, size: Column, name: str) -> DataFrame:
    """df as a table in the shared folder, dealt to buckets by a key, each with some BUCKET_BYTES of size: joins on the key then
    move the other side only. The table's entry in the catalog goes at once, its files when the driver ends."""
    spark = df.sparkSession
    total = df.agg(F.sum(size.cast("long"))).first()[0] or 0
    n = min(MAX_BUCKETS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // BUCKET_BYTES))
    path = scratch_path(spark, name)
    for made in _recording:
        made.append(path)
    table = f"scratch_{uuid.uuid4().hex}"
    df.repartition(n, key).write.format("parquet").bucketBy(n, key).option("path", path).saveAsTable(table)
    out = spark.table(table)
    out.schema  # noqa: B018 the plan is resolved before the entry goes
    spark.sql(f"DROP TABLE {table}")
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes the files of materialized tables that nothing reads any more."""
    for t in tables:
        files = t.inputFiles()
        if files:
            delete(t.sparkSession, [files[0].rsplit("/", 1)[0]])


def release() -> None:
    """After a shuffle as large as the input: drops what Python and the JVM hold of finished queries, so that Spark's cleaner
    removes their shuffle files now and not at some later collection."""
    gc.collect()
    spark = SparkSession.getActiveSession()
    if spark is not None:
        spark._jvm.System.gc()


def lean(apply):
    """A function over Arrow batches for mapInArrow that gives memory back: Arrow takes it from malloc, and what malloc
    has kept is returned when the task ends, as its worker process waits for the next task."""

    def run(batches):
        import ctypes

        import pyarrow as pa

        pa.set_memory_pool(pa.system_memory_pool())
        try:
            yield from apply(batches)
        finally:
            with contextlib.suppress(OSError, AttributeError):  # other C libraries
                ctypes.CDLL(None).malloc_trim(0)

    return run


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have (names compare without case in Spark)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def column(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def text_of(name: str) -> Column:
    return F.coalesce(column(name).cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text, in order; an empty array where there is none."""
    cut = F.btrim(text, F.lit(TRIM))
    return F.when((cut == "") | cut.isNull(), F.array().cast("array<string>")).otherwise(F.split(cut, SPACE + "+"))


def let(value: Column, body) -> Column:
    """Binds value once for body, which may use it many times inside other lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)

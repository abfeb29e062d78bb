"""Written intermediate tables, for iterations and for results used more than once."""

from __future__ import annotations

import atexit
import shutil
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; where it is unset, below the warehouse on a cluster and below /tmp in local mode."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    own = f"/tmp/checkpoints/{uuid.uuid4().hex}"
    spark.conf.set("spark.checkpoint.dir", f"file://{own}")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    return f"file://{own}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder. Whatever is there when the driver ends is deleted then."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: its lineage ends there, and executors can be lost without loss."""
    path = scratch_path(df.sparkSession, "t")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

"""Rules that give rows of issues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def issues(rows: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """One row for each rule that a row breaks: key (as text), rule. A rule is a condition that holds for bad rows; null is good."""
    found = F.array_compact(F.array(*[F.when(cond, name) for name, cond in rules.items()]))
    return rows.select(F.col(key).cast("string").alias("key"), F.explode(found).alias("rule"))


def rollup_report(rows: DataFrame, dims: list[str], **aggs: Column) -> DataFrame:
    """Aggregates by all prefixes of dims; ``level`` says how many of them a row has."""
    return rows.rollup(*dims).agg(*[c.alias(n) for n, c in aggs.items()], F.grouping_id().alias("__g")).withColumn("level", F.lit(len(dims)) - F.bit_count("__g")).drop("__g")


def exactly_once(expected: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that are missing, there more than once, or not expected: keys, issue."""
    e = expected.select(*keys).distinct().withColumn("__e", F.lit(True))
    f = found.groupBy(*keys).agg(F.count("*").alias("__n"))
    issue = F.when(F.col("__n").isNull(), "missing").when(F.col("__e").isNull(), "unexpected").when(F.col("__n") > 1, "duplicate")
    return e.join(f, keys, "full").withColumn("issue", issue).where("issue IS NOT NULL").select(*keys, "issue")

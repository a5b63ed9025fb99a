"""Shared folder, sizes and connected components for the operators of this package."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; where that is unset, a local one, which needs a local master."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df` written to the shared folder and read again: short lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{folder(spark)}/chainlake-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete the files of a table made by stored() that nothing needs any more."""
    jvm = df.sparkSession._jvm
    conf = df.sparkSession._jsc.hadoopConfiguration()
    for parent in {name.rpartition("/")[0] for name in df.inputFiles()}:
        if "/chainlake-" in parent:
            at = jvm.org.apache.hadoop.fs.Path(parent)
            at.getFileSystem(conf).delete(at, True)


def least_by_hash(rows: DataFrame, column: str, most: int) -> DataFrame:
    """The `most` rows with the least hash of `column` (ties by the value): any row is as likely as any other.

    A bound on the hash that a few more rows meet is set first, so that tasks don't each send `most` rows to one place.
    """
    hashed = F.xxhash64(column)
    share = 2 * most / max(rows.count(), 1)
    while share < 1:
        within = rows.where(hashed < int((share - 0.5) * 2**64))
        if within.count() >= most:
            rows = within
            break
        share *= 2
    return rows.orderBy(hashed, column).limit(most)


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, root) for each node of the edges (a, b): root is the smallest node reachable.

    Alternating large-star and small-star steps; each step is a minimum by key and a join, so a
    hub's edges are never gathered in one place. Every round is written to the shared folder.
    No edges give no rows; loops and repeated edges don't matter.
    """
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        after = stored(small, "edges")
        forget(now)
        now = after
        open_ends = now.select("a").join(now.select(F.col("b").alias("a")), "a", "left_semi").limit(1).count()
        twice = 0 if open_ends else now.groupBy("a").count().where("count > 1").limit(1).count()
        if not open_ends and not twice:
            break
    else:
        raise RuntimeError(f"components still change after {rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())

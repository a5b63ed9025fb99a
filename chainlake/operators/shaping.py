"""Ranges, statistics, address sets and log filters over raw tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKET = 100_000
ORDERS = {
    "events": ("block_number", "tx_index", "log_index"),
    "traces": ("block_number", "tx_index", "trace_path"),
    "accounts": ("block_number", "tx_index", "event_type"),
    "rollup": ("bucket",),
}


def scan_range(df: DataFrame, chain_id: int, low: int, high: int) -> DataFrame:
    """Rows of an inclusive block range in canonical order; the bucket predicate prunes partitions where there are any."""
    out = df.where((F.col("chain_id") == chain_id) & F.col("block_number").between(low, high))
    if "block_bucket" in df.columns:
        out = out.where(F.col("block_bucket").between(low // BUCKET, high // BUCKET))
    return order_canonical(out, "events")


def order_canonical(df: DataFrame, kind: str, descending: bool = False) -> DataFrame:
    """Block order with the kind's tie-breaks; traces by numeric path, not by its text."""
    columns = [c for c in ORDERS[kind] if c in df.columns or c == "trace_path"]
    keys = [F.split("trace_address", r"\.").try_cast("array<int>") if c == "trace_path" and c not in df.columns else F.col(c) for c in columns]
    return df.orderBy(*[k.desc() if descending else k.asc() for k in keys])


def stats(df: DataFrame, keys: tuple[str, ...] = ("chain_id",)) -> DataFrame:
    """(keys, earliest, latest, rows) by min, max and count of the block number."""
    return df.groupBy(*keys).agg(F.min("block_number").alias("earliest"), F.max("block_number").alias("latest"), F.count("*").alias("rows"))


def stored_stats(spark: SparkSession, path: str, keys: tuple[str, ...] = ("chain_id",), layout: tuple[str, ...] = ("chain_id", "block_bucket")) -> DataFrame:
    """`stats` of a stored table, from its files' footers: min, max and count are pushed to the scan, which reads no column.

    keys: partition columns, of which the table has `layout`; the scan has a row for each file and partition. The settings that
    this needs are those of a session of its own.
    """
    own = spark.newSession()
    own.conf.set("spark.sql.sources.useV1SourceList", "")
    own.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    parts = stats(own.read.parquet(path), layout)
    return parts.groupBy(*keys).agg(F.min("earliest").alias("earliest"), F.max("latest").alias("latest"), F.sum("rows").alias("rows"))


def address_set(*frames: DataFrame) -> DataFrame:
    """Distinct lower addresses of the first columns of the given frames."""
    out = frames[0].select(F.lower(F.col(frames[0].columns[0])).alias("address"))
    for df in frames[1:]:
        out = out.union(df.select(F.lower(F.col(df.columns[0]))))
    return out.where("address is not null").distinct()


def apply_log_filter(logs: DataFrame, addresses: DataFrame | None = None, topics: DataFrame | None = None) -> DataFrame:
    """Logs whose address and topic0 are in the given sets; no set keeps all."""
    if addresses is not None:
        logs = logs.join(addresses.select(F.lower("address").alias("address")), "address", "left_semi")
    return logs if topics is None else logs.join(topics.select("topic0"), "topic0", "left_semi")

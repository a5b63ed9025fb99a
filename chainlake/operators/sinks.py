"""Side outputs: CSV files, webhook bodies and stream messages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def export_csv(tables: dict[str, DataFrame], folder: str) -> None:
    """A folder of CSV files with a header for each table; later calls add files."""
    for name, df in tables.items():
        df.write.mode("append").option("header", True).csv(f"{folder}/{name}")


def webhook_payloads(decoded: DataFrame, events: list[str] | None = None, batch: tuple[str, ...] = ("chain_id", "block_number")) -> DataFrame:
    """(batch columns, body): a JSON array of the batch's events, in log order; `events` is an allow-list of names.

    A batch is a block by default: its size is bounded by the chain's block limit.
    """
    own = decoded.where(F.col("name").isin(events)) if events else decoded
    item = F.to_json(F.struct(F.col("name").alias("event"), "contract", *[c for c in ("chain_id", "block_number", "tx_hash", "log_index", "address") if c in decoded.columns], "params"))
    ordered = F.sort_array(F.collect_list(F.struct("log_index", "contract", item.alias("item"))))
    return own.groupBy(*batch).agg(F.concat(F.lit("["), F.array_join(F.transform(ordered, lambda x: x["item"]), ","), F.lit("]")).alias("body"))


def stream_messages(batches: DataFrame | None = None, live: DataFrame | None = None, reorgs: DataFrame | None = None, status: DataFrame | None = None, children: DataFrame | None = None) -> DataFrame:
    """(key, value) messages: events:<chain> for batches, live blocks and children, control:<chain> for reorgs and status."""
    out = None
    for kind, topic, df in (("event_batch", "events", batches), ("live_block", "events", live), ("factory_child", "events", children), ("reorg", "control", reorgs), ("sync_status", "control", status)):
        if df is None:
            continue
        body = F.to_json(F.struct(F.lit(kind).alias("type"), *df.columns))
        rows = df.select(F.concat(F.lit(f"{topic}:"), F.col("chain_id")).alias("key"), body.alias("value"))
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise ValueError("no messages given")
    return out

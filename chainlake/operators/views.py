"""Readers' views over decoded, raw and rolled-up tables, and their cut-over to a new deployment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chainlake.operators.shaping import order_canonical


def of_addresses(df: DataFrame, chain_id: int, address: str | None = None, children: DataFrame | None = None) -> DataFrame:
    """Rows of a chain, of one address or of a factory's children; of every address without either."""
    out = df.where(F.col("chain_id") == chain_id)
    if address is not None:
        return out.where(F.col("address") == address.lower())
    if children is not None:
        own = children.where(F.col("chain_id") == chain_id).select(F.lower("child_address").alias("address"))
        out = out.join(own, "address", "left_semi")
    return out


def event_view(decoded: DataFrame, chain_id: int, address: str | None = None, children: DataFrame | None = None) -> DataFrame:
    return order_canonical(of_addresses(decoded, chain_id, address, children), "events")


def all_events_view(raw: DataFrame, chain_id: int, addresses: list[str] | None = None, children: DataFrame | None = None) -> DataFrame:
    """Raw events of one contract: of its listed addresses, or of its children."""
    out = of_addresses(raw, chain_id, None, children)
    return order_canonical(out.where(F.col("address").isin([a.lower() for a in addresses])) if addresses else out, "events")


def traces_view(traces: DataFrame, chain_id: int) -> DataFrame:
    return order_canonical(of_addresses(traces, chain_id), "traces")


def account_events_view(accounts: DataFrame, chain_id: int) -> DataFrame:
    return order_canonical(of_addresses(accounts, chain_id), "accounts")


def aggregate_view(rolled: DataFrame, chain_id: int, address: str | None = None, children: DataFrame | None = None) -> DataFrame:
    return order_canonical(of_addresses(rolled, chain_id, address, children), "rollup")


def cutover(spark: SparkSession, user_db: str, tables: dict[str, str]) -> list[str]:
    """Point the views of the readers' database at new tables: {view: table or query}. Each replacement is atomic."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{user_db}`")
    made = []
    for view, source in sorted(tables.items()):
        query = source if source.lstrip().lower().startswith(("select", "with")) else f"SELECT * FROM {source}"
        spark.sql(f"CREATE OR REPLACE VIEW `{user_db}`.`{view}` AS {query}")
        made.append(f"{user_db}.{view}")
    return made

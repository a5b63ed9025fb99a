"""Account events: transactions and transfers seen from tracked addresses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainlake.operators.factory import BROADCAST_ADDRESSES

COLUMNS = ("chain_id", "block_number", "tx_index", "tx_hash", "event_type", "address", "counterparty", "value", "trace_address")


def _seen(rows: DataFrame, kind: str, tracked: DataFrame) -> DataFrame:
    """Both sides' rows, each found by a semi join before anything is copied; a set of up to BROADCAST_ADDRESSES is sent to the tasks."""
    few = tracked.limit(BROADCAST_ADDRESSES + 1).count() <= BROADCAST_ADDRESSES
    if "trace_address" not in rows.columns:
        rows = rows.withColumn("trace_address", F.lit(None).cast("string"))
    sides = []
    for side, other in (("from", "to"), ("to", "from")):
        own = tracked.where(F.col("kind") == f"{kind}:{side}").select(F.lower("address").alias("_own")).where("_own is not null").distinct()
        found = rows.join(F.broadcast(own) if few else own, F.lower(f"{side}_address") == F.col("_own"), "left_semi")
        told = {"event_type": F.lit(f"{kind}:{side}"), "address": F.lower(f"{side}_address"), "counterparty": F.lower(f"{other}_address")}
        sides.append(found.select(*[told[c].alias(c) if c in told else F.col(c) for c in COLUMNS]))
    return sides[0].unionByName(sides[1])


def account_tx_events(transactions: DataFrame, tracked: DataFrame) -> DataFrame:
    """A row of COLUMNS for each direction of a transaction that is tracked; a creation has no `to` side."""
    return _seen(transactions, "transaction", tracked)


def account_transfer_events(traces: DataFrame, tracked: DataFrame) -> DataFrame:
    """The same of internal transfers; calls that move nothing are left out."""
    return _seen(traces.where("value is not null and value not in ('0', '0x0', '0x', '')"), "transfer", tracked)


def account_ledger(transactions: DataFrame, transfers: DataFrame, address: str, n: int) -> DataFrame:
    """The newest n account events of one address."""
    both = transactions.unionByName(transfers).where(F.col("address") == address.lower())
    return both.orderBy(F.desc("block_number"), F.desc("tx_index"), "event_type", "trace_address", "tx_hash", "counterparty", "value").limit(n)

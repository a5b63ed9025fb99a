"""Contracts that factories create: discovery, and their events from creation on."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chainlake.functions import abi_words as abi
from chainlake.sources.abi import Definition, resolve_slots


@dataclass(frozen=True)
class Factory:
    """An event of a factory contract whose address parameters `params` name children of `child_contract`."""

    address: str
    event: Definition
    params: tuple[str, ...]
    child_contract: str


CHILD = ("chain_id", "factory_address", "child_address", "contract_name", "created_at_block", "created_at_tx_hash", "created_at_log_index")


def _watched(spark: SparkSession, factories: list[Factory]) -> DataFrame:
    """A row for each named parameter of each factory: where its word is."""
    rows = [(f.address.lower(), f.event.key, f.child_contract, p.indexed, p.slot) for f in factories for p in resolve_slots(f.event, list(f.params))]
    return spark.createDataFrame(rows, "factory_address string, topic0 string, contract_name string, indexed boolean, slot int")


def discover_children(logs: DataFrame, factories: list[Factory]) -> DataFrame:
    """A row of CHILD for each named parameter of each factory log; data too short gives none.

    The factories are a broadcast table, as large as the configuration, so that the plan doesn't grow with them.
    """
    topics = [abi.strip(F.col(c)) if c in logs.columns else F.lit(None).cast("string") for c in ("topic1", "topic2", "topic3")]
    body = abi.strip(F.col("data"))
    found = logs.withColumn("factory_address", F.lower("address")).join(F.broadcast(_watched(logs.sparkSession, factories)), ["factory_address", "topic0"])
    begin = F.col("slot") * abi.WORD
    word = F.when(F.col("indexed"), F.get(F.array(*topics), F.col("slot") - 1)).when(F.length(body) >= begin + abi.WORD, F.substr(body, begin + 1, F.lit(abi.WORD)))
    out = found.select("chain_id", "factory_address", abi.address(word).alias("child_address"), "contract_name", F.col("block_number").alias("created_at_block"), F.col("tx_hash").alias("created_at_tx_hash"), F.col("log_index").alias("created_at_log_index"))
    return out.where("child_address is not null").select(*CHILD)


def dedup_children(children: DataFrame) -> DataFrame:
    """The first row of each (chain, child), by block, log index and contract name."""
    first = F.min_by(F.struct(*CHILD), F.struct("created_at_block", "created_at_log_index", "contract_name", "factory_address", "created_at_tx_hash"))
    return children.groupBy("chain_id", "child_address").agg(first.alias("c")).select("c.*")


def children_by_contract(children: DataFrame) -> DataFrame:
    """(chain_id, contract_name, children in order of creation)."""
    listed = F.sort_array(F.collect_list(F.struct("created_at_block", "child_address")))
    return children.groupBy("chain_id", "contract_name").agg(F.transform(listed, lambda x: x["child_address"]).alias("children"))


def children_by_factory(children: DataFrame, factory: str) -> DataFrame:
    return children.where(F.col("factory_address") == factory.lower()).orderBy("created_at_block", "child_address")


def children_with_blocks(children: DataFrame) -> DataFrame:
    return children.select("child_address", "created_at_block").orderBy("created_at_block", "child_address")


def child_signatures(registry: list[Definition], factories: list[Factory]) -> list[str]:
    """Topics of the events of child contracts."""
    names = {f.child_contract for f in factories}
    return sorted({d.key for d in registry if d.contract in names})


def child_events(logs: DataFrame, children: DataFrame, signatures: list[str], tip: int | None = None) -> DataFrame:
    """Logs of children with one of the signatures, from each child's creation on; children from the tip on are left out."""
    if tip is not None:
        children = children.where(F.col("created_at_block") < tip)
    own = children.select("chain_id", F.col("child_address").alias("address"), "created_at_block")
    kept = logs.where(F.col("topic0").isin(signatures)) if signatures else logs
    joined = kept.join(own, ["chain_id", "address"])  # one row for each child; a hot child's logs can be split
    return joined.where("block_number >= created_at_block").drop("created_at_block").select(*logs.columns)


def prune_children(children: DataFrame, from_block: int) -> DataFrame:
    """What is left of the children when blocks from `from_block` on are undone."""
    return children.where(F.col("created_at_block") < from_block)


#: Addresses that are sent to every task (about 100 bytes each); larger sets are joined by shuffles.
BROADCAST_ADDRESSES = 500_000


def filter_traces(traces: DataFrame, addresses: DataFrame | None) -> DataFrame:
    """Traces from or to an address in the set; no set keeps all.

    A set of up to BROADCAST_ADDRESSES is sent to the tasks. A larger one is joined by key, first the senders, then
    the receivers of what is left, as semi joins, of which hot addresses can be split.
    """
    if addresses is None:
        return traces
    own = addresses.select(F.lower("address").alias("_own")).where("_own is not null").distinct()
    if own.limit(BROADCAST_ADDRESSES + 1).count() <= BROADCAST_ADDRESSES:
        own = F.broadcast(own)
    sends, gets = F.col("from_address") == F.col("_own"), F.col("to_address") == F.col("_own")
    rest = traces.join(own, sends, "left_anti")
    return traces.join(own, sends, "left_semi").unionByName(rest.join(own, gets, "left_semi"))

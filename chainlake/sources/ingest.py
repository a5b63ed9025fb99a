"""Landed node output (JSON text columns or files) to raw tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainlake.functions.abi_words import hex_quantity, hex_u256
from chainlake.sources.scratch import new_folder

LOG = "address string, topics array<string>, data string, blockNumber string, blockHash string, transactionHash string, transactionIndex string, logIndex string, blockTimestamp string"
HEADER = "number string, hash string, parentHash string, timestamp string, logsBloom string"
TRANSACTION = "blockNumber string, blockHash string, hash string, transactionIndex string, `from` string, `to` string, value string, input string, gasPrice string, nonce string"
FLAT_TRACE = (
    "action struct<callType:string,`from`:string,`to`:string,input:string,value:string,gas:string>, result struct<output:string,gasUsed:string>, "
    "traceAddress array<int>, transactionHash string, transactionPosition string, blockNumber string, blockHash string, type string, error string"
)
PAGE = (
    "data array<struct<blocks:array<struct<number:string,hash:string,parent_hash:string,timestamp:string>>,"
    "logs:array<struct<block_number:string,block_hash:string,transaction_hash:string,transaction_index:string,log_index:string,address:string,data:string,topic0:string,topic1:string,topic2:string,topic3:string>>>>, next_block long"
)
LARGEST_INT = 2_147_483_647


def clamp_int(quantity: Column) -> Column:
    """A 32-bit integer, cut off at its largest value."""
    return F.least(quantity, F.lit(LARGEST_INT)).cast("int")


def ingest_logs(rows: DataFrame, chain_id: int, column: str = "json") -> DataFrame:
    """raw_events from log JSON: topics to columns, lower addresses, absent indexes 0."""
    j = rows.select(F.from_json(column, LOG).alias("j")).select("j.*")
    return j.select(
        F.lit(chain_id).cast("int").alias("chain_id"), _q("blockNumber").alias("block_number"), clamp_int(_q("transactionIndex")).alias("tx_index"), clamp_int(_q("logIndex")).alias("log_index"),
        F.coalesce("blockHash", F.lit("")).alias("block_hash"), _q("blockTimestamp").alias("block_timestamp"), F.coalesce("transactionHash", F.lit("")).alias("tx_hash"), F.lower("address").alias("address"),
        *[F.get("topics", F.lit(i)).alias(f"topic{i}") for i in range(4)], F.coalesce("data", F.lit("0x")).alias("data"),
    )


def _q(name: str) -> Column:
    return F.coalesce(hex_quantity(F.col(name)), F.lit(0).cast("bigint"))


def ingest_log_batches(rows: DataFrame, chain_id: int, column: str = "json") -> tuple[DataFrame, DataFrame]:
    """(logs, headers) from pages of {data: [{blocks, logs}]}."""
    parts = rows.select(F.explode(F.from_json(column, PAGE)["data"]).alias("d"))
    headers = parts.select(F.explode("d.blocks").alias("b")).select("b.*").select(F.lit(chain_id).cast("int").alias("chain_id"), _q("number").alias("block_number"), F.col("hash").alias("block_hash"), "parent_hash", _q("timestamp").alias("block_timestamp"))
    logs = parts.select(F.explode("d.logs").alias("l")).select("l.*")
    logs = logs.select(
        F.lit(chain_id).cast("int").alias("chain_id"), _q("block_number").alias("block_number"), clamp_int(_q("transaction_index")).alias("tx_index"), clamp_int(_q("log_index")).alias("log_index"),
        "block_hash", F.col("transaction_hash").alias("tx_hash"), F.lower("address").alias("address"), "topic0", "topic1", "topic2", "topic3", F.coalesce("data", F.lit("0x")).alias("data"),
    )
    return logs, headers


def ingest_headers(rows: DataFrame, chain_id: int, column: str = "json") -> DataFrame:
    j = rows.select(F.from_json(column, HEADER).alias("j")).select("j.*")
    return j.select(F.lit(chain_id).cast("int").alias("chain_id"), _q("number").alias("block_number"), F.col("hash").alias("block_hash"), F.col("parentHash").alias("parent_hash"), _q("timestamp").alias("block_timestamp"))


def ingest_transactions(rows: DataFrame, chain_id: int, column: str = "json") -> DataFrame:
    """transactions; rows without hash are dropped; `to` null is a creation; gas_used and status aren't known here."""
    j = rows.select(F.from_json(column, TRANSACTION).alias("j")).select("j.*").where("hash is not null")
    return j.select(
        F.lit(chain_id).cast("int").alias("chain_id"), _q("blockNumber").alias("block_number"), clamp_int(_q("transactionIndex")).alias("tx_index"), F.col("hash").alias("tx_hash"),
        F.lower("from").alias("from_address"), F.lower("to").alias("to_address"), hex_u256(F.col("value")).alias("value"), F.coalesce("input", F.lit("0x")).alias("input"),
        F.lit(None).cast("long").alias("gas_used"), F.lit(None).cast("int").alias("status"),
    )


def ingest_flat_traces(rows: DataFrame, chain_id: int, column: str = "json") -> DataFrame:
    """raw_traces from flat traces; without action dropped; call type, else type, else call."""
    j = rows.select(F.from_json(column, FLAT_TRACE).alias("j")).select("j.*").where("action is not null")
    calls = j.select(
        _q("blockNumber").alias("block_number"), clamp_int(_q("transactionPosition")).alias("tx_index"), F.col("transactionHash").alias("tx_hash"), F.coalesce("traceAddress", F.array().cast("array<int>")).alias("trace_path"),
        F.lower(F.coalesce("action.callType", "type", F.lit("call"))).alias("call_type"), F.col("action.from").alias("from_address"), F.col("action.to").alias("to_address"),
        F.coalesce("action.input", F.lit("0x")).alias("input"), F.coalesce("result.output", F.lit("0x")).alias("output"), F.coalesce("action.value", F.lit("0x0")).alias("value"), "error",
    )
    return to_raw_traces(calls, chain_id)


def flatten_call_tree(rows: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """One row for each call of nested call JSON: keys, trace_path, call_type, from, to, input, output, value, error.

    Each level is one explode of the level above, which has been written to the shared folder: the
    source is read once for the top level, and no level is derived twice. The loop ends where no call has children, so
    depth is bounded by the data only. A call's path holds its ancestors' places and its own.
    """
    call = "type string, `from` string, `to` string, input string, output string, value string, error string, calls string"
    level = rows.select(*keys, F.array().cast("array<int>").alias("trace_path"), F.from_json(column, call).alias("c"))
    levels = []
    while True:
        levels.append(level.select(*keys, "trace_path", F.lower(F.coalesce("c.type", F.lit("call"))).alias("call_type"), F.lower("c.from").alias("from_address"), F.lower("c.to").alias("to_address"), F.coalesce("c.input", F.lit("0x")).alias("input"), F.coalesce("c.output", F.lit("0x")).alias("output"), F.coalesce("c.value", F.lit("0x0")).alias("value"), F.col("c.error").alias("error")))
        inner = level.where("c.calls is not null and c.calls <> '[]'")
        below = inner.select(*keys, "trace_path", F.posexplode(F.from_json("c.calls", f"array<struct<{_struct(call)}>>")).alias("i", "c")).withColumn("trace_path", F.array_append("trace_path", F.col("i"))).drop("i")
        path = new_folder(rows.sparkSession, "calls")
        below.write.parquet(path)
        level = rows.sparkSession.read.schema(below.schema).parquet(path)
        if level.limit(1).count() == 0:
            return reduce(DataFrame.unionByName, levels)


def _struct(ddl: str) -> str:
    return ",".join(part.strip().replace(" ", ":", 1) for part in ddl.split(","))


def to_raw_traces(calls: DataFrame, chain_id: int) -> DataFrame:
    """Dotted trace_address beside the path, lower addresses, decimal values, selector of inputs that have one."""
    return calls.select(
        F.lit(chain_id).cast("int").alias("chain_id"),
        *[c for c in calls.columns if c not in ("from_address", "to_address", "value", "chain_id")],
        F.array_join("trace_path", ".").alias("trace_address"),
        F.lower("from_address").alias("from_address"),
        F.lower("to_address").alias("to_address"),
        hex_u256(F.col("value")).alias("value"),
        F.when(F.length("input") >= 10, F.substring(F.lower("input"), 1, 10)).alias("function_sig"),
    )


def read_multi_chain(frames: dict[int, DataFrame]) -> DataFrame:
    """One logical table of several chains' tables."""
    return reduce(DataFrame.unionByName, [df.withColumn("chain_id", F.lit(c).cast("int")) for c, df in frames.items()])


def union_batches(frames: list[DataFrame], keys: list[str]) -> DataFrame:
    """Batches of one table put together, rows of equal key once (the first in order of all columns)."""
    from chainlake.operators.store import first_by_key

    return first_by_key(reduce(DataFrame.unionByName, frames), keys)

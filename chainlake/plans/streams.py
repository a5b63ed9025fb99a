"""Registered streaming queries: the lenses are landed as files, streamed to the end, and read back."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from chainlake.plans.catalog import _FIRST, _PURCHASE, PAIR_CREATED, SWAP, TRANSFER, _bucket, _stamp, query
from chainlake.plans.contracts import EVENTS, FACTORIES, GENESIS, RULES
from chainlake.plans.lenses import lens
from chainlake.sources.scratch import new_folder
from chainlake.operators import sinks
from chainlake.streaming import live, messages


def _fed(spark: SparkSession, parts: list[DataFrame], name: str, start: Callable[[DataFrame], StreamingQuery]) -> None:
    """Each part is landed as files, of which one run of the stream takes all; the checkpoint tells later runs what is new."""
    path = new_folder(spark, name)
    for df in parts:
        df.write.mode("append").parquet(path)
        start(spark.readStream.schema(df.schema).parquet(path)).awaitTermination()


def _collected(spark: SparkSession, parts: list[DataFrame], name: str, of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What the stream `of` the parts has put out at the end."""
    path, checkpoint = new_folder(spark, name), new_folder(spark, name)
    _fed(spark, parts, name, lambda stream: of(stream).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    return spark.read.parquet(path)


def _logs(spark, sf) -> DataFrame:
    return lens(spark, sf, "fx_raw_events").where("topic0 is not null")


@query("SELECT block_number, log_index FROM fx_raw_events WHERE topic0 IS NOT NULL")
def stream_dedup(spark, sf):
    """Blocks come in any order over the whole history, so no key is given up."""
    logs = _logs(spark, sf)
    parts = [logs.where("block_number % 2 = 0"), logs, logs.where("block_number % 3 = 0")]
    with live.with_state_on_disk(spark):
        return _collected(spark, parts, "dedup", lambda stream: live.stream_dedup(stream, live.EVENT_KEY)).select("block_number", "log_index")


#: Blocks of a part, and of the one before that come with it again; parts that one run of the stream takes: an eighth of all, this many at most.
PART, AGAIN, PARTS_AT_ONCE = 2_000, 200, 100


@query("SELECT block_number, log_index FROM fx_raw_events WHERE topic0 IS NOT NULL")
def stream_dedup_evicted(spark, sf):
    """Blocks come in order, each part with the end of the one before again; a delay of 10 days keeps as much state and no more.

    The logs are dealt out to their parts in one pass. A run of the stream takes an eighth of the parts, or PARTS_AT_ONCE,
    so that the runs grow slower than the parts and what a run holds stays bounded.
    """
    logs = _logs(spark, sf)
    n = F.col("block_number") - GENESIS
    last = logs.agg(F.max(n)).first()[0] // PART
    part = F.floor(n / PART)
    twice = (n % PART >= PART - AGAIN) & (part < last)
    dealt = logs.withColumn("part", F.explode(F.when(twice, F.array(part, part + 1)).otherwise(F.array(part))))
    at_once = min(PARTS_AT_ONCE, max(1, (last + 1) // 8))
    path = new_folder(spark, "parts")
    dealt.withColumn("run", F.floor(F.col("part") / at_once)).drop("part").hint("rebalance", "run").write.partitionBy("run").parquet(path)
    landed = spark.read.parquet(path)
    parts = [landed.where(F.col("run") == i).drop("run") for i in range(last // at_once + 1)]
    with live.with_state_on_disk(spark):
        return _collected(spark, parts, "evicted", lambda stream: live.stream_dedup(stream, live.EVENT_KEY, "10 days")).select("block_number", "log_index")


_DAYS = f"""SELECT address, {_bucket("1d")} AS bucket, count(*) AS event_count, CAST(sum(log_index) AS BIGINT) AS places, max(epoch(time_bucket(INTERVAL '1 day', make_timestamp(block_timestamp * 1000000)))) AS b, count(DISTINCT tx_hash) AS txs FROM fx_raw_events WHERE topic0 IS NOT NULL GROUP BY address, bucket"""
_CLOSED = "(SELECT max(block_timestamp) AS t FROM fx_raw_events WHERE topic0 IS NOT NULL) WHERE b + 86400 <= t"


def _streamed_days(spark, sf, name: str) -> DataFrame:
    logs, middle = _logs(spark, sf), GENESIS + 500
    parts = [logs.where(F.col("block_number") < middle), logs.where(F.col("block_number") >= middle)]
    return _collected(spark, parts, name, lambda stream: live.stream_rollup(stream, "1d", "0 seconds", [("places", "sum(log_index)")]))


@query(f"SELECT address, bucket, event_count FROM ({_DAYS}), {_CLOSED}")
def stream_rollup(spark, sf):
    return _streamed_days(spark, sf, "rollup").select("address", _stamp("bucket"), "event_count")


@query(f"SELECT address, bucket, places, txs AS tx_count FROM ({_DAYS}), {_CLOSED}")
def stream_rollup_metrics(spark, sf):
    """Custom metrics and the exact tx_count of a stream."""
    return _streamed_days(spark, sf, "rollup-metrics").select("address", _stamp("bucket"), "places", "tx_count")


@query(f"SELECT block_number, log_index, CAST(cents AS VARCHAR) AS p_value FROM ({_PURCHASE}) WHERE event_type = 'purchase' AND cents >= 10000")
def live_ingest(spark, sf):
    logs = _logs(spark, sf)
    folder, checkpoint = new_folder(spark, "live-out"), new_folder(spark, "live-check")
    parts = [logs.where("block_number % 2 = 0"), logs.where("block_number % 2 = 1"), logs.where("block_number % 5 = 0")]
    _fed(spark, parts, "live", lambda stream: live.live_ingest(stream, folder, [d for d in EVENTS if d.contract == "Token"], RULES, checkpoint))
    return spark.read.parquet(f"{folder}/event_token_transfer").select("block_number", "log_index", "p_value")


def _forked(spark, sf) -> tuple[DataFrame, DataFrame, int]:
    """(blocks with the last seven orphaned, canonical blocks above the ancestor, tip)."""
    blocks = lens(spark, sf, "fx_blocks")
    stored = lens(spark, sf, "fx_stored_blocks").join(blocks.drop("block_hash"), ["chain_id", "block_number"]).select(blocks.columns)
    tip = blocks.agg(F.max("block_number")).first()[0]
    whole = stored.withColumn("parent_hash", F.when(F.col("block_number") > tip - 6, F.concat(F.lit("0xdead"), F.substring("parent_hash", 7, 100))).otherwise(F.col("parent_hash")))
    return whole, blocks.where(F.col("block_number") > tip - 7), tip


@query("SELECT max(block_number) - 6 AS block_number FROM fx_blocks")
def detect_reorgs(spark, sf):
    """The stored chain comes first, then the canonical blocks from the second orphan on, of which the first doesn't fit."""
    whole, canonical, tip = _forked(spark, sf)
    folder, checkpoint = new_folder(spark, "reorgs-out"), new_folder(spark, "reorgs-check")
    _fed(spark, [whole, canonical.where(F.col("block_number") > tip - 6)], "reorgs", lambda stream: live.detect_reorgs(stream, folder, 64, checkpoint))
    return spark.read.parquet(f"{folder}/reorgs").select((F.col("block_number") - 1).alias("block_number"))


_SYNCED: dict[tuple[str, str], str] = {}


def _synced(spark, sf) -> str:
    """The folder of a live sync over a fork, made once in a session: the orphaned blocks hold logs (log_index from 100 on) and a child that must not stay."""
    if (key := (spark.sparkContext.applicationId, sf)) in _SYNCED:
        return _SYNCED[key]
    whole, canonical, tip = _forked(spark, sf)
    item = F.struct("tx_index", "log_index", "block_hash", "tx_hash", "address", "topic0", "topic1", "topic2", "topic3", "data")
    events = lens(spark, sf, "fx_raw_events").drop("block_hash", "block_timestamp", "chain_id")
    created = lens(spark, sf, "fx_factory_logs").withColumn("topic3", F.lit(None).cast("string")).withColumn("tx_index", F.lit(9)).select(events.columns)
    lost = created.orderBy("log_index").limit(1).withColumn("block_number", F.lit(tip - 2)).withColumn("data", F.concat(F.lit("0x"), F.lpad(F.lit("dead"), 64, "0"), F.lpad(F.lit("1"), 64, "0"))).withColumn("log_index", F.lit(100)).select(events.columns)
    orphaned = events.where(F.col("block_number") > tip - 7).withColumn("log_index", F.col("log_index") + 100).unionByName(lost)

    def blocks_with(blocks: DataFrame, logs: DataFrame) -> DataFrame:
        own = logs.join(blocks.select("block_number", "block_hash"), "block_number").groupBy("block_number").agg(F.collect_list(item).alias("logs"))
        return blocks.join(own, "block_number", "left").withColumn("logs", F.coalesce("logs", F.array().cast(live.LOG_OF_BLOCK)).cast(live.LOG_OF_BLOCK)).select(*blocks.columns, "logs")

    both = events.unionByName(created)
    first = blocks_with(whole, both.where(F.col("block_number") <= tip - 7).unionByName(orphaned))
    folder, checkpoint = new_folder(spark, "sync-out"), new_folder(spark, "sync-check")
    _fed(spark, [first, blocks_with(canonical, both)], "sync", lambda stream: live.live_sync(stream, folder, EVENTS, RULES, FACTORIES, checkpoint))
    _SYNCED[key] = folder
    return folder


@query(f"""SELECT 'raw' AS what, block_number, log_index, block_hash AS value FROM fx_raw_events
UNION ALL SELECT 'transfer', block_number, log_index, CAST(cents AS VARCHAR) FROM ({_PURCHASE}) WHERE event_type = 'purchase' AND cents >= 10000
UNION ALL SELECT 'block', block_number, 0, block_hash FROM fx_blocks
UNION ALL SELECT 'child', created_at_block, 0, child_address FROM ({_FIRST})
UNION ALL SELECT 'child event', r.block_number, r.log_index, r.address FROM fx_raw_events r JOIN ({_FIRST}) c ON r.address = c.child_address WHERE r.block_number >= c.created_at_block AND r.topic0 IN ('{TRANSFER}', '{SWAP}')
UNION ALL SELECT 'reorg', max(block_number) - 7, 7, CAST(max(block_number) AS VARCHAR) FROM fx_blocks""")
def live_sync(spark, sf):
    """A fork is streamed; raw logs, decoded events, blocks, children and the message are read back."""
    folder = _synced(spark, sf)
    of = lambda name, what, at, value: spark.read.parquet(f"{folder}/{name}").select(F.lit(what).alias("what"), "block_number", F.expr(at).cast("int").alias("log_index"), F.expr(value).alias("value"))
    raw = spark.read.parquet(f"{folder}/raw_events").where(~F.col("topic0").eqNullSafe(PAIR_CREATED)).select(F.lit("raw").alias("what"), "block_number", "log_index", F.col("block_hash").alias("value"))
    parts = [of("event_token_transfer", "transfer", "log_index", "p_value"), of("blocks", "block", "0", "block_hash"), of("factory_children", "child", "0", "child_address"), of("child_events", "child event", "log_index", "address"), of("reorgs", "reorg", "depth", "string(tip)")]
    return reduce(DataFrame.unionByName, parts, raw)


@query(f"""SELECT address, {_bucket("1h")} AS bucket, count(*) AS event_count FROM (SELECT block_number, lower(address) AS address, 1704240000 + 600 * (block_number - 10000835) AS block_timestamp FROM fx_raw_events
UNION ALL SELECT block_number, address, 1704240000 + 600 * (block_number - 10000835) FROM fx_factory_logs) GROUP BY ALL""")
def live_sync_rollup(spark, sf):
    """The stored rollup after the fork has been repaired."""
    return spark.read.parquet(f"{_synced(spark, sf)}/rollup_hourly").select("address", _stamp("bucket"), "event_count")


@query(f"SELECT r.block_number, r.log_index FROM fx_raw_events r JOIN ({_FIRST}) c ON r.address = c.child_address WHERE r.block_number >= c.created_at_block AND r.topic0 IN ('{TRANSFER}', '{SWAP}')")
def stream_children(spark, sf):
    logs = lens(spark, sf, "fx_raw_events").drop("block_hash", "block_timestamp")
    created = lens(spark, sf, "fx_factory_logs").withColumn("topic3", F.lit(None).cast("string")).withColumn("tx_index", F.lit(9)).select(logs.columns)
    folder, checkpoint = new_folder(spark, "children-out"), new_folder(spark, "children-check")
    parts = [logs.where("block_number % 2 = 0"), created, logs.where("block_number % 2 = 1"), created]
    _fed(spark, parts, "children", lambda stream: live.stream_children(stream, folder, FACTORIES, EVENTS, checkpoint))
    return spark.read.parquet(f"{folder}/child_events").select("block_number", "log_index")


@query("""SELECT 'blocks' AS metric, count(*) + 7 AS value FROM fx_blocks UNION ALL SELECT 'tip', max(block_number) FROM fx_blocks UNION ALL SELECT 'reorgs', 1
UNION ALL SELECT 'events', (SELECT count(*) FROM fx_raw_events) + (SELECT count(*) FROM fx_raw_events WHERE block_number > (SELECT max(block_number) - 7 FROM fx_blocks)) + (SELECT count(*) FROM fx_factory_logs) + 1""")
def live_sync_counters(spark, sf):
    """What was counted while a fork was streamed: orphaned blocks and logs count too."""
    return messages.counters(spark, _synced(spark, sf)).where("metric <> 'rejected'").select("metric", "value")


@query("SELECT 'events:1' AS key, block_number AS position, count(*) OVER (PARTITION BY block_number) AS times FROM fx_blocks")
def stream_published(spark, sf):
    """Live blocks as messages, in two runs of the stream; how often each position was delivered."""
    blocks = lens(spark, sf, "fx_blocks")
    folder, checkpoint = new_folder(spark, "messages"), new_folder(spark, "messages-check")
    out = lambda stream: sinks.stream_messages(live=stream).withColumn("position", F.get_json_object("value", "$.block_number").cast("long"))
    _fed(spark, [blocks.where("block_number % 2 = 0"), blocks.where("block_number % 2 = 1")], "messages-in", lambda s: messages.publish(out(s), folder, checkpoint))
    return messages.delivered(spark, folder).groupBy("key", "position").agg(F.count("*").alias("times"))

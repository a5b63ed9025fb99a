"""Structured Streaming forms of ingest, deduplication, rollups, reorganisation checks and factories."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from chainlake.operators import decode, factory, forks, reorg, rollup, store
from chainlake.operators.filters import Rule, condition
from chainlake.operators.rollup import INTERVALS
from chainlake.operators.shaping import BUCKET
from chainlake.operators.store import with_bucket
from chainlake.sources import scratch
from chainlake.sources.abi import Definition

EVENT_KEY = ["chain_id", "block_number", "tx_index", "log_index"]


def _started(stream: DataFrame, batch: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict) -> StreamingQuery:
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def live_ingest(stream: DataFrame, folder: str, registry: list[Definition], rules: list[Rule], checkpoint: str, sinks: Callable[[dict[str, DataFrame]], None] | None = None, trigger: dict | None = None) -> StreamingQuery:
    """Raw logs into raw_events, then one table for each event, then the sinks.

    Every write is an insert of absent keys, so a batch that is replayed after a failure adds
    nothing twice; a reader may see raw rows before their decoded ones. The checkpoint holds what
    has been read.
    """

    def batch(rows: DataFrame, _id: int) -> None:
        rows = rows.persist()
        try:
            store.insert_new(rows, f"{folder}/raw_events", EVENT_KEY)
            tables = {}
            for d in registry:
                table = decode.event_table(rows, registry, d.contract, d.name)
                tables[d.table] = table.where(condition(rules, d.contract, d.name, table.columns))
                store.insert_new(tables[d.table], f"{folder}/{d.table}", EVENT_KEY)
            if sinks:
                sinks(tables)
        finally:
            rows.unpersist()

    return _started(stream, batch, checkpoint, trigger or {"availableNow": True})


def _with_time(stream: DataFrame, delay: str) -> DataFrame:
    return stream.withColumn("event_time", F.timestamp_seconds("block_timestamp")).withWatermark("event_time", delay)


def stream_dedup(stream: DataFrame, keys: list[str], delay: str | None = None) -> DataFrame:
    """The stream with the first row of each key, in any order of arrival: the state holds every key that has come.

    delay: keys are kept that long of event time only, and rows that come later than it, behind the newest block, are dropped
    whether their key has come or not; for streams whose rows come in order, up to the delay. Start the stream under
    `with_state_on_disk`, which keeps the keys out of the executors' heaps.
    """
    if delay is None:
        return stream.dropDuplicates(keys)
    return _with_time(stream, delay).dropDuplicatesWithinWatermark(keys).drop("event_time")


#: How the parts of an aggregate are put together.
MERGES = {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max}


def stream_rollup(stream: DataFrame, interval: str, delay: str, metrics: list[tuple[str, str]] = ()) -> DataFrame:
    """Tumbling buckets with exact tx_count, emitted once the watermark passes them; rows later than that are dropped.

    Two stateful steps under one watermark: each bucket's rows by transaction, then the bucket's transactions. metrics are
    SQL aggregates that can be put together from parts: sum, count, min or max of an expression; others raise ValueError.
    """
    merges = {}
    for name, text in metrics:
        found = re.fullmatch(r"\s*(\w+)\s*\((?!\s*distinct\b).*\)\s*", text, re.IGNORECASE | re.DOTALL)
        if not found or found[1].lower() not in MERGES:
            raise ValueError(f"a streamed rollup can't put {text} together from parts")
        merges[name] = MERGES[found[1].lower()]
    width = f"{INTERVALS[interval][0]} seconds"
    shift = "4 days" if interval == "1w" else "0 seconds"
    by_tx = _with_time(stream, delay).groupBy("chain_id", "address", "tx_hash", F.window("event_time", width, width, shift)).agg(F.count("*").alias("event_count"), *[F.expr(text).alias(name) for name, text in metrics])
    whole = by_tx.groupBy("chain_id", "address", F.window(F.window_time("window"), width, width, shift).alias("window"))
    out = whole.agg(F.sum("event_count").alias("event_count"), F.count("tx_hash").alias("tx_count"), *[merge(name).alias(name) for name, merge in merges.items()])
    return out.select("chain_id", "address", F.col("window.start").alias("bucket"), "event_count", "tx_count", *merges)


BLOCK_KEY = ["chain_id", "block_number"]
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def with_state_on_disk(spark: SparkSession) -> Iterator[None]:
    """Streams that are started inside keep their state in RocksDB; a query takes its settings when it starts."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, STATE_STORE)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


REORG = "chain_id int, block_number long, parent_hash string, stored_hash string"


class Forks(StatefulProcessor):
    """One chain's blocks of all branches within the newest `depth` numbers of the chosen one, as state.

    The same choice as forks.best_branch, among the state and a batch's blocks of the chain, which the task holds: a
    source's rate is to be limited accordingly (some 200 bytes a block).
    """

    def __init__(self, depth: int):
        self.depth = depth

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.blocks = handle.getListState("blocks", "number long, hash string, parent string, told boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = {(n, h): [p, told] for n, h, p, told in self.blocks.get()}
        new = set()
        for part in rows:
            for n, h, p in zip(part["block_number"].tolist(), part["block_hash"], part["parent_hash"], strict=True):
                if (n, h) not in held:
                    held[n, h] = [p, False]
                    new.add((n, h))
        best = {at: (-at[0], at not in new, at[1]) for at in held}
        chosen: dict[int, tuple[int, str]] = {}
        for at in sorted(held, key=lambda x: -x[0]):  # from the tips down
            below = (at[0] - 1, held[at][0])
            if below in best:
                best[below] = min(best[below], best[at])
        for at in held:
            if at[0] not in chosen or best[at] < best[chosen[at[0]]]:
                chosen[at[0]] = at
        found = []
        for n, at in chosen.items():
            parent, told = held[at]
            if n - 1 in chosen and chosen[n - 1][1] != parent and not told:
                held[at][1] = True
                found.append((key[0], n, parent, chosen[n - 1][1]))
        low = sorted(chosen, reverse=True)[: self.depth][-1]
        self.blocks.put([(n, h, p, told) for (n, h), (p, told) in held.items() if n >= low])
        yield pd.DataFrame(found, columns=["chain_id", "block_number", "parent_hash", "stored_hash"])

    def close(self) -> None:
        pass


def detect_reorgs(stream: DataFrame, folder: str, depth: int, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Append to `folder`/reorgs (chain_id, block_number, parent_hash, stored_hash) of blocks that don't continue the known ones.

    Known is, of each chain, the best branch among the blocks of the newest `depth` numbers (highest tip, of equal ones
    a batch's, then the least hash): keyed state, kept with the checkpoint. A block is told of once. However the
    stream is cut into batches, the rows are those of all its blocks at once, as long as the branch that wins is the one that stays.
    """
    with with_state_on_disk(stream.sparkSession):  # as keyed state with several values needs it
        found = stream.select(*BLOCK_KEY, "block_hash", "parent_hash").groupBy("chain_id").transformWithStateInPandas(Forks(depth), REORG, "Append", "None")
        return found.writeStream.format("parquet").option("path", f"{folder}/reorgs").option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


LOG_OF_BLOCK = "array<struct<tx_index:int,log_index:int,block_hash:string,tx_hash:string,address:string,topic0:string,topic1:string,topic2:string,topic3:string,data:string>>"


def live_sync(
    stream: DataFrame, folder: str, registry: list[Definition], rules: list[Rule], factories: list[factory.Factory], checkpoint: str, depth: int = 64, interval: str = "1h", sinks: Callable[[dict[str, DataFrame]], None] | None = None, trigger: dict | None = None, also: tuple[str, ...] = (),
    publish: Callable[[list[tuple[int, str, int]]], None] | None = None,
) -> StreamingQuery:
    """Follow chains block by block, reorganisations included. The stream has a row for each block: chain_id,
    block_number, block_hash, parent_hash, block_timestamp and logs (LOG_OF_BLOCK).

    Each batch joins the stored window and the blocks of all branches that the last `depth` numbers hold
    (`pool`); of these one chain is chosen (forks.best_branch: highest tip, of equal ones the batch's, then the least hash).
    Stored blocks that aren't on it go from all tables, and all above them, however deep below finality; so
    do the rows of `also`, tables under `folder` that others fill (traces, account events and ledgers), and
    children that were created there. A row goes to `reorgs`. Then what is chosen and not stored is inserted: blocks,
    logs, decoded events, factory children and their events; logs whose hash isn't their header's go to `rejected`. The
    rollup is refreshed from the ancestor's time on, of the batch's chains only. So blocks may come in any order and in any batches,
    as long as branches differ in their last `depth` numbers.

    If a chosen block's parent isn't there and another block stands in its place, then what is known below it
    may be orphaned: the whole known window goes, and the source has to send it again. Counters (blocks, events, rejected, reorgs) and
    the tip are observed while a batch is written; `publish` gets them as (chain_id, metric, value), and messages.counters adds
    them up. Every write is by key, and blocks are
    written last, so a replayed batch, which starts from the pool before it, ends in the same state.
    """
    tables = {n: f"{folder}/{n}" for n in ("blocks", "raw_events", "factory_children", "child_events", *also, *(d.table for d in registry))}

    def repair(spark, known: DataFrame, chosen: DataFrame) -> dict[int, int]:
        """Delete what is stored and not chosen; the times, of each chain, from which rollups are out of date."""
        since = {}
        mine = chosen.select(*BLOCK_KEY, F.col("block_hash").alias("_right"))
        wrong = known.join(mine, BLOCK_KEY, "left").where("not block_hash <=> _right")  # each known number is among the nodes
        forks = wrong.groupBy("chain_id").agg(F.min("block_number").alias("fork"))
        tips = known.groupBy("chain_id").agg(F.max("block_number").alias("tip"))
        for r in forks.join(tips, "chain_id").collect():  # a row for each chain that forks
            since[r.chain_id] = known.where((F.col("chain_id") == r.chain_id) & (F.col("block_number") >= r.fork)).agg(F.min("block_timestamp")).first()[0]
            reorg.rewrite_reorg(spark, tables, r.chain_id, r.fork - 1, r.tip, messages=f"{folder}/reorgs", last="blocks")
        return since

    def settled(nodes: DataFrame, known: DataFrame, aside: str) -> tuple[DataFrame, DataFrame]:
        """(nodes, chosen ones) without the windows below blocks that don't continue them."""
        chosen = forks.best_branch(nodes, aside)
        broken = forks.breaks(chosen).select("chain_id", "block_number", "stored_hash")
        if not broken.limit(1).count():
            return nodes, chosen
        window = known.groupBy("chain_id").agg(F.min("block_number").alias("_low"))
        held = known.select("chain_id", F.col("block_hash").alias("stored_hash"), F.lit(True).alias("_held"))
        spans = broken.join(held, ["chain_id", "stored_hash"], "left").join(window, "chain_id", "left")
        spans = spans.select("chain_id", F.when(F.col("_held"), F.least("_low", F.col("block_number") - depth)).otherwise(F.col("block_number") - depth).alias("_a"), (F.col("block_number") - 1).alias("_b"))
        spans = spans.groupBy("chain_id").agg(F.collect_list(F.struct("_a", "_b")).alias("_gone"))  # one for each break of a batch
        out = F.exists(F.coalesce("_gone", F.array().cast("array<struct<_a:bigint,_b:bigint>>")), lambda g: F.col("block_number").between(g["_a"], g["_b"]))
        drop = lambda df: df.join(F.broadcast(spans), "chain_id", "left").where(~out).drop("_gone")
        return drop(nodes), drop(chosen)

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        columns, heads = rows.columns, [c for c in rows.columns if c != "logs"]
        aside = scratch.new_folder(spark, "sync")
        try:
            given = scratch.written(rows, f"{aside}/given")  # all that is read of it below is the headers, but for the logs' own pass
            ordered = given.withColumn("_fewer", -F.size(F.coalesce("logs", F.array().cast(LOG_OF_BLOCK)))).withColumn("_text", F.xxhash64(*columns))
            rows = store.single_by_key(ordered, forks.NODE, f"{aside}/repeated", ["_fewer", "_text"]).select(*columns)
            first = {r.chain_id: r.t for r in rows.groupBy("chain_id").agg(F.min("block_timestamp").alias("t")).collect()}  # a row for each chain
            if not first:
                return
            known = scratch.written(reorg.known_window(store.of_buckets_from(spark, rows.select(*heads), tables["blocks"], depth), depth), f"{aside}/known")
            pool = store.read(spark, f"{folder}/pool/{number - 1}", rows)
            mine = pool.where(F.col("chain_id").isin(list(first)))
            side = mine.join(rows.select(*forks.NODE), forks.NODE, "left_anti").withColumn("_new", F.lit(0)).unionByName(rows.withColumn("_new", F.lit(1)))
            bare = known.join(side.select(*forks.NODE), forks.NODE, "left_anti").withColumn("_new", F.lit(0)).withColumn("_whole", F.lit(False))
            nodes = scratch.written(side.select(*heads, "_new", F.col("logs").isNotNull().alias("_whole")).unionByName(bare), f"{aside}/nodes")  # the choice takes headers only
            nodes, chosen = settled(nodes, known, f"{aside}/branches")
            chosen = scratch.written(chosen.drop("_new"), f"{aside}/chosen")
            since = repair(spark, known, chosen)
            blocks = chosen.where("_whole").join(store.of_buckets(spark, chosen.select(*heads), tables["blocks"]).select(*BLOCK_KEY), BLOCK_KEY, "left_anti")
            blocks = scratch.written(blocks.select(*heads), f"{aside}/blocks")
            gone = scratch.written(store.without(side.select(*forks.NODE), blocks, forks.NODE), f"{aside}/gone")  # few, but for replays
            fresh = store.without(side, gone, forks.NODE).select(*columns)
            seen = Observation("fresh")
            bad = lambda h: F.coalesce((h["block_hash"] != "") & (F.col("block_hash") != "") & (h["block_hash"] != F.col("block_hash")), F.lit(False))
            counts = {"blocks": F.lit(1), "events": F.size(F.filter("logs", lambda h: ~bad(h))), "rejected": F.size(F.filter("logs", bad))}
            of_chain = [F.sum(F.when(F.col("chain_id") == c, x).otherwise(0)).alias(f"{m}:{c}") for c in first for m, x in counts.items()]
            of_chain += [F.max(F.when(F.col("chain_id") == c, F.col("block_number"))).alias(f"tip:{c}") for c in first]
            fresh = fresh.observe(seen, *of_chain)  # counted as their logs are written, not in a pass of their own
            logs = fresh.select(*BLOCK_KEY, F.col("block_hash").alias("_head"), "block_timestamp", F.explode("logs").alias("l")).select(*BLOCK_KEY, "_head", "block_timestamp", "l.*")
            logs = scratch.written(logs, f"{aside}/logs")
            told = {**seen.get, **{f"reorgs:{c}": 1 for c in since}}
            buckets = store.bucket_filter(blocks)
            wrong = F.coalesce((F.col("block_hash") != "") & (F.col("_head") != "") & (F.col("block_hash") != F.col("_head")), F.lit(False))
            store.insert_new(logs.where(wrong).drop("_head"), f"{folder}/rejected", [*EVENT_KEY, "block_hash"], buckets=buckets)
            logs = logs.where(~wrong).drop("_head").withColumn("address", F.lower("address")).select(*EVENT_KEY, "block_hash", "block_timestamp", "tx_hash", "address", "topic0", "topic1", "topic2", "topic3", "data")
            logs = store.single_by_key(logs, EVENT_KEY, f"{aside}/repeated-logs")
            store.insert_new(logs, tables["raw_events"], EVENT_KEY, buckets=buckets, single=True)
            made = {}
            for d in registry:
                table = decode.event_table(logs, registry, d.contract, d.name)
                made[d.table] = table.where(condition(rules, d.contract, d.name, table.columns))
                store.insert_new(made[d.table], tables[d.table], EVENT_KEY, buckets=buckets, single=True)
            _follow_children(logs, folder, factories, factory.child_signatures(registry, factories), buckets)
            store.insert_new(blocks, tables["blocks"], BLOCK_KEY, buckets=buckets)
            raw = spark.read.parquet(tables["raw_events"]) if store.exists(spark, tables["raw_events"]) else None
            if raw is not None:
                times = {c: min(x) for c in first if (x := [t for t in (first[c], since.get(c)) if t is not None])}
                rollup.refresh_stored(spark, raw, f"{folder}/rollup{INTERVALS[interval][1]}", interval, times, blocks=spark.read.parquet(tables["blocks"]))
            if sinks:
                sinks(made)
            counted = [(int(k.split(":")[1]), k.split(":")[0], int(v)) for k, v in told.items() if v]
            spark.createDataFrame(counted, "chain_id int, metric string, value long").coalesce(1).write.mode("overwrite").parquet(f"{folder}/counters/batch={number}")
            if publish:
                publish(counted)
            lowest = reorg.known_window(chosen.select(*heads), depth).groupBy("chain_id").agg(F.min("block_number").alias("_low"))
            kept = nodes.where("_whole").join(F.broadcast(lowest), "chain_id", "left").where("_low is null or block_number >= _low").select(*forks.NODE)
            kept = side.join(F.broadcast(kept), forks.NODE, "left_semi").select(*columns)  # the last `depth` numbers' blocks
            others = pool.where(~F.col("chain_id").isin(list(first)))
            kept.unionByName(others).write.mode("overwrite").parquet(f"{folder}/pool/{number}")
            store.remove(spark, f"{folder}/pool/{number - 2}")
        finally:
            store.remove(spark, aside)

    return _started(stream, batch, checkpoint, trigger or {"availableNow": True})


CHILD_KEY = ["chain_id", "child_address"]


def _follow_children(rows: DataFrame, folder: str, factories: list[factory.Factory], signatures: list[str], buckets: Column | None = None) -> None:
    """Bring factory_children and child_events up to date with logs that raw_events has taken in already.

    New children get their events of earlier batches from raw_events, of which only the buckets from the oldest
    creation on are read, and nothing where there are none. The children are stored last: a replay finds them new
    again until their events are in. buckets: the condition on the partitions of `rows`, if no key repeats in them.
    """
    spark = rows.sparkSession
    found = factory.dedup_children(factory.discover_children(rows, factories))
    as_stored = found.withColumn("block_number", F.col("created_at_block"))
    known = store.read(spark, f"{folder}/factory_children", with_bucket(as_stored))
    new = store.new_rows(as_stored, known, CHILD_KEY).persist()
    try:
        events = factory.child_events(rows, known.select(*as_stored.columns), signatures)
        oldest = new.agg(F.min("created_at_block")).first()[0]
        if oldest is not None:
            raw = store.read(spark, f"{folder}/raw_events", with_bucket(rows)).where(F.col("block_bucket") >= oldest // BUCKET)
            events = events.unionByName(factory.child_events(raw.select(*rows.columns), new, signatures))
        reached = buckets if buckets is None or oldest is None else buckets | (F.col("block_bucket") >= oldest // BUCKET)
        store.insert_new(events, f"{folder}/child_events", EVENT_KEY, buckets=reached, single=buckets is not None)  # an event is of a known child or of a new one
        if oldest is not None:
            store.append(new, f"{folder}/factory_children")
    finally:
        new.unpersist()


def stream_children(stream: DataFrame, folder: str, factories: list[factory.Factory], registry: list[Definition], checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Keep raw_events, factory_children and child_events under `folder` up to date.

    A batch's new children get their events of earlier batches from raw_events; all known children
    get theirs of this one. Inserts are by key, so replays change nothing.
    """
    signatures = factory.child_signatures(registry, factories)

    def batch(rows: DataFrame, _id: int) -> None:
        rows = rows.persist()
        try:
            store.insert_new(rows, f"{folder}/raw_events", EVENT_KEY)
            _follow_children(rows, folder, factories, signatures)
        finally:
            rows.unpersist()

    return _started(stream, batch, checkpoint, trigger or {"availableNow": True})

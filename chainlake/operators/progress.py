"""Progress and readiness of a synchronisation, from its table of workers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest(workers: DataFrame) -> DataFrame:
    """One row for each (chain, worker): the furthest."""
    w = Window.partitionBy("chain_id", "worker_id").orderBy(F.desc("current_block"), "status")
    return workers.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def _percent(done, total):
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.when(total > 0, done * 100.0 / total).otherwise(F.lit(100.0)))), 4)


def sync_status(workers: DataFrame, raw: DataFrame, tip: int | None = None) -> DataFrame:
    """(chain_id, mode, current_block, tip, percent, synced): tip by default the newest of checkpoints and stored blocks."""
    by = latest(workers).groupBy("chain_id").agg(F.max("current_block").alias("current_block"), F.bool_or(F.col("status") == "live").alias("_live"), F.count("*").alias("_n"))
    stored = raw.groupBy("chain_id").agg(F.max("block_number").alias("_stored"))
    out = by.join(stored, "chain_id", "full_outer")
    out = out.withColumn("mode", F.when(F.col("_live"), "live").when(F.col("_n") > 0, "historical").otherwise("initializing"))
    out = out.withColumn("current_block", F.coalesce("current_block", F.lit(0).cast("bigint"))).withColumn("tip", F.greatest(F.lit(tip).cast("bigint") if tip is not None else F.col("current_block"), "current_block", F.coalesce("_stored", F.lit(0).cast("bigint"))))
    synced = (F.col("mode") == "live") & (F.col("tip") - F.col("current_block") <= 1)
    return out.select("chain_id", "mode", "current_block", "tip", _percent(F.col("current_block"), F.col("tip")).alias("percent"), synced.alias("synced"))


def readiness(workers: DataFrame) -> DataFrame:
    """(all_live, any_live) over all chains; a chain is live if one of its workers is."""
    chains = workers.groupBy("chain_id").agg(F.bool_or(F.col("status") == "live").alias("live"))
    return chains.agg(F.coalesce(F.bool_and("live"), F.lit(False)).alias("all_live"), F.coalesce(F.bool_or("live"), F.lit(False)).alias("any_live"))


def range_progress(ranges: DataFrame) -> DataFrame:
    """(chain_id, worker_id, done, total, percent), and a row with worker_id null for each chain as a whole."""
    one = ranges.where("range_end is not null").select("chain_id", "worker_id", F.least(F.greatest(F.col("current_block") - F.col("range_start") + 1, F.lit(0)), F.col("range_end") - F.col("range_start") + 1).alias("done"), (F.col("range_end") - F.col("range_start") + 1).alias("total"))
    both = one.unionByName(one.groupBy("chain_id").agg(F.sum("done").alias("done"), F.sum("total").alias("total")).withColumn("worker_id", F.lit(None).cast("int")))
    return both.select("chain_id", "worker_id", "done", "total", _percent(F.col("done"), F.col("total")).alias("percent"))


def throughput(progress: DataFrame) -> DataFrame:
    """Rows (chain_id, done, total, seconds) with percent, blocks_per_second and eta_seconds, null below one block a second."""
    rate = F.when(F.col("seconds") > 0, F.col("done") / F.col("seconds"))
    eta = F.when(rate >= 1, F.floor((F.col("total") - F.col("done")) / rate).cast("bigint"))
    return progress.select("chain_id", _percent(F.col("done"), F.col("total")).alias("percent"), F.round(rate, 4).alias("blocks_per_second"), eta.alias("eta_seconds"))


def remaining_ranges(workers: DataFrame) -> DataFrame:
    """(chain_id, worker_id, from_block, to_block) of unfinished historic ranges."""
    open_ = latest(workers).where((F.col("status") == "historical") & F.col("range_end").isNotNull() & (F.col("current_block") < F.col("range_end")))
    return open_.select("chain_id", "worker_id", F.greatest(F.col("current_block") + 1, F.col("range_start")).alias("from_block"), F.col("range_end").alias("to_block"))


def start_mode(workers: DataFrame, chains: DataFrame) -> DataFrame:
    """(chain_id, mode): fresh without workers, resume with unfinished ranges, else live."""
    left = remaining_ranges(workers).groupBy("chain_id").agg(F.count("*").alias("_open"))
    seen = workers.groupBy("chain_id").agg(F.count("*").alias("_seen"))
    out = chains.select("chain_id").distinct().join(seen, "chain_id", "left").join(left, "chain_id", "left")
    return out.select("chain_id", F.when(F.col("_seen").isNull(), "fresh").when(F.col("_open").isNotNull(), "resume").otherwise("live").alias("mode"))


def slice_coverage(df: DataFrame, low: int, high: int, n: int) -> DataFrame:
    """(slice, first, last, rows, blocks) of n even slices of [low, high); the remainder goes to the first ones. A row's slice is arithmetic."""
    size, more = divmod(high - low, n)
    slices = df.sparkSession.range(n).select(F.col("id").cast("int").alias("slice"))
    slices = slices.select("slice", (low + F.col("slice") * size + F.least(F.col("slice"), F.lit(more))).cast("bigint").alias("first"))
    slices = slices.withColumn("last", F.col("first") + size + F.when(F.col("slice") < more, 1).otherwise(0) - 1)
    at = F.col("block_number") - low
    cut = more * (size + 1)
    number = F.when(at < cut, F.floor(at / (size + 1))).otherwise(more + F.floor((at - cut) / max(size, 1))).cast("int")
    held = df.where((F.col("block_number") >= low) & (F.col("block_number") < high)).groupBy(number.alias("slice")).agg(F.count("*").alias("rows"), F.count_distinct("block_number").alias("blocks"))
    return slices.join(held, "slice", "left").select("slice", "first", "last", F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("blocks", F.lit(0)).alias("blocks"))

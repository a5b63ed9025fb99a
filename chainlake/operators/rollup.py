"""Time-bucket rollups, their refresh, and state snapshots at block multiples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chainlake.operators.shaping import BUCKET
from chainlake.operators.store import exists, replace_partitions

#: Interval: (seconds, table suffix). Weeks start on Monday.
INTERVALS = {
    "15m": (900, "_15m"), "30m": (1_800, "_30m"), "1h": (3_600, "_hourly"), "4h": (14_400, "_4h"), "1d": (86_400, "_daily"), "1w": (604_800, "_weekly"),
}
MONDAY = 4 * 86_400
#: Seconds before now within which a scheduled refresh recomputes: (start, end) offsets (fixed values).
WINDOWS = {"15m": (1_800, 300), "30m": (3_600, 300), "1h": (7_200, 600), "4h": (28_800, 1_800), "1d": (172_800, 3_600), "1w": (1_209_600, 86_400)}


def bucket_start(seconds: Column, interval: str) -> Column:
    """Start of the bucket, in Unix seconds."""
    width = INTERVALS[interval][0]
    origin = MONDAY if interval == "1w" else 0
    return seconds - F.pmod(seconds - origin, F.lit(width))


def rollup(events: DataFrame, interval: str, metrics: list[tuple[str, Column | str]] = ()) -> DataFrame:
    """(chain_id, address, bucket, event_count, tx_count, metrics...): metrics are aggregates as SQL text or Columns."""
    more = [(F.expr(m) if isinstance(m, str) else m).alias(name) for name, m in metrics]
    bucket = F.timestamp_seconds(bucket_start(F.col("block_timestamp"), interval)).alias("bucket")
    return events.groupBy("chain_id", "address", bucket).agg(F.count("*").alias("event_count"), F.count_distinct("tx_hash").alias("tx_count"), *more)


def touched(events: DataFrame, interval: str, start: int, end: int | None = None) -> DataFrame:
    """Events of the buckets that begin in [start, end)."""
    begin = bucket_start(F.col("block_timestamp"), interval)
    kept = F.col("block_timestamp") >= start  # reaches the scan
    return events.where(kept & (begin >= start) if end is None else kept & (begin >= start) & (begin < end))


def refresh_rollup(events: DataFrame, stored: DataFrame, interval: str, now: int, metrics: list[tuple[str, Column | str]] = ()) -> DataFrame:
    """The stored rollup with the buckets of the scheduled window before `now` recomputed."""
    start, end = (now - x for x in WINDOWS[interval])
    return _replaced(stored, rollup(touched(events, interval, start, end), interval, metrics), start, end)


def refresh_rollup_from(events: DataFrame, stored: DataFrame, interval: str, from_seconds: int, metrics: list[tuple[str, Column | str]] = ()) -> DataFrame:
    """The stored rollup with every bucket from that of `from_seconds` on recomputed, as after a reorganisation."""
    width, origin = INTERVALS[interval][0], MONDAY if interval == "1w" else 0
    start = from_seconds - (from_seconds - origin) % width
    return _replaced(stored, rollup(touched(events, interval, start), interval, metrics), start, None)


def _replaced(stored: DataFrame, new: DataFrame, start: int, end: int | None) -> DataFrame:
    old = F.unix_timestamp("bucket") < start
    return stored.where(old if end is None else old | (F.unix_timestamp("bucket") >= end)).unionByName(new)


def refresh_stored(spark: SparkSession, events: DataFrame, path: str, interval: str, from_seconds: int | dict[int, int], metrics: list[tuple[str, Column | str]] = (), blocks: DataFrame | None = None) -> None:
    """Recompute the buckets from that of `from_seconds` on in a stored rollup, which is partitioned by chain_id and bucket_date.

    A partition holds a day, or a month under the name of its first day: months that are written whole, are over (a chain's newest
    event or header lies in a later one) and aren't stored by days already. So a long history is some folders a year, while
    a refresh at its end rewrites days. A month's partition into which the refresh falls keeps its rows before that day.

    from_seconds: of all chains, or of each chain that is to be recomputed; other chains are neither read nor written.
    Only the days from that bucket's on are recomputed. blocks: headers, whose times give each chain's first block
    that is needed, so that older partitions of `events` aren't read.
    """
    width, origin = INTERVALS[interval][0], MONDAY if interval == "1w" else 0

    def day_of(seconds: int) -> int:
        start = seconds - (seconds - origin) % width
        return start - start % 86_400  # whole days, as they are partitions

    of_all = None if isinstance(from_seconds, dict) else day_of(from_seconds)
    starts = {c: day_of(t) for c, t in from_seconds.items()} if of_all is None else {}
    chain, day, month = F.col("chain_id"), F.to_date("bucket"), F.trunc("bucket", "month")
    at = lambda t: F.timestamp_seconds(F.lit(t))
    month_of = lambda t: F.trunc(at(t), "month")
    either = lambda of: of_all_or({c: (chain == c) & of(t) for c, t in starts.items()}) if of_all is None else of(of_all)
    spans = (events if blocks is None else blocks).where(either(lambda t: F.col("block_timestamp") >= t)).groupBy("chain_id")
    newest = {r.chain_id: r for r in spans.agg(F.max("block_timestamp").alias("t"), *([] if blocks is None else [F.min("block_number").alias("b")])).collect()}  # a row for each chain
    if blocks is not None:
        bucketed = "block_bucket" in events.columns
        events = events.where(of_all_or({c: (chain == c) & (F.col("block_number") >= r.b) & ((F.col("block_bucket") >= r.b // BUCKET) if bucketed else F.lit(True)) for c, r in newest.items()}))
    new = rollup(events.where(either(lambda t: F.col("block_timestamp") >= t)), interval, metrics)
    hit, by_days, entered = None, {}, F.lit(False)
    if exists(spark, path):
        stored, label = spark.read.parquet(path), F.col("bucket_date")
        inside = stored.where(either(lambda t: (label == month_of(t)) & (F.col("bucket") >= at(t)) & (label < F.to_date(at(t)))))
        chains = [r.chain_id for r in inside.select("chain_id").distinct().collect()]  # whose month goes on beyond the first day
        entered = chain.isin(chains)
        hit = stored.where(either(lambda t: (label >= F.to_date(at(t))) | (entered & (label == month_of(t)))))
        for r in hit.where("day(bucket_date) > 1").select("chain_id", F.trunc("bucket_date", "month").alias("m")).distinct().collect():
            by_days.setdefault(r.chain_id, []).append(r.m)
        kept = hit.where(either(lambda t: F.col("bucket") < at(t)))
        new = new.unionByName(kept.select(*new.columns)) if chains else new
    over = of_all_or({c: (chain == c) & (month < month_of(r.t)) & ~month.isin(by_days.get(c, [])) for c, r in newest.items()})
    whole = either(lambda t: (over & (month >= F.to_date(at(t)))) | (entered & (month == month_of(t))))
    store_rollup(spark, new, path, F.when(whole, month).otherwise(day), hit)


def store_rollup(spark: SparkSession, rolled: DataFrame, path: str, span: Column | None = None, hit: DataFrame | None = None) -> None:
    """Store a rollup by chain_id and bucket_date, in place of the partitions in `hit`. span: the first day of a row's partition, by default of its month."""
    columns = ["chain_id", "bucket_date"]
    rows = rolled.withColumn("bucket_date", F.trunc("bucket", "month") if span is None else span)
    replace_partitions(spark, rows.hint("rebalance", *columns), path, columns, hit)  # a partition's rows meet in one task, or in several if they are many


def of_all_or(conditions: dict[int, Column]) -> Column:
    """Any of the conditions, of which there is one for each chain."""
    out = F.lit(False)
    for c in conditions.values():
        out = out | c
    return out


def distinct_sketch(column: str) -> Column:
    """A metric for `rollup`: a sketch of the distinct values of a column, which `coarsen` can merge."""
    return F.hll_sketch_agg(column, SKETCH_BITS)


#: Registers of a distinct-count sketch, as a power of two: a standard error of 1.04 / sqrt(2^12), under 2 %.
SKETCH_BITS = 12


def coarsen(rolled: DataFrame, to: str, sums: list[str] = (), sketches: list[str] = ()) -> DataFrame:
    """A coarser rollup from a finer one, of what adds up: event_count, the given metrics, and distinct counts kept as sketches.

    sketches: columns made by distinct_sketch; each stays a sketch, with its estimate beside it as <name>_estimate.
    """
    bucket = F.timestamp_seconds(bucket_start(F.unix_timestamp("bucket"), to)).alias("bucket")
    merged = rolled.groupBy("chain_id", "address", bucket).agg(F.sum("event_count").alias("event_count"), *[F.sum(c).alias(c) for c in sums], *[F.hll_union_agg(c).alias(c) for c in sketches])
    return merged.withColumns({f"{c}_estimate": F.hll_sketch_estimate(c) for c in sketches}) if sketches else merged


def refresh_coarse(rolled: DataFrame, stored: DataFrame, to: str, from_seconds: int, sums: list[str] = (), sketches: list[str] = ()) -> DataFrame:
    """The stored coarser rollup with the buckets from that of `from_seconds` on merged anew from the finer one, of which only those are read."""
    width, origin = INTERVALS[to][0], MONDAY if to == "1w" else 0
    start = from_seconds - (from_seconds - origin) % width
    new = coarsen(rolled.where(F.col("bucket") >= F.timestamp_seconds(F.lit(start))), to, sums, sketches)
    return _replaced(stored, new.select(*stored.columns), start, None)


def snapshot_every(events: DataFrame, blocks: DataFrame, n: int, columns: list[str], order: tuple[str, ...] = ("tx_index", "log_index")) -> DataFrame:
    """(chain_id, address, block_number, columns) at each multiple of n, as of the address's last event.

    Each event is valid from the first multiple at or after its block until the next event's, so
    it is repeated for the multiples it covers: no join of all addresses with all blocks.
    """
    tips = blocks.groupBy("chain_id").agg(F.max("block_number").alias("_tip"))
    slot = (F.ceil(F.col("block_number") / F.lit(n)) * n).cast("bigint")
    last = events.withColumn("_slot", slot).groupBy("chain_id", "address", "_slot").agg(F.max_by(F.struct(*columns), F.struct("block_number", *order)).alias("_v"))
    following = F.lead("_slot").over(Window.partitionBy("chain_id", "address").orderBy("_slot"))
    spans = last.withColumn("_next", following).join(F.broadcast(tips), "chain_id")  # a row for each chain
    spans = spans.withColumn("_end", F.least(F.coalesce(F.col("_next") - n, "_tip"), "_tip")).where("_slot <= _end")
    return spans.select("chain_id", "address", F.explode(F.sequence("_slot", "_end", F.lit(n).cast("bigint"))).alias("block_number"), "_v.*")


def metrics_by_chain(blocks: DataFrame, events: DataFrame, traces: DataFrame, accounts: DataFrame, reorgs: DataFrame | None = None, workers: DataFrame | None = None) -> DataFrame:
    """(chain_id, metric, label, value): counters of blocks, events, traces, account events and reorganisations, and the gauges current and tip."""

    def counted(df: DataFrame, metric: str, label: Column) -> DataFrame:
        return df.groupBy("chain_id", label.alias("label")).agg(F.count("*").alias("value")).select("chain_id", F.lit(metric).alias("metric"), "label", "value")

    tip = blocks.groupBy("chain_id").agg(F.max("block_number").alias("value")).select("chain_id", F.lit("tip").alias("metric"), F.lit("").alias("label"), "value")
    none = F.lit("")
    gauge = lambda df, metric, column: df.groupBy("chain_id").agg(F.max(column).cast("bigint").alias("value")).select("chain_id", F.lit(metric).alias("metric"), F.lit("").alias("label"), "value")
    if reorgs is not None:
        tip = tip.unionByName(counted(reorgs, "reorgs", none))
    if workers is not None:
        tip = tip.unionByName(gauge(workers, "current", "current_block"))
    return counted(blocks, "blocks", none).unionByName(counted(events, "events", none)).unionByName(counted(traces, "traces", F.col("call_type"))).unionByName(counted(accounts, "account_events", F.col("event_type"))).unionByName(tip)

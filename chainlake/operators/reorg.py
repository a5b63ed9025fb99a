"""Chain reorganisations: detection, common ancestors, and repair of stored tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chainlake.operators.store import append, delete_range, exists, insert_new

#: Blocks after which a chain's block is final, by chain id (fixed values); others have DEFAULT_FINALITY.
FINALITY = {
    1: 65, 5: 65, 11155111: 65, 137: 200, 80001: 200, 42161: 240, 421613: 240, 10: 240, 420: 240, 56: 15, 97: 15,
    43114: 12, 43113: 12, 250: 5, 100: 20, 8453: 240, 84531: 240, 324: 50, 1101: 50, 59144: 100, 534352: 100,
}
DEFAULT_FINALITY = 65


def parent_check(blocks: DataFrame) -> DataFrame:
    """(chain_id, block_number, parent_hash, stored_hash) where a block's parent isn't the stored block before it; an absent parent is fine."""
    parents = blocks.select("chain_id", (F.col("block_number") + 1).alias("block_number"), F.col("block_hash").alias("stored_hash"))
    joined = blocks.select("chain_id", "block_number", "parent_hash").join(parents, ["chain_id", "block_number"])
    return joined.where("parent_hash <> stored_hash")


def common_ancestor(stored: DataFrame, canonical: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(chain_id, ancestor, tip, depth, reorged): the highest stored block that is canonical, and those above it.

    Only the newest `max_depth` stored blocks are looked at. ancestor is null if none of them matches.
    """
    keys = ["chain_id", "block_number"]
    if max_depth is not None:
        stored = known_window(stored, max_depth)
    tips = stored.groupBy("chain_id").agg(F.max("block_number").alias("tip"))
    own = stored.join(F.broadcast(tips), "chain_id")  # a row for each chain
    both = own.select(*keys, "tip", "block_hash").join(canonical.select(*keys, F.col("block_hash").alias("true_hash")), keys, "left")
    found = both.groupBy("chain_id", "tip").agg(F.max(F.when(F.col("block_hash") == F.col("true_hash"), F.col("block_number"))).alias("ancestor"))
    above = both.join(F.broadcast(found.select("chain_id", "ancestor")), "chain_id").where("ancestor is null or block_number > ancestor")
    lists = above.groupBy("chain_id").agg(F.sort_array(F.collect_list("block_number")).alias("reorged"))
    return found.join(lists, "chain_id", "left").select("chain_id", "ancestor", "tip", (F.col("tip") - F.col("ancestor")).alias("depth"), F.coalesce("reorged", F.array().cast("array<bigint>")).alias("reorged"))


def conservative_ancestor(stored: DataFrame, depth: int) -> DataFrame:
    """(chain_id, ancestor): the block before the whole known window."""
    return known_window(stored, depth).groupBy("chain_id").agg((F.min("block_number") - 1).alias("ancestor"))


def known_window(blocks: DataFrame, depth: int, from_block: int | None = None) -> DataFrame:
    """Each chain's newest `depth` blocks, whatever numbers are missing, those from `from_block` on dropped first.

    A task hands on no more than `depth` blocks of a chain (the rank's limit is applied before the shuffle).
    """
    if from_block is not None:
        blocks = blocks.where(F.col("block_number") < from_block)
    newest = Window.partitionBy("chain_id").orderBy(F.desc("block_number"), "block_hash")
    return blocks.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= depth).drop("_n")


def chain_difference(stored: DataFrame, canonical: DataFrame) -> DataFrame:
    """(chain_id, block_number, block_hash, true_hash, state) of every number of either chain: same, replaced, only stored (orphan) or only canonical (absent)."""
    own = stored.select("chain_id", "block_number", "block_hash")
    both = own.join(canonical.select("chain_id", "block_number", F.col("block_hash").alias("true_hash")), ["chain_id", "block_number"], "full_outer")
    state = F.when(F.col("true_hash").isNull(), "orphan").when(F.col("block_hash").isNull(), "absent").when(F.col("block_hash") == F.col("true_hash"), "same").otherwise("replaced")
    return both.withColumn("state", state)


def with_finality(blocks: DataFrame, tips: DataFrame | None = None) -> DataFrame:
    """Blocks with finality (the chain's depth) and is_final. tips: (chain_id, tip), by default the newest block."""
    tips = blocks.groupBy("chain_id").agg(F.max("block_number").alias("tip")) if tips is None else tips
    depth = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in FINALITY.items() for x in pair]), F.col("chain_id").cast("int")), F.lit(DEFAULT_FINALITY))
    return blocks.join(F.broadcast(tips), "chain_id").withColumn("finality", depth).withColumn("is_final", F.col("tip") - F.col("block_number") >= F.col("finality")).drop("tip")


def canonicalize(raw: DataFrame, canonical: DataFrame) -> DataFrame:
    """Rows whose block is canonical by number and hash."""
    return raw.join(canonical.select("chain_id", "block_number", "block_hash"), ["chain_id", "block_number", "block_hash"], "left_semi")


def rewritten(stored: DataFrame, replay: DataFrame, chain_id: int, ancestor: int, tip: int) -> DataFrame:
    """A table with (ancestor, tip] of a chain replaced by the replayed rows of that range."""
    inside = F.col("block_number").between(ancestor + 1, tip)
    kept = stored.where((F.col("chain_id") != chain_id) | ~inside)
    return kept.unionByName(replay.where((F.col("chain_id") == chain_id) & inside))


def rewrite_reorg(
    spark: SparkSession, store: dict[str, str], chain_id: int, ancestor: int, tip: int, replay: dict[str, DataFrame] = {}, refresh: Callable[[], None] | None = None, messages: str | None = None, last: str | None = None
) -> None:
    """Repair stored tables {name: path}: note the reorganisation, delete (ancestor, tip] everywhere, append the replay, refresh rollups.

    Children that were created in deleted blocks go with them, as their table holds block_number too. messages:
    a table that gets a row (chain_id, ancestor, tip, depth, below_finality), once. A fork deeper than the chain's
    finality is repaired like any other; below_finality says so. last: the name of the table that tells
    whether a repair is needed; it is repaired after all others, so that an attempt that fails is made again.
    Every step can be repeated after a failure: the deletion removes what an earlier attempt has appended.
    """
    below = tip - ancestor > FINALITY.get(chain_id, DEFAULT_FINALITY)
    if messages:
        row = spark.range(1).select(F.lit(chain_id).cast("int").alias("chain_id"), F.lit(ancestor).cast("bigint").alias("block_number"), F.lit(tip).cast("bigint").alias("tip"), F.lit(tip - ancestor).cast("bigint").alias("depth"), F.lit(below).alias("below_finality"))
        insert_new(row, messages, ["chain_id", "block_number", "tip"])
    for name in sorted(store, key=lambda n: n == last):
        path = store[name]
        if exists(spark, path):
            delete_range(spark, path, chain_id, ancestor + 1, tip)
        if name in replay:
            rows = replay[name].where((F.col("chain_id") == chain_id) & F.col("block_number").between(ancestor + 1, tip))
            append(rows, path)
    if refresh:
        refresh()

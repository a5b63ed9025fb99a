"""Choice of one chain among blocks of several branches.

Blocks form a forest by their parents' hashes. Of each block number the block is chosen whose best
descendant is highest; of equally high ones a new one, then the one with the least hash. So the chosen
blocks are linked wherever a parent is there at all. Best descendants are found by pointer doubling:
after i rounds each block has met all that lie less than 2^i above it, and points 2^i blocks down.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainlake.operators.store import remove
from chainlake.sources.scratch import new_folder, written

NUMBER = ["chain_id", "block_number"]
NODE = [*NUMBER, "block_hash"]


def _rank(number: str = "block_number"):
    """Smaller is better."""
    return F.struct((-F.col(number)).alias("n"), (1 - F.col("_new")).alias("o"), F.col("block_hash").alias("h"))


def best_branch(blocks: DataFrame, folder: str | None = None) -> DataFrame:
    """The chosen blocks: a row of each (chain_id, block_number) of `blocks`, which has block_hash, parent_hash, _new (1 or 0), and no two rows of one hash and number.

    Blocks below the lowest number that has several aren't looked at, and nothing is where no number has:
    an ordinary batch costs one aggregate. Each round's pointers are written under `folder`, by default a new shared one,
    where the last ones stay as long as the result is needed.
    """
    spark = blocks.sparkSession
    ids = blocks.select(*NODE, "parent_hash", "_new")
    several = ids.groupBy(*NUMBER).count().where("count > 1").groupBy("chain_id").agg(F.min("block_number").alias("_low"))
    if not several.limit(1).count():
        return blocks
    region = ids.join(F.broadcast(several), "chain_id").where("block_number >= _low").drop("_low")  # a row for each chain that forks
    parents = region.select("chain_id", (F.col("block_number") + 1).alias("block_number"), F.col("block_hash").alias("parent_hash"), F.lit(True).alias("_there"))
    nodes = region.join(parents, [*NUMBER, "parent_hash"], "left").select(*NODE, F.when(F.col("_there"), F.col("parent_hash")).alias("up"), _rank().alias("best"))
    step, held, folder = 1, None, folder or new_folder(spark, "branches")
    while True:
        nodes = written(nodes, path := f"{folder}/up-{step}")
        if held:
            remove(spark, held)
        held = path
        if not nodes.where("up is not null").limit(1).count():
            break
        from_above = nodes.where("up is not null").groupBy("chain_id", (F.col("block_number") - step).alias("block_number"), F.col("up").alias("block_hash")).agg(F.min("best").alias("_above"))
        further = nodes.select("chain_id", (F.col("block_number") + step).alias("block_number"), F.col("block_hash").alias("up"), F.col("up").alias("_further"))
        nodes = nodes.join(from_above, NODE, "left").join(further, [*NUMBER, "up"], "left").select(*NODE, F.col("_further").alias("up"), F.least("best", "_above").alias("best"))
        step *= 2
    chosen = nodes.groupBy(*NUMBER).agg(F.min_by("block_hash", "best").alias("_chosen"))
    return blocks.join(chosen, NUMBER, "left").where("_chosen is null or block_hash = _chosen").drop("_chosen")


def breaks(chosen: DataFrame) -> DataFrame:
    """(chain_id, block_number, parent_hash, stored_hash) of chosen blocks whose parent isn't the chosen block before them; an absent one is fine."""
    before = chosen.select("chain_id", (F.col("block_number") + 1).alias("block_number"), F.col("block_hash").alias("stored_hash"))
    return chosen.select(*NUMBER, "parent_hash").join(before, NUMBER).where("parent_hash <> stored_hash")

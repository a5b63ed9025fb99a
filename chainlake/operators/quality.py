"""Validation of logs against headers, and completeness of block ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chainlake.operators.shaping import BUCKET
from chainlake.sources.keccak import keccak256

KEY = ["chain_id", "block_number"]


def enrich_headers(logs: DataFrame, blocks: DataFrame, how: str = "strict") -> DataFrame:
    """Logs with block_timestamp: without a header they are dropped (strict) or get 0 (lenient)."""
    stamps = blocks.select(*KEY, "block_timestamp").dropDuplicates(KEY)
    out = logs.drop("block_timestamp").join(stamps, KEY, "inner" if how == "strict" else "left")
    return out.withColumn("block_timestamp", F.coalesce("block_timestamp", F.lit(0).cast("bigint")))


def drop_out_of_range(logs: DataFrame, low: int, high: int) -> DataFrame:
    return logs.where(F.col("block_number").between(low, high))


def split_hash_mismatch(logs: DataFrame, blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): rejected where log and header both have a hash and they differ."""
    heads = blocks.select(*KEY, F.col("block_hash").alias("_head")).dropDuplicates(KEY)
    joined = logs.join(heads, KEY, "left")
    differs = F.coalesce((F.col("block_hash") != "") & (F.col("_head") != "") & (F.col("block_hash") != F.col("_head")), F.lit(False))
    return joined.where(~differs).drop("_head"), joined.where(differs).drop("_head")


def bloom_is_empty(bloom):
    return F.coalesce(F.ltrim(F.regexp_replace(F.lower(bloom), "^0x", ""), F.lit("0")) == "", F.lit(True))


def bloom_audit(blocks: DataFrame, logs: DataFrame) -> DataFrame:
    """Blocks whose bloom isn't empty but that have no logs."""
    return blocks.where(~bloom_is_empty(F.col("logs_bloom"))).join(logs.select(*KEY).distinct(), KEY, "left_anti")


def bloom_bits(address: str) -> list[int]:
    """The three bits of a 2048-bit bloom that an address sets."""
    h = keccak256(bytes.fromhex(address.removeprefix("0x")))
    return [int(h[4 * i : 4 * i + 4], 16) & 2047 for i in range(3)]


def bloom_may_contain(blocks: DataFrame, addresses: list[str]) -> DataFrame:
    """Blocks whose bloom may hold one of the addresses; without any, those whose bloom isn't empty.

    The addresses' bits are one small table (twelve bytes an address), read as one value; a block's bloom becomes 32 words
    of 64 bits, of which bits are tested. The plan is the same for one address and for 100,000. A null bloom holds none.
    """
    if not addresses:
        return blocks.where(~bloom_is_empty(F.col("logs_bloom")))
    spark = blocks.sparkSession
    table = spark.createDataFrame([tuple(bloom_bits(a)) for a in sorted(set(addresses))], "a int, b int, c int")
    wanted = table.agg(F.collect_list(F.struct("a", "b", "c"))).scalar()
    body = F.lpad(F.regexp_replace(F.lower("logs_bloom"), "^0x", ""), 512, "0")
    words = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.conv(F.substr(body, 497 - 16 * i, F.lit(16)), 16, -10).cast("bigint"))  # word 0 holds the lowest bits
    bit = lambda w, n: F.getbit(F.get(w, F.shiftright(n, 6)), n.bitwiseAND(63)) == 1
    any_of = lambda w: F.exists("_wanted", lambda x: bit(w, x["a"]) & bit(w, x["b"]) & bit(w, x["c"]))
    held = F.transform(F.array(words), any_of).getItem(0)  # the words are made once
    return blocks.withColumn("_wanted", wanted).where(F.coalesce(held, F.lit(False))).select(*blocks.columns)


#: Block numbers that one bitmap holds.
BITS = 32_768


def _bits(df: DataFrame) -> DataFrame:
    """(chain_id, _of, _bits): a bitmap of the block numbers of each chain and BITS numbers; tasks hand on bitmaps only."""
    n = F.col("block_number")
    return df.select("chain_id", F.bitmap_bucket_number(n).alias("_of"), F.bitmap_bit_position(n).alias("_at")).groupBy("chain_id", "_of").agg(F.bitmap_construct_agg("_at").alias("_bits"))


def _held(bits: Column, at: Column) -> Column:
    """Whether a bit is set, in a bitmap's hex digits."""
    digits = F.substr(bits, (F.floor(at / 8) * 2 + 1).cast("int"), F.lit(2))
    return F.getbit(F.conv(digits, 16, 10).cast("int"), (at % 8).cast("int")) == 1


def missing_blocks(spark: SparkSession, blocks: DataFrame, low: int, high: int) -> DataFrame:
    """(chain_id, block_number) of an inclusive range that a chain of `blocks` lacks.

    Each chain's blocks become bitmaps of BITS numbers; the range is a row for each BITS numbers and chain, not for each number, and
    missing numbers are read from bitmaps that aren't full. Numbers are taken to be positive; block 0 has a bitmap of its own.
    """
    inside = blocks.where(F.col("block_number").between(low, high))
    at = lambda n: 1 + (n - 1) // BITS if n > 0 else 0
    every = blocks.select("chain_id").distinct().select("chain_id", F.explode(F.sequence(F.lit(at(low)).cast("bigint"), F.lit(at(high)).cast("bigint"))).alias("_of"), F.unhex(F.lit("")).alias("_bits"))
    bits = _bits(inside).unionByName(every).groupBy("chain_id", "_of").agg(F.bitmap_or_agg("_bits").alias("_bits")).where(F.bitmap_count("_bits") < BITS)
    first = F.when(F.col("_of") > 0, (F.col("_of") - 1) * BITS + 1).otherwise(F.lit(0).cast("bigint"))
    last = F.when(F.col("_of") > 0, F.col("_of") * BITS).otherwise(F.lit(0).cast("bigint"))
    spans = bits.select("chain_id", first.alias("_first"), F.greatest(first, F.lit(low)).alias("_a"), F.least(last, F.lit(high)).alias("_b"), "_bits").where("_a <= _b")
    gone = F.transform(F.array(F.hex("_bits")), lambda h: F.filter(F.sequence("_a", "_b"), lambda n: ~_held(h, n - F.col("_first")))).getItem(0)  # the digits are made once
    return spans.select("chain_id", F.explode(gone).alias("block_number"))


def present(df: DataFrame, blocks: DataFrame) -> DataFrame:
    """The given blocks (block_number, and chain_id if it is there) with present: without chain_id, whether any chain has the number.

    `df` is sent as bitmaps of BITS numbers, however many rows it has. A null number is absent.
    """
    keys = [c for c in ("chain_id", "block_number") if c in blocks.columns]
    if "chain_id" not in keys:
        have = _bits(df.select(F.lit(0).alias("chain_id"), "block_number"))
        return present_in(have, blocks.select(F.lit(0).alias("chain_id"), "block_number")).select("block_number", "present")
    return present_in(_bits(df), blocks.select(*keys))


def present_in(bits: DataFrame, blocks: DataFrame) -> DataFrame:
    """The given (chain_id, block_number) with present, by bitmaps."""
    n = F.col("block_number")
    asked = blocks.withColumn("_of", F.bitmap_bucket_number(n)).join(bits.withColumn("_bits", F.hex("_bits")), ["chain_id", "_of"], "left")
    return asked.select("chain_id", "block_number", F.coalesce(_held(F.col("_bits"), F.bitmap_bit_position(n)), F.lit(False)).alias("present"))


def gap_ranges(blocks: DataFrame) -> DataFrame:
    """(chain_id, first, last) of the missing runs between a chain's stored blocks.

    Neighbours are looked for within buckets of block numbers, so that no chain is sorted in one place; between
    buckets only their first and last blocks are.
    """
    b = blocks.select("chain_id", "block_number", F.floor(F.col("block_number") / BUCKET).alias("_bucket")).distinct()
    after = F.lead("block_number").over(Window.partitionBy("chain_id", "_bucket").orderBy("block_number"))
    inner = b.select("chain_id", "block_number", after.alias("next"))
    edges = b.groupBy("chain_id", "_bucket").agg(F.min("block_number").alias("low"), F.max("block_number").alias("block_number"))  # two numbers a bucket
    outer = edges.select("chain_id", "block_number", F.lead("low").over(Window.partitionBy("chain_id").orderBy("_bucket")).alias("next"))
    gaps = inner.unionByName(outer).where("next > block_number + 1")
    return gaps.select("chain_id", (F.col("block_number") + 1).alias("first"), (F.col("next") - 1).alias("last"))

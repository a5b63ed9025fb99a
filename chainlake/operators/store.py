"""Stored tables: key-idempotent inserts, range deletes, layout.

Tables are Parquet folders partitioned by chain_id and block_bucket. Rewrites replace whole
partitions (dynamic partition overwrite) and touch only those that change.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chainlake.operators.shaping import BUCKET
from chainlake.sources.scratch import written

LAYOUT = ["chain_id", "block_bucket"]


def first_by_key(df: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """One row of each key: the least by `order`, by default by all columns, so the choice is stated.

    An aggregate with partial results, not a window: repeated keys meet in no sort.
    """
    rest = [c for c in df.columns if c not in keys]
    order = order or rest
    if not rest:
        return df.distinct()
    packed = F.struct(*rest) if order == rest else None
    least = F.min(packed) if packed is not None else F.min_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(least.alias("_r")).select(*[F.col(c) if c in keys else F.col(f"_r.{c}").alias(c) for c in df.columns])


def without(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of `df` whose key isn't in `other`; null keys are equal, as in groups."""
    return _matched(df, other, keys, "left_anti")


def _matched(df: DataFrame, other: DataFrame, keys: list[str], how: str) -> DataFrame:
    same = [F.col(f"own.{k}").eqNullSafe(F.col(f"theirs.{k}")) for k in keys]
    return df.alias("own").join(other.select(*keys).alias("theirs"), reduce(Column.__and__, same), how)


def single_by_key(df: DataFrame, keys: list[str], aside: str, order: list[str] | None = None) -> DataFrame:
    """As first_by_key, for wide rows of which few keys repeat: only the keys are shuffled, and whole rows of those that repeat.

    `df` is read for the keys and again for the rows, so it should be a stored table. The repeated keys are written to `aside`.
    """
    repeated = written(df.groupBy(*keys).count().where("count > 1").select(*keys), aside)
    if not repeated.limit(1).count():
        return df
    return without(df, repeated, keys).unionByName(first_by_key(_matched(df, repeated, keys, "left_semi"), keys, order))


def with_bucket(df: DataFrame) -> DataFrame:
    return df.withColumn("block_bucket", F.floor(F.col("block_number") / BUCKET).cast("bigint"))


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a table with rows; an insert of none leaves an empty folder."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(at) and any(not f.getPath().getName().startswith(("_", ".")) for f in fs.listStatus(at))


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def read(spark: SparkSession, path: str, like: DataFrame | None = None) -> DataFrame:
    """The table at `path`; given `like`, with its schema, and empty where there is no table yet."""
    if like is None:
        return spark.read.parquet(path)
    return spark.read.schema(like.schema).parquet(path) if exists(spark, path) else like.limit(0)


def new_rows(df: DataFrame, stored: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """Rows whose key isn't stored, one of each key: what is stored already goes before keys are made single."""
    return first_by_key(df.join(stored.select(*keys), keys, "left_anti").select(*df.columns), keys, order)


def append(df: DataFrame, path: str) -> None:
    with_bucket(df).sortWithinPartitions("block_number").write.mode("append").partitionBy(*LAYOUT).parquet(path)


def insert_new(df: DataFrame, path: str, keys: list[str], order: list[str] | None = None, buckets: Column | None = None, single: bool = False) -> None:
    """Append rows of absent keys, so that a repeated batch adds nothing.

    Only the buckets of the batch are read: both the bucket range and the anti-join's keys reach the scan.
    buckets: a condition that holds for the partitions of all rows (bucket_filter), where it is known already; it saves a pass
    over `df`. single: no key repeats in `df`, so that its rows needn't be shuffled.
    """
    stored = of_buckets(df.sparkSession, df, path, buckets)
    append(df.join(stored.select(*keys), keys, "left_anti").select(*df.columns) if single else new_rows(df, stored, keys, order), path)


#: Partitions that are named one by one in a filter; of more, each chain's span is.
NAMED_PARTITIONS = 2_000


def bucket_filter(df: DataFrame, below: int = 0, onward: bool = False) -> Column:
    """A condition on chain_id and block_bucket: the partitions that `df` has rows of, of each chain its own.

    below: how many blocks lower than its lowest a chain's rows may be; onward: whether its higher buckets count too.
    """
    pairs = df.select("chain_id", F.floor((F.col("block_number") - below) / BUCKET).cast("bigint").alias("low"), F.floor(F.col("block_number") / BUCKET).cast("bigint").alias("high")).distinct()
    spans = pairs.groupBy("chain_id").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.count("*").alias("n"), F.slice(F.array_sort(F.collect_set("high")), 1, NAMED_PARTITIONS).alias("named")).collect()
    chain, bucket, out = F.col("chain_id"), F.col("block_bucket"), F.lit(False)
    few = sum(r.n for r in spans) <= NAMED_PARTITIONS and not below and not onward
    for r in spans:
        of_chain = bucket.isin(r.named) if few else bucket >= r.low if onward else bucket.between(r.low, r.high)
        out = out | ((chain == r.chain_id) & of_chain)
    return out


def of_buckets(spark: SparkSession, df: DataFrame, path: str, buckets: Column | None = None) -> DataFrame:
    """The stored rows of the partitions that `df` has rows of; other chains' and other buckets' files aren't read. buckets: that condition, if it is known."""
    stored = read(spark, path, with_bucket(df))
    return stored if not exists(spark, path) else stored.where(bucket_filter(df) if buckets is None else buckets)


def of_buckets_from(spark: SparkSession, df: DataFrame, path: str, depth: int) -> DataFrame:
    """The stored rows of the chains of `df`, from `depth` blocks below a chain's lowest on."""
    return read(spark, path, with_bucket(df)).where(bucket_filter(df, depth, onward=True)).select(*df.columns)


def conflicts(df: DataFrame, stored: DataFrame, keys: list[str]) -> int:
    """Keys of the batch that are stored already or come twice in it."""
    twice = df.groupBy(*keys).count().where("count > 1").select(*keys)
    return df.select(*keys).join(stored.select(*keys), keys, "left_semi").union(twice).distinct().count()


def insert_strict(df: DataFrame, path: str, keys: list[str], on_conflict: str = "fail") -> str:
    """Append the batch as it is if no key conflicts; else fail, skip it, or insert_new ("fallback"). Returns what was done."""
    if conflicts(df, of_buckets(df.sparkSession, df, path), keys) == 0:
        append(df, path)
        return "inserted"
    if on_conflict == "fail":
        raise ValueError("the batch has keys that are stored already or repeat")
    if on_conflict == "fallback":
        insert_new(df, path, keys)
    return {"skip": "skipped", "fallback": "fallback"}[on_conflict]


def without_range(df: DataFrame, chain_id: int, low: int, high: int, block: str = "block_number") -> DataFrame:
    """Rows outside an inclusive block range of a chain."""
    return df.where((F.col("chain_id") != chain_id) | ~F.col(block).between(low, high))


def replace_partitions(spark: SparkSession, rows: DataFrame, path: str, columns: list[str], hit: DataFrame | None, options: dict[str, str] = {}) -> None:
    """Replace the partitions in `hit` (a row of `columns` for each; None for none) by `rows`, which may come from the same table.

    The rows are written aside first, in a folder of their own and not yet by partition; partitions without rows are dropped.
    """
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    fs = fs_path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    aside = f"{path.rstrip('/')}__{uuid.uuid4().hex}"
    rows.write.parquet(aside)
    wanted = {tuple(r) for r in hit.select(*columns).distinct().collect()} if hit is not None else set()  # the partitions that are replaced
    kept = spark.read.schema(rows.schema).parquet(aside)
    kept.write.mode("overwrite").options(**options).option("partitionOverwriteMode", "dynamic").partitionBy(*columns).parquet(path)
    full = {tuple(r) for r in kept.select(*columns).distinct().collect()}
    for gone in wanted - full:
        fs.delete(fs_path("/".join([path.rstrip("/"), *[f"{c}={v}" for c, v in zip(columns, gone, strict=True)]])), True)
    fs.delete(fs_path(aside), True)


def delete_range(spark: SparkSession, path: str, chain_id: int, low: int, high: int) -> None:
    """Remove an inclusive block range: the buckets it touches are rewritten, and dropped where nothing stays."""
    stored = spark.read.parquet(path)
    hit = stored.where((F.col("chain_id") == chain_id) & F.col("block_bucket").between(low // BUCKET, high // BUCKET))
    replace_partitions(spark, without_range(hit, chain_id, low, high), path, LAYOUT, hit)


def delete_everywhere(spark: SparkSession, tables: dict[str, str], chain_id: int, low: int, high: int) -> list[str]:
    """delete_range of every stored table {name: path} of a deployment: raw, decoded, traces, accounts, children. Returns the names of those there are."""
    there = [name for name in sorted(tables) if exists(spark, tables[name])]
    for name in there:
        delete_range(spark, tables[name], chain_id, low, high)
    return there


#: How cold partitions are stored: a stronger codec, Bloom filters of what is looked up, row groups small enough to be passed over.
COLD = {"compression": "zstd", "parquet.compression.codec.zstd.level": "9", "parquet.block.size": str(8 << 20)}
LOOKED_UP = ("address", "topic0", "from_address", "to_address")


def compact(spark: SparkSession, path: str, older_than: int, to: str | None = None, options: dict[str, str] = COLD) -> None:
    """Rewrite the buckets whose blocks are all below `older_than`, clustered by bucket, address and newest block first; elsewhere if `to` is given.

    A large bucket is cut by ranges of address and block among several tasks. The files get `options`, and Bloom filters on
    the columns of LOOKED_UP, so that a lookup passes over row groups that can't hold its address or topic.
    """
    old = spark.read.parquet(path).where(F.col("block_bucket") < older_than // BUCKET)
    order = [c for c in ("address", "from_address") if c in old.columns][:1]
    clustered = old.repartitionByRange(*LAYOUT, *order, "block_number").sortWithinPartitions(*LAYOUT, *order, F.desc("block_number"))
    tier = {**options, **{f"parquet.bloom.filter.enabled#{c}": "true" for c in LOOKED_UP if c in old.columns}}
    if to:
        clustered.write.mode("overwrite").options(**tier).partitionBy(*LAYOUT).parquet(to)
    else:
        replace_partitions(spark, clustered, path, LAYOUT, old, tier)

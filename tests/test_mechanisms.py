import random

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from chainlake.operators import quality, rollup, shaping, store
from chainlake.plans.streams import _collected
from chainlake.streaming import live


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def blocks(spark, chain_id, numbers):
    return spark.createDataFrame([(chain_id, n, f"0x{n % 5}", f"t{n}") for n in numbers], "chain_id int, block_number long, address string, tx_hash string")


def test_missing_blocks_by_bitmaps(spark):
    rng = random.Random(1)
    have = {c: sorted(rng.sample(range(0, 140_000), 120_000)) for c in (1, 7)}
    df = blocks(spark, 1, have[1]).unionByName(blocks(spark, 7, have[7]))
    for low, high in ((0, 139_999), (32_700, 65_600), (1, 1), (70_000, 70_000)):
        got = sorted(map(tuple, quality.missing_blocks(spark, df, low, high).collect()))
        assert got == sorted((c, n) for c in have for n in set(range(low, high + 1)) - set(have[c]))
    wide = plan(quality.missing_blocks(spark, df, 1, 10**9))
    assert "Join" not in wide and "Range (" not in wide


def test_presence_by_bitmaps(spark):
    df = blocks(spark, 1, range(0, 70_000, 3))
    asked = spark.createDataFrame([(1, 0), (1, 32_769), (1, 32_768), (1, 69_999), (2, 3), (1, None)], "chain_id int, block_number long")
    assert {(r.chain_id, r.block_number): r.present for r in quality.present(df, asked).collect()} == {(1, 0): True, (1, 32_769): True, (1, 32_768): False, (1, 69_999): True, (2, 3): False, (1, None): False}
    assert [r.present for r in quality.present(df, asked.select("block_number").where("block_number = 3")).collect()] == [True]


def test_bloom_plan_doesnt_grow_with_addresses(spark):
    address = lambda i: f"0x{i:040x}"
    value = 0
    for bit in quality.bloom_bits(address(3)):
        value |= 1 << bit
    rows = [(1, f"0x{value:0512x}"), (2, "0x" + "0" * 512), (3, None), (4, f"{value:X}"), (5, "0x" + "f" * 512)]
    df = spark.createDataFrame(rows, "block_number long, logs_bloom string")
    one, many = quality.bloom_may_contain(df, [address(3)]), quality.bloom_may_contain(df, [address(i) for i in range(200)])
    assert sorted(r.block_number for r in one.collect()) == [1, 4, 5] == sorted(r.block_number for r in many.collect())
    shape = lambda d: len(d._jdf.queryExecution().optimizedPlan().toString())
    assert abs(shape(one) - shape(many)) < 60


def test_stats_come_from_footers(spark, tmp_path):
    path = str(tmp_path / "t")
    store.append(blocks(spark, 1, range(5, 900)).unionByName(blocks(spark, 2, range(100_000, 100_010))), path)
    got = shaping.stored_stats(spark, path)
    assert sorted(map(tuple, got.collect())) == [(1, 5, 899, 895), (2, 100_000, 100_009, 10)]
    assert "PushedAggregation: [MIN(block_number), MAX(block_number), COUNT(*)]" in plan(got) and "PushedGroupBy: [chain_id, block_bucket]" in plan(got)


def test_reads_are_of_a_batchs_own_partitions(spark, tmp_path):
    """Chains far apart: what lies between their blocks isn't read."""
    path = str(tmp_path / "t")
    store.append(blocks(spark, 1, [5, 20_000_000]).unionByName(blocks(spark, 2, [7, 300_000_000, 150_000_000])), path)
    batch = blocks(spark, 1, [20_000_001]).unionByName(blocks(spark, 2, [300_000_001]))
    files = lambda df: sorted(f.split("/t/")[1].rpartition("/")[0] for f in df.inputFiles())
    got = store.of_buckets(spark, batch, path)
    assert sorted(r.block_number for r in got.collect()) == [20_000_000, 300_000_000] and "block_bucket" in plan(got).split("PartitionFilters")[1]
    got = store.of_buckets_from(spark, blocks(spark, 1, [20_000_001]), path, 64)
    assert [r.block_number for r in got.collect()] == [20_000_000]
    store.insert_new(batch.unionByName(blocks(spark, 2, [300_000_000])), path, ["chain_id", "block_number"])
    assert spark.read.parquet(path).count() == 7 and len(files(spark.read.parquet(path))) >= 5


def test_rollups_of_the_given_chains_only_are_refreshed(spark, tmp_path):
    events = blocks(spark, 1, range(50)).unionByName(blocks(spark, 2, range(50))).withColumn("block_timestamp", 1_704_240_000 + 3_600 * F.col("block_number"))
    path = str(tmp_path / "r")
    rollup.refresh_stored(spark, events.where("block_number < 40"), path, "1h", 0)
    count = lambda: {r.chain_id: r.n for r in spark.read.parquet(path).groupBy("chain_id").agg(F.sum("event_count").alias("n")).collect()}
    assert count() == {1: 40, 2: 40}
    rollup.refresh_stored(spark, events, path, "1h", {2: 1_704_240_000 + 3_600 * 30}, blocks=events)
    assert count() == {1: 40, 2: 50}


def test_cold_buckets_have_their_codec_and_are_passed_over(spark, tmp_path):
    rows = spark.range(60_000).selectExpr("1 AS chain_id", "id % 90000 AS block_number", "sha2(string(id % 2000), 256) AS address", "sha2(string(id), 256) AS data", "sha2(string(id % 7), 256) AS topic0")
    path = str(tmp_path / "t")
    store.append(rows.unionByName(rows.limit(5).withColumn("block_number", F.lit(500_000).cast("long"))), path)
    store.compact(spark, path, 200_000, options={**store.COLD, "parquet.block.size": str(256 << 10)})
    cold, hot = (sorted((tmp_path / "t" / "chain_id=1" / f"block_bucket={b}").glob("*.parquet")) for b in (0, 5))
    meta = [pq.ParquetFile(f).metadata for f in cold]
    codec = lambda m: m.row_group(0).column(0).compression
    assert {codec(m) for m in meta} == {"ZSTD"} and codec(pq.ParquetFile(hot[0]).metadata) == "SNAPPY" and sum(m.num_row_groups for m in meta) > 4
    wanted = spark.read.parquet(path).where("block_bucket = 0 and address = sha2('77', 256)")
    assert wanted.count() == 30
    held = [(m.row_group(i).column(m.schema.to_arrow_schema().names.index("address")).statistics, m.row_group(i).num_rows) for m in meta for i in range(m.num_row_groups)]
    value = wanted.first().address
    assert sum(n for s, n in held if s.min <= value <= s.max) < 60_000 / 3  # what a lookup has to read, of all rows
    nodes = [wanted._jdf.queryExecution().executedPlan()]
    assert "PushedFilters: [IsNotNull(address)" in nodes[0].toString()


def test_streamed_transactions_are_counted_exactly(spark):
    rng = random.Random(2)
    rows = [(1, "0xa", f"t{rng.randrange(40)}", 1_704_240_000 + 600 * i, rng.randrange(9)) for i in range(600)]
    rows += [(1, "0xb", "t1", 1_704_240_000 + 600 * 599, 1)]
    df = spark.createDataFrame(rows, "chain_id int, address string, tx_hash string, block_timestamp long, log_index int")
    parts = [df.where(f"block_timestamp between 1704240000 + 600 * {a} and 1704240000 + 600 * {b}") for a, b in ((0, 250), (200, 430), (431, 600))]  # 51 rows come twice, within the delay
    got = _collected(spark, parts, "exact", lambda s: live.stream_rollup(s, "1d", "2 days", [("low", "min(log_index)"), ("all", "sum(log_index)")]))
    want = rollup.rollup(df.unionByName(df.where("block_timestamp between 1704240000 + 600 * 200 and 1704240000 + 600 * 250")), "1d", [("low", "min(log_index)"), ("all", "sum(log_index)")])
    done = {(r.address, r.bucket): (r.event_count, r.tx_count, r.low, r["all"]) for r in got.collect()}
    exact = {(r.address, r.bucket): (r.event_count, r.tx_count, r.low, r["all"]) for r in want.collect()}
    assert len(done) >= 2 and all(exact[k] == v for k, v in done.items())
    for text in ("avg(log_index)", "count(DISTINCT tx_hash)", "sum(a) + 1"):
        with pytest.raises(ValueError):
            live.stream_rollup(df, "1d", "1 day", [("x", text)])

import pytest
from pyspark.sql import functions as F

from chainlake.operators import accounts, factory, progress, quality, reorg, rollup, shaping, sinks, store, views
from chainlake.plans import catalog
from chainlake.sources import ingest

KEY = ["chain_id", "block_number", "log_index"]


def logs(spark, blocks, value="a"):
    rows = [(1, b, 0, i, f"h{b}", f"t{b}", "0xaa", value) for b in blocks for i in range(2)]
    return spark.createDataFrame(rows, "chain_id int, block_number long, tx_index int, log_index int, block_hash string, tx_hash string, address string, note string")


def test_inserts_are_idempotent(spark, tmp_path):
    path = str(tmp_path / "t")
    store.insert_new(logs(spark, [1, 2, 100_000]).union(logs(spark, [2], "0")), path, KEY)
    store.insert_new(logs(spark, [1, 2, 3, 100_000], "b"), path, KEY)
    got = {(r.block_number, r.log_index): r.note for r in spark.read.parquet(path).collect()}
    assert len(got) == 8 and spark.read.parquet(path).count() == 8
    assert got[1, 0] == "a" and got[2, 0] == "0" and got[3, 1] == "b"
    store.insert_new(logs(spark, []), path, KEY)
    assert store.insert_strict(logs(spark, [4]), path, KEY) == "inserted"
    assert store.insert_strict(logs(spark, [4]), path, KEY, "skip") == "skipped"
    assert store.insert_strict(logs(spark, [4, 5]), path, KEY, "fallback") == "fallback"
    with pytest.raises(ValueError):
        store.insert_strict(logs(spark, [5]), path, KEY)
    assert spark.read.parquet(path).count() == 12


def test_delete_range_and_reorg(spark, tmp_path):
    path = str(tmp_path / "t")
    store.insert_new(logs(spark, [5, 99_999, 100_000, 250_000]), path, KEY)
    store.delete_range(spark, path, 1, 99_999, 199_999)
    assert sorted({r.block_number for r in spark.read.parquet(path).collect()}) == [5, 250_000]
    refreshed = []
    reorg.rewrite_reorg(spark, {"raw": path}, 1, 249_999, 250_001, {"raw": logs(spark, [250_000, 250_001, 7], "new")}, lambda: refreshed.append(1))
    assert sorted((r.block_number, r.note) for r in spark.read.parquet(path).where("log_index = 0").collect()) == [(5, "a"), (250_000, "new"), (250_001, "new")]
    assert refreshed == [1]
    notes = str(tmp_path / "notes")
    reorg.rewrite_reorg(spark, {"raw": path}, 1, 249_999, 250_001, {}, messages=notes)  # within finality
    reorg.rewrite_reorg(spark, {"raw": path}, 1, 99_999, 250_001, {}, messages=notes)  # below it
    assert sorted((r.block_number, r.below_finality) for r in spark.read.parquet(notes).collect()) == [(99_999, True), (249_999, False)]
    store.compact(spark, path, 200_000, str(tmp_path / "old"))
    assert spark.read.parquet(str(tmp_path / "old")).count() == 2


def test_partition_pruning_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    store.insert_new(logs(spark, [5, 100_000, 250_000]), path, KEY)
    plan = shaping.scan_range(spark.read.parquet(path), 1, 100_000, 199_999)._jdf.queryExecution().executedPlan().toString()
    assert "block_bucket" in plan.split("PartitionFilters")[1].split("]")[0]


def test_nested_calls(spark):
    tree = '{"type":"CALL","to":"0xA","calls":[{"type":"CALL","to":"0xB","calls":[{"type":"DELEGATECALL","to":"0xC","value":"0xde0b6b3a7640000"}]},{"to":"0xD"}]}'
    got = ingest.to_raw_traces(ingest.flatten_call_tree(spark.createDataFrame([("t", tree)], "tx string, j string"), "j", ["tx"]), 1).collect()
    assert sorted((r.trace_address, r.call_type, r.to_address, r.value) for r in got) == [("", "call", "0xa", "0"), ("0", "call", "0xb", "0"), ("0.0", "delegatecall", "0xc", str(10**18)), ("1", "call", "0xd", "0")]


def test_damaged_json_and_clamps(spark):
    rows = spark.createDataFrame([('{"topics":["0x1"],"address":"0xAB","logIndex":"0xffffffffff","blockNumber":"zz"}',), ("{}",)], "json string")
    got = ingest.ingest_logs(rows, 5).orderBy("log_index").collect()
    assert got[1].log_index == 2_147_483_647 and got[1].topic0 == "0x1" and got[1].topic1 is None and got[1].address == "0xab" and got[0].data == "0x"
    assert ingest.ingest_transactions(spark.createDataFrame([('{"value":"0x1"}',)], "json string"), 1).count() == 0
    assert ingest.ingest_flat_traces(spark.createDataFrame([('{"type":"reward"}',)], "json string"), 1).count() == 0


def test_order_by_path(spark):
    df = spark.createDataFrame([(1, 0, p) for p in ("1.10", "1.2", "", "1")], "block_number long, tx_index int, trace_address string")
    assert [r.trace_address for r in shaping.order_canonical(df, "traces").collect()] == ["", "1", "1.2", "1.10"]


def test_quality(spark):
    blocks = spark.createDataFrame([(1, b, f"h{b}", "0x" + "00" * 256) for b in (1, 2, 5)], "chain_id int, block_number long, block_hash string, logs_bloom string")
    assert [tuple(r) for r in quality.gap_ranges(blocks).collect()] == [(1, 3, 4)]
    assert quality.bloom_may_contain(blocks, []).count() == 0 and quality.bloom_audit(blocks, blocks.limit(0)).count() == 0
    bad = logs(spark, [1, 2]).withColumn("block_hash", F.when(F.col("block_number") == 1, "").otherwise("x"))
    ok, rejected = quality.split_hash_mismatch(bad, blocks)
    assert {r.block_number for r in ok.collect()} == {1} and {r.block_number for r in rejected.collect()} == {2}


def test_common_ancestor_cases(spark):
    chain = lambda *hs: spark.createDataFrame([(1, i, h) for i, h in enumerate(hs)], "chain_id int, block_number long, block_hash string")
    r = reorg.common_ancestor(chain("a", "b", "c", "d"), chain("a", "b", "x", "y", "z")).first()
    assert (r.ancestor, r.tip, r.depth, r.reorged) == (1, 3, 2, [2, 3])
    assert reorg.common_ancestor(chain("a", "b"), chain("a", "b", "c")).first().reorged == []
    r = reorg.common_ancestor(chain("a", "b", "c"), chain("a", "x", "y"), max_depth=2).first()
    assert r.ancestor is None and r.reorged == [1, 2]
    assert reorg.conservative_ancestor(chain("a", "b", "c"), 2).first().ancestor == 0


def test_rollup_weeks_and_snapshots(spark):
    ev = spark.createDataFrame([(1, "a", 1, 0, 0, 1_704_672_000 + d * 86_400, f"t{d}") for d in (-1, 0, 6, 7)], "chain_id int, address string, block_number long, tx_index int, log_index int, block_timestamp long, tx_hash string")
    got = {str(r.bucket)[:10]: r.event_count for r in rollup.rollup(ev, "1w").withColumn("bucket", F.date_format("bucket", "yyyy-MM-dd")).collect()}
    assert got == {"2024-01-01": 1, "2024-01-08": 2, "2024-01-15": 1}
    rows = spark.createDataFrame([(1, "a", 3, 0, 0, "x"), (1, "a", 10, 0, 0, "y"), (1, "a", 10, 0, 1, "z"), (1, "b", 25, 0, 0, "w")], "chain_id int, address string, block_number long, tx_index int, log_index int, v string")
    blocks = spark.range(31).select(F.lit(1).alias("chain_id"), F.col("id").alias("block_number"))
    assert sorted((r.address, r.block_number, r.v) for r in rollup.snapshot_every(rows, blocks, 10, ["v"]).collect()) == [("a", 10, "z"), ("a", 20, "z"), ("a", 30, "z"), ("b", 30, "w")]


def test_accounts_and_traces(spark):
    txs = spark.createDataFrame([(1, 1, 0, "t", "0xA", None, "5"), (1, 2, 0, "u", "0xa", "0xa", "0")], "chain_id int, block_number long, tx_index int, tx_hash string, from_address string, to_address string, value string")
    tracked = spark.createDataFrame([("0xA", "transaction:from"), ("0xa", "transaction:to"), ("0xa", "transfer:to")], "address string, kind string")
    own = accounts.account_tx_events(txs, tracked)
    assert sorted((r.block_number, r.event_type) for r in own.collect()) == [(1, "transaction:from"), (2, "transaction:from"), (2, "transaction:to")]
    moves = accounts.account_transfer_events(txs, tracked)
    assert moves.count() == 0 and [r.block_number for r in accounts.account_ledger(own, moves, "0xA", 2).collect()] == [2, 2]
    assert factory.filter_traces(txs, tracked.select("address").distinct().limit(0)).count() == 0 and factory.filter_traces(txs, None).count() == 2


def test_progress(spark):
    workers = spark.createDataFrame([(1, 0, 0, 9, 5, "historical"), (1, 0, 0, 9, 7, "historical"), (2, 0, 0, None, 100, "live")], "chain_id int, worker_id int, range_start long, range_end long, current_block long, status string")
    assert [tuple(r) for r in progress.remaining_ranges(workers).collect()] == [(1, 0, 8, 9)]
    chains = spark.createDataFrame([(c,) for c in (1, 2, 3)], "chain_id int")
    assert {r.chain_id: r.mode for r in progress.start_mode(workers, chains).collect()} == {1: "resume", 2: "live", 3: "fresh"}
    status = {r.chain_id: r for r in progress.sync_status(workers, logs(spark, [50])).collect()}
    assert status[1].tip == 50 and status[1].percent == 14.0 and status[2].synced and not status[1].synced
    none = progress.readiness(workers.limit(0)).first()
    assert (none.all_live, none.any_live) == (False, False)
    slices = progress.slice_coverage(logs(spark, range(10)), 0, 10, 3).orderBy("slice").collect()
    assert [(s.first, s.last, s.blocks) for s in slices] == [(0, 3, 4), (4, 6, 3), (7, 9, 3)]


def test_sinks_and_views(spark, tmp_path):
    df = logs(spark, [1])
    sinks.export_csv({"t": df}, str(tmp_path / "csv"))
    sinks.export_csv({"t": df}, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv/t")).count() == 4
    with pytest.raises(ValueError):
        sinks.stream_messages()
    df.write.mode("overwrite").saveAsTable("cut_old")
    df.union(df).write.mode("overwrite").saveAsTable("cut_new")
    for table, n in (("cut_old", 2), ("cut_new", 4)):
        assert views.cutover(spark, "readers", {"events": table}) == ["readers.events"]
        assert spark.table("readers.events").count() == n


def test_plans_stay_in_the_jvm(spark):
    sf = "/root/testdata/sf0.001"
    for name in ("event_table_note", "filtered_hourly_transfers", "child_events", "account_tx_events", "rollup_custom_metrics"):
        plan = catalog.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan
    assert "BroadcastHashJoin" in catalog.queries()["decode_events"](spark, sf)._jdf.queryExecution().executedPlan().toString()

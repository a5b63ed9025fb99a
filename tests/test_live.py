import random

from pyspark.sql import functions as F

from chainlake.operators import store
from chainlake.plans.contracts import EVENTS, FACTORIES, RULES
from chainlake.plans.streams import _fed
from chainlake.streaming import live

SCHEMA = f"chain_id int, block_number long, block_hash string, parent_hash string, block_timestamp long, logs {live.LOG_OF_BLOCK}"


def log(n, i, of, address="0xAA"):
    return (0, i, of, f"tx{n}.{i}", address, None, None, None, None, "0x")


def chain(spark, rows):
    """(number, hash, parent, logs) to blocks of chain 1."""
    return spark.createDataFrame([(1, n, h, p, 1_704_240_000 + 600 * n, logs) for n, h, p, logs in rows], SCHEMA)


def run(spark, tmp_path, parts, name="s", depth=4):
    folder = f"file://{tmp_path}/{name}"
    _fed(spark, parts, "live-test", lambda s: live.live_sync(s, folder, EVENTS[:1], RULES, FACTORIES, f"file://{tmp_path}/{name}-check", depth))
    return folder


def table(spark, folder, name, *columns):
    return sorted(tuple(r) for r in spark.read.parquet(f"{folder}/{name}").select(*columns).collect()) if store.exists(spark, f"{folder}/{name}") else []


def test_forks_are_repaired_and_wrong_logs_rejected(spark, tmp_path):
    first = chain(spark, [(n, f"a{n}", f"a{n - 1}", [log(n, 0, f"a{n}"), log(n, 1, "other" if n == 2 else "")]) for n in range(1, 7)])
    fork = chain(spark, [(n, f"b{n}", "a4" if n == 5 else f"b{n - 1}", [log(n, 5, f"b{n}")]) for n in range(5, 8)])
    folder = run(spark, tmp_path, [first, fork, fork])  # the last part is a replay
    assert table(spark, folder, "blocks", "block_number", "block_hash") == [(n, f"{'a' if n < 5 else 'b'}{n}") for n in range(1, 8)]
    assert table(spark, folder, "raw_events", "block_number", "log_index") == sorted([(n, i) for n in range(1, 5) for i in (0, 1) if (n, i) != (2, 1)] + [(n, 5) for n in (5, 6, 7)])
    assert table(spark, folder, "rejected", "block_number", "log_index") == [(2, 1)]
    assert table(spark, folder, "reorgs", "block_number", "tip", "depth") == [(4, 6, 2)]
    counted = spark.read.parquet(f"{folder}/rollup_hourly").agg(F.sum("event_count")).first()[0]
    assert counted == 10


def test_a_batch_above_the_fork_drops_the_known_window(spark, tmp_path):
    first = chain(spark, [(n, f"a{n}", f"a{n - 1}", [log(n, 0, f"a{n}")]) for n in range(1, 11)])
    above = chain(spark, [(11, "b11", "b10", [log(11, 0, "b11")])])
    again = chain(spark, [(n, f"b{n}", "a6" if n == 7 else f"b{n - 1}", [log(n, 1, f"b{n}")]) for n in range(7, 11)])
    folder = run(spark, tmp_path, [first, above])
    assert [n for n, _ in table(spark, folder, "blocks", "block_number", "block_hash")] == [1, 2, 3, 4, 5, 6, 11]
    assert table(spark, folder, "reorgs", "block_number", "tip") == [(6, 10)]
    folder = run(spark, tmp_path, [first, above, again], "t")
    assert table(spark, folder, "blocks", "block_hash") == sorted([(f"a{n}",) for n in range(1, 7)] + [(f"b{n}",) for n in range(7, 12)])


def test_reorgs_of_several_chains_are_found_once(spark, tmp_path):
    rows = [(c, n, f"{c}a{n}", f"{c}a{n - 1}") for c in (1, 2) for n in range(1, 9)]
    fork = [(2, n, f"2b{n}", "2b5" if n == 6 else f"2b{n - 1}") for n in range(6, 9)] + [(1, 9, "1a9", "1a8")]
    schema = "chain_id int, block_number long, block_hash string, parent_hash string"
    folder = f"file://{tmp_path}/r"
    parts = [spark.createDataFrame(rows[::-1], schema).repartition(3), spark.createDataFrame(fork, schema)]
    _fed(spark, parts, "reorg-test", lambda s: live.detect_reorgs(s, folder, 5, f"file://{tmp_path}/r-check"))
    assert table(spark, folder, "reorgs", "chain_id", "block_number", "stored_hash") == [(2, 6, "2a5")]
    state = spark.read.format("statestore").option("path", f"file://{tmp_path}/r-check").option("stateVarName", "blocks").load().select("key.chain_id", "list_element.*")
    held = sorted((r.chain_id, r.number, r.hash) for r in state.collect())
    assert held == sorted([(1, n, f"1a{n}") for n in range(5, 10)] + [(2, n, f"2a{n}") for n in range(4, 9)] + [(2, n, f"2b{n}") for n in range(6, 9)])


def grown(rng, size, depth):
    """Blocks (number, hash, parent) in the order of their arrival: a chain with branches shorter than `depth`, parents first, and a tip that stands alone."""
    blocks, tips = [(0, "g0", "none")], [(0, "g0")]
    for i in range(1, size):
        top = max(t[0] for t in tips)
        tips = [t for t in tips if t[0] > top - depth + 2]
        of = rng.choice(tips if rng.random() < 0.9 else [b[:2] for b in blocks if b[0] > top - depth + 2])
        made = (of[0] + 1, f"h{rng.randrange(10**6)}-{i}", of[1])
        blocks.append(made)
        tips = [t for t in tips if t != of] + [made[:2]]
    top = max(b[0] for b in blocks)
    last = rng.choice([b for b in blocks if b[0] == top])
    return [*blocks, (top + 1, "last", last[1])]


def line_to_tip(blocks):
    """The tip's line, found by following parents."""
    by = {(n, h): p for n, h, p in blocks}
    at = max(by)
    out = []
    while at in by:
        out.append(at)
        at = (at[0] - 1, by[at])
    return sorted(out)


def replayed(blocks):
    """Block by block: each one becomes the tip where it is higher than the tip."""
    by, tip = {}, None
    for n, h, p in blocks:
        by[n, h] = p
        tip = (n, h) if tip is None or n > tip[0] else tip
    out = []
    while tip in by:
        out.append(tip)
        tip = (tip[0] - 1, by[tip])
    return sorted(out)


def test_forks_dealt_over_any_batches_end_as_block_by_block(spark, tmp_path):
    rng = random.Random(11)
    for trial in range(2):
        blocks = grown(rng, 26, 8)
        assert replayed(blocks) == line_to_tip(blocks)
        cuts = sorted(rng.sample(range(1, len(blocks)), 2))
        rows = [(n, h, p, [log(n, 0, h)]) for n, h, p in blocks]
        parts = [chain(spark, rng.sample(x, len(x))) for x in (rows[: cuts[0]], rows[cuts[0] : cuts[1]], rows[cuts[1] :])]
        folder = run(spark, tmp_path, parts, f"f{trial}", depth=8)
        assert table(spark, folder, "blocks", "block_number", "block_hash") == replayed(blocks)
        assert table(spark, folder, "raw_events", "block_number", "block_hash") == replayed(blocks)
        assert spark.read.parquet(f"{folder}/rollup_hourly").agg(F.sum("event_count")).first()[0] == len(replayed(blocks))


def test_both_branches_in_one_batch(spark, tmp_path):
    """What is stored below stays, and one linked chain is left."""
    first = chain(spark, [(3, "c3", "c2", []), (4, "x4", "c3", [log(4, 0, "x4")])])
    both = chain(spark, [(n, h, p, [log(n, 0, h)]) for n, h, p in [(5, "a5", "x4"), (6, "b6", "a5"), (5, "b5", "x4"), (6, "a6", "b5"), (7, "a7", "a6")]])
    folder = run(spark, tmp_path, [first, both], "both")
    assert table(spark, folder, "blocks", "block_hash") == sorted([("c3",), ("x4",), ("b5",), ("a6",), ("a7",)])
    assert table(spark, folder, "raw_events", "block_hash") == sorted([("x4",), ("b5",), ("a6",), ("a7",)])
    assert table(spark, folder, "reorgs", "block_number") == []


def test_forks_below_finality_are_repaired_in_all_tables(spark, tmp_path):
    """Chain 56 is final after 15 blocks; a fork of 25 is repaired, traces included, and the message says so."""
    of = lambda rows: chain(spark, rows).withColumn("chain_id", F.lit(56))
    first = of([(n, f"a{n}", f"a{n - 1}", [log(n, 0, f"a{n}")]) for n in range(100, 130)])
    fork = of([(n, f"b{n}", "a104" if n == 105 else f"b{n - 1}", [log(n, 1, f"b{n}")]) for n in range(105, 131)])
    folder = f"file://{tmp_path}/deep"
    start = lambda s: live.live_sync(s, folder, [], [], [], f"file://{tmp_path}/deep-check", 64, also=("traces",))
    path = f"{tmp_path}/deep-in"
    for i, part in enumerate((first, fork)):
        if i:
            store.append(spark.range(100, 130).selectExpr("56 AS chain_id", "id AS block_number"), f"{folder}/traces")
        part.write.mode("append").parquet(path)
        start(spark.readStream.schema(part.schema).parquet(path)).awaitTermination()
    assert table(spark, folder, "blocks", "block_hash") == sorted([(f"a{n}",) for n in range(100, 105)] + [(f"b{n}",) for n in range(105, 131)])
    assert table(spark, folder, "traces", "block_number") == [(n,) for n in range(100, 105)]
    assert table(spark, folder, "reorgs", "block_number", "tip", "below_finality") == [(104, 129, True)]


def test_detection_by_state_equals_all_at_once_for_any_cuts(spark, tmp_path):
    rng = random.Random(5)
    line = [(n, f"a{n}", f"a{n - 1}") for n in range(1, 30)]
    other = [(n, f"b{n}", f"b{n - 1}") for n in range(27, 34)]  # its first parent never comes
    arrived = [(7, *b) for b in line + other]
    schema = "chain_id int, block_number long, block_hash string, parent_hash string"
    for i, cuts in enumerate([[], [12, 31], sorted(rng.sample(range(1, 36), 3))]):
        parts = [spark.createDataFrame(rng.sample(x, len(x)), schema) for a, b in zip([0, *cuts], [*cuts, 36], strict=True) if (x := arrived[a:b])]
        folder = f"file://{tmp_path}/d{i}"
        _fed(spark, parts, "detect-test", lambda s, f=folder, i=i: live.detect_reorgs(s, f, 10, f"file://{tmp_path}/d{i}-check"))  # each part is a run of its own from the checkpoint
        assert table(spark, folder, "reorgs", "chain_id", "block_number", "parent_hash", "stored_hash") == [(7, 27, "b26", "a26")]


def test_windows_and_gaps_by_count_and_chain(spark):
    from chainlake.operators import quality, reorg, shaping

    b = lambda c, ns: spark.createDataFrame([(c, n, f"h{n}") for n in ns], "chain_id int, block_number long, block_hash string")
    gappy = b(1, [1, 2, 3, 9, 10])
    assert sorted(r.block_number for r in reorg.known_window(gappy, 4).collect()) == [2, 3, 9, 10]
    assert reorg.conservative_ancestor(gappy, 4).first().ancestor == 1
    two = b(1, [1, 3]).unionByName(b(2, [2]))
    assert sorted(map(tuple, quality.missing_blocks(spark, two, 1, 3).collect())) == [(1, 2), (2, 1), (2, 3)]
    wide = b(1, [5, 99_999, 100_001, 250_000, 400_001])
    assert sorted(map(tuple, quality.gap_ranges(wide).collect())) == [(1, 6, 99_998), (1, 100_000, 100_000), (1, 100_002, 249_999), (1, 250_001, 400_000)]
    wanted = spark.createDataFrame([(1, 2), (2, 2)], "chain_id int, block_number long")
    assert sorted(map(tuple, quality.present(two, wanted).collect())) == [(1, 2, False), (2, 2, True)]

"""Histories of years: stored rollups, live sync and deduplication whose work must grow with the rows only."""

from pathlib import Path

from pyspark.sql import functions as F

from chainlake.operators import filters, rollup, store
from chainlake.plans import streams
from chainlake.plans.contracts import EVENTS, FACTORIES, RULES
from chainlake.plans.lenses import lens
from chainlake.plans.streams import _fed
from chainlake.streaming import live

START = 1_704_240_000  # 2024-01-03
DAY = 86_400


def events(spark, days, chain=1):
    """An event each 8 hours, of one address."""
    return spark.range(3 * days).selectExpr(f"{chain} AS chain_id", "id AS block_number", "'a' AS address", f"{START} + 28800 * id AS block_timestamp", "string(id) AS tx_hash")


def counts(df):
    return {(r.chain_id, r.day): r.n for r in df.groupBy("chain_id", F.to_date("bucket").cast("string").alias("day")).agg(F.sum("event_count").alias("n")).collect()}


def folders(path):
    return sorted(f"{p.parent.name[9:]}/{p.name[12:]}" for p in Path(path).glob("chain_id=*/bucket_date=*"))


def test_past_months_of_a_stored_rollup_are_one_partition_each(spark, tmp_path):
    path = str(tmp_path / "r")
    both = events(spark, 400).unionByName(events(spark, 40, 2))
    rollup.refresh_stored(spark, both, path, "1h", 0)
    found = folders(path)
    assert [f for f in found if f[:2] == "2/"] == ["2/2024-01-01", *[f"2/2024-02-{d:02}" for d in range(1, 12)]]  # its newest month by days
    assert [f for f in found if f[:9] == "1/2024-02"] == ["1/2024-02-01"] and len(found) < 400 / 30 + 31 + 14
    assert counts(spark.read.parquet(path)) == counts(rollup.rollup(both, "1h"))


def test_a_refresh_into_a_past_month_keeps_its_days_before(spark, tmp_path):
    path = str(tmp_path / "r")
    rolled = rollup.rollup(events(spark, 100), "1h")
    rollup.store_rollup(spark, rolled.withColumn("event_count", F.lit(100).cast("long")), path)
    fewer = events(spark, 90).where(f"block_number % 3 > 0 or block_timestamp < {START + 60 * DAY}")
    rollup.refresh_stored(spark, fewer, path, "1h", START + 40 * DAY + 5, blocks=fewer)  # 2024-02-12
    got = counts(spark.read.parquet(path))
    wanted = {k: 300 if k[1] < "2024-02-12" else n for k, n in counts(rollup.rollup(events(spark, 100), "1h")).items()}
    wanted = {k: n if n == 300 else 3 if k[1] < "2024-03-03" else 2 for k, n in wanted.items() if k[1] < "2024-04-02"}
    assert got == wanted and "1/2024-02-01" in folders(path) and not [f for f in folders(path) if "2024-02-1" in f]


def test_days_that_are_stored_stay_days(spark, tmp_path):
    path = str(tmp_path / "r")
    rows = events(spark, 70)
    rollup.rollup(rows, "1h").withColumn("bucket_date", F.to_date("bucket")).write.partitionBy("chain_id", "bucket_date").parquet(path)
    before = folders(path)
    for since in (START + 20 * DAY, START, 0):
        rollup.refresh_stored(spark, rows, path, "1h", since)
        assert folders(path) == before and counts(spark.read.parquet(path)) == counts(rollup.rollup(rows, "1h"))


def test_a_synced_history_is_stored_by_months(spark, tmp_path):
    """Blocks and logs that come twice, a block without logs and one with null for them; then a fork at the end."""

    def block(n, name, before, logs):
        return (1, n, f"{name}{n}", f"{before}{n - 1}", START + DAY * n, logs)

    log = lambda n, name, i: (0, i, f"{name}{n}", f"tx{n}.{i}", "0xAA", None, None, None, None, "0x")
    rows = [block(n, "a", "a", [] if n == 50 else None if n == 120 else [log(n, "a", 0), log(n, "a", 0), log(n, "a", 1)]) for n in range(120, 0, -1)]
    schema = f"chain_id int, block_number long, block_hash string, parent_hash string, block_timestamp long, logs {live.LOG_OF_BLOCK}"
    fork = [block(118, "b", "a", [log(118, "b", 5)]), block(119, "b", "b", [log(119, "b", 5)]), block(121, "b", "b", [])]
    folder = f"file://{tmp_path}/s"
    parts = [spark.createDataFrame(r, schema).repartition(3) for r in (rows + rows[:40] + [block(60, "a", "a", [])], [*fork, block(120, "b", "b", [log(120, "b", 0)])])]
    _fed(spark, parts, "months", lambda s: live.live_sync(s, folder, EVENTS[:1], RULES, FACTORIES, f"file://{tmp_path}/s-check", 4))
    raw = spark.read.parquet(f"{folder}/raw_events")
    wanted = {(n, i) for n in range(1, 118) if n != 50 for i in (0, 1)} | {(118, 5), (119, 5), (120, 0)}
    got = [(r.block_number, r.log_index) for r in raw.collect()]
    assert len(got) == len(wanted) and set(got) == wanted and spark.read.parquet(f"{folder}/blocks").count() == 121
    assert counts(spark.read.parquet(f"{folder}/rollup_hourly")) == counts(rollup.rollup(raw, "1h"))
    assert len(folders(tmp_path / "s" / "rollup_hourly")) < 40  # of 121 days


def test_few_repeated_keys_are_the_only_rows_that_are_aggregated(spark, tmp_path):
    rows = [(i, "a", f"v{i}") for i in range(50)] + [(7, "a", "u"), (7, "a", "v7"), (8, None, "y"), (8, None, "x"), (None, None, "z")]
    df = spark.createDataFrame(rows, "k int, l string, v string")
    path = str(tmp_path / "t")
    df.write.parquet(path)
    got = store.single_by_key(spark.read.parquet(path), ["k", "l"], str(tmp_path / "repeated"))
    assert sorted(map(str, got.collect())) == sorted(map(str, store.first_by_key(df, ["k", "l"]).collect()))
    once = store.single_by_key(spark.read.parquet(path).where("k > 10"), ["k", "l"], str(tmp_path / "none"))
    assert "Exchange" not in once._jdf.queryExecution().executedPlan().toString()


def test_short_integers_compare_as_long_ones(spark):
    texts = ["5", "-0", "007", "+5", "5\n", " 5", "", "x", "-6", "999999999999999999", "1000000000000000000", "-1000000000000000001", "9" * 70, None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for op, f in filters.OPS.items():
        for value in ("5", "-6", "0", "+7", "-999999999999999999"):
            whole = F.struct(filters.order_key(F.col("t")).alias("number"))["number"]
            slow = F.when(whole.isNotNull(), f(whole, F.lit(filters.integer_key(value)))).otherwise(f(F.col("t"), F.lit(value)))
            got = df.select("t", filters.compare(F.col("t"), op, value).alias("fast"), slow.alias("slow")).collect()
            assert [r for r in got if r.fast != r.slow] == [], (op, value)


def keys(df):
    return sorted((r.block_number, r.log_index) for r in df.select("block_number", "log_index").collect())


def test_deduplication_loses_nothing_over_decades(spark, tmp_path):
    """Events of 28 years, of which the first part holds both ends."""
    few = spark.range(0, 15_000_000, 49_999).selectExpr("id AS event_id", "id % 1000 AS user_id", "'purchase' AS event_type", "1.5D AS value")
    few.write.parquet(str(tmp_path / "events.parquet"))
    wanted = keys(lens(spark, str(tmp_path), "fx_raw_events"))
    assert len(wanted) == 301 and keys(streams.stream_dedup(spark, str(tmp_path))) == wanted


def test_runs_of_the_stream_grow_slower_than_the_parts(spark, monkeypatch):
    sf, starts, dedup = "/root/testdata/sf0.001", [], live.stream_dedup
    monkeypatch.setattr(streams, "PART", 3)  # 34 parts
    monkeypatch.setattr(streams, "AGAIN", 1)
    monkeypatch.setattr(live, "stream_dedup", lambda *a: starts.append(a) or dedup(*a))
    assert keys(streams.stream_dedup_evicted(spark, sf)) == keys(lens(spark, sf, "fx_raw_events").where("topic0 is not null"))
    assert len(starts) == 9

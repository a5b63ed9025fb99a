"""Registered on-chain queries: operators over the lenses, each with the SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chainlake.functions import abi_words, wide
from chainlake.operators import accounts, decode, factory, filters, progress, quality, reorg, rollup, shaping, sinks, store, views
from chainlake.operators.snapshots import Snapshots
from chainlake.plans.contracts import EVENTS, FACTORIES, FACTORY_ADDRESS, FUNCTIONS, GENESIS, RULES
from chainlake.plans.lenses import lens, with_lenses
from chainlake.sources import ingest
from chainlake.sources.scratch import new_folder

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}
TRACE_KEY = ["chain_id", "block_number", "tx_index", "trace_address"]
TRANSFER, APPROVAL, SWAP = (next(d.key for d in EVENTS if d.name == n) for n in ("Transfer", "Approval", "Swap"))
PAIR_CREATED = next(d.key for d in EVENTS if d.name == "PairCreated")
NOTE = next(d.key for d in EVENTS if d.name == "Note")
PAD = "'0x' || lpad(lower(hex({})), 40, '0')"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _ORACLES[f.__name__] = with_lenses(sql)
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)


def _stamp(c: str) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)


# -- scans, ingest, shaping


@query("SELECT chain_id, min(block_number) AS earliest, max(block_number) AS latest, count(*) AS rows FROM fx_raw_events GROUP BY ALL")
def stored_table_stats(spark, sf):
    """From the footers of a stored table."""
    path = new_folder(spark, "stats")
    store.append(lens(spark, sf, "fx_raw_events"), path)
    return shaping.stored_stats(spark, path)


@query("SELECT chain_id, block_number, tx_index, log_index, address, topic0 FROM fx_raw_events WHERE chain_id = 1 AND block_number BETWEEN 10000845 AND 10000864")
def scan_range(spark, sf):
    return shaping.scan_range(lens(spark, sf, "fx_raw_events"), 1, GENESIS + 10, GENESIS + 29).select("chain_id", "block_number", "tx_index", "log_index", "address", "topic0")


@query("SELECT chain_id, min(block_number) AS earliest, max(block_number) AS latest, count(*) AS rows FROM fx_raw_events GROUP BY ALL")
def table_stats(spark, sf):
    return shaping.stats(lens(spark, sf, "fx_raw_events"))


@query("""
SELECT n.block_number, b.block_number IS NOT NULL AS present
FROM (SELECT CAST(10000835 + unnest(range(0, 200000, 7)) AS BIGINT) AS block_number) n LEFT JOIN fx_blocks b ON b.block_number = n.block_number""")
def blocks_present(spark, sf):
    wanted = spark.range(GENESIS, GENESIS + 200_000, 7).toDF("block_number")
    return quality.present(lens(spark, sf, "fx_blocks"), wanted)


LOG_COLUMNS = "chain_id, block_number, tx_index, log_index, block_hash, block_timestamp, tx_hash, address, topic0, topic1, topic2, topic3, data"


def _log_json() -> Column:
    quantity = lambda c: F.concat(F.lit("0x"), F.lower(F.hex(F.col(c).cast("long"))))
    topics = F.array_compact(F.array("topic0", "topic1", "topic2", "topic3"))
    return F.to_json(F.struct(
        F.upper("address").alias("address"), topics.alias("topics"), "data", quantity("block_number").alias("blockNumber"), F.col("block_hash").alias("blockHash"), F.col("tx_hash").alias("transactionHash"),
        quantity("tx_index").alias("transactionIndex"), quantity("log_index").alias("logIndex"), quantity("block_timestamp").alias("blockTimestamp"),
    )).alias("json")


@query(f"SELECT {LOG_COLUMNS} FROM fx_raw_events")
def ingest_logs(spark, sf):
    return ingest.ingest_logs(lens(spark, sf, "fx_raw_events").select(_log_json()), 1)


@query("SELECT chain_id, block_number, tx_index, log_index, address, topic0, data FROM fx_raw_events")
def ingest_log_batches(spark, sf):
    quantity = lambda c: F.concat(F.lit("0x"), F.lower(F.hex(F.col(c).cast("long"))))
    log = F.struct(quantity("block_number").alias("block_number"), "block_hash", F.col("tx_hash").alias("transaction_hash"), quantity("tx_index").alias("transaction_index"), quantity("log_index").alias("log_index"), "address", "data", "topic0", "topic1", "topic2")
    pages = lens(spark, sf, "fx_raw_events").groupBy("block_number").agg(F.collect_list(log).alias("logs"))
    pages = pages.select(F.to_json(F.struct(F.array(F.struct("logs")).alias("data"))).alias("json"))
    return ingest.ingest_log_batches(pages, 1)[0].select("chain_id", "block_number", "tx_index", "log_index", "address", "topic0", "data")


@query("SELECT chain_id, block_number, block_hash, parent_hash, block_timestamp FROM fx_blocks")
def ingest_headers(spark, sf):
    quantity = lambda c: F.concat(F.lit("0x"), F.lower(F.hex(F.col(c).cast("long"))))
    rows = lens(spark, sf, "fx_blocks").select(F.to_json(F.struct(quantity("block_number").alias("number"), F.col("block_hash").alias("hash"), F.col("parent_hash").alias("parentHash"), quantity("block_timestamp").alias("timestamp"))).alias("json"))
    return ingest.ingest_headers(rows, 1)


@query("SELECT chain_id, block_number, tx_index, tx_hash, from_address, to_address, value, input, CAST(NULL AS BIGINT) AS gas_used, CAST(NULL AS INT) AS status FROM fx_transactions")
def ingest_transactions(spark, sf):
    quantity = lambda c: F.concat(F.lit("0x"), F.lower(F.hex(c.cast("long"))))
    t = lens(spark, sf, "fx_transactions")
    rows = t.select(F.to_json(F.struct(quantity(F.col("block_number")).alias("blockNumber"), F.col("tx_hash").alias("hash"), quantity(F.col("tx_index")).alias("transactionIndex"), F.upper("from_address").alias("from"), F.col("to_address").alias("to"), quantity(F.col("value")).alias("value"), "input")).alias("json"))
    return ingest.ingest_transactions(rows, 1)


FLAT = "chain_id, block_number, tx_index, tx_hash, trace_address, call_type, from_address, to_address, input, value"


@query(f"SELECT {FLAT} FROM fx_traces")
def ingest_flat_traces(spark, sf):
    t = lens(spark, sf, "fx_traces")
    quantity = lambda c: F.concat(F.lit("0x"), F.lower(F.hex(c.cast("long"))))
    path = F.when(F.col("trace_address") == "", F.array().cast("array<int>")).otherwise(F.split("trace_address", r"\.").cast("array<int>"))
    action = F.struct(F.upper("call_type").alias("callType"), F.col("from_address").alias("from"), F.col("to_address").alias("to"), "input", quantity(F.col("value")).alias("value"))
    rows = t.select(F.to_json(F.struct(action.alias("action"), path.alias("traceAddress"), F.col("tx_hash").alias("transactionHash"), quantity(F.col("tx_index")).alias("transactionPosition"), quantity(F.col("block_number")).alias("blockNumber"))).alias("json"))
    return ingest.ingest_flat_traces(rows, 1).select(*FLAT.split(", "))


@query("""
WITH c AS (SELECT tx_hash, from_address, to_address, row_number() OVER (PARTITION BY tx_hash ORDER BY l_partkey, l_suppkey, l_extendedprice, l_tax, l_quantity, l_shipdate, l_discount, l_returnflag, trace_address) - 1 AS i, l_partkey FROM fx_traces)
SELECT tx_hash, CAST(i AS VARCHAR) AS path, 'call' AS call_type, to_address FROM c
UNION ALL SELECT DISTINCT tx_hash, '' AS path, 'call' AS call_type, '0xroot' AS to_address FROM c
UNION ALL SELECT tx_hash, i || '.0' AS path, 'staticcall' AS call_type, '0xleaf' AS to_address FROM c WHERE l_partkey % 2 = 0""")
def flatten_call_tree(spark, sf):
    order = ["l_partkey", "l_suppkey", "l_extendedprice", "l_tax", "l_quantity", "l_shipdate", "l_discount", "l_returnflag", "trace_address"]
    leaf = F.when(F.col("l_partkey") % 2 == 0, F.array(F.struct(F.lit("STATICCALL").alias("type"), F.lit("0xLEAF").alias("to"))))
    call = F.struct(F.lit("CALL").alias("type"), F.col("to_address").alias("to"), leaf.alias("calls"))
    trees = lens(spark, sf, "fx_traces").groupBy("tx_hash").agg(F.sort_array(F.collect_list(F.struct(*order, call.alias("c")))).alias("l"))
    trees = trees.select("tx_hash", F.to_json(F.struct(F.lit("CALL").alias("type"), F.lit("0xroot").alias("to"), F.transform("l", lambda x: x["c"]).alias("calls"))).alias("json"))
    return ingest.flatten_call_tree(trees, "json", ["tx_hash"]).select("tx_hash", F.array_join("trace_path", ".").alias("path"), "call_type", "to_address")


@query("SELECT c AS chain_id, count(*) AS rows, CAST(sum(block_number) AS BIGINT) AS total FROM fx_blocks, (SELECT unnest([1, 2]) AS c) GROUP BY c")
def read_multi_chain(spark, sf):
    b = lens(spark, sf, "fx_blocks")
    return ingest.read_multi_chain({1: b, 2: b}).groupBy("chain_id").agg(F.count("*").alias("rows"), F.sum("block_number").alias("total"))


@query(f"""
SELECT count(*) AS rows, count(DISTINCT address) AS addresses FROM fx_raw_events
WHERE topic0 IN ('{TRANSFER}', '{SWAP}') AND address IN (SELECT '0x' || lpad(lower(hex(s_suppkey % 30)), 40, '0') FROM supplier UNION SELECT '0x' || lpad('23', 40, '0'))""")
def apply_log_filter(spark, sf):
    children = factory.discover_children(lens(spark, sf, "fx_factory_logs"), FACTORIES).select("child_address")
    fixed = spark.range(1).select(F.lit("0x" + "23".rjust(40, "0").upper()).alias("address"))
    topics = spark.range(1).select(F.explode(F.array(F.lit(TRANSFER), F.lit(SWAP))).alias("topic0"))
    out = shaping.apply_log_filter(lens(spark, sf, "fx_raw_events"), shaping.address_set(fixed, children), topics)
    return out.agg(F.count("*").alias("rows"), F.count_distinct("address").alias("addresses"))


@query("SELECT count(*) AS rows, CAST(sum(block_number) AS BIGINT) AS total FROM (SELECT DISTINCT chain_id, block_number, tx_index, trace_address FROM fx_traces)")
def union_batches(spark, sf):
    t = lens(spark, sf, "fx_traces")
    out = ingest.union_batches([t.where("block_number % 3 < 2"), t.where("block_number % 3 > 0")], TRACE_KEY)
    return out.agg(F.count("*").alias("rows"), F.sum("block_number").alias("total"))


# -- validation


def _damaged(spark, sf):
    """(blocks, logs) with gaps in headers, altered hashes and logs out of range."""
    blocks = lens(spark, sf, "fx_blocks").where("block_number % 41 <> 0")
    event = (F.col("block_number") - GENESIS) * 10 + F.col("log_index")
    logs = lens(spark, sf, "fx_raw_events").withColumn("block_hash", F.when(event % 53 == 0, F.lit("0xbad")).otherwise(F.col("block_hash")))
    return blocks, logs.withColumn("block_number", F.when(event % 61 == 0, F.col("block_number") + 10_000_000).otherwise(F.col("block_number")))


_DAMAGED = """
WITH ev AS (SELECT *, (block_number - 10000835) * 10 + log_index AS event FROM fx_raw_events),
logs AS (SELECT * REPLACE (CASE WHEN event % 53 = 0 THEN '0xbad' ELSE block_hash END AS block_hash, CASE WHEN event % 61 = 0 THEN block_number + 10000000 ELSE block_number END AS block_number) FROM ev),
blocks AS (SELECT * FROM fx_blocks WHERE block_number % 41 <> 0)
"""


@query(_DAMAGED + """SELECT l.block_number, l.log_index, b.block_timestamp FROM logs l JOIN blocks b ON b.block_number = l.block_number""")
def enrich_headers_strict(spark, sf):
    blocks, logs = _damaged(spark, sf)
    return quality.enrich_headers(logs, blocks).select("block_number", "log_index", "block_timestamp")


@query(_DAMAGED + """SELECT l.block_number, l.log_index, coalesce(b.block_timestamp, 0) AS block_timestamp FROM logs l LEFT JOIN blocks b ON b.block_number = l.block_number""")
def enrich_headers_lenient(spark, sf):
    blocks, logs = _damaged(spark, sf)
    return quality.enrich_headers(logs, blocks, "lenient").select("block_number", "log_index", "block_timestamp")


@query(_DAMAGED + """SELECT block_number, log_index FROM logs WHERE block_number BETWEEN 10000835 AND 15000000""")
def drop_out_of_range(spark, sf):
    return quality.drop_out_of_range(_damaged(spark, sf)[1], GENESIS, 15_000_000).select("block_number", "log_index")


@query(_DAMAGED + """SELECT l.block_number, l.log_index, l.block_hash FROM logs l JOIN blocks b ON b.block_number = l.block_number WHERE l.block_hash <> b.block_hash""")
def split_hash_mismatch(spark, sf):
    blocks, logs = _damaged(spark, sf)
    return quality.split_hash_mismatch(logs, blocks)[1].select("block_number", "log_index", "block_hash")


@query("""SELECT DISTINCT block_number FROM fx_blocks WHERE block_number % 10 = 0
EXCEPT SELECT block_number FROM fx_raw_events WHERE topic0 IS NOT NULL AND block_number % 3 <> 0""")
def bloom_audit(spark, sf):
    blocks = lens(spark, sf, "fx_blocks").withColumn("logs_bloom", F.when(F.col("block_number") % 10 == 0, F.lit("0x" + "00" * 255 + "01")).otherwise("0x" + "00" * 256))
    logs = lens(spark, sf, "fx_raw_events").where("topic0 is not null and block_number % 3 <> 0")
    return quality.bloom_audit(blocks, logs).select("block_number")


@query("SELECT block_number FROM fx_blocks WHERE block_number % 4 = 0")
def bloom_may_contain(spark, sf):
    value = 0
    for bit in quality.bloom_bits(FACTORY_ADDRESS):
        value |= 1 << bit
    some = f"0x{value:0512x}"
    blocks = lens(spark, sf, "fx_blocks").withColumn("logs_bloom", F.when(F.col("block_number") % 4 == 0, F.lit(some)).otherwise("0x" + "00" * 256))
    return quality.bloom_may_contain(blocks, [FACTORY_ADDRESS]).select("block_number")


_BLOOM = "'0x' || " + " || ".join(f"sha256(CAST(block_number * 8 + {i} AS VARCHAR))" for i in range(8))


def _some_addresses() -> list[str]:
    return [f"0x{i * 2654435761 % 2**32:040x}" for i in range(1, 9)]


def _bloom_sql() -> str:
    """The three bits of each address, as places of hex digits and masks, against every block's digits."""
    bits = ", ".join(str(tuple(quality.bloom_bits(a))) for a in _some_addresses())
    held = " AND ".join(f"(strpos('0123456789abcdef', substr(bloom, 514 - {c} // 4, 1)) - 1) & (1 << ({c} % 4)) > 0" for c in "abc")
    return f"""WITH a(a, b, c) AS (VALUES {bits}), k AS (SELECT block_number, {_BLOOM} AS bloom FROM fx_blocks)
SELECT block_number FROM k WHERE EXISTS (SELECT 1 FROM a WHERE {held})"""


@query(_bloom_sql())
def bloom_may_contain_many(spark, sf):
    """Eight addresses against blooms made from the block's number, of which half the bits are set."""
    bloom = F.concat(F.lit("0x"), *[F.sha2((F.col("block_number") * 8 + i).cast("string"), 256) for i in range(8)])
    return quality.bloom_may_contain(lens(spark, sf, "fx_blocks").withColumn("logs_bloom", bloom), _some_addresses()).select("block_number")


@query("SELECT block_number FROM (SELECT CAST(unnest(range(10000835, 10020000)) AS BIGINT) AS block_number) EXCEPT SELECT block_number FROM fx_blocks WHERE block_number % 41 <> 0")
def missing_blocks(spark, sf):
    return quality.missing_blocks(spark, _damaged(spark, sf)[0], GENESIS, 10_019_999).select("block_number")


def _two_chains(spark, sf) -> DataFrame:
    """Chain 1 lacks every third block, chain 2 every fifth."""
    b = lens(spark, sf, "fx_blocks")
    return b.where("block_number % 3 <> 0").unionByName(b.where("block_number % 5 <> 0").withColumn("chain_id", F.lit(2)))


_TWO_CHAINS = "WITH two AS (SELECT * FROM fx_blocks WHERE block_number % 3 <> 0 UNION ALL SELECT * REPLACE (CAST(2 AS INT) AS chain_id) FROM fx_blocks WHERE block_number % 5 <> 0)"


@query(_TWO_CHAINS + "SELECT CAST(c AS INT) AS chain_id, n AS block_number FROM (SELECT unnest([1, 2]) AS c), (SELECT CAST(unnest(range(10000835, 10001335)) AS BIGINT) AS n) EXCEPT SELECT chain_id, block_number FROM two")
def missing_blocks_by_chain(spark, sf):
    return quality.missing_blocks(spark, _two_chains(spark, sf), GENESIS, GENESIS + 499)


@query(_TWO_CHAINS + """, b AS (SELECT chain_id, block_number, lead(block_number) OVER (PARTITION BY chain_id ORDER BY block_number) AS n FROM two)
SELECT chain_id, block_number + 1 AS first, n - 1 AS last FROM b WHERE n > block_number + 1""")
def gap_ranges_by_chain(spark, sf):
    return quality.gap_ranges(_two_chains(spark, sf))


@query(_TWO_CHAINS + """, w AS (SELECT CAST(c AS INT) AS chain_id, n AS block_number FROM (SELECT unnest([1, 2, 3]) AS c), (SELECT CAST(10000835 + unnest(range(0, 3000, 7)) AS BIGINT) AS n))
SELECT w.chain_id, w.block_number, two.block_number IS NOT NULL AS present FROM w LEFT JOIN two USING (chain_id, block_number)""")
def blocks_present_by_chain(spark, sf):
    chains = F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("chain_id")
    return quality.present(_two_chains(spark, sf), spark.range(GENESIS, GENESIS + 3000, 7).select(chains, F.col("id").alias("block_number")))


@query("""WITH b AS (SELECT block_number, lead(block_number) OVER (ORDER BY block_number) AS n FROM fx_blocks WHERE block_number % 41 <> 0)
SELECT CAST(1 AS INT) AS chain_id, block_number + 1 AS first, n - 1 AS last FROM b WHERE n > block_number + 1""")
def gap_ranges(spark, sf):
    return quality.gap_ranges(_damaged(spark, sf)[0])


# -- decoding

_PURCHASE = "SELECT 10000835 + CAST(floor(event_id / 10) AS BIGINT) AS block_number, CAST(event_id % 10 AS INT) AS log_index, '0x' || lpad(lower(hex(user_id)), 40, '0') AS a, '0x' || lpad(lower(hex(event_id % 97)), 40, '0') AS b, CAST(round(value * 100) AS BIGINT) AS cents, event_id, user_id, event_type FROM events"


@query(f"SELECT block_number, log_index, a AS p_from, b AS p_to, CAST(cents AS VARCHAR) AS p_value, lpad(lower(hex(cents)), 64, '0') AS p_value_hex FROM ({_PURCHASE}) WHERE event_type = 'purchase'")
def event_table_transfer(spark, sf):
    return decode.event_table(lens(spark, sf, "fx_raw_events"), EVENTS, "Token", "Transfer").select("block_number", "log_index", "p_from", "p_to", "p_value", "p_value_hex")


@query(f"SELECT block_number, log_index, a AS p_owner, CAST(CAST(cents AS HUGEINT) * 1208925819614629174706176 AS VARCHAR) AS p_value FROM ({_PURCHASE}) WHERE event_type = 'signup'")
def event_table_approval(spark, sf):
    return decode.event_table(lens(spark, sf, "fx_raw_events"), EVENTS, "Token", "Approval").select("block_number", "log_index", "p_owner", "p_value")


@query(f"SELECT block_number, log_index, a AS p_sender, CAST(cents AS VARCHAR) AS p_amount0_in, CAST(event_id AS VARCHAR) AS p_amount1_in, '0' AS p_amount0_out, CAST(user_id AS VARCHAR) AS p_amount1_out, b AS p_to FROM ({_PURCHASE}) WHERE event_type = 'click'")
def event_table_swap(spark, sf):
    return decode.event_table(lens(spark, sf, "fx_raw_events"), EVENTS, "Pair", "Swap").select("block_number", "log_index", "p_sender", "p_amount0_in", "p_amount1_in", "p_amount0_out", "p_amount1_out", "p_to")


@query("""SELECT 10000835 + CAST(floor(event_id / 10) AS BIGINT) AS block_number, CAST(event_id % 10 AS INT) AS log_index, CAST(event_id % 200 - 100 AS INT) AS p_delta, event_type || '-' || CAST(user_id AS VARCHAR) AS p_memo,
lpad(lower(hex(event_id % 65536)), 8, '0') AS p_tag, event_id % 3 = 0 AS p_flag, CAST(user_id AS VARCHAR) || ',' || CAST(event_id AS VARCHAR) AS p_xs FROM events WHERE event_type = 'view'""")
def event_table_note(spark, sf):
    return decode.event_table(lens(spark, sf, "fx_raw_events"), EVENTS, "Board", "Note").select("block_number", "log_index", "p_delta", "p_memo", "p_tag", "p_flag", F.array_join("p_xs", ",").alias("p_xs"))


_OWNERS = f"(VALUES ('{TRANSFER}', 'event_token_transfer', 0), ('{APPROVAL}', 'event_token_approval', 1), ('{SWAP}', 'event_pair_swap', 2), ('{TRANSFER}', 'event_pair_transfer', 3), ('{NOTE}', 'event_board_note', 4)) o(topic0, table_name, n)"


@query(f"SELECT o.table_name, r.block_number, r.log_index FROM fx_raw_events r JOIN {_OWNERS} ON r.topic0 = o.topic0")
def decode_events(spark, sf):
    return decode.decode_events(lens(spark, sf, "fx_raw_events"), EVENTS).select("table_name", "block_number", "log_index")


@query(f"""SELECT o.table_name, block_number, log_index, CASE event_type WHEN 'purchase' THEN a || ' ' || b || ' ' || cents WHEN 'signup' THEN a || ' ' || b || ' ' || (CAST(cents AS HUGEINT) * 1208925819614629174706176)
WHEN 'click' THEN a || ' ' || cents || ' ' || event_id || ' 0 ' || user_id || ' ' || b ELSE (event_id % 200 - 100) || ' view-' || user_id || ' ' || lpad(lower(hex(event_id % 65536)), 8, '0') || ' ' || (event_id % 3 = 0) || ' [' || user_id || ', ' || event_id || ']' END AS params
FROM (SELECT *, CASE event_type WHEN 'purchase' THEN '{TRANSFER}' WHEN 'signup' THEN '{APPROVAL}' WHEN 'click' THEN '{SWAP}' WHEN 'view' THEN '{NOTE}' END AS topic0 FROM ({_PURCHASE})) e JOIN {_OWNERS} ON e.topic0 = o.topic0""")
def decode_events_values(spark, sf):
    """The long form with every parameter of every event, in the order of its definition."""
    long = decode.decode_events(lens(spark, sf, "fx_raw_events"), EVENTS)
    return long.select("table_name", "block_number", "log_index", F.array_join(F.map_values("params"), " ").alias("params"))


@query(f"SELECT block_number, log_index, a AS p_from, b AS p_to, CAST(cents AS VARCHAR) AS p_value FROM ({_PURCHASE}) WHERE event_type = 'purchase'")
def decode_events_params(spark, sf):
    long = decode.decode_events_first(lens(spark, sf, "fx_raw_events"), EVENTS).where("name = 'Transfer'")
    return long.select("block_number", "log_index", F.col("params")["from"].alias("p_from"), F.col("params")["to"].alias("p_to"), F.col("params")["value"].alias("p_value"))


@query(f"SELECT o.table_name, count(*) AS rows FROM fx_raw_events r JOIN (SELECT * FROM {_OWNERS} WHERE n <> 3) o ON r.topic0 = o.topic0 GROUP BY ALL")
def decode_events_first(spark, sf):
    return decode.decode_events_first(lens(spark, sf, "fx_raw_events"), EVENTS).groupBy("table_name").agg(F.count("*").alias("rows"))


@query(f"SELECT o.table_name, count(*) AS rows FROM fx_raw_events r JOIN (SELECT * FROM {_OWNERS} WHERE n <> 0) o ON r.topic0 = o.topic0 GROUP BY ALL")
def decode_events_for(spark, sf):
    return decode.decode_events_first(lens(spark, sf, "fx_raw_events"), EVENTS, "Pair").groupBy("table_name").agg(F.count("*").alias("rows"))


@query("SELECT table_name, count(*) AS rows FROM (SELECT o.table_name FROM fx_raw_events r JOIN " + _OWNERS + " ON r.topic0 = o.topic0) GROUP BY ALL")
def route(spark, sf):
    parts = decode.route(decode.decode_events(lens(spark, sf, "fx_raw_events"), EVENTS))
    out = None
    for name, df in parts.items():
        one = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table_name"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


_CALLS = "SELECT block_number, tx_index, trace_address, '0x' || lpad(lower(hex(l_suppkey)), 40, '0') AS p_to, CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS VARCHAR) AS p_amount FROM fx_traces WHERE l_returnflag <> 'N'"


@query(_CALLS)
def call_table(spark, sf):
    return decode.call_table(lens(spark, sf, "fx_traces"), FUNCTIONS, "Token", "transfer").select("block_number", "tx_index", "trace_address", "p_to", "p_amount")


@query(_CALLS.replace("AS p_to", "AS p_to, 'trace_token_transfer' AS table_name"))
def decode_calls(spark, sf):
    return decode.decode_calls(lens(spark, sf, "fx_traces"), FUNCTIONS).select("block_number", "tx_index", "trace_address", F.col("params")["to"].alias("p_to"), "table_name", F.col("params")["amount"].alias("p_amount"))


@query("SELECT CASE WHEN l_returnflag <> 'N' THEN 'transfer' END AS function_name, count(*) AS rows FROM fx_traces GROUP BY ALL")
def label_function_names(spark, sf):
    return decode.label_function_names(lens(spark, sf, "fx_traces"), FUNCTIONS).groupBy("function_name").agg(F.count("*").alias("rows"))


@query("SELECT block_number, tx_index, trace_address, l_partkey % 2 = 1 AS p_output_0 FROM fx_traces WHERE l_returnflag <> 'N'")
def decode_outputs(spark, sf):
    t = lens(spark, sf, "fx_traces").withColumn("output", F.concat(F.lit("0x"), F.lpad((F.col("l_partkey") % 2).cast("string"), 64, "0")))
    return decode.decode_outputs(t, FUNCTIONS, "Token", "transfer").select("block_number", "tx_index", "trace_address", "p_output_0")


_KEPT = f"""SELECT event_type, count(*) AS rows FROM ({_PURCHASE}) WHERE (event_type = 'purchase' AND cents >= 10000) OR (event_type = 'signup' AND CAST(cents AS HUGEINT) * 1208925819614629174706176 > 18446744073709551616)
OR (event_type = 'view' AND (event_id % 200 - 100 < 0 OR contains(event_type || '-' || CAST(user_id AS VARCHAR), 'view-1'))) OR event_type = 'click' GROUP BY ALL"""


@query(f"SELECT CASE event_type WHEN 'purchase' THEN 'event_token_transfer' WHEN 'signup' THEN 'event_token_approval' WHEN 'view' THEN 'event_board_note' ELSE 'event_pair_swap' END AS table_name, rows FROM ({_KEPT})")
def rebuild(spark, sf):
    out = None
    for name, df in decode.rebuild(lens(spark, sf, "fx_raw_events"), [d for d in EVENTS if d.contract != "Factory" and (d.contract, d.name) != ("Pair", "Transfer")], RULES).items():
        one = df.groupBy(F.lit(name).alias("table_name")).agg(F.count("*").alias("rows"))
        out = one if out is None else out.unionByName(one)
    return out


@query(f"""SELECT CASE event_type WHEN 'purchase' THEN 'event_token_transfer' WHEN 'signup' THEN 'event_token_approval' WHEN 'view' THEN 'event_board_note' ELSE 'event_pair_swap' END AS table_name, rows FROM ({_KEPT})
UNION ALL SELECT 'event_pair_transfer', rows FROM ({_KEPT}) WHERE event_type = 'purchase' UNION ALL SELECT 'event_factory_pair_created', count(*) FROM supplier""")
def rebuild_all(spark, sf):
    """Every definition, the factory's and the one that two contracts share included."""
    created = lens(spark, sf, "fx_factory_logs")
    raw = lens(spark, sf, "fx_raw_events").unionByName(created.withColumn("topic3", F.lit(None).cast("string")).withColumn("block_hash", F.lit("0x")).withColumn("block_timestamp", F.lit(0).cast("bigint")))
    parts = [df.groupBy(F.lit(name).alias("table_name")).agg(F.count("*").alias("rows")) for name, df in decode.rebuild(raw, EVENTS, RULES).items()]
    return reduce(DataFrame.unionByName, parts)


@query(f"""WITH n AS (SELECT topic0, count(*) AS raw_rows FROM fx_raw_events GROUP BY ALL), d AS (SELECT o.table_name, coalesce(n.raw_rows, 0) AS raw_rows, CASE WHEN o.table_name LIKE 'event_token_%' THEN coalesce(n.raw_rows, 0) ELSE 0 END AS decoded_rows FROM {_OWNERS} LEFT JOIN n ON n.topic0 = o.topic0)
SELECT *, raw_rows > 0 AND decoded_rows = 0 AS needed FROM d UNION ALL SELECT 'event_factory_pair_created', 0, 0, false""")
def rebuild_needed(spark, sf):
    """Tables that have raw logs but no decoded rows, where the token's events alone have been decoded."""
    raw = lens(spark, sf, "fx_raw_events")
    token = [d for d in EVENTS if d.contract == "Token"]
    return decode.rebuild_needed(raw, EVENTS, decode.decode_events(raw, token).groupBy("table_name").agg(F.count("*").alias("decoded_rows")))


@query(f"SELECT block_number, log_index, CAST(cents AS VARCHAR) AS p_value FROM ({_PURCHASE}) WHERE event_type = 'purchase' AND cents >= 10000")
def apply_filters_integers(spark, sf):
    table = decode.event_table(lens(spark, sf, "fx_raw_events"), EVENTS, "Token", "Transfer")
    return filters.apply_filters(table, RULES, "Token", "Transfer").select("block_number", "log_index", "p_value")


@query("""SELECT 10000835 + CAST(floor(event_id / 10) AS BIGINT) AS block_number, CAST(event_id % 10 AS INT) AS log_index FROM events
WHERE event_type = 'view' AND (event_id % 200 - 100 < 0 OR contains('view-' || CAST(user_id AS VARCHAR), 'view-1'))""")
def apply_filters_any_rule(spark, sf):
    table = decode.event_table(lens(spark, sf, "fx_raw_events"), EVENTS, "Board", "Note")
    return filters.apply_filters(table, RULES, "Board", "Note").select("block_number", "log_index")


# -- factories, traces, accounts

_CHILDREN = "SELECT '0x' || lpad(lower(hex(s_suppkey % 30)), 40, '0') AS child_address, CAST(10000835 + (s_suppkey * 7) % 50 AS BIGINT) AS created_at_block, CAST(s_suppkey AS INT) AS created_at_log_index FROM supplier"
_FIRST = f"SELECT child_address, min(created_at_block) AS created_at_block FROM ({_CHILDREN}) GROUP BY child_address"


def _children(spark, sf) -> DataFrame:
    return factory.dedup_children(factory.discover_children(lens(spark, sf, "fx_factory_logs"), FACTORIES))


@query(_CHILDREN)
def discover_children(spark, sf):
    return factory.discover_children(lens(spark, sf, "fx_factory_logs"), FACTORIES).select("child_address", "created_at_block", "created_at_log_index")


@query(f"SELECT child_address, created_at_block, created_at_log_index FROM (SELECT *, row_number() OVER (PARTITION BY child_address ORDER BY created_at_block, created_at_log_index) AS n FROM ({_CHILDREN})) WHERE n = 1")
def dedup_children(spark, sf):
    return _children(spark, sf).select("child_address", "created_at_block", "created_at_log_index")


@query(f"SELECT 'Pair' AS contract_name, string_agg(child_address, ',' ORDER BY created_at_block, child_address) AS children FROM ({_FIRST})")
def children_by_contract(spark, sf):
    return factory.children_by_contract(_children(spark, sf)).select("contract_name", F.array_join("children", ",").alias("children"))


@query(_FIRST)
def children_by_factory(spark, sf):
    return factory.children_by_factory(_children(spark, sf), FACTORY_ADDRESS.upper().replace("0X", "0x")).select("child_address", "created_at_block")


@query(_FIRST)
def children_with_blocks(spark, sf):
    return factory.children_with_blocks(_children(spark, sf))


@query(f"SELECT r.block_number, r.log_index, r.address FROM fx_raw_events r JOIN ({_FIRST}) c ON r.address = c.child_address WHERE r.block_number >= c.created_at_block AND c.created_at_block < 10000880 AND r.topic0 IN ('{TRANSFER}', '{SWAP}')")
def child_events(spark, sf):
    return factory.child_events(lens(spark, sf, "fx_raw_events"), _children(spark, sf), factory.child_signatures(EVENTS, FACTORIES), GENESIS + 45).select("block_number", "log_index", "address")


@query(f"SELECT child_address, created_at_block FROM ({_FIRST}) WHERE created_at_block < 10000850")
def prune_children(spark, sf):
    return factory.prune_children(_children(spark, sf), GENESIS + 15).select("child_address", "created_at_block")


@query(f"SELECT block_number, tx_index, trace_address, from_address, to_address FROM fx_traces WHERE from_address IN (SELECT child_address FROM ({_FIRST})) OR to_address IN (SELECT child_address FROM ({_FIRST}))")
def filter_traces(spark, sf):
    own = _children(spark, sf).select(F.col("child_address").alias("address"))
    return factory.filter_traces(lens(spark, sf, "fx_traces"), own).select("block_number", "tx_index", "trace_address", "from_address", "to_address")


_TX_EVENTS = """SELECT block_number, tx_index, kind AS event_type, address, counterparty, value FROM (
SELECT block_number, tx_index, 'transaction:from' AS kind, from_address AS address, to_address AS counterparty, value FROM fx_transactions
UNION ALL SELECT block_number, tx_index, 'transaction:to', to_address, from_address, value FROM fx_transactions) JOIN fx_tracked USING (address, kind)"""
_TRANSFERS = """SELECT block_number, tx_index, trace_address, kind AS event_type, address, counterparty, value FROM (
SELECT block_number, tx_index, trace_address, 'transfer:from' AS kind, from_address AS address, to_address AS counterparty, value FROM fx_traces WHERE value <> '0'
UNION ALL SELECT block_number, tx_index, trace_address, 'transfer:to', to_address, from_address, value FROM fx_traces WHERE value <> '0') JOIN fx_tracked USING (address, kind)"""


@query(_TX_EVENTS)
def account_tx_events(spark, sf):
    return accounts.account_tx_events(lens(spark, sf, "fx_transactions"), lens(spark, sf, "fx_tracked")).select("block_number", "tx_index", "event_type", "address", "counterparty", "value")


@query(_TRANSFERS)
def account_transfer_events(spark, sf):
    return accounts.account_transfer_events(lens(spark, sf, "fx_traces"), lens(spark, sf, "fx_tracked")).select("block_number", "tx_index", "trace_address", "event_type", "address", "counterparty", "value")


@query(f"""SELECT block_number, tx_index, event_type FROM (SELECT block_number, tx_index, event_type, '' AS t FROM ({_TX_EVENTS}) WHERE address = '0x' || lpad('5', 40, '0')
UNION ALL SELECT block_number, tx_index, event_type, trace_address FROM ({_TRANSFERS}) WHERE address = '0x' || lpad('5', 40, '0')) ORDER BY block_number DESC, tx_index DESC, event_type LIMIT 50""")
def account_ledger(spark, sf):
    tracked = lens(spark, sf, "fx_tracked")
    txs, moves = accounts.account_tx_events(lens(spark, sf, "fx_transactions"), tracked), accounts.account_transfer_events(lens(spark, sf, "fx_traces"), tracked)
    return accounts.account_ledger(txs, moves, "0x" + "5".rjust(40, "0"), 50).select("block_number", "tx_index", "event_type")


# -- rollups and snapshots

_ORIGIN = {"15m": ("15 minutes", ""), "30m": ("30 minutes", ""), "1h": ("1 hour", ""), "4h": ("4 hours", ""), "1d": ("1 day", ""), "1w": ("7 days", ", TIMESTAMP '1970-01-05'")}


def _bucket(interval: str) -> str:
    width, origin = _ORIGIN[interval]
    return f"strftime(time_bucket(INTERVAL '{width}', make_timestamp(block_timestamp * 1000000){origin}), '%Y-%m-%d %H:%M:%S')"


def _rollup_query(interval: str) -> None:
    def run(spark, sf):
        out = rollup.rollup(lens(spark, sf, "fx_raw_events").where("topic0 is not null"), interval)
        return out.select("chain_id", "address", _stamp("bucket"), "event_count", "tx_count")

    run.__name__ = f"rollup_{interval}"
    query(f"SELECT chain_id, address, {_bucket(interval)} AS bucket, count(*) AS event_count, count(DISTINCT tx_hash) AS tx_count FROM fx_raw_events WHERE topic0 IS NOT NULL GROUP BY ALL")(run)


for _interval in rollup.INTERVALS:
    _rollup_query(_interval)

def _metrics() -> list[tuple[str, Column | str]]:
    return [
        ("total", wide.wide_sum(F.col("p_value_hex"))),
        ("mean", wide.wide_avg(F.col("p_value_hex"))),
        ("least", wide.wide_min(F.col("p_value_hex"))),
        ("most", wide.wide_max(F.col("p_value_hex"))),
        ("senders", "count(DISTINCT p_from)"),
        ("large", "count(*) FILTER (WHERE cast(p_value AS bigint) > 10000)"),
        ("median", "percentile_cont(0.5) WITHIN GROUP (ORDER BY cast(p_value AS bigint))"),
    ]


def _transfers(spark, sf) -> DataFrame:
    return decode.event_table(lens(spark, sf, "fx_raw_events"), EVENTS, "Token", "Transfer")


@query(f"""SELECT address, {_bucket("1d")} AS bucket, count(*) AS event_count, count(DISTINCT tx_hash) AS tx_count, CAST(CAST(sum(c) AS HUGEINT) AS VARCHAR) AS total, CAST(CAST(sum(c) AS HUGEINT) // count(*) AS VARCHAR) AS mean,
CAST(min(c) AS VARCHAR) AS least, CAST(max(c) AS VARCHAR) AS most, count(DISTINCT topic1) AS senders, count(*) FILTER (WHERE c > 10000) AS large, round(quantile_cont(c, 0.5), 4) AS median
FROM (SELECT *, CAST('0x' || ltrim(substr(data, 3), '0') AS BIGINT) AS c FROM fx_raw_events WHERE topic0 = '{TRANSFER}') GROUP BY address, bucket""")
def rollup_custom_metrics(spark, sf):
    out = rollup.rollup(_transfers(spark, sf), "1d", _metrics())
    return out.select("address", _stamp("bucket"), "event_count", "tx_count", "total", "mean", "least", "most", "senders", "large", F.round("median", 4).alias("median"))


@query(f"""SELECT address, {_bucket("1w")} AS bucket, CAST(CAST(sum(c) AS HUGEINT) AS VARCHAR) AS total, CAST(max(c) AS VARCHAR) AS most FROM (
SELECT r.*, CAST(round(e.value * 100) AS HUGEINT) * 1208925819614629174706176 AS c FROM fx_raw_events r JOIN events e ON e.event_id = (r.block_number - 10000835) * 10 + r.log_index WHERE r.topic0 = '{APPROVAL}') GROUP BY address, bucket""")
def rollup_wide_values(spark, sf):
    table = decode.event_table(lens(spark, sf, "fx_raw_events"), EVENTS, "Token", "Approval")
    return rollup.rollup(table, "1w", _metrics()[:1] + _metrics()[3:4]).select("address", _stamp("bucket"), "total", "most")


@query(f"""SELECT address, {_bucket("1d")} AS bucket, string_agg(DISTINCT CAST(c AS VARCHAR), ',' ORDER BY CAST(c AS VARCHAR)) AS amounts, CAST(sum(c) AS BIGINT) // nullif(CAST(sum(c % 2) AS BIGINT), 0) AS per_odd
FROM (SELECT *, CAST('0x' || ltrim(substr(data, 3), '0') AS BIGINT) AS c FROM fx_raw_events WHERE topic0 = '{TRANSFER}') GROUP BY address, bucket""")
def rollup_lists_and_nulls(spark, sf):
    """array_agg and nullif in metrics."""
    metrics = [("amounts", "array_join(array_sort(array_distinct(array_agg(p_value))), ',')"), ("per_odd", "sum(cast(p_value AS bigint)) div nullif(sum(cast(p_value AS bigint) % 2), 0)")]
    return rollup.rollup(_transfers(spark, sf), "1d", metrics).select("address", _stamp("bucket"), "amounts", "per_odd")


@query(f"""SELECT block_number, log_index, CAST(-CAST(cents AS HUGEINT) * 1208925819614629174706176 AS VARCHAR) AS negated, CAST(CAST(cents AS HUGEINT) * 1208925819614629174706176 AS VARCHAR) AS value,
CAST(cents AS HUGEINT) * 1208925819614629174706176 < CAST(1208925819614629174706176 AS HUGEINT) * 10000 AS small FROM ({_PURCHASE}) WHERE event_type = 'signup'""")
def wide_values(spark, sf):
    """Negative 256-bit values from their two's complement, values that fit 38 digits, and comparison by digits."""
    table = decode.event_table(lens(spark, sf, "fx_raw_events"), EVENTS, "Token", "Approval")
    digits, zeros = F.col("p_value_hex"), "0" * 20  # the values are multiples of 2 ** 80, and their rest fits a long
    cents = F.conv(F.substring(digits, 29, 16), 16, 10).cast("bigint")
    complement = F.concat(F.lit("f" * 28), F.lower(F.lpad(F.hex(-cents), 16, "f")), F.lit(zeros))
    negated = F.when(cents == 0, F.lit("0")).otherwise(wide.signed_text(complement))
    return table.select("block_number", "log_index", negated.alias("negated"), wide.fits38(digits).cast("string").alias("value"), (digits < f"{10_000:044x}{zeros}").alias("small"))


def _stale(spark, sf) -> tuple[DataFrame, DataFrame]:
    events = lens(spark, sf, "fx_raw_events").where("topic0 is not null")
    return events, rollup.rollup(events, "1h").withColumn("event_count", F.col("event_count") + 1)


_HOUR = "epoch(time_bucket(INTERVAL '1 hour', make_timestamp(block_timestamp * 1000000)))"


@query(f"""SELECT address, bucket, n + CASE WHEN h >= 1704333000 AND h < 1704339600 THEN 0 ELSE 1 END AS event_count
FROM (SELECT address, {_bucket("1h")} AS bucket, {_HOUR} AS h, count(*) AS n FROM fx_raw_events WHERE topic0 IS NOT NULL GROUP BY ALL)""")
def refresh_rollup(spark, sf):
    events, stored = _stale(spark, sf)
    return rollup.refresh_rollup(events, stored, "1h", 1_704_340_200).select("address", _stamp("bucket"), "event_count")


@query(f"""SELECT address, bucket, n + CASE WHEN h >= 1704337200 THEN 0 ELSE 1 END AS event_count
FROM (SELECT address, {_bucket("1h")} AS bucket, {_HOUR} AS h, count(*) AS n FROM fx_raw_events WHERE topic0 IS NOT NULL GROUP BY ALL)""")
def refresh_rollup_from(spark, sf):
    events, stored = _stale(spark, sf)
    return rollup.refresh_rollup_from(events, stored, "1h", 1_704_340_200).select("address", _stamp("bucket"), "event_count")


@query(f"""SELECT address, bucket, n + CASE WHEN h >= 1704326400 THEN 0 ELSE 1 END AS event_count
FROM (SELECT address, {_bucket("1h")} AS bucket, {_HOUR} AS h, count(*) AS n FROM fx_raw_events WHERE topic0 IS NOT NULL GROUP BY ALL)""")
def refresh_rollup_stored(spark, sf):
    """A stored rollup of which the days from 2024-01-04 on are recomputed; the days before stay as they are."""
    events, stale = _stale(spark, sf)
    path = new_folder(spark, "rollup")
    rollup.store_rollup(spark, stale, path)
    rollup.refresh_stored(spark, events, path, "1h", 1_704_340_200, blocks=lens(spark, sf, "fx_blocks"))
    return spark.read.parquet(path).select("address", _stamp("bucket"), "event_count")


@query(f"SELECT address, {_bucket('1d')} AS bucket, count(*) AS event_count FROM fx_raw_events WHERE topic0 IS NOT NULL GROUP BY ALL")
def coarsen(spark, sf):
    return rollup.coarsen(rollup.rollup(lens(spark, sf, "fx_raw_events").where("topic0 is not null"), "1h"), "1d").select("address", _stamp("bucket"), "event_count")


@query(f"SELECT address, {_bucket('1d')} AS bucket, count(*) AS event_count, count(DISTINCT tx_hash) AS txs, true AS near FROM fx_raw_events WHERE topic0 IS NOT NULL GROUP BY address, bucket")
def coarsen_distinct(spark, sf):
    """Distinct transactions of days from sketches of hours, the days from 2024-01-04 on merged anew: each within 10 % of the exact count (five times the sketch's error), which stands beside it."""
    events = lens(spark, sf, "fx_raw_events").where("topic0 is not null")
    hours = rollup.rollup(events, "1h", [("txs", rollup.distinct_sketch("tx_hash"))])
    old = rollup.coarsen(hours, "1d", sketches=["txs"])
    old = old.withColumn("txs_estimate", F.when(F.unix_timestamp("bucket") >= 1_704_326_400, 0).otherwise(F.col("txs_estimate")))
    days = rollup.refresh_coarse(hours, old, "1d", 1_704_330_000, sketches=["txs"])
    exact = rollup.rollup(events, "1d").select("address", "bucket", F.col("tx_count").alias("exact"))
    near = F.abs(F.col("txs_estimate") - F.col("exact")) <= F.greatest(F.lit(1.0), F.col("exact") * 0.1)
    return days.drop("txs").join(exact, ["address", "bucket"]).select("address", _stamp("bucket"), "event_count", F.col("exact").alias("txs"), near.alias("near"))


@query("""WITH s AS (SELECT block_number FROM fx_blocks WHERE block_number % 100 = 0), a AS (SELECT DISTINCT address FROM fx_raw_events)
SELECT s.block_number, a.address, (SELECT arg_max(r.tx_hash, r.block_number * 100 + r.log_index) FROM fx_raw_events r WHERE r.address = a.address AND r.block_number <= s.block_number) AS tx_hash
FROM s, a WHERE EXISTS (SELECT 1 FROM fx_raw_events r WHERE r.address = a.address AND r.block_number <= s.block_number)""")
def snapshot_every(spark, sf):
    return rollup.snapshot_every(lens(spark, sf, "fx_raw_events"), lens(spark, sf, "fx_blocks"), 100, ["tx_hash"]).select("block_number", "address", "tx_hash")


@query(f"""WITH r AS (SELECT *, CAST('0x' || ltrim(substr(data, 3), '0') AS BIGINT) AS c FROM fx_raw_events WHERE topic0 = '{TRANSFER}'), s AS (SELECT block_number FROM fx_blocks WHERE block_number % 500 = 0), a AS (SELECT DISTINCT address FROM r)
SELECT s.block_number, a.address, CAST((SELECT arg_max(r.c, r.block_number * 100 + r.log_index) FROM r WHERE r.address = a.address AND r.block_number <= s.block_number) AS VARCHAR) AS value
FROM s, a WHERE EXISTS (SELECT 1 FROM r WHERE r.address = a.address AND r.block_number <= s.block_number)""")
def decode_snapshot(spark, sf):
    raw = lens(spark, sf, "fx_raw_events").where(F.col("topic0") == TRANSFER)
    shots = rollup.snapshot_every(raw, lens(spark, sf, "fx_blocks"), 500, ["data"])
    return shots.select("block_number", "address", abi_words.static("uint256", abi_words.word(abi_words.strip(F.col("data")), 0)).alias("value"))


@query(f"""SELECT chain_id, 'blocks' AS metric, '' AS label, count(*) AS value FROM fx_blocks GROUP BY ALL UNION ALL SELECT chain_id, 'events', '', count(*) FROM fx_raw_events GROUP BY ALL
UNION ALL SELECT chain_id, 'traces', call_type, count(*) FROM fx_traces GROUP BY ALL UNION ALL SELECT chain_id, 'tip', '', max(block_number) FROM fx_blocks GROUP BY ALL
UNION ALL SELECT CAST(1 AS INT), 'account_events', event_type, count(*) FROM ({_TX_EVENTS}) GROUP BY ALL""")
def metrics_by_chain(spark, sf):
    own = accounts.account_tx_events(lens(spark, sf, "fx_transactions"), lens(spark, sf, "fx_tracked"))
    return rollup.metrics_by_chain(lens(spark, sf, "fx_blocks"), lens(spark, sf, "fx_raw_events"), lens(spark, sf, "fx_traces"), own)


@query(f"""SELECT chain_id, 'reorgs' AS metric, '' AS label, count(*) AS value FROM (SELECT 1 AS chain_id FROM fx_stored_blocks s JOIN fx_blocks b USING (block_number) WHERE s.block_hash <> b.block_hash) GROUP BY ALL
UNION ALL SELECT chain_id, 'current', '', max(current_block) FROM fx_workers GROUP BY ALL UNION ALL SELECT chain_id, 'tip', '', max(block_number) FROM fx_blocks GROUP BY ALL""")
def metrics_of_sync(spark, sf):
    """The counter of reorganisations and the gauges."""
    replaced = reorg.chain_difference(lens(spark, sf, "fx_stored_blocks"), lens(spark, sf, "fx_blocks")).where("state = 'replaced'")
    out = rollup.metrics_by_chain(lens(spark, sf, "fx_blocks"), lens(spark, sf, "fx_raw_events"), lens(spark, sf, "fx_traces"), accounts.account_tx_events(lens(spark, sf, "fx_transactions"), lens(spark, sf, "fx_tracked")), replaced, lens(spark, sf, "fx_workers"))
    return out.where("metric in ('reorgs', 'current', 'tip')")


# -- views, writes, sinks


@query("SELECT block_number, tx_index, trace_address FROM fx_traces")
def order_canonical(spark, sf):
    return shaping.order_canonical(lens(spark, sf, "fx_traces"), "traces").select("block_number", "tx_index", "trace_address")


@query(f"SELECT block_number, log_index, address FROM fx_raw_events WHERE topic0 = '{TRANSFER}' AND address IN (SELECT child_address FROM ({_FIRST}))")
def event_view(spark, sf):
    return views.event_view(_transfers(spark, sf), 1, children=_children(spark, sf)).select("block_number", "log_index", "address")


@query("SELECT block_number, log_index, address FROM fx_raw_events WHERE address IN ('0x' || lpad('1', 40, '0'), '0x' || lpad('a', 40, '0'))")
def all_events_view(spark, sf):
    return views.all_events_view(lens(spark, sf, "fx_raw_events"), 1, ["0x" + "1".rjust(40, "0"), "0x" + "A".rjust(40, "0")]).select("block_number", "log_index", "address")


@query("SELECT count(*) AS rows, max(block_number) AS latest FROM fx_traces WHERE chain_id = 1")
def traces_view(spark, sf):
    return views.traces_view(lens(spark, sf, "fx_traces"), 1).agg(F.count("*").alias("rows"), F.max("block_number").alias("latest"))


@query(_TX_EVENTS)
def account_events_view(spark, sf):
    own = accounts.account_tx_events(lens(spark, sf, "fx_transactions"), lens(spark, sf, "fx_tracked"))
    return views.account_events_view(own, 1).select("block_number", "tx_index", "event_type", "address", "counterparty", "value")


@query(f"SELECT address, {_bucket('1d')} AS bucket, count(*) AS event_count FROM fx_raw_events WHERE address IN (SELECT child_address FROM ({_FIRST})) GROUP BY ALL")
def aggregate_view(spark, sf):
    rolled = rollup.rollup(lens(spark, sf, "fx_raw_events"), "1d")
    return views.aggregate_view(rolled, 1, children=_children(spark, sf)).select("address", _stamp("bucket"), "event_count")


_TIE = "l_partkey, l_suppkey, l_extendedprice, l_discount, l_tax, l_quantity, l_returnflag, l_shipdate"


@query(f"""WITH f AS (SELECT *, row_number() OVER (PARTITION BY chain_id, block_number, tx_index, trace_address ORDER BY {_TIE}) AS n FROM fx_traces)
SELECT block_number, tx_index, trace_address, l_partkey, l_suppkey FROM f WHERE n = 1 AND NOT EXISTS (SELECT 1 FROM fx_traces s WHERE s.block_number % 5 = 0 AND s.block_number = f.block_number AND s.tx_index = f.tx_index AND s.trace_address = f.trace_address)""")
def insert_new(spark, sf):
    t = lens(spark, sf, "fx_traces")
    return store.new_rows(t, t.where("block_number % 5 = 0"), TRACE_KEY, _TIE.split(", ")).select("block_number", "tx_index", "trace_address", "l_partkey", "l_suppkey")


@query("SELECT count(*) AS conflicts FROM (SELECT chain_id, block_number, tx_index, trace_address FROM fx_traces GROUP BY ALL HAVING count(*) > 1 OR bool_or(block_number % 5 = 0))")
def insert_strict(spark, sf):
    t = lens(spark, sf, "fx_traces")
    n = store.conflicts(t, t.where("block_number % 5 = 0"), TRACE_KEY)
    return spark.range(1).select(F.lit(n).cast("bigint").alias("conflicts"))


@query(f"""SELECT 'first' AS batch, block_number, tx_index, trace_address FROM fx_traces WHERE block_number % 5 = 0 GROUP BY ALL
UNION ALL SELECT 'fallback', block_number, tx_index, trace_address FROM fx_traces WHERE block_number % 5 > 0 AND block_number % 3 = 0 GROUP BY ALL UNION ALL SELECT 'inserted', block_number, tx_index, trace_address FROM fx_traces WHERE block_number % 5 > 0 AND block_number % 3 = 1 GROUP BY ALL""")
def insert_strict_stored(spark, sf):
    """What three batches leave in the table: one that falls back, one that is skipped, one without conflicts."""
    t = store.first_by_key(lens(spark, sf, "fx_traces").select(*TRACE_KEY, "value"), TRACE_KEY)
    path = new_folder(spark, "strict")
    batches = {"first": ("block_number % 5 = 0", "fail"), "fallback": ("block_number % 5 = 0 or block_number % 3 = 0", "fallback"), "skipped": ("block_number % 3 < 2", "skip"), "inserted": ("block_number % 5 > 0 and block_number % 3 = 1", "fail")}
    done = [store.insert_strict(t.where(rows).withColumn("batch", F.lit(name)), path, TRACE_KEY, how) for name, (rows, how) in batches.items()]
    if done != ["inserted", "fallback", "skipped", "inserted"]:
        raise AssertionError(done)
    return spark.read.parquet(path).select("batch", "block_number", "tx_index", "trace_address")


@query(f"""SELECT 'raw_events' AS what, count(*) AS rows, CAST(sum(block_number) AS BIGINT) AS total FROM fx_raw_events WHERE block_number NOT BETWEEN 10000900 AND 10001000
UNION ALL SELECT 'transfers', count(*), CAST(sum(block_number) AS BIGINT) FROM fx_raw_events WHERE topic0 = '{TRANSFER}' AND block_number NOT BETWEEN 10000900 AND 10001000
UNION ALL SELECT 'traces', count(*), CAST(sum(block_number) AS BIGINT) FROM fx_traces WHERE block_number NOT BETWEEN 10000900 AND 10001000
UNION ALL SELECT 'accounts', count(*), CAST(sum(block_number) AS BIGINT) FROM ({_TX_EVENTS}) WHERE block_number NOT BETWEEN 10000900 AND 10001000""")
def delete_everywhere(spark, sf):
    folder = new_folder(spark, "deployment")
    made = {"raw_events": lens(spark, sf, "fx_raw_events"), "transfers": _transfers(spark, sf), "traces": lens(spark, sf, "fx_traces"), "accounts": accounts.account_tx_events(lens(spark, sf, "fx_transactions"), lens(spark, sf, "fx_tracked"))}
    for name, df in made.items():
        store.append(df, f"{folder}/{name}")
    left = store.delete_everywhere(spark, {n: f"{folder}/{n}" for n in [*made, "never_made"]}, 1, 10_000_900, 10_001_000)
    parts = [spark.read.parquet(f"{folder}/{n}").agg(F.lit(n).alias("what"), F.count("*").alias("rows"), F.sum("block_number").alias("total")) for n in left]
    return reduce(DataFrame.unionByName, parts)


@query("SELECT block_number, log_index FROM fx_raw_events")
def compact_in_place(spark, sf):
    stored = new_folder(spark, "stored")
    store.append(lens(spark, sf, "fx_raw_events"), stored)
    store.compact(spark, stored, 10_100_000)
    return spark.read.parquet(stored).select("block_number", "log_index")


@query("""SELECT 'raw' AS what, count(*) AS rows, CAST(sum(block_number) AS BIGINT) AS total FROM fx_raw_events WHERE block_number NOT BETWEEN 10000900 AND 10000950
UNION ALL SELECT 'traces', count(*), CAST(sum(block_number) AS BIGINT) FROM fx_traces WHERE block_number NOT BETWEEN 10000900 AND 10000950
UNION ALL SELECT 'replayed', count(*), CAST(sum(block_number) AS BIGINT) FROM fx_raw_events WHERE block_number BETWEEN 10000990 AND 10001000
UNION ALL SELECT 'restored', count(*), CAST(sum(block_number) AS BIGINT) FROM fx_raw_events""")
def snapshot_states(spark, sf):
    """Two tables are deleted from, repaired and compacted, each step in one commit; then the first state is published again."""
    state = Snapshots(spark, new_folder(spark, "states"))
    raw, traces = lens(spark, sf, "fx_raw_events"), lens(spark, sf, "fx_traces")
    state.append({"raw": raw.withColumn("origin", F.lit("first")), "traces": traces})
    state.delete_range(1, 10_000_900, 10_000_950)
    state.rewrite_reorg(1, 10_000_989, 10_001_000, {"raw": raw.withColumn("origin", F.lit("replayed")), "traces": traces})
    state.compact(10_100_000)
    of = lambda what, df: df.agg(F.lit(what).alias("what"), F.count("*").alias("rows"), F.sum("block_number").alias("total"))
    now = [of("raw", state.read("raw")), of("traces", state.read("traces")), of("replayed", state.read("raw").where("origin = 'replayed'"))]
    state.restore(1)
    return reduce(DataFrame.unionByName, [*now, of("restored", state.read("raw"))])


@query(f"SELECT 'old' AS deployment, count(*) AS rows FROM fx_raw_events WHERE topic0 = '{TRANSFER}' UNION ALL SELECT 'new', count(*) FROM fx_raw_events WHERE topic0 = '{SWAP}'")
def cutover(spark, sf):
    """One reader's view, before and after it is pointed to another deployment."""
    out = []
    for name, topic in (("old", TRANSFER), ("new", SWAP)):
        table = f"deployment_{name}_{uuid.uuid4().hex}"
        lens(spark, sf, "fx_raw_events").where(F.col("topic0") == topic).write.option("path", new_folder(spark, "deployment")).saveAsTable(table)
        views.cutover(spark, "chainlake_readers", {"events": table})
        out.append(spark.table("chainlake_readers.events").agg(F.count("*").alias("rows")).select(F.lit(name).alias("deployment"), "rows").first())
    return spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(r.deployment).alias("deployment"), F.lit(r.rows).cast("bigint").alias("rows")) for r in out])).alias("r")).select("r.*")


@query("SELECT block_number, log_index FROM fx_raw_events WHERE block_number NOT BETWEEN 10000900 AND 10001000")
def delete_range(spark, sf):
    return store.without_range(lens(spark, sf, "fx_raw_events"), 1, 10_000_900, 10_001_000).select("block_number", "log_index")


@query(f"SELECT block_number, count(*) AS events, CAST(sum(cents) AS BIGINT) AS cents FROM ({_PURCHASE}) WHERE event_type = 'purchase' GROUP BY ALL")
def webhook_payloads(spark, sf):
    long = decode.decode_events_first(lens(spark, sf, "fx_raw_events"), EVENTS)
    bodies = sinks.webhook_payloads(long, ["Transfer"])
    items = F.from_json("body", "array<struct<event:string,log_index:int,params:map<string,string>>>")
    return bodies.select("block_number", F.explode(items).alias("x")).groupBy("block_number").agg(F.count("*").alias("events"), F.sum(F.col("x.params")["value"].cast("bigint")).alias("cents"))


@query(f"""SELECT 'events:1' AS key, count(*) AS messages FROM (SELECT child_address FROM ({_CHILDREN})) UNION ALL SELECT 'control:1', 1 UNION ALL SELECT 'events:1', (SELECT count(*) FROM fx_blocks)""")
def stream_messages(spark, sf):
    ancestor = reorg.common_ancestor(lens(spark, sf, "fx_stored_blocks"), lens(spark, sf, "fx_blocks"))
    children = sinks.stream_messages(children=factory.discover_children(lens(spark, sf, "fx_factory_logs"), FACTORIES)).groupBy("key").agg(F.count("value").alias("messages"))
    rest = sinks.stream_messages(live=lens(spark, sf, "fx_blocks"), reorgs=ancestor).groupBy("key").agg(F.count("value").alias("messages"))
    return children.unionByName(rest)


@query(f"""SELECT 'events:1' AS key, 'live_block' AS type, CAST(block_number AS VARCHAR) AS value FROM fx_blocks UNION ALL SELECT 'events:1', 'factory_child', child_address FROM ({_CHILDREN})
UNION ALL SELECT 'control:1', 'reorg', CAST(max(block_number) - 7 AS VARCHAR) FROM fx_blocks UNION ALL SELECT 'events:1', 'event_batch', CAST(count(*) AS VARCHAR) FROM fx_raw_events WHERE topic0 = '{TRANSFER}' GROUP BY block_number
UNION ALL SELECT 'control:' || chain_id, 'sync_status', CASE WHEN bool_or(status = 'live') THEN 'live' ELSE 'historical' END FROM fx_workers GROUP BY chain_id""")
def stream_message_bodies(spark, sf):
    """All five kinds, read back from their bodies."""
    batches = _transfers(spark, sf).groupBy("chain_id", "block_number").agg(F.count("*").alias("events"))
    out = sinks.stream_messages(batches, lens(spark, sf, "fx_blocks"), reorg.common_ancestor(lens(spark, sf, "fx_stored_blocks"), lens(spark, sf, "fx_blocks")), progress.sync_status(lens(spark, sf, "fx_workers"), lens(spark, sf, "fx_blocks")), factory.discover_children(lens(spark, sf, "fx_factory_logs"), FACTORIES))
    body = F.from_json("value", "type string, block_number string, child_address string, ancestor string, events string, mode string")
    return out.select("key", body.alias("b")).select("key", "b.type", F.coalesce("b.mode", "b.ancestor", "b.child_address", "b.events", "b.block_number").alias("value"))


@query(f"SELECT block_number, log_index, a AS p_from, CAST(cents AS VARCHAR) AS p_value FROM ({_PURCHASE}) WHERE event_type = 'purchase'")
def export_csv(spark, sf):
    folder = new_folder(spark, "csv")
    sinks.export_csv({"transfers": _transfers(spark, sf).select("block_number", "log_index", "p_from", "p_value")}, folder)
    return spark.read.schema("block_number long, log_index int, p_from string, p_value string").option("header", True).csv(f"{folder}/transfers")


@query("SELECT block_number, log_index FROM fx_raw_events WHERE block_number < 10100000")
def compact(spark, sf):
    """Stored, then the closed buckets written anew."""
    stored, clustered = new_folder(spark, "stored"), new_folder(spark, "compacted")
    store.insert_new(lens(spark, sf, "fx_raw_events"), stored, ["chain_id", "block_number", "tx_index", "log_index"])
    store.compact(spark, stored, 10_100_000, clustered)
    return spark.read.parquet(clustered).select("block_number", "log_index")


@query("SELECT block_number, log_index FROM fx_raw_events WHERE block_number NOT BETWEEN 10000900 AND 10001000")
def delete_range_stored(spark, sf):
    """The same deletion as delete_range, on a stored table."""
    stored = new_folder(spark, "stored")
    store.insert_new(lens(spark, sf, "fx_raw_events"), stored, ["chain_id", "block_number", "tx_index", "log_index"])
    store.delete_range(spark, stored, 1, 10_000_900, 10_001_000)
    return spark.read.parquet(stored).select("block_number", "log_index")


@query("SELECT count(*) FILTER (WHERE regexp_full_match(address, '0x[0-9a-f]{40}')) AS addresses, count(*) FILTER (WHERE regexp_full_match(event_type, '[A-Za-z_][A-Za-z0-9_]*')) AS names FROM (SELECT r.address, e.event_type FROM fx_raw_events r JOIN events e ON e.event_id = (r.block_number - 10000835) * 10 + r.log_index)")
def valid_names(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "event_type")
    raw = lens(spark, sf, "fx_raw_events").withColumn("event_id", (F.col("block_number") - GENESIS) * 10 + F.col("log_index"))
    return raw.join(events, "event_id").agg(F.count_if(abi_words.valid_address(F.col("address"))).alias("addresses"), F.count_if(abi_words.valid_identifier(F.col("event_type"))).alias("names"))


# -- reorganisations


@query("SELECT count(*) AS suspects FROM fx_stored_blocks s JOIN fx_blocks b ON b.block_number = s.block_number + 1 WHERE b.parent_hash <> s.block_hash")
def parent_check(spark, sf):
    blocks, stored = lens(spark, sf, "fx_blocks"), lens(spark, sf, "fx_stored_blocks")
    mixed = blocks.join(stored.withColumnRenamed("block_hash", "own"), ["chain_id", "block_number"]).withColumn("block_hash", F.col("own"))
    return reorg.parent_check(mixed).agg(F.count("*").alias("suspects"))


@query("SELECT CAST(1 AS INT) AS chain_id, max(block_number) - 7 AS ancestor, max(block_number) AS tip, CAST(7 AS BIGINT) AS depth, string_agg(CASE WHEN block_number > t - 7 THEN CAST(block_number AS VARCHAR) END, ',' ORDER BY block_number) AS reorged FROM fx_blocks, (SELECT max(block_number) AS t FROM fx_blocks)")
def common_ancestor(spark, sf):
    out = reorg.common_ancestor(lens(spark, sf, "fx_stored_blocks"), lens(spark, sf, "fx_blocks"), 64)
    return out.withColumn("reorged", F.array_join("reorged", ","))


@query("SELECT CAST(1 AS INT) AS chain_id, max(block_number) - 64 AS ancestor FROM fx_blocks")
def conservative_ancestor(spark, sf):
    return reorg.conservative_ancestor(lens(spark, sf, "fx_stored_blocks"), 64)


@query("SELECT block_number, block_hash FROM fx_blocks WHERE block_number < 10000900 ORDER BY block_number DESC LIMIT 20")
def known_window(spark, sf):
    return reorg.known_window(lens(spark, sf, "fx_blocks"), 20, 10_000_900).select("block_number", "block_hash")


@query("SELECT block_number, block_hash FROM fx_blocks WHERE block_number % 3 = 0 ORDER BY block_number DESC LIMIT 20")
def known_window_with_gaps(spark, sf):
    return reorg.known_window(lens(spark, sf, "fx_blocks").where("block_number % 3 = 0"), 20).select("block_number", "block_hash")


@query("SELECT CAST(1 AS INT) AS chain_id, min(block_number) - 1 AS ancestor FROM (SELECT block_number FROM fx_blocks WHERE block_number % 3 = 0 ORDER BY block_number DESC LIMIT 20)")
def conservative_ancestor_with_gaps(spark, sf):
    return reorg.conservative_ancestor(lens(spark, sf, "fx_stored_blocks").where("block_number % 3 = 0"), 20)


@query("""SELECT coalesce(s.block_number, b.block_number) AS block_number, CASE WHEN b.block_hash IS NULL THEN 'orphan' WHEN s.block_hash IS NULL THEN 'absent' WHEN s.block_hash = b.block_hash THEN 'same' ELSE 'replaced' END AS state
FROM (SELECT * FROM fx_stored_blocks WHERE block_number % 4 > 0) s FULL JOIN (SELECT * FROM fx_blocks WHERE block_number % 6 > 0) b ON s.block_number = b.block_number""")
def chain_difference(spark, sf):
    return reorg.chain_difference(lens(spark, sf, "fx_stored_blocks").where("block_number % 4 > 0"), lens(spark, sf, "fx_blocks").where("block_number % 6 > 0")).select("block_number", "state")


@query("SELECT block_number, 65 AS finality, (SELECT max(block_number) FROM fx_blocks) - block_number >= 65 AS is_final FROM fx_blocks")
def with_finality(spark, sf):
    return reorg.with_finality(lens(spark, sf, "fx_blocks")).select("block_number", "finality", "is_final")


@query("SELECT r.block_number, r.log_index FROM fx_raw_events r JOIN fx_stored_blocks s ON s.block_number = r.block_number AND s.block_hash = r.block_hash")
def canonicalize(spark, sf):
    return reorg.canonicalize(lens(spark, sf, "fx_raw_events"), lens(spark, sf, "fx_stored_blocks")).select("block_number", "log_index")


@query("""WITH t AS (SELECT max(block_number) AS tip FROM fx_blocks) SELECT block_number, log_index, CASE WHEN block_number > tip - 7 THEN 'replayed' ELSE 'stored' END AS origin FROM fx_raw_events, t""")
def rewrite_reorg(spark, sf):
    found = reorg.common_ancestor(lens(spark, sf, "fx_stored_blocks"), lens(spark, sf, "fx_blocks"), 64).first()
    raw = lens(spark, sf, "fx_raw_events")
    out = reorg.rewritten(raw.withColumn("origin", F.lit("stored")), raw.withColumn("origin", F.lit("replayed")), 1, found.ancestor, found.tip)
    return out.select("block_number", "log_index", "origin")


@query("""WITH t AS (SELECT max(block_number) AS tip FROM fx_blocks) SELECT block_number, log_index, CASE WHEN block_number > tip - 7 THEN 'replayed' ELSE 'stored' END AS origin FROM fx_raw_events, t
UNION ALL SELECT tip - 7, 7, 'message' FROM t""")
def rewrite_reorg_stored(spark, sf):
    """The same repair of stored tables, and its message."""
    found = reorg.common_ancestor(lens(spark, sf, "fx_stored_blocks"), lens(spark, sf, "fx_blocks"), 64).first()
    raw, folder = lens(spark, sf, "fx_raw_events"), new_folder(spark, "repaired")
    store.append(raw.withColumn("origin", F.lit("stored")), f"{folder}/raw_events")
    for _ in range(2):  # a repeated repair changes nothing
        reorg.rewrite_reorg(spark, {"raw": f"{folder}/raw_events"}, 1, found.ancestor, found.tip, {"raw": raw.withColumn("origin", F.lit("replayed"))}, messages=f"{folder}/reorgs")
    message = spark.read.parquet(f"{folder}/reorgs").select("block_number", F.col("depth").cast("int").alias("log_index"), F.lit("message").alias("origin"))
    return spark.read.parquet(f"{folder}/raw_events").select("block_number", "log_index", "origin").unionByName(message)


# -- progress


@query("""WITH w AS (SELECT chain_id, max(current_block) AS current_block, bool_or(status = 'live') AS live FROM fx_workers GROUP BY ALL), s AS (SELECT chain_id, max(block_number) AS stored FROM fx_blocks GROUP BY ALL)
SELECT w.chain_id, CASE WHEN live THEN 'live' ELSE 'historical' END AS mode, current_block, greatest(current_block, coalesce(stored, 0)) AS tip, round(current_block * 100.0 / greatest(current_block, coalesce(stored, 0)), 4) AS percent,
live AND greatest(current_block, coalesce(stored, 0)) - current_block <= 1 AS synced FROM w LEFT JOIN s USING (chain_id)""")
def sync_status(spark, sf):
    return progress.sync_status(lens(spark, sf, "fx_workers"), lens(spark, sf, "fx_blocks"))


@query("SELECT false AS all_live, true AS any_live FROM fx_workers LIMIT 1")
def readiness(spark, sf):
    return progress.readiness(lens(spark, sf, "fx_workers"))


_RANGES = "SELECT chain_id, worker_id, current_block - range_start + 1 AS done, range_end - range_start + 1 AS total FROM fx_workers WHERE range_end IS NOT NULL"


@query(f"SELECT chain_id, worker_id, done, total, round(done * 100.0 / total, 4) AS percent FROM ({_RANGES} UNION ALL SELECT chain_id, NULL, CAST(sum(done) AS BIGINT), CAST(sum(total) AS BIGINT) FROM ({_RANGES}) GROUP BY chain_id)")
def range_progress(spark, sf):
    return progress.range_progress(lens(spark, sf, "fx_workers"))


@query(f"SELECT chain_id, round(done * 100.0 / total, 4) AS percent, round(done / 100.0, 4) AS blocks_per_second, CASE WHEN done >= 100 THEN CAST(floor((total - done) / (done / 100.0)) AS BIGINT) END AS eta_seconds FROM ({_RANGES})")
def throughput(spark, sf):
    one = progress.range_progress(lens(spark, sf, "fx_workers")).where("worker_id is not null").withColumn("seconds", F.lit(100))
    return progress.throughput(one)


@query("SELECT chain_id, worker_id, greatest(current_block + 1, range_start) AS from_block, range_end AS to_block FROM fx_workers WHERE status = 'historical' AND current_block < range_end")
def remaining_ranges(spark, sf):
    return progress.remaining_ranges(lens(spark, sf, "fx_workers"))


@query("""WITH s AS (SELECT CAST(i AS INT) AS slice, 10000835 + i * 142 + least(i, 6) AS first, 10000835 + (i + 1) * 142 + least(i + 1, 6) - 1 AS last FROM range(7) t(i))
SELECT s.slice, CAST(s.first AS BIGINT) AS first, CAST(s.last AS BIGINT) AS last, count(r.block_number) AS rows, count(DISTINCT r.block_number) AS blocks FROM s LEFT JOIN fx_raw_events r ON r.block_number BETWEEN s.first AND s.last GROUP BY ALL""")
def slice_coverage(spark, sf):
    return progress.slice_coverage(lens(spark, sf, "fx_raw_events"), GENESIS, GENESIS + 1000, 7)


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly sums and senders of transfers that the rules let through."""
    kept = filters.apply_filters(_transfers(spark, sf_dir), RULES, "Token", "Transfer")
    return rollup.rollup(kept, "1h", [_metrics()[0], _metrics()[4]]).orderBy("bucket", "address")


@query(f"""SELECT chain_id, address, {_bucket("1h")} AS bucket, count(*) AS event_count, count(DISTINCT tx_hash) AS tx_count, CAST(CAST(sum(c) AS HUGEINT) AS VARCHAR) AS total, count(DISTINCT topic1) AS senders
FROM (SELECT *, CAST('0x' || ltrim(substr(data, 3), '0') AS BIGINT) AS c FROM fx_raw_events WHERE topic0 = '{TRANSFER}') WHERE c >= 10000 GROUP BY ALL""")
def filtered_hourly_transfers(spark, sf):
    return entry(spark, sf).withColumn("bucket", _stamp("bucket"))

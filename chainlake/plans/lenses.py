"""Lenses: SQL that shapes the given tables into on-chain tables, the same text for Spark and DuckDB."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

FX_BLOCKS = """
SELECT DISTINCT CAST(1 AS INT) AS chain_id,
  CAST(10000835 + floor(event_id / 10) AS BIGINT) AS block_number,
  '0x' || lpad(lower(hex(CAST((10000835 + floor(event_id / 10)) * 7919 AS BIGINT))), 64, '0') AS block_hash,
  '0x' || lpad(lower(hex(CAST((10000834 + floor(event_id / 10)) * 7919 AS BIGINT))), 64, '0') AS parent_hash,
  CAST(1704240000 + 600 * floor(event_id / 10) AS BIGINT) AS block_timestamp
FROM events
"""

FX_RAW_EVENTS = """
WITH e AS (
  SELECT *, CAST(floor(event_id / 10) AS BIGINT) AS b, CAST(round(value * 100) AS BIGINT) AS cents,
    CAST(event_id % 200 - 100 AS BIGINT) AS delta, event_type || '-' || CAST(user_id AS STRING) AS memo
  FROM events)
SELECT CAST(1 AS INT) AS chain_id, 10000835 + b AS block_number,
  CAST(floor((event_id % 10) / 2) AS INT) AS tx_index, CAST(event_id % 10 AS INT) AS log_index,
  '0x' || lpad(lower(hex((10000835 + b) * 7919)), 64, '0') AS block_hash,
  1704240000 + 600 * b AS block_timestamp,
  '0x' || lpad(lower(hex(CAST(floor(event_id / 2) AS BIGINT))), 64, '0') AS tx_hash,
  '0x' || lpad(lower(hex(user_id % 40)), 40, '0') AS address,
  CASE event_type
    WHEN 'purchase' THEN '0xddf252ad1be2c89b69c2b068fc378daa952ba7f163c4a11628f55a4df523b3ef'
    WHEN 'signup' THEN '0x8c5be1e5ebec7d5bd14f71427d1e84f3dd0314c0f7b2291e5b200ac8c7c3b925'
    WHEN 'click' THEN '0xd78ad95fa46c994b6551d0da85fc275fe613ce37657fb8d5e3d130840159d822'
    WHEN 'view' THEN '0x5840d8b15e9661d2bc0aa9fab9fdea422af500dc69ae12d6c259ba40cd0054db' END AS topic0,
  CASE WHEN event_type IN ('purchase', 'signup', 'click')
    THEN '0x' || lpad(lower(hex(user_id)), 64, '0') END AS topic1,
  CASE WHEN event_type IN ('purchase', 'signup', 'click')
    THEN '0x' || lpad(lower(hex(event_id % 97)), 64, '0') END AS topic2,
  CAST(NULL AS STRING) AS topic3,
  CASE event_type
    WHEN 'purchase' THEN '0x' || lpad(lower(hex(cents)), 64, '0')
    WHEN 'signup' THEN '0x' || lpad(lower(hex(cents)) || '00000000000000000000', 64, '0')
    WHEN 'click' THEN '0x' || lpad(lower(hex(cents)), 64, '0') || lpad(lower(hex(event_id)), 64, '0')
      || lpad('0', 64, '0') || lpad(lower(hex(user_id)), 64, '0')
    WHEN 'view' THEN '0x'
      || lpad(lower(hex(delta)), 64, CASE WHEN delta < 0 THEN 'f' ELSE '0' END)
      || lpad('a0', 64, '0')
      || rpad(lpad(lower(hex(event_id % 65536)), 8, '0'), 64, '0')
      || lpad(CASE WHEN event_id % 3 = 0 THEN '1' ELSE '0' END, 64, '0')
      || lpad('e0', 64, '0')
      || lpad(lower(hex(CAST(length(memo) AS BIGINT))), 64, '0') || rpad(lower(hex(memo)), 64, '0')
      || lpad('2', 64, '0') || lpad(lower(hex(user_id)), 64, '0') || lpad(lower(hex(event_id)), 64, '0')
    ELSE '0x' END AS data
FROM e
"""

FX_FACTORY_LOGS = """
SELECT CAST(1 AS INT) AS chain_id, CAST(10000835 + (s_suppkey * 7) % 50 AS BIGINT) AS block_number,
  CAST(0 AS INT) AS tx_index, CAST(s_suppkey AS INT) AS log_index,
  '0x' || lpad(lower(hex(s_suppkey + 1000000)), 64, '0') AS tx_hash,
  '0x5c69bee701ef814a2b6a3edd4b1652cb9cc5aa6f' AS address,
  '0x0d3648bd0f6ba80134a33ba9275ac585d9d315f0ad8355cddefde31afa28d0e9' AS topic0,
  '0x' || lpad(lower(hex(CAST(s_nationkey AS BIGINT))), 64, '0') AS topic1,
  '0x' || lpad(lower(hex(s_suppkey)), 64, '0') AS topic2,
  '0x' || lpad(lower(hex(s_suppkey % 30)), 64, '0') || lpad(lower(hex(s_suppkey)), 64, '0') AS data
FROM supplier
"""

FX_TRANSACTIONS = """
SELECT CAST(1 AS INT) AS chain_id, CAST(10000835 + floor(o_orderkey / 8) AS BIGINT) AS block_number,
  CAST(o_orderkey % 8 AS INT) AS tx_index, '0x' || lpad(lower(hex(o_orderkey)), 64, '0') AS tx_hash,
  '0x' || lpad(lower(hex(o_custkey % 50)), 40, '0') AS from_address,
  CASE WHEN o_orderkey % 25 = 0 THEN NULL
    ELSE '0x' || lpad(lower(hex((o_orderkey * 31) % 50)), 40, '0') END AS to_address,
  CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS STRING) AS value, '0x' AS input
FROM orders
"""

FX_TRACES = """
SELECT CAST(1 AS INT) AS chain_id, CAST(10000835 + floor(l_orderkey / 8) AS BIGINT) AS block_number,
  CAST(l_orderkey % 8 AS INT) AS tx_index,
  CASE WHEN l_linenumber = 1 THEN '' ELSE '0.' || CAST(l_linenumber * 5 AS STRING) END AS trace_address,
  '0x' || lpad(lower(hex(l_orderkey)), 64, '0') AS tx_hash, 'call' AS call_type,
  '0x' || lpad(lower(hex(l_suppkey % 50)), 40, '0') AS from_address,
  '0x' || lpad(lower(hex(l_partkey % 50)), 40, '0') AS to_address,
  CASE WHEN l_returnflag = 'N' THEN '0x'
    ELSE '0xa9059cbb' || lpad(lower(hex(l_suppkey)), 64, '0')
      || lpad(lower(hex(CAST(round(l_extendedprice * 100) AS BIGINT))), 64, '0') END AS input,
  CASE WHEN l_discount = 0 THEN '0'
    ELSE CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS STRING) END AS value,
  l_partkey, l_suppkey, l_extendedprice, l_discount, l_tax, l_quantity, l_returnflag, l_shipdate
FROM lineitem
"""

FX_STORED_BLOCKS = """
SELECT b.chain_id, b.block_number,
  CASE WHEN b.block_number > m.tip - 7 THEN '0xdead' || substr(b.block_hash, 7) ELSE b.block_hash END AS block_hash
FROM fx_blocks b CROSS JOIN (SELECT max(block_number) AS tip FROM fx_blocks) m
"""

FX_WORKERS = """
SELECT CAST(n_regionkey + 1 AS INT) AS chain_id, CAST(n_nationkey AS INT) AS worker_id,
  CAST(n_nationkey * 1000 AS BIGINT) AS range_start,
  CASE WHEN n_regionkey = 0 THEN NULL ELSE CAST(n_nationkey * 1000 + 999 AS BIGINT) END AS range_end,
  CAST(n_nationkey * 1000 + CASE WHEN n_nationkey % 4 = 0 THEN 999 ELSE (n_nationkey * 37) % 1000 END AS BIGINT) AS current_block,
  CASE WHEN n_regionkey = 0 THEN 'live' ELSE 'historical' END AS status
FROM nation
"""

FX_TRACKED = """
SELECT '0x' || lpad(lower(hex(c_custkey)), 40, '0') AS address, k.kind
FROM customer CROSS JOIN (SELECT 'transaction:from' AS kind UNION ALL SELECT 'transaction:to'
  UNION ALL SELECT 'transfer:from' UNION ALL SELECT 'transfer:to') k
WHERE c_custkey < 20 AND (c_custkey % 3 <> 0 OR k.kind LIKE 'transaction%')
"""

LENSES = {
    "fx_blocks": FX_BLOCKS,
    "fx_raw_events": FX_RAW_EVENTS,
    "fx_factory_logs": FX_FACTORY_LOGS,
    "fx_transactions": FX_TRANSACTIONS,
    "fx_traces": FX_TRACES,
    "fx_stored_blocks": FX_STORED_BLOCKS,
    "fx_workers": FX_WORKERS,
    "fx_tracked": FX_TRACKED,
}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def _names(sql: str, among) -> list[str]:
    return [n for n in among if re.search(rf"\b{n}\b", sql)]


def _table(spark: SparkSession, path: str) -> DataFrame:
    """The table; one that is a single small file is dealt out, so that its rows are decoded in parallel."""
    df, cores = spark.read.parquet(path), spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def lens(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The lens as a DataFrame over the Parquet tables of `sf_dir`."""
    sql = LENSES[name]
    inputs = {t: _table(spark, f"{sf_dir}/{t}.parquet") for t in _names(sql, TABLES)}
    inputs |= {n: lens(spark, sf_dir, n) for n in _names(sql, LENSES)}
    for n in inputs:
        sql = re.sub(rf"\b(FROM|JOIN) {n}\b", rf"\1 {{{n}}}", sql)
    return spark.sql(sql, **inputs)


def with_lenses(sql: str) -> str:
    """DuckDB SQL with the lenses that it names as common table expressions."""
    needed: list[str] = []

    def need(text: str) -> None:
        for n in _names(text, LENSES):
            if n not in needed:
                need(LENSES[n])
                needed.append(n)

    need(sql)
    heads = [f"{n} AS ({LENSES[n]})" for n in needed]
    if not heads:
        return sql
    body = sql.strip()
    return "WITH " + ", ".join(heads) + (", " + body[5:] if body[:5].upper() == "WITH " else " " + body)

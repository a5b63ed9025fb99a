"""Decoding of logs, calls and return data against registries of contract ABIs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chainlake.functions import abi_words as abi
from chainlake.operators.filters import Rule, condition
from chainlake.sources.abi import Definition, find, registry_frame

BASE = ("chain_id", "block_number", "tx_index", "log_index", "block_hash", "block_timestamp", "tx_hash", "address")
TOPICS = ("topic0", "topic1", "topic2", "topic3")


def _topics() -> list[Column]:
    return [F.col(t) for t in TOPICS]


def event_table(raw: DataFrame, registry: list[Definition], contract: str, event: str) -> DataFrame:
    """One event as a typed table: base columns and p_<param> columns. A static plan, no shuffle."""
    d = find(registry, contract, event)
    own = raw.where(F.col("topic0") == d.key).withColumn("_body", abi.strip(F.col("data")))
    return own.select(*[c for c in BASE if c in raw.columns], *abi.values(d, F.col("_body"), _topics()))


def _params(definitions: list[Definition], key: str, body: Column, topics: list[Column]) -> Column:
    """A map from parameter name to text, by the row's key."""
    out = F.lit(None).cast("map<string,string>")
    for d in {d.key: d for d in definitions}.values():
        entries = [x for p in d.params for x in (F.lit(abi.snake_name(p)), abi.value(p, body, topics).cast("string"))]
        out = F.when(F.col(key) == d.key, F.create_map(*entries) if entries else F.create_map().cast("map<string,string>")).otherwise(out)
    return out


def _long(rows: DataFrame, registry: list[Definition], owners: DataFrame, key: str, body: Column, topics: list[Column], base: list[str]) -> DataFrame:
    # the parameters depend on the key alone: decoded once a row, before it is repeated for every owner
    known = rows.where(F.col(key).isin(sorted({d.key for d in registry}))).withColumn("_body", body)
    known = known.withColumn("_params", _params(registry, key, F.col("_body"), topics))
    owned = known.join(F.broadcast(owners.withColumnRenamed("key", key)), key)  # a row for each definition in the ABIs
    return owned.select("table_name", "contract", "name", *base, F.col("_params").alias("params"))


def decode_events(raw: DataFrame, registry: list[Definition]) -> DataFrame:
    """(table_name, contract, name, base columns, params) for every contract that has the event."""
    owners = registry_frame(raw.sparkSession, registry).drop("signature", "ordinal")
    return _long(raw, registry, owners, "topic0", abi.strip(F.col("data")), _topics(), [c for c in BASE if c in raw.columns])


def decode_events_first(raw: DataFrame, registry: list[Definition], contract: str | None = None) -> DataFrame:
    """As decode_events, for one owner of a key: `contract` if it has it, else the first in the registry."""
    order = Window.partitionBy("key").orderBy((F.col("contract") == F.lit(contract)).desc() if contract else F.lit(0), "ordinal")
    owners = registry_frame(raw.sparkSession, registry).withColumn("n", F.row_number().over(order)).where("n = 1").drop("n", "signature", "ordinal")
    return _long(raw, registry, owners, "topic0", abi.strip(F.col("data")), _topics(), [c for c in BASE if c in raw.columns])


def call_table(traces: DataFrame, registry: list[Definition], contract: str, function: str) -> DataFrame:
    """Calls of one function as a typed table: the trace's columns without input, and its inputs."""
    d = find(registry, contract, function)
    own = traces.where(F.lower(F.substring("input", 1, 10)) == d.key).withColumn("_body", F.substring(F.lower("input"), 11, 1 << 30))
    return own.select(*[c for c in traces.columns if c != "input"], *abi.values(d, F.col("_body"), []))


def decode_calls(traces: DataFrame, registry: list[Definition]) -> DataFrame:
    """(table_name, contract, name, the trace's columns, params) for every contract that has the function."""
    owners = registry_frame(traces.sparkSession, registry).drop("signature", "ordinal")
    rows = traces.withColumn("selector", F.lower(F.substring("input", 1, 10)))
    return _long(rows, registry, owners, "selector", F.substring(F.lower("input"), 11, 1 << 30), [], traces.columns)


def label_function_names(traces: DataFrame, registry: list[Definition]) -> DataFrame:
    """Adds function_name of the first owner of the call's selector, null for others."""
    first = Window.partitionBy("selector").orderBy("ordinal")
    names = registry_frame(traces.sparkSession, registry).select(F.col("key").alias("selector"), F.col("name").alias("function_name"), "ordinal")
    names = names.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n", "ordinal")
    return traces.drop("function_name").withColumn("selector", F.lower(F.substring("input", 1, 10))).join(F.broadcast(names), "selector", "left").drop("selector")


def decode_outputs(traces: DataFrame, registry: list[Definition], contract: str, function: str) -> DataFrame:
    """The trace's columns and the function's return values, from `output`."""
    d = find(registry, contract, function)
    own = traces.where(F.lower(F.substring("input", 1, 10)) == d.key).withColumn("_body", abi.strip(F.col("output")))
    return own.select(*[c for c in traces.columns if c != "output"], *abi.values(d, F.col("_body"), [], d.outputs))


def route(decoded: DataFrame) -> dict[str, DataFrame]:
    """A frame for each table of a decoded long form; write with partitionBy('table_name') to route in one pass."""
    names = [r.table_name for r in decoded.select("table_name").distinct().collect()]  # as many as definitions
    return {n: decoded.where(F.col("table_name") == n).drop("table_name") for n in sorted(names)}


def rebuild(raw: DataFrame, registry: list[Definition], rules: list[Rule]) -> dict[str, DataFrame]:
    """Every event's typed table from raw logs, filtered by its rules; to overwrite the stored tables with."""
    out = {}
    for d in registry:
        table = event_table(raw, registry, d.contract, d.name)
        out[d.table] = table.where(condition(rules, d.contract, d.name, table.columns))
    return out


def should_rebuild(raw: DataFrame, decoded: DataFrame) -> bool:
    """Whether there are raw logs but no decoded rows."""
    return decoded.limit(1).count() == 0 and raw.limit(1).count() > 0


def rebuild_needed(raw: DataFrame, registry: list[Definition], rows_of: DataFrame) -> DataFrame:
    """(table_name, raw_rows, decoded_rows, needed) for every definition: needed where logs of its topic0 are there and decoded rows aren't.

    rows_of: (table_name, decoded_rows) of the stored tables; a table it doesn't name has none. Logs are counted by topic0 first,
    so that a row for each definition is all that is joined.
    """
    owners = registry_frame(raw.sparkSession, registry).select("key", "table_name")
    seen = raw.where(F.col("topic0").isin(sorted({d.key for d in registry}))).groupBy(F.col("topic0").alias("key")).agg(F.count("*").alias("raw_rows"))
    both = owners.join(seen, "key", "left").join(rows_of.groupBy("table_name").agg(F.sum("decoded_rows").alias("decoded_rows")), "table_name", "left")
    both = both.select("table_name", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("raw_rows", "decoded_rows")])
    return both.withColumn("needed", (F.col("raw_rows") > 0) & (F.col("decoded_rows") == 0))

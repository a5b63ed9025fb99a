import __spark_entry__ as contract
from pyspark.sql import functions as F

from chainlake.plans import catalog, streams
from chainlake.plans.lenses import lens

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_streams_equal_batches(spark):
    raw = lens(spark, SF, "fx_raw_events").where("topic0 is not null")
    assert rows(streams.stream_dedup(spark, SF)) == rows(raw.select("block_number", "log_index"))
    assert rows(streams.live_ingest(spark, SF)) == rows(catalog.apply_filters_integers(spark, SF))
    children = catalog._children(spark, SF)
    from chainlake.operators.factory import child_events, child_signatures
    from chainlake.plans.contracts import EVENTS, FACTORIES

    own = child_events(lens(spark, SF, "fx_raw_events"), children, child_signatures(EVENTS, FACTORIES))
    assert rows(streams.stream_children(spark, SF)) == rows(own.select("block_number", "log_index"))
    rolled = {(r.address, r.bucket): r.event_count for r in catalog.queries()["rollup_1d"](spark, SF).collect()}
    streamed = streams.stream_rollup(spark, SF).collect()
    assert streamed or len({b for _, b in rolled}) == 1
    assert all(rolled[r.address, r.bucket] == r.event_count for r in streamed)


def test_reorg_is_found_once(spark):
    tip = lens(spark, SF, "fx_blocks").agg(F.max("block_number")).first()[0]
    assert rows(streams.detect_reorgs(spark, SF)) == [(tip - 6,)]


def test_contract(spark):
    found, sql = contract.queries(), contract.oracle_sql()
    assert set(sql) <= set(found) and len(found) >= 91
    assert catalog.entry(spark, SF).count() > 0

"""Headline queries, each run to a no-op sink; prints one JSON line."""

from __future__ import annotations

import json
import os
import tempfile
import time

from chainlake.operators import accounts, decode, factory, reorg, rollup, store
from chainlake.plans import catalog
from chainlake.plans.contracts import EVENTS, FACTORIES
from chainlake.plans.lenses import lens
from chainlake.session import session

QUERIES = {
    "decode_events": lambda s, d: decode.decode_events(lens(s, d, "fx_raw_events"), EVENTS),
    "filtered_hourly_transfers": catalog.entry,
    "rollup_1h": lambda s, d: rollup.rollup(lens(s, d, "fx_raw_events").where("topic0 is not null"), "1h"),
    "rollup_wide_values": catalog.queries()["rollup_wide_values"],
    "insert_traces": lambda s, d: store.new_rows(t := lens(s, d, "fx_traces"), t.where("block_number % 5 = 0"), catalog.TRACE_KEY),
    "account_transfer_events": lambda s, d: accounts.account_transfer_events(lens(s, d, "fx_traces"), lens(s, d, "fx_tracked")),
    "child_events": lambda s, d: factory.child_events(lens(s, d, "fx_raw_events"), factory.dedup_children(factory.discover_children(lens(s, d, "fx_factory_logs"), FACTORIES)), factory.child_signatures(EVENTS, FACTORIES)),
    "snapshot_every": catalog.queries()["snapshot_every"],
    "reorg_rewrite": catalog.queries()["rewrite_reorg"],
    "common_ancestor": lambda s, d: reorg.common_ancestor(lens(s, d, "fx_stored_blocks"), lens(s, d, "fx_blocks"), 64),
}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    scratch = tempfile.mkdtemp(prefix="spark-")
    spark = session(
        f"local[{cpus}]", "bench",
        **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g", "spark.checkpoint.dir": f"{scratch}/shared", "spark.local.dir": f"{scratch}/local"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name, run in QUERIES.items():
        run(spark, sf_dir).write.format("noop").mode("overwrite").save()  # code is compiled, files are cached
        began = time.perf_counter()
        run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()

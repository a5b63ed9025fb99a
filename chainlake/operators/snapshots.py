"""Tables of one deployment whose states are published together.

Files are never changed: a commit writes new ones beside the old and then publishes, by one rename, a
list of the partitions' folders that make up every table. Readers follow the newest list, so they see
all tables before a repair or all after it, and an attempt that fails leaves what was there. Lists have a
line for each partition and table (chain and 100,000 blocks), which the driver holds.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from chainlake.operators import reorg
from chainlake.operators.shaping import BUCKET
from chainlake.operators.store import LAYOUT, with_bucket, without_range

Part = tuple[int, int]


class Snapshots:
    """The states of the tables under `folder`."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, *names: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.folder, *names]))

    def _fs(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, path) -> list[str]:
        return [f.getPath().getName() for f in self._fs().listStatus(path)] if self._fs().exists(path) else []

    def versions(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self._names(self._path("_states")) if n.endswith(".json"))

    def state(self, version: int | None = None) -> dict:
        """{table: {"schema": ..., "parts": [[chain_id, block_bucket, commit], ...]}} of a version, by default the newest."""
        found = self.versions()
        if not found:
            return {}
        path = self._path("_states", f"{version if version is not None else found[-1]:012d}.json").toString()
        return json.loads("\n".join(r.value for r in self.spark.read.text(path).collect()))

    def read(self, table: str, parts: set[Part] | None = None, version: int | None = None) -> DataFrame:
        """A table's rows, chain_id and block_bucket included; `parts` names the partitions that are wanted."""
        known = self.state(version)[table]
        schema = StructType.fromJson(known["schema"])
        folders = [f"{self.folder}/{table}/commit={c}/chain_id={k}/block_bucket={b}" for k, b, c in known["parts"] if parts is None or (k, b) in parts]
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.folder}/{table}").parquet(*folders).select(*schema.names)

    def _written(self, table: str, rows: DataFrame, commit: str) -> list[list]:
        with_bucket(rows).write.partitionBy(*LAYOUT).parquet(f"{self.folder}/{table}/commit={commit}")
        base = self._path(table, f"commit={commit}")
        parts = []
        for chain in self._names(base):
            if "=" in chain:
                parts += [[int(chain.split("=")[1]), int(b.split("=")[1]), commit] for b in self._names(self._path(table, f"commit={commit}", chain))]
        return parts

    def _publish(self, state: dict, version: int) -> None:
        """The one step that readers see. Two writers can't publish the same version."""
        aside = self._path("_states", f"_{uuid.uuid4().hex}")
        out = self._fs().create(aside)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(aside.toUri() if aside.toUri().getScheme() else self._fs().getUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark._sc._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        context.rename(self._fs().makeQualified(aside), self._fs().makeQualified(self._path("_states", f"{version:012d}.json")), options)

    def commit(self, changes: dict[str, tuple[set[Part], DataFrame | None]]) -> int:
        """Replace, in each table, the given partitions by the given rows (which may lie anywhere), all at once. Returns the new version.

        Rows may be derived from the tables themselves. Raises if another writer has published meanwhile.
        """
        version = (self.versions() or [0])[-1]
        state, commit = self.state(), uuid.uuid4().hex
        for table, (gone, rows) in changes.items():
            known = state.get(table, {"schema": None, "parts": []})
            parts = [p for p in known["parts"] if (p[0], p[1]) not in gone]
            if rows is not None:
                parts += self._written(table, rows.drop("block_bucket"), commit)
                if known["schema"] is None:
                    known["schema"] = with_bucket(rows.drop("block_bucket")).schema.jsonValue()
            state[table] = {"schema": known["schema"], "parts": parts}
        self._publish(state, version + 1)
        return version + 1

    def append(self, rows: dict[str, DataFrame]) -> int:
        return self.commit({t: (set(), df) for t, df in rows.items()})

    def _parts(self, state: dict, table: str, chain_id: int, low: int, high: int) -> set[Part]:
        return {(k, b) for k, b, _ in state[table]["parts"] if k == chain_id and low // BUCKET <= b <= high // BUCKET}

    def delete_range(self, chain_id: int, low: int, high: int) -> int:
        """Remove an inclusive block range of a chain from all tables."""
        state, changes = self.state(), {}
        for table in state:
            if hit := self._parts(state, table, chain_id, low, high):
                changes[table] = (hit, without_range(self.read(table, hit), chain_id, low, high))
        return self.commit(changes)

    def rewrite_reorg(self, chain_id: int, ancestor: int, tip: int, replay: dict[str, DataFrame] | None = None, message: str = "reorgs") -> int:
        """Replace (ancestor, tip] of a chain in all tables by the replayed rows of that range, and note it in the table `message`."""
        state, changes = self.state(), {}
        inside = (F.col("chain_id") == chain_id) & F.col("block_number").between(ancestor + 1, tip)
        for table in {*state, *(replay or {})} - {message}:
            hit = self._parts(state, table, chain_id, ancestor + 1, tip) if table in state else set()
            kept = without_range(self.read(table, hit), chain_id, ancestor + 1, tip).drop("block_bucket") if hit else None
            new = replay[table].where(inside) if replay and table in replay else None
            rows = kept if new is None else new if kept is None else kept.unionByName(new)
            if rows is not None:
                changes[table] = (hit, rows)
        below = tip - ancestor > reorg.FINALITY.get(chain_id, reorg.DEFAULT_FINALITY)
        changes[message] = (set(), self.spark.createDataFrame([(chain_id, ancestor, tip, tip - ancestor, below)], "chain_id int, block_number long, tip long, depth long, below_finality boolean"))
        return self.commit(changes)

    def compact(self, older_than: int) -> int:
        """Put the files of each partition below `older_than` together, in all tables, clustered by address where there is one."""
        changes = {}
        for table, known in self.state().items():
            hit = {(k, b) for k, b, _ in known["parts"] if b < older_than // BUCKET}
            if hit:
                rows = self.read(table, hit)
                order = [c for c in ("address", "from_address") if c in rows.columns][:1]
                changes[table] = (hit, rows.repartitionByRange(*LAYOUT, *order, "block_number").sortWithinPartitions(*LAYOUT, *order, F.desc("block_number")))
        return self.commit(changes)

    def restore(self, version: int) -> int:
        """Publish an earlier state again, as the newest: a cut-over back, or forth."""
        newest = self.versions()[-1]
        self._publish(self.state(version), newest + 1)
        return newest + 1

    def vacuum(self, keep: int = 2) -> int:
        """Delete what none of the newest `keep` states needs, states included; returns how many commits' folders went."""
        versions, gone = self.versions(), 0
        needed = {(t, p[2]) for v in versions[-keep:] for t, known in self.state(v).items() for p in known["parts"]}
        for v in versions[:-keep]:
            self._fs().delete(self._path("_states", f"{v:012d}.json"), False)
        for table in [n for n in self._names(self._path()) if not n.startswith("_")]:
            for name in self._names(self._path(table)):
                if (table, name.removeprefix("commit=")) not in needed:
                    self._fs().delete(self._path(table, name), True)
                    gone += 1
        return gone

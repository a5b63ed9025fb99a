"""A stream writer for (key, value) messages, each of which is delivered once, and counters of a live stream."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, WriterCommitMessage
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

MESSAGE = "key string, value string, position long"


@dataclass
class Staged(WriterCommitMessage):
    """A task's file, and how many messages it holds."""

    file: str
    messages: int


class MessageWriter(DataSourceStreamWriter):
    """Tasks stage files; a batch's commit publishes the list of its files by one rename. A batch that is replayed after it was published is dropped."""

    def __init__(self, folder: str):
        self.folder = folder

    def _open(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.folder) if "://" in self.folder or self.folder.startswith("file:") else (fs.LocalFileSystem(), self.folder)

    def write(self, iterator: Iterator[Row]) -> Staged:
        files, base = self._open()
        name, n = f"{base}/_staged/{uuid.uuid4().hex}.json", 0
        files.create_dir(f"{base}/_staged")
        with files.open_output_stream(name) as out:
            for row in sorted(iterator, key=lambda r: (r.key, r.position)):  # a task's share of a batch: the source's rate bounds it
                out.write(json.dumps(row.asDict()).encode() + b"\n")
                n += 1
        return Staged(name.rpartition("/")[2], n)

    def commit(self, messages: list[Staged | None], batchId: int) -> None:  # noqa: N803
        files, base = self._open()
        listed, aside = f"{base}/_batches/{batchId:012d}.json", f"{base}/_batches/_{uuid.uuid4().hex}"
        files.create_dir(f"{base}/_batches")
        if files.get_file_info(listed).type != fs.FileType.NotFound:
            self.abort(messages, batchId)
            return
        with files.open_output_stream(aside) as out:
            out.write(json.dumps([m.file for m in messages if m and m.messages]).encode())
        files.move(aside, listed)

    def abort(self, messages: list[Staged | None], batchId: int) -> None:  # noqa: N803
        files, base = self._open()
        for m in messages:
            if m:
                files.delete_file(f"{base}/_staged/{m.file}")


class MessageSink(DataSource):
    """`messages`: option path is the folder, in a store that all executors share."""

    @classmethod
    def name(cls) -> str:
        return "messages"

    def streamWriter(self, schema: StructType, overwrite: bool) -> MessageWriter:  # noqa: N802
        return MessageWriter(self.options["path"])


def publish(messages: DataFrame, folder: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Write a stream of (key, value, position) messages to `folder`; a key's messages of a batch are in one file, by position."""
    messages.sparkSession.dataSource.register(MessageSink)
    ordered = messages.selectExpr("key", "value", "cast(position as long) as position").repartition("key")
    return ordered.writeStream.format("messages").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(**(trigger or {"availableNow": True})).start()


def delivered(spark: SparkSession, folder: str) -> DataFrame:
    """(key, value, position) of all published batches; staged files of others aren't read."""
    files, base = MessageWriter(folder)._open()
    listed = files.get_file_info(fs.FileSelector(f"{base}/_batches", allow_not_found=True))
    names = [n for x in listed if not x.base_name.startswith("_") for n in json.loads(files.open_input_stream(x.path).read())]
    return spark.read.schema(MESSAGE).json([f"{folder}/_staged/{n}" for n in names]) if names else spark.createDataFrame([], MESSAGE)


COUNTERS = ("blocks", "events", "rejected", "reorgs")


def counters(spark: SparkSession, folder: str) -> DataFrame:
    """(chain_id, metric, value) of a live_sync: its counters added up over the batches, and the gauge `tip`. A replayed batch counts once."""
    rows = spark.read.parquet(f"{folder}/counters")
    value = F.when(F.col("metric") == "tip", F.max("value")).otherwise(F.sum("value"))
    return rows.groupBy("chain_id", "metric").agg(value.alias("value"))

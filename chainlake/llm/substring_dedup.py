"""Removal of repeated passages by a log-structured index of window fingerprints.

Every 13-word window of a text has a 56-bit fingerprint. A batch of documents becomes one immutable
run: a table bucketed by the fingerprint's leading bits, each bucket holding the batch's distinct
fingerprints in order, in rows of some thousands, each with the smallest document that starts it. Beside it stands the batch's
text log, bucketed by doc_id. A new run is merge-joined with each older one, bucket by bucket and
without moving either. Equal fingerprints are only candidates: the text logs give a second,
independent 64-bit hash of their words, which must be the same in all places (120 bits in all); where
it isn't, the words themselves are compared and decide. Runs are
compacted when there are many, and a manifest in the shared folder lets a later session go on. What a
task knows already (a window repeated within the texts it has read) isn't sent again, so a passage
that a third of all documents share costs one entry a task.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from functools import reduce
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chainlake.llm import shared
from chainlake.llm.words import Words, mix, runs, words

WINDOW = 13
#: Windows that a task sorts at a time.
RUN = 600_000
PRINT_BITS = 56
#: Windows whose words are put together at a time where they are compared.
COMPARED = 1 << 15
#: Batches, in ascending order of doc_id, that one call over a whole table is cut into, and the runs after which they are compacted.
BATCHES, COMPACT_AT = 3, 2
#: Characters of all texts to each group of fingerprints, about.
GROUP = 4_000_000
#: Fingerprints to a row of a run, rows that a task sends at a time, and bytes that it is sent: memory beside the heap is held in these.
PIECE, SENT, ARROW_BYTES = 1 << 14, 16, 4 << 20
#: Runs are written and read back in row groups of about this size, counted from the first few rows, which are large.
RUN_OPTIONS = {"parquet.block.size": str(8 << 20), "parquet.page.size.row.check.min": "16"}
#: kind 0: fingerprints and first documents of a run; 1: windows of docs that smaller documents start; 2: windows of docs that larger
#: ones repeat. The latter two are dealt by document: part.
RUN_SCHEMA = "bucket int, kind int, part int, prints binary, docs binary"
_RUN, _REPEAT, _OWNER = 0, 1, 2


def _prints(w: Words, window: int) -> tuple[np.ndarray, np.ndarray]:
    at, prints = w.windows(window, 1)
    return at, prints >> np.uint64(64 - PRINT_BITS)


def _planes(values: np.ndarray) -> bytes:
    """The values' bytes, lowest bytes of all first: what barely changes lies together and compresses."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes()


def _unplanes(data: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).reshape(-1).view(kind)


def _pieces(bucket: int, prints: np.ndarray, docs: np.ndarray, size: int) -> list[tuple]:
    """Rows of at most `size` fingerprints, which are in order."""
    return [(bucket, _RUN, None, _planes(np.diff(prints[k : k + size], prepend=np.uint64(0))), _planes(docs[k : k + size])) for k in range(0, len(prints), size)]


def _first_of(prints: np.ndarray, docs: np.ndarray):
    """Order by fingerprint, first place of each distinct one, and its smallest document, all in that order.

    The stable sort merges stretches that are in order already, so blocks put end to end are merged.
    """
    order = np.argsort(prints, kind="stable")
    p = prints[order]
    at = np.flatnonzero(np.r_[True, p[1:] != p[:-1]]) if len(p) else np.zeros(0, np.int64)
    return order, at, np.minimum.reduceat(docs[order], at) if len(at) else docs[:0]


def _by_part(docs: np.ndarray, prints: np.ndarray, kind: int, bucket: int | None, parts: int) -> list[tuple]:
    """A row for each part of the documents with their fingerprints. Without a bucket, rows are spread over some."""
    part = (mix(docs.view(np.uint64)) & np.uint64(parts - 1)).astype(np.int64)
    by = np.argsort(part, kind="stable")
    part, docs, prints = part[by], docs[by], prints[by]
    cut = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else np.zeros(0, np.int64)
    split = lambda x: np.split(x, cut[1:]) if len(cut) else []
    return [(int(k) if bucket is None else bucket, kind, int(k), p.tobytes(), d.tobytes()) for k, p, d in zip(part[cut], split(prints), split(docs), strict=True)]


def _merged(prints: np.ndarray, docs: np.ndarray, bucket: int | None, parts: int) -> tuple[np.ndarray, np.ndarray, list[tuple]]:
    """Distinct fingerprints in order, their smallest documents, and rows for the repeats and their owners."""
    order, at, first = _first_of(prints, docs)
    owner = np.repeat(first, np.diff(np.append(at, len(order))))
    p, d = prints[order], docs[order]
    again = d > owner
    rows = _by_part(d[again], p[again], _REPEAT, bucket, parts) + _by_part(owner[again], p[again], _OWNER, bucket, parts)
    return p[at], first, rows


def _by_doc(table: pa.Table) -> pa.Table:
    """Rows of a part to (doc_id, kind, prints), one for each document and kind."""
    out: list[tuple] = []
    kinds = np.array(table.column("kind"))
    for kind in (_REPEAT, _OWNER):
        own = table.filter(pa.array(kinds == kind))
        docs, prints = (np.frombuffer(b"".join(own.column(c).to_pylist()), t) for c, t in (("docs", np.int64), ("prints", np.uint64)))
        if len(docs):
            by = np.lexsort((prints, docs))
            docs, prints = docs[by], prints[by]
            new = np.r_[True, (docs[1:] != docs[:-1]) | (prints[1:] != prints[:-1])]
            docs, prints = docs[new], prints[new]
            cut = np.flatnonzero(np.r_[True, docs[1:] != docs[:-1]])
            out += [(int(d), kind, p.tobytes()) for d, p in zip(docs[cut], np.split(prints, cut[1:]), strict=True)]
    columns = list(zip(*out, strict=True)) or [()] * 3
    return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.binary()), strict=True)], ["doc_id", "kind", "prints"])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
    columns = list(zip(*rows, strict=True)) or [()] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["bucket", "kind", "part", "prints", "docs"])


def _to_blocks(bits: int, window: int, n_parts: int):
    """Texts to rows of RUN_SCHEMA: sorted blocks by bucket, and what repeats within the texts at hand."""

    def flush(parts: list) -> pa.RecordBatch:
        prints, docs = (np.concatenate(x) for x in zip(*parts, strict=True))
        p, first, rows = _merged(prints, docs, None, n_parts)
        edges = np.searchsorted(p, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(PRINT_BITS - bits)) if bits else []
        for k, (x, y) in enumerate(zip(np.split(p, edges), np.split(first, edges), strict=True)):
            rows += _pieces(k, x, y, PIECE)
        return _batch(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, n = [], 0
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for lo, hi, offsets, data in runs(batch.column(1)):
                w = words(offsets, data)
                at, prints = _prints(w, window)
                if len(at):
                    parts.append((prints, ids[lo:hi].astype(np.int64)[w.doc()[at]]))
                    n += len(at)
                if n > RUN:
                    full, parts, n = parts, [], 0
                    yield flush(full)
        if parts:
            yield flush(parts)
        pa.default_memory_pool().release_unused()

    return run


def _blocks(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints and documents of a bucket's pieces by their first fingerprint: in order, if they are one run's."""
    found = []
    for kind, prints, docs in zip(*(table.column(x) for x in ("kind", "prints", "docs")), strict=True):
        if kind.as_py() == _RUN:
            found.append((np.cumsum(_unplanes(prints.as_py(), np.uint64)), _unplanes(docs.as_py(), np.int64)))
    found.sort(key=lambda x: x[0][0])
    return np.concatenate([np.zeros(0, np.uint64), *(p for p, _ in found)]), np.concatenate([np.zeros(0, np.int64), *(d for _, d in found)])


def _to_run(parts: int):
    def run(table: pa.Table) -> pa.Table:
        """A bucket's pieces of one batch, or of several runs, as those of one run; rows on documents stay and are added to."""
        bucket = table.column("bucket")[0].as_py()
        kinds = np.array(table.column("kind"))
        p, first, rows = _merged(*_blocks(table), bucket, parts)
        known = table.filter(pa.array(kinds != _RUN)).select(["bucket", "kind", "part", "prints", "docs"])
        pieces = _pieces(bucket, p, first, PIECE)
        made = pa.Table.from_batches([_batch(rows), *(_batch(pieces[k : k + SENT]) for k in range(0, len(pieces), SENT))])
        return pa.concat_tables([known.cast(made.schema), made])

    return run


def _two_runs(parts: int):
    to_run = _to_run(parts)

    def run(one: pa.Table, two: pa.Table) -> pa.Table:
        return to_run(pa.concat_tables([one, two]))

    return run


def _merge_join(parts: int):
    def run(old: pa.Table, new: pa.Table) -> pa.Table:
        """Merge join of a bucket of an older run and of the new one: the new documents' repeats, and the older ones that own them."""
        (p, d), (q, e) = _blocks(old), _blocks(new)
        at = np.minimum(np.searchsorted(p, q), max(len(p) - 1, 0))
        hit = p[at] == q if len(p) else np.zeros(len(q), bool)
        return pa.Table.from_batches([_batch(_by_part(e[hit], q[hit], _REPEAT, 0, parts) + _by_part(d[at[hit]], q[hit], _OWNER, 0, parts))])

    return run


def _spaced(w: Words, n_bytes: int, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All words one space apart, and where each begins (and the next would)."""
    size = w.end - w.start
    start = np.concatenate([[0], np.cumsum(size + 1)])
    out = np.full(int(start[-1]), 32, np.uint8)
    place = np.repeat(start[:-1] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(int(size.sum()))
    source = np.repeat(w.start - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(int(size.sum()))
    out[place] = data[source]
    return out, start


def _slices(text: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.Array:
    """text[begin[i]:end[i]] of each i."""
    size = end - begin
    offsets = np.concatenate([[0], np.cumsum(size)])
    index = np.repeat(begin - offsets[:-1], size) + np.arange(int(offsets[-1]))
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(text[index])])


def _evidence(window: int, whole: bool):
    """(doc_id, text, list of fingerprints) of the windows with those fingerprints: print, and a second hash or (whole) words and doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, wanted = batch.column(0).to_numpy(zero_copy_only=False), batch.column(2)
            for lo, hi, offsets, data in runs(batch.column(1)):
                w = words(offsets, data, (1,) if whole else (1, 2))
                at, prints = _prints(w, window)
                edges = np.searchsorted(at, w.first)
                look = np.zeros(len(at), bool)
                for i in range(hi - lo):
                    here = slice(edges[i], edges[i + 1])
                    look[here] = np.isin(prints[here], np.frombuffer(b"".join(wanted[lo + i].as_py()), np.uint64))
                if not whole:
                    yield pa.RecordBatch.from_arrays([pa.array(prints[look].view(np.int64)), pa.array(w.windows(window, 2)[1][look].view(np.int64))], ["print", "other"])
                    continue
                at, prints, docs = at[look], prints[look], ids[lo:hi].astype(np.int64)[w.doc()[at[look]]]
                text, start = _spaced(w, len(data), data)
                for k in range(0, len(at), COMPARED):
                    part = slice(k, k + COMPARED)
                    yield pa.RecordBatch.from_arrays([pa.array(prints[part].view(np.int64)), _slices(text, start[at[part]], start[at[part] + window] - 1), pa.array(docs[part])], ["print", "words", "doc_id"])

    return run


def _digest(window: int):
    """(doc_id, text, fingerprints that go, but not these, windows' words that go) to (doc_id, n_words, n_removed, kept_text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, but, exact = batch.column(2), batch.column(3), batch.column(4)
            n_words, n_removed, kept = [], [], []
            for lo, hi, offsets, data in runs(batch.column(1)):
                w = words(offsets, data)
                at, prints = _prints(w, window)
                edges = np.searchsorted(at, w.first)
                for i in range(hi - lo):
                    split = data[offsets[i] : offsets[i + 1]].tobytes().split()
                    repeats, by_words = found[lo + i].as_py() or [], set(exact[lo + i].as_py() or [])
                    start, gone, left = np.zeros(0, np.int64), 0, split
                    if repeats and edges[i + 1] > edges[i]:
                        here = slice(edges[i], edges[i + 1])
                        gone_prints = np.frombuffer(b"".join(repeats), np.uint64)
                        if not_these := but[lo + i].as_py():
                            gone_prints = np.setdiff1d(gone_prints, np.array(not_these, np.int64).view(np.uint64))
                        start = at[here][np.isin(prints[here], gone_prints)] - w.first[i]
                    if by_words:
                        more = [k for k in range(len(split) - window + 1) if b" ".join(split[k : k + window]) in by_words]
                        start = np.concatenate([start, np.array(more, np.int64)])
                    if len(start):
                        cover = np.zeros(len(split) + 1, np.int64)
                        np.add.at(cover, start, 1)
                        np.add.at(cover, np.minimum(start + window, len(split)), -1)
                        stay = np.cumsum(cover)[: len(split)] == 0
                        gone = int(len(split) - stay.sum())
                        left = list(compress(split, stay))
                    n_words.append(len(split))
                    n_removed.append(gone)
                    kept.append(b" ".join(left))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept_text"])

    return run


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


class Stored:
    """A table in the shared folder, bucketed by one column."""

    def __init__(self, spark: SparkSession, path: str, schema: str, column: str, bits: int):
        self.path, self.name = path, f"chainlake_{path.rpartition('/')[2].replace('-', '_')}"
        spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name} ({schema}) USING parquet CLUSTERED BY ({column}) INTO {1 << bits} BUCKETS LOCATION '{path}'")
        self.rows = spark.table(self.name)

    @classmethod
    def write(cls, rows: DataFrame, folder: str, kind: str, schema: str, column: str, bits: int, **options: str) -> Stored:
        """Rows of a bucket should come from one task."""
        spark, path = rows.sparkSession, f"{folder}/chainlake-{kind}-{uuid.uuid4().hex}"
        name = f"chainlake_{path.rpartition('/')[2].replace('-', '_')}"
        rows.write.bucketBy(1 << bits, column).format("parquet").option("path", path).option("compression", "zstd").options(**options).saveAsTable(name)
        return cls(spark, path, schema, column, bits)

    def forget(self) -> None:
        shared.forget(self.rows)
        self.rows.sparkSession.sql(f"DROP TABLE IF EXISTS {self.name}")


TEXT_SCHEMA, HELD_SCHEMA = "doc_id long, text string", "doc_id long, kind int, prints binary"


class SubstringIndex:
    """Window fingerprints and texts of all documents seen so far, as immutable tables in a shared folder.

    Batches must come in ascending order of doc_id for `ingest` to give what one call over all
    documents gives. bits: fingerprints are dealt into 2 ** bits groups, which meet in memory, eight to
    a file; the same for the index's whole life. `bits_for` suggests it from the length of all texts, so
    that a group stays a few MB.
    """

    def __init__(self, bits: int, window: int = WINDOW, most_runs: int = 8, folder: str | None = None):
        self.bits, self.window, self.most_runs, self.folder = bits, window, most_runs, folder
        self.files = max(bits - 3, 0)
        self.parts = 1 << self.files
        self.runs: list[Stored] = []
        self.texts: list[Stored] = []
        self.clashes: list[str] = []
        self._version = 0

    @staticmethod
    def bits_for(characters: int) -> int:
        return max(3, (characters // GROUP).bit_length())

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> SubstringIndex:
        """The index whose manifest is in `folder`, as its last ingest or compaction left it."""
        last = spark.read.schema("version long, state string").json(f"{folder}/manifest").orderBy(F.desc("version")).first()
        state = json.loads(last.state)
        index = cls(state["bits"], state["window"], state["most_runs"], folder)
        index._version, index.clashes = last.version, state["clashes"]
        index._settings(spark)
        index.runs = [Stored(spark, path, RUN_SCHEMA, "bucket", index.files) for path in state["runs"]]
        index.texts = [Stored(spark, path, TEXT_SCHEMA, "doc_id", index.files) for path in state["texts"]]
        return index

    def _publish(self, spark: SparkSession) -> None:
        """Append the present state to the manifest; readers take the newest."""
        self._version += 1
        state = {"bits": self.bits, "window": self.window, "most_runs": self.most_runs, "runs": [r.path for r in self.runs], "texts": [t.path for t in self.texts], "clashes": self.clashes}
        spark.createDataFrame([(self._version, json.dumps(state))], "version long, state string").coalesce(1).write.mode("append").json(f"{self.folder}/manifest")

    def _settings(self, spark: SparkSession) -> None:
        """Shuffle files of a finished step go, as its result is stored; Python is sent a few MB at a time; enough buckets are allowed."""
        spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
        if 1 << self.files > int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets")):
            spark.conf.set("spark.sql.sources.bucketing.maxBuckets", str(1 << self.files))

    def ingest(self, docs: DataFrame, keep: bool = True) -> DataFrame:
        """(doc_id, n_words, n_removed, kept_text) for each row of `docs` (doc_id, text).

        A word goes if a window that covers it also starts in a document with a smaller doc_id,
        in this batch or an earlier one. Null texts have no words; rows without doc_id keep all
        their words and remove none elsewhere; rows of equal doc_id don't remove each other's.
        keep: whether the batch becomes part of the index.
        """
        spark = docs.sparkSession
        self._settings(spark)
        self.folder = self.folder or f"{shared.folder(spark)}/chainlake-index-{uuid.uuid4().hex}"
        docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        log = Stored.write(docs.repartition(self.parts, "doc_id"), self.folder, "texts", TEXT_SCHEMA, "doc_id", self.files)
        blocks = log.rows.where("doc_id is not null").mapInArrow(_to_blocks(self.bits, self.window, self.parts), RUN_SCHEMA)
        new = Stored.write(blocks.repartition(self.parts, "bucket").groupBy("bucket").applyInArrow(_to_run(self.parts), RUN_SCHEMA), self.folder, "run", RUN_SCHEMA, "bucket", self.files, **RUN_OPTIONS)
        by_bucket = lambda run: run.rows.where("kind = 0").groupBy("bucket")
        joined = [by_bucket(old).cogroup(by_bucket(new)).applyInArrow(_merge_join(self.parts), RUN_SCHEMA) for old in self.runs]
        held = _union([new.rows.where("kind > 0"), *joined]).repartition(self.parts, "part").groupBy("part").applyInArrow(_by_doc, HELD_SCHEMA)
        held = Stored.write(held.repartition(self.parts, "doc_id"), self.folder, "held", HELD_SCHEMA, "doc_id", self.files)
        repeats = self._verified(held.rows, [t.rows for t in self.texts] + [log.rows])
        out = log.rows.join(repeats.hint("shuffle_hash"), log.rows.doc_id == F.col("_id"), "left").select("doc_id", "text", "prints", "but", "exact").mapInArrow(_digest(self.window), "doc_id long, n_words long, n_removed long, kept_text string")
        if keep:
            self.runs.append(new)
            self.texts.append(log)
            if len(self.runs) > self.most_runs:
                self.compact()
            else:
                self._publish(spark)
        return out

    def _verified(self, held: DataFrame, logs: list[DataFrame]) -> DataFrame:
        """(_id, prints, but, exact) of the documents with repeats.

        prints: fingerprints of repeated windows; but: those of them that stand for different words
        in different places; exact: the words of the windows among these that do repeat.
        """
        spark = held.sparkSession
        by_doc = held.groupBy(F.col("doc_id").alias("_id")).agg(F.collect_list("prints").alias("prints"))
        by_doc = by_doc.hint("shuffle_hash")  # a bucket's fingerprints are small; texts needn't be sorted
        texts = _union([log.join(by_doc, log.doc_id == F.col("_id")).select("doc_id", "text", "prints") for log in logs])
        hashed = texts.mapInArrow(_evidence(self.window, False), "print long, other long")
        hashed = hashed.groupBy("print").agg(F.min("other").alias("least"), F.max("other").alias("most"))
        clashing = hashed.where("least <> most").select("print")
        older = [spark.read.parquet(path) for path in self.clashes]
        if older:
            clashing = _union([clashing, *[c.select("print") for c in older]]).distinct()
        clashing = shared.stored(clashing, "clashing")
        repeats = held.where("kind = 1").groupBy(F.col("doc_id").alias("_id")).agg(F.collect_list("prints").alias("prints"))
        if not clashing.limit(1).count():
            return repeats.select("_id", "prints", F.array().cast("array<bigint>").alias("but"), F.array().cast("array<binary>").alias("exact"))
        mine = texts.mapInArrow(_evidence(self.window, True), "print long, words binary, doc_id long")
        mine = shared.stored(mine.join(clashing, "print"), "doubtful")
        first = _union([mine.groupBy("print", "words").agg(F.min("doc_id").alias("first")), *older]).groupBy("print", "words").agg(F.min("first").alias("first"))
        path = f"{self.folder}/chainlake-clash-{uuid.uuid4().hex}"
        first.write.parquet(path)
        self.clashes = [path]  # it holds the older ones
        exact = mine.join(spark.read.parquet(path), ["print", "words"]).where("doc_id > first").groupBy("doc_id").agg(F.collect_set("words").alias("exact"))
        doubtful = mine.groupBy("doc_id").agg(F.collect_set("print").alias("but"))
        sure = doubtful.join(exact, "doc_id", "left")
        return repeats.join(sure, repeats["_id"] == sure["doc_id"], "left").select("_id", "prints", "but", "exact")

    def compact(self) -> None:
        """Merge all runs into one, publish it, and delete the merged ones; no result of `ingest` reads runs."""
        spark, old = self.runs[0].rows.sparkSession, self.runs
        merged = old[0].rows.where("kind = 0")
        for run in old[1:]:
            merged = merged.groupBy("bucket").cogroup(run.rows.where("kind = 0").groupBy("bucket")).applyInArrow(_two_runs(self.parts), RUN_SCHEMA).where("kind = 0")
        self.runs = [Stored.write(merged, self.folder, "run", RUN_SCHEMA, "bucket", self.files, **RUN_OPTIONS)]
        self._publish(spark)
        for run in old:
            run.forget()


def substring_dedup(docs: DataFrame, window: int = WINDOW, batches: int = BATCHES) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text) of all of `docs`, through an index that takes them in batches by doc_id.

    See SubstringIndex.ingest for null texts, null and equal ids; rows without doc_id go with the
    first batch. An empty table gives an empty table; other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = docs.agg(F.percentile_approx("doc_id", [k / batches for k in range(1, max(batches, 2))]).alias("cuts"), F.sum(F.length("text")).alias("characters")).first()
    cuts = sorted(set(known.cuts or [])) if batches > 1 else []
    index = SubstringIndex(SubstringIndex.bits_for(known.characters or 0), window)
    out = []
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        id_ = F.col("doc_id")
        within = F.lit(True) if low is None and high is None else id_.isNull() | (id_ <= high) if low is None else id_ > low if high is None else (id_ > low) & (id_ <= high)
        out.append(index.ingest(docs.where(within)))
        if len(index.runs) == COMPACT_AT and high is not None:
            index.compact()
    return _union(out)


def digests(kept: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of an ingest's result, without a further Python worker a task."""
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))

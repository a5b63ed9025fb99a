"""Quality selection by importance resampling.

Two bag-of-n-grams models over hashed features, one of target texts (those labelled good) and one
of all raw texts, give each text the log ratio of its probabilities: its log weight, whatever its length. A
sample without replacement in proportion to the weights is the top k of log weight plus Gumbel noise. Features
are words, word pairs and pairs of word shapes (case, length, marks, digits, repetition).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainlake.llm.shared import least_by_hash, stored
from chainlake.llm.words import mix, runs, words

#: Buckets of each of the three kinds of feature.
BUCKETS = 1 << 14
SMOOTHING = 0.5
#: The most labelled texts that the target model is fitted on, by hash order of their id.
MAX_TARGET = 20_000
#: The share of target texts whose weight the sample's size is meant to reach.
TARGET_SHARE = 0.998
SEED = 17
_U = np.uint64


def _buckets(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of every feature."""
    w = words(offsets, data)
    h, doc = w.hashes[1], w.doc()
    if not len(h):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)

    def within(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int32)])
        return total[w.end] - total[w.start]

    size = w.end - w.start
    upper, digits = within((data >= 65) & (data <= 90)), within((data >= 48) & (data <= 57))
    lower = within(((data >= 97) & (data <= 122)) | (data >= 128))
    marks = size - upper - lower - digits
    first = np.r_[True, doc[1:] != doc[:-1]]
    again = np.r_[False, h[1:] == h[:-1]] & ~first
    shape = np.minimum(upper, 2) + 3 * (lower > 0) + 6 * np.minimum(marks, 3) + 24 * (digits > 0) + 48 * np.minimum(size // 4, 4) + 240 * again + 480 * (data[w.end - 1] == 46)
    shape = mix(shape.astype(np.uint64) + _U(1))
    pair = ~first[1:]
    n = _U(BUCKETS)
    found = (mix(h + _U(11)) % n, mix(h[:-1] * _U(3) + h[1:] * _U(5))[pair] % n + n, mix(shape[:-1] * _U(3) + shape[1:] * _U(5))[pair] % n + n + n)
    after = doc[1:][pair]
    return np.concatenate([doc, after, after]), np.concatenate(found).astype(np.int64)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, is_target) to (bucket, target, raw), a row for each bucket and task."""
    raw, target = np.zeros(3 * BUCKETS, np.int64), np.zeros(3 * BUCKETS, np.int64)
    for batch in batches:
        flags = batch.column(1).fill_null(False).to_numpy(zero_copy_only=False)
        for lo, hi, offsets, data in runs(batch.column(0)):
            doc, bucket = _buckets(offsets, data)
            raw += np.bincount(bucket, minlength=len(raw))
            target += np.bincount(bucket[flags[lo:hi][doc]], minlength=len(raw))
    at = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(target[at]), pa.array(raw[at])], ["bucket", "target", "raw"])


def _log_ratios(counts: list) -> np.ndarray:
    """Of each bucket, the target's models being smoothed towards the raw ones, each kind of feature on its own."""
    target, raw = np.zeros(3 * BUCKETS), np.zeros(3 * BUCKETS)
    for r in counts:
        target[r.bucket], raw[r.bucket] = r.target, r.raw
    target, raw = target.reshape(3, -1), raw.reshape(3, -1)
    weight = SMOOTHING * BUCKETS
    q = (raw + SMOOTHING) / (raw.sum(1, keepdims=True) + weight)
    p = (target + weight * q) / (target.sum(1, keepdims=True) + weight)
    return np.log(p / q).reshape(-1)


def kth_largest(df: DataFrame, column: str, k: int) -> float | None:
    """The k-th largest value of a column without nulls, by counting in ever narrower ranges; None if k < 1."""
    if k < 1:
        return None
    span = df.agg(F.min(column).alias("lo"), F.max(column).alias("hi")).first()
    lo, hi, left = span.lo, span.hi, k
    while lo < hi:
        width = (hi - lo) / 1024
        inside = df.where(F.col(column).between(lo, hi))
        if width <= 0 or lo + width == lo:
            rows = inside.groupBy(column).count().orderBy(F.desc(column)).limit(4096).collect()
            for r in rows:
                left -= r["count"]
                if left <= 0:
                    return r[column]
        cell = F.least(F.floor((F.col(column) - lo) / width), F.lit(1023))
        cells = inside.groupBy(cell.alias("cell")).agg(F.count("*").alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")).collect()  # at most 1,024 rows
        for r in sorted(cells, key=lambda r: -r.cell):
            if left <= r.n:
                lo, hi = r.lo, r.hi
                break
            left -= r.n
    return lo


def gumbel(id_column: str | Column, seed: int = SEED) -> Column:
    """Standard Gumbel noise that depends on the id and the seed alone."""
    u = (F.shiftrightunsigned(F.xxhash64(id_column, F.lit(seed)), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.log(-F.log(u))


class ImportanceModel:
    """Log ratios of the buckets, and the least key of the sample: `last`, None for a sample of none."""

    def __init__(self, ratios: np.ndarray, seed: int):
        self.ratios, self.seed, self.last = ratios, seed, None

    def weigh(self, docs: DataFrame, keys: list[str], id_column: str = "doc_id", column: str = "text") -> DataFrame:
        """The columns `keys` of every row with n_features, log_weight and key."""
        ratios, width = docs.sparkSession.sparkContext.broadcast(self.ratios), len(keys)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n, w = [np.zeros(0, np.int64)], [np.zeros(0)]
                for lo, hi, offsets, data in runs(batch.column(width)):
                    doc, bucket = _buckets(offsets, data)
                    n.append(np.bincount(doc, minlength=hi - lo))
                    w.append(np.bincount(doc, weights=ratios.value[bucket], minlength=hi - lo))
                yield pa.RecordBatch.from_arrays([*batch.columns[:width], pa.array(np.concatenate(n)), pa.array(np.concatenate(w))], [*keys, "n_features", "log_weight"])

        kinds = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keys)
        weighed = docs.select(*keys, F.col(column).alias("_text_of")).mapInArrow(run, f"{kinds}n_features long, log_weight double")
        return weighed.withColumn("key", F.col("log_weight") + gumbel(id_column, self.seed))

    def kept(self) -> Column:
        return F.col("key") >= F.lit(self.last) if self.last is not None else F.lit(False)


def _fitted(docs: DataFrame, labels: DataFrame, id_column: str, column: str, label: str, size: int | None, seed: int) -> tuple[ImportanceModel, DataFrame]:
    """The model with its cut, and (_id, n_features, log_weight, key) of every row."""
    target = labels.where((F.col(label) == 1) & F.col(id_column).isNotNull()).select(F.col(id_column).alias("_id")).distinct()
    target = least_by_hash(target, "_id", MAX_TARGET)
    fitted = F.pmod(F.xxhash64("_id", F.lit(seed)), F.lit(4)) > 0  # the others set the sample's size
    target = F.broadcast(stored(target, "target").withColumn("is_target", fitted))  # at most MAX_TARGET ids
    plain = docs.select(F.col(id_column).alias("_id"), F.col(column).alias("_text")).join(target, "_id", "left").select("_id", "is_target", "_text")
    counts = plain.select("_text", "is_target").mapInArrow(_counts, "bucket long, target long, raw long").groupBy("bucket").agg(F.sum("target").alias("target"), F.sum("raw").alias("raw")).collect()  # at most 3 * BUCKETS rows
    model = ImportanceModel(_log_ratios(counts) if any(r.target for r in counts) else np.zeros(3 * BUCKETS), seed)
    scored = stored(model.weigh(plain, ["_id", "is_target"], "_id", "_text"), "weights")
    if size is None:
        least = scored.where("not is_target").agg(F.percentile_approx("log_weight", 1 - TARGET_SHARE, 100_000).alias("x")).first().x
        size = scored.where(F.col("log_weight") >= F.lit(least)).count() if least is not None else scored.count()
    model.last = kth_largest(scored, "key", min(size, scored.count()))
    return model, scored


def importance_sample(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", column: str = "text", label: str = "quality", size: int | None = None, seed: int = SEED) -> DataFrame:
    """(id, n_features, log_weight, key, kept) of every row of `docs`.

    log_weight is the sum of the log ratios of a text's features; key is log_weight plus Gumbel noise; kept marks the `size` largest keys, ties with the last
    one included. Without a size it is the number of texts whose log_weight is no less than that
    of TARGET_SHARE of a quarter of the target texts, which the model isn't fitted on. Null and empty texts have no features and log_weight 0.
    Without target labels every log_weight is 0 and all rows are kept. Rows of equal id have equal
    noise. An empty table gives an empty table; other columns are ignored.
    """
    model, scored = _fitted(docs, labels, id_column, column, label, size, seed)
    return scored.select(F.col("_id").alias(id_column), "n_features", "log_weight", "key", model.kept().alias("kept"))


def important_rows(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", column: str = "text", label: str = "quality", size: int | None = None, seed: int = SEED) -> DataFrame:
    """The rows of `docs` that importance_sample keeps, with all their columns. They are weighed a second time in the task that reads them, so that no text is shuffled."""
    model, _ = _fitted(docs, labels, id_column, column, label, size, seed)
    plain = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(id_column).alias("_id"), F.col(column).alias("_text"))
    return model.weigh(plain, ["_id", "_row"], "_id", "_text").where(model.kept()).select("_row.*")

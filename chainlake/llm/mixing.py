"""Mixing documents so that expected domain token totals meet targets.

A classifier trained on labelled documents gives each document a posterior over domains, not one
domain. Each document gets a rate (the expected number of times it is used), and rates are fitted
by projected gradient steps on the weighted squares of (expected domain tokens - targets), with
rates kept nonnegative. A step needs one aggregate over the documents: the rates of any step are a
short expression of the posterior and of the step vectors so far, so no state is carried along.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainlake.llm.importance import BUCKETS, _buckets
from chainlake.llm.shared import least_by_hash, stored
from chainlake.llm.words import runs, words

#: Dimensions of the classifier: hashed words, then hashed pairs of word shapes.
WORD_FEATURES, SHAPE_FEATURES = 768, 256
#: The most labelled documents that the classifier is fitted on, by hash order of their id.
MAX_LABELLED = 10_000
STEPS = 40
TOLERANCE = 1e-6


def _features(offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
    """A row for each text: square roots of hashed frequencies; zeros for a text without words."""
    n = len(offsets) - 1
    doc, bucket = _buckets(offsets, data)
    out = []
    for kind, size in ((0, WORD_FEATURES), (2, SHAPE_FEATURES)):
        own = bucket // BUCKETS == kind
        counts = np.bincount(doc[own] * size + bucket[own] % size, minlength=n * size).reshape(n, size)
        out.append(np.sqrt(counts / np.maximum(counts.sum(1, keepdims=True), 1)))
    return np.hstack(out)


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [_features(o, d) for _, _, o, d in runs(batch.column(1))]
        x = np.concatenate(rows) if rows else np.zeros((0, WORD_FEATURES + SHAPE_FEATURES))
        ends = np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(x.reshape(-1)))], ["label", "features"])


class DomainModel:
    """Posteriors over `domains`: softmax of weights on hashed frequencies."""

    def __init__(self, domains: list[str], weights: np.ndarray, bias: np.ndarray):
        self.domains, self.weights, self.bias = domains, weights, bias

    def posteriors(self, docs: DataFrame, keys: list[str], column: str = "text") -> DataFrame:
        """The columns `keys` of every row with n_tokens and p: whitespace tokens and an array in the order of `domains`."""
        weights, bias, k, width = self.weights, self.bias, len(self.domains), len(keys)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                tokens, p = [np.zeros(0, np.int64)], [np.zeros((0, k))]
                for _, _, offsets, data in runs(batch.column(width)):
                    tokens.append(words(offsets, data).counts)
                    z = _features(offsets, data) @ weights.T + bias
                    z = np.exp(z - z.max(1, keepdims=True))
                    p.append(z / z.sum(1, keepdims=True))
                flat = np.concatenate(p).reshape(-1)
                ends = np.arange(0, len(flat) + 1, k, dtype=np.int32)
                yield pa.RecordBatch.from_arrays([*batch.columns[:width], pa.array(np.concatenate(tokens), pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], [*keys, "n_tokens", "p"])

        kinds = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keys)
        return docs.select(*keys, F.col(column).alias("_text_of")).mapInArrow(run, f"{kinds}n_tokens long, p array<double>")


def fit_domains(docs: DataFrame, labels: DataFrame, domains: list[str], id_column: str = "doc_id", column: str = "text", label: str = "domain", most: int = MAX_LABELLED) -> DomainModel:
    """Multinomial logistic regression on at most `most` labelled documents, by hash order of the id.

    Labels outside `domains` and null ids don't count; an id with several labels has the first in
    the order of `domains`. With labels of fewer than two domains every posterior is uniform.
    """
    place = F.array_position(F.array(*map(F.lit, domains)), F.col(label)) - 1
    known = labels.where(F.col(id_column).isNotNull()).select(F.col(id_column).alias("_id"), place.alias("label")).where("label >= 0").groupBy("_id").agg(F.min("label").cast("double").alias("label"))
    known = F.broadcast(stored(least_by_hash(known, "_id", most), "labelled"))  # at most `most` ids
    rows = docs.select(F.col(id_column).alias("_id"), F.col(column).alias("_text")).join(known, "_id").select("label", "_text")
    rows = stored(rows.mapInArrow(_vectors, "label double, features array<double>"), "vectors").coalesce(6)  # bounded by `most`; the scan above keeps its tasks
    size = WORD_FEATURES + SHAPE_FEATURES
    weights, bias = np.zeros((len(domains), size)), np.zeros(len(domains))
    if rows.select("label").distinct().count() > 1:
        model = LogisticRegression(maxIter=40, regParam=1e-3, family="multinomial", standardization=False).fit(rows.select("label", array_to_vector("features").alias("features")))
        fitted = model.coefficientMatrix.toArray()
        weights[: len(fitted)], bias[: len(fitted)] = fitted, model.interceptVector.toArray()
        bias[len(fitted) :] = -1e9  # domains after the last one that has a label
    return DomainModel(domains, weights, bias)


def _rate(steps: list[np.ndarray]) -> Column:
    """Rates after the given steps, from 1."""
    rate = F.lit(1.0)
    for v in steps:
        move = sum((F.get("p", F.lit(k)) * float(x) for k, x in enumerate(v)), F.lit(0.0))
        rate = F.greatest(F.lit(0.0), rate - move)
    return rate


def fit_rates(posteriors: DataFrame, targets: list[float], steps: int = STEPS, tolerance: float = TOLERANCE) -> tuple[Column, np.ndarray]:
    """(rate as a Column of `p`, expected domain tokens) for a table with `n_tokens` and `p`.

    Each step is a projected gradient step on the squares of the residual under the inverse of the
    documents' token-weighted second moments, in the token-weighted metric; there the step size 1
    is safe. Starts at rate 1; stops when every residual is below `tolerance` of all tokens.
    """
    k = len(targets)
    p = [F.get("p", F.lit(i)) for i in range(k)]
    moments = posteriors.agg(*[F.coalesce(F.sum(F.col("n_tokens") * p[i] * p[j]), F.lit(0.0)).alias(f"m{i}_{j}") for i in range(k) for j in range(k)]).first()
    inverse = np.linalg.pinv(np.array(list(moments)).reshape(k, k), rcond=1e-9)
    target, taken = np.array(targets, float), []
    while True:
        rate = _rate(taken)
        totals = np.array(list(posteriors.agg(*[F.coalesce(F.sum(rate * F.col("n_tokens") * x), F.lit(0.0)) for x in p]).first()))
        if len(taken) == steps or np.abs(totals - target).max() <= tolerance * max(target.sum(), 1.0):
            return rate, totals
        taken.append(inverse @ (totals - target))


def mix(docs: DataFrame, labels: DataFrame, shares: dict[str, float], id_column: str = "doc_id", column: str = "text", label: str = "domain", tokens: float | None = None, carry: list[str] = ()) -> DataFrame:
    """(id, n_tokens, p_<domain>..., rate, reached_<domain>...) of every row of `docs`.

    shares: the wanted share of tokens of each domain; tokens: their sum, by default the number of
    tokens in `docs`. Documents with equal posteriors get equal rates. Null and empty texts have 0
    tokens, the classifier's posterior of a text without words, and the rate that follows from it.
    Targets that no nonnegative rates reach are met as nearly as the steps get: reached_<domain>, the same
    in each row, is the share of tokens that the rates give the domain in expectation. An empty table
    gives an empty table; other columns are ignored, but for those in `carry`, which stand in the id's place
    (without those that have a name of the result): then posteriors are taken a second time beside them, so that no text is shuffled.
    """
    domains = list(shares)
    model = fit_domains(docs, labels, domains, id_column, column, label)
    found = stored(model.posteriors(docs, [id_column], column), "posteriors")
    total = found.agg(F.sum("n_tokens")).first()[0] or 0 if tokens is None else tokens
    rate, totals = fit_rates(found, [total * x / sum(shares.values()) for x in shares.values()])
    reached = totals / max(totals.sum(), 1e-300)
    out = [F.col("n_tokens"), *[F.get("p", F.lit(i)).alias(f"p_{d}") for i, d in enumerate(domains)], rate.alias("rate"), *[F.lit(float(x)).alias(f"reached_{d}") for d, x in zip(domains, reached, strict=True)]]
    named = {"n_tokens", "rate", *[f"{kind}_{d}" for kind in ("p", "reached") for d in domains]}
    if not carry:
        return found.select(id_column, *out)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("_row"), F.col(column).alias("_text"))
    return model.posteriors(rows, ["_row"], "_text").select(*[F.col(f"_row.`{c}`") for c in carry if c not in named], *out)

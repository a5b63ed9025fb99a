"""Ranked lexical search with per-term geometric blocking.

Texts become short vectors of the asked terms and their counts, once, in the task that reads them.
The vectors are searched shard by shard. In a shard each asked term has a posting list; a long list is
cut into blocks of similar documents, and each block keeps, for every term that is asked together with
the list's, the largest impact that any of its documents has. The inner product of a question with such
a summary bounds the score of every document of the block, so a block is passed over only if its bound
is below the k-th best score known so far; a whole list only if the lists that are left can't add up to it.

The k-th best score of a sample of the vectors comes first: it is a lower bound of the true one, lets
each shard pass over most blocks, and keeps what shards hand on small. Sketches that group documents
decide speed only; bounds and scores are exact integers.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chainlake.llm.shared import stored
from chainlake.llm.words import utf8

#: Asked terms (with repeats over questions) that are searched for at a time; more questions are taken in several turns.
TERMS_AT_ONCE = 200_000
#: Documents and postings of a shard, and documents of a block.
SHARD_DOCS, SHARD_POSTINGS, BLOCK = 16_384, 4_000_000, 64
SKETCH = 32
#: One vector of so many is in the sample that gives the first bounds.
SAMPLE = 16
PIECE = 1 << 20

#: Bytes of terms: digits, letters (A-Z lowered) and all of other scripts; any other byte parts terms.
_TERM = bytes(b | 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, in pieces of about PIECE bytes."""
    text = text.translate(_TERM)
    begin = 0
    while begin < len(text):
        stop = text.find(b" ", begin + PIECE)
        stop = len(text) if stop < 0 else stop
        yield text[begin:stop].split()
        begin = stop


def _texts(column: pa.Array) -> Iterator[bytes]:
    offsets, data = utf8(column)
    for low, high in zip(offsets[:-1], offsets[1:], strict=True):
        yield data[low:high].tobytes()


def _asked(queries: DataFrame, id_column: str, column: str) -> DataFrame:
    """(_q, item, terms): a number for each row of `queries`, its id and its distinct terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = [sorted({t for piece in _terms(text) for t in piece}) for text in _texts(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(terms, pa.list_(pa.binary()))], ["_q", "_item", "terms"])

    kind = queries.schema[id_column].dataType.simpleString()
    numbered = queries.select(F.monotonically_increasing_id().alias("_q"), F.col(id_column).alias("_item"), F.col(column).alias("_text"))
    return stored(numbered.mapInArrow(run, f"_q long, _item {kind}, terms array<binary>"), "asked")


def vectors(docs: DataFrame, vocabulary: list[bytes], id_column: str = "doc_id", column: str = "text") -> DataFrame:
    """(id, n, terms, counts) of every row: the terms of the whole text with repeats, and which of `vocabulary` it holds, by place, how often."""
    known = docs.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(vocabulary)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = known.value
        for batch in batches:
            sizes, offsets, terms, counts = [], [0], [], []
            for text in _texts(batch.column(1)):
                n, found = 0, [np.zeros(0, np.int64)]
                for piece in _terms(text):
                    n += len(piece)
                    at = np.fromiter(map(place.get, piece, repeat(-1)), np.int64, len(piece))
                    found.append(at[at >= 0])
                at, many = np.unique(np.concatenate(found), return_counts=True)
                sizes.append(n)
                terms.append(at)
                counts.append(many)
                offsets.append(offsets[-1] + len(at))
            lists = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *x]).astype(np.int32))) for x in (terms, counts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), *lists], ["_id", "n", "terms", "counts"])

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(F.col(id_column).alias("_id"), F.col(column).alias("_text")).mapInArrow(run, f"_id {kind}, n long, terms array<int>, counts array<int>")


class _Shard:
    """Vectors of documents in the order of their ids, and the posting lists over them."""

    def __init__(self, table: pa.Table, weights: np.ndarray, n_docs: int, n_terms: int, together):
        table = table.take(pc.sort_indices(table.column("_id").combine_chunks(), null_placement="at_end"))
        self.ids = table.column("_id").combine_chunks()
        terms, counts = (table.column(c).combine_chunks() for c in ("terms", "counts"))
        self.n = table.num_rows
        self.edge = np.concatenate([[0], np.cumsum(pc.list_value_length(terms).to_numpy(zero_copy_only=False))]).astype(np.int64)
        self.term = terms.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        tf = counts.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        size = 50 + 50 * table.column("n").to_numpy() * n_docs // max(n_terms, 1)
        self.doc = np.repeat(np.arange(self.n), np.diff(self.edge))
        self.impact = 1_000_000_000 * tf // (1000 * tf + 20 * size[self.doc])
        self.weights, self.together = weights, together
        order = np.argsort(self.term, kind="stable")
        self.posted = self.doc[order]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(self.term, minlength=len(weights)))])
        self.peak = np.zeros(len(weights), np.int64)
        np.maximum.at(self.peak, self.term, self.impact)
        self.sketches: np.ndarray | None = None
        self.blocked: dict[int, tuple] = {}

    def entries(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the documents' entries, and where each document's begin among them."""
        size = self.edge[docs + 1] - self.edge[docs]
        start = np.cumsum(size) - size
        return np.repeat(self.edge[docs] - start, size) + np.arange(int(size.sum())), start

    def _sketch(self) -> np.ndarray:
        if self.sketches is None:
            signs = np.random.Generator(np.random.PCG64(1)).standard_normal((len(self.weights), SKETCH), np.float32)
            out = np.zeros((self.n, SKETCH), np.float32)
            for low in range(0, self.n, 1024):
                docs = np.arange(low, min(low + 1024, self.n))
                docs = docs[self.edge[docs + 1] > self.edge[docs]]
                if len(docs):
                    at, start = self.entries(docs)
                    force = (self.weights[self.term[at]] * self.impact[at]).astype(np.float32)
                    out[docs] = np.add.reduceat(signs[self.term[at]] * force[:, None], start)
            self.sketches = out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)
        return self.sketches

    def blocks(self, t: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
        """The documents of each block of a list, and the blocks' summaries: terms, largest impacts, where each block's begin.

        Blocks are the documents nearest to the same of some members of the list, split where there are many.
        """
        if t not in self.blocked:
            docs = self.posted[self.first[t] : self.first[t + 1]]
            sketches = self._sketch()[docs]
            some = np.random.Generator(np.random.PCG64(t)).choice(len(docs), -(-len(docs) // BLOCK), replace=False)
            nearest = (sketches @ sketches[some].T).argmax(axis=1)
            order = np.argsort(nearest, kind="stable")
            docs, nearest = docs[order], nearest[order]
            new = np.concatenate([[True], nearest[1:] != nearest[:-1]])
            within = np.arange(len(docs)) - np.maximum.accumulate(np.where(new, np.arange(len(docs)), 0))
            number = np.cumsum(new | (within % (2 * BLOCK) == 0)) - 1
            at, _ = self.entries(docs)
            owner = np.repeat(number, self.edge[docs + 1] - self.edge[docs])
            asked = np.zeros(len(self.weights), bool)
            asked[self.together(t)] = True
            asked = asked[self.term[at]]
            at, owner = at[asked], owner[asked]
            key = owner * len(self.weights) + self.term[at]
            order = np.argsort(key, kind="stable")
            key = key[order]
            begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            most = np.maximum.reduceat(self.impact[at][order], begin)  # the list's own term is in every block
            self.blocked[t] = (
                np.split(docs, np.flatnonzero(np.diff(number)) + 1),
                key[begin] % len(self.weights), most, np.searchsorted(key[begin] // len(self.weights), np.arange(number[-1] + 1)),
            )
        return self.blocked[t]

    def best(self, terms: np.ndarray, low: int, tied: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores), best first, at most k: those that score more than `low`, or `low` if they are among the first `tied`."""
        terms = terms[self.first[terms + 1] > self.first[terms]]
        most = self.weights[terms] * self.peak[terms]
        order = np.argsort(-most, kind="stable")
        terms, most = terms[order], most[order]
        left = np.cumsum(most[::-1])[::-1]
        asked = np.zeros(len(self.weights), np.int64)
        asked[terms] = self.weights[terms]
        seen = np.zeros(self.n, bool)
        docs, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def score(new: np.ndarray) -> None:
            nonlocal docs, scores, low, tied
            new = new[~seen[new]]
            if not len(new):
                return
            seen[new] = True
            at, start = self.entries(new)
            of = np.add.reduceat(asked[self.term[at]] * self.impact[at], start)
            good = (of > low) | ((of == low) & (new < tied))
            docs, scores = np.concatenate([docs, new[good]]), np.concatenate([scores, of[good]])
            if len(docs) > k:
                keep = np.lexsort((docs, -scores))[:k]
                docs, scores = docs[keep], scores[keep]
            if len(docs) == k and int(scores.min()) > low:
                low, tied = int(scores.min()), self.n

        for t, rest in zip(terms.tolist(), left.tolist(), strict=True):
            if rest < low:
                break  # a document of the lists that are left alone can't reach it
            if self.first[t + 1] - self.first[t] <= 2 * BLOCK:
                score(self.posted[self.first[t] : self.first[t + 1]])
                continue
            members, of, largest, begin = self.blocks(t)
            bounds = np.add.reduceat(asked[of] * largest, begin)
            ranked, done, step = np.argsort(-bounds, kind="stable"), 0, 2
            while done < len(ranked) and bounds[ranked[done]] >= low:
                turn = [b for b in ranked[done : done + step].tolist() if bounds[b] >= low]
                score(np.concatenate([members[b] for b in turn]))
                done, step = done + step, 2 * step
        order = np.lexsort((docs, -scores))
        return docs[order], scores[order]


def _search(table: DataFrame, questions: list[np.ndarray], weights: np.ndarray, floors: dict[int, tuple], n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(_k, _id, score): of each shard, the k best documents of each question (by place) that its floor (score, id) lets through."""
    kind = table.schema["_id"].dataType.simpleString()
    shared = table.sparkSession.sparkContext.broadcast((questions, weights, floors))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        questions, weights, floors = shared.value
        by_term: dict[int, list[int]] = {}
        for i, terms in enumerate(questions):
            for t in terms.tolist():
                by_term.setdefault(t, []).append(i)
        together = lambda t: np.concatenate([questions[i] for i in by_term[t]])

        def shard(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            here = _Shard(pa.Table.from_batches(held), weights, n_docs, n_terms, together)
            ids = here.ids.drop_null().to_pylist() if floors else []
            places, docs, scores = [], [], []
            for i, terms in enumerate(questions):
                low, least = floors.get(i, (1, None))
                found, of = here.best(terms, low, here.n if least is None else bisect_right(ids, least), k)
                places.append(np.full(len(found), i, np.int64))
                docs.append(found)
                scores.append(of)
            flat = [np.concatenate([np.zeros(0, np.int64), *x]) for x in (places, docs, scores)]
            return pa.RecordBatch.from_arrays([pa.array(flat[0]), here.ids.take(pa.array(flat[1])), pa.array(flat[2])], ["_k", "_id", "score"])

        held, rows, postings = [], 0, 0
        for batch in batches:
            held.append(batch)
            rows, postings = rows + batch.num_rows, postings + len(batch.column(2).flatten())
            if rows >= SHARD_DOCS or postings >= SHARD_POSTINGS:
                yield shard(held)
                held, rows, postings = [], 0, 0
        if rows:
            yield shard(held)

    return table.mapInArrow(run, f"_k long, _id {kind}, score long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("_k").orderBy(F.desc("score"), F.asc_nulls_last("_id"))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def lexical_search(docs: DataFrame, queries: DataFrame, k: int = 50, id_column: str = "doc_id", column: str = "text", query_id: str = "item_id", query_column: str = "text", terms_at_once: int = TERMS_AT_ONCE) -> DataFrame:
    """(query id, rank, id, score): the k best of all rows of `docs` for each row of `queries`, scores above 0 only.

    A term is a run of ASCII digits and letters (A-Z lowered) and of characters beyond ASCII. With N
    documents that have a term, L terms in all of them, df documents that hold the term, tf times in a
    document of n terms: the score adds, over the question's distinct terms, w * ((1e9 tf) div (1000 tf + 20 m)),
    w = floor(1000 ln((2N + 2) / (2 df + 1))), m = 50 + (50 n N) div L. Equal scores go by ascending id,
    null ids last. Every row is a document and every row of `queries` a question, null and repeated ids
    included. Null and empty texts have no term, are no one's result and ask for nothing; empty tables
    give an empty one. Other columns are ignored. What is broadcast is bounded by `terms_at_once`:
    questions with more terms in all are taken in several turns, each over all documents; a single question is never split.
    """
    asked = _asked(queries, query_id, query_column)
    turns = -(-(asked.agg(F.sum(F.size("terms"))).first()[0] or 0) // terms_at_once)
    found = []
    for turn in range(turns):
        block = asked.where(F.pmod(F.xxhash64("_q"), F.lit(turns)) == turn)
        rows = [(r["_q"], [bytes(t) for t in r["terms"]]) for r in block.select("_q", "terms").collect()]  # about `terms_at_once` terms
        vocabulary = sorted({t for _, terms in rows for t in terms})
        place = {t: i for i, t in enumerate(vocabulary)}
        questions = [np.array([place[t] for t in terms], np.int64) for _, terms in rows]
        table = stored(vectors(docs, vocabulary, id_column, column), "vectors")
        total = table.agg(F.count_if(F.col("n") > 0).alias("docs"), F.sum("n").alias("terms")).first()
        held = table.select(F.explode("terms").alias("t")).groupBy("t").count().collect()  # a row for each asked term
        weights = np.zeros(len(vocabulary), np.int64)
        for r in held:
            weights[r.t] = math.floor(1000 * math.log((2 * total.docs + 2) / (2 * r["count"] + 1)))
        some = table.where(F.size("terms") > 0)
        search = lambda rows, floors: _search(rows, questions, weights, floors, total.docs, total.terms or 0, k)  # noqa: B023, E731
        first = _ranked(search(some.where(F.pmod(F.xxhash64("_id", "n"), F.lit(SAMPLE)) == 0), {}), k).where(F.col("rank") == k)
        floors = {r["_k"]: (r["score"], r["_id"]) for r in first.collect()}  # a row for each question
        number = docs.sparkSession.createDataFrame([(i, q) for i, (q, _) in enumerate(rows)], "_k long, _q long")
        best = _ranked(search(some, floors), k)
        found.append(best.join(number, "_k").join(block.select("_q", F.col("_item").alias(query_id)), "_q").select(query_id, "rank", F.col("_id").alias(id_column), "score"))
    if not found:
        kinds = [queries.schema[query_id].dataType.simpleString(), "int", docs.schema[id_column].dataType.simpleString(), "long"]
        return docs.sparkSession.createDataFrame([], ", ".join(f"`{c}` {t}" for c, t in zip([query_id, "rank", id_column, "score"], kinds, strict=True)))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out

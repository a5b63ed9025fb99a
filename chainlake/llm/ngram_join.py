"""Near duplicates by a chosen-path join on word 5-grams.

Texts with the same set of 5-word shingles are one class, represented by its smallest id. Each
representative has a sketch of min-hashes, that is of sampled shingles. A run walks every
representative down a random tree: a node picks one sampled position, at times two, and splits
its members by what they have there, so that texts sharing the chosen shingles stay together.
Small buckets are compared by brute force; large ones are split further. Runs are repeated until a
pair at the threshold is met with the target probability. Buckets only tell which texts belong
to a neighbourhood; within neighbourhoods all pairs are verified on whole shingle sets, in blocks
that hold a bounded number of texts, and counted rather than listed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainlake.llm import shared
from chainlake.llm.words import Words, mix, runs, words

SHINGLE = 5
SIMILARITY = 0.8
RECALL = 0.995
POSITIONS = 64
#: Levels of the tree that are walked before buckets are counted, and per round after that.
LEVELS, MORE_LEVELS, ROUNDS = 3, 2, 2
SMALL = 100
BLOCK = 256
#: Standard deviations below the threshold at which the share of equal positions still makes texts neighbours.
MARGIN = 3.2

_U = np.uint64
_RANDOM = np.random.Generator(np.random.PCG64(11))
_XORS = _RANDOM.integers(0, 2**63, POSITIONS, dtype=np.uint64) * _U(2)
_ODDS = _RANDOM.integers(0, 2**63, POSITIONS, dtype=np.uint64) * _U(2) + _U(1)


def second_chance(similarity: float) -> float:
    """Chance of a second position at a node: 1 / similarity positions are expected."""
    return min(1.0, 1 / similarity - 1)


def neighbour_share(similarity: float) -> float:
    """Least share of equal positions for texts to be neighbours."""
    return max(0.0, similarity - MARGIN * math.sqrt(similarity * (1 - similarity) / POSITIONS))


def expected_recall(runs: int, similarity: float = SIMILARITY, levels: int = LEVELS + ROUNDS * MORE_LEVELS) -> float:
    """Probability that two texts of that similarity become neighbours in buckets `levels` deep.

    All runs share the positions, so the number of equal ones is drawn once; too few of them, and the pair is missed.
    """
    second, out = second_chance(similarity), 0.0
    for k in range(POSITIONS + 1):
        share, meet = k / POSITIONS, 1.0
        if share < neighbour_share(similarity):
            continue
        for _ in range(levels):
            meet = (1 - second) * share * meet + second * (1 - (1 - share * meet) ** 2)
        out += math.comb(POSITIONS, k) * similarity**k * (1 - similarity) ** (POSITIONS - k) * (1 - (1 - meet) ** runs)
    return out


def runs_needed(similarity: float = SIMILARITY, recall: float = RECALL, levels: int = LEVELS + ROUNDS * MORE_LEVELS) -> int:
    """Runs until that recall is expected in the deepest buckets, which those of hot texts are."""
    if expected_recall(1_000, similarity, levels) < recall:
        raise ValueError(f"a recall of {recall} at similarity {similarity} needs more than {POSITIONS} positions")
    return next(n for n in range(1, 1_001) if expected_recall(n, similarity, levels) >= recall)


def _shingles(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of every shingle, in text order; a text of fewer than n words is one shingle."""
    at, h = w.windows(n)
    doc = w.doc()
    docs, hashes = [doc[at]], [h]
    counts = w.counts
    for k in range(1, n):
        if (counts == k).any():
            at, h = w.windows(k)
            whole = counts[doc[at]] == k
            docs.append(doc[at][whole])
            hashes.append(h[whole] ^ _U(k))
    doc, h = np.concatenate(docs), np.concatenate(hashes)
    order = np.argsort(doc, kind="stable")
    return doc[order], h[order]


def _sketch(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, one, two, sketches = [], [], [], []
            for lo, hi, offsets, data in runs(batch.column(1)):
                doc, h = _shingles(words(offsets, data), n)
                edges = np.searchsorted(doc, np.arange(hi - lo + 1))
                full = np.flatnonzero(np.diff(edges))
                least = np.empty((len(full), POSITIONS), np.uint32)
                for i in range(POSITIONS if len(full) else 0):
                    least[:, i] = (np.minimum.reduceat((h ^ _XORS[i]) * _ODDS[i], edges[full]) >> _U(32)).astype(np.uint32)
                at = dict(zip(full.tolist(), range(len(full)), strict=True))
                for k in range(hi - lo):
                    distinct = np.unique(h[edges[k] : edges[k + 1]])
                    sizes.append(len(distinct))
                    one.append(int(np.add.reduce(mix(distinct ^ _U(0x5851F42D4C957F2D))).view(np.int64)) if len(distinct) else 0)
                    two.append(int(np.add.reduce(mix(distinct ^ _U(0x14057B7EF767814F))).view(np.int64)) if len(distinct) else 0)
                    sketches.append(least[at[k]].tobytes() if len(distinct) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(sketches, pa.binary())], ["id", "n_shingles", "one", "two", "sketch"])

    return run


def _children(nodes: np.ndarray, owners: np.ndarray, sketches: np.ndarray, levels: int, second_chance: float) -> tuple[np.ndarray, np.ndarray]:
    """(node, owner) `levels` below the given ones."""
    for _ in range(levels):
        first = (mix(nodes ^ _U(0xA0761D6478BD642F)) % _U(POSITIONS)).astype(np.int64)
        second = (mix(nodes ^ _U(0xE7037ED1A0B428DB)) % _U(POSITIONS - 1)).astype(np.int64)
        second += second >= first
        both = (mix(nodes ^ _U(0x8EBC6AF09C88C6E3)) >> _U(32)).astype(np.float64) < second_chance * 2**32
        down = lambda place, of: mix(nodes[of] * _U(0x9E3779B97F4A7C15) + mix((place[of].astype(np.uint64) << _U(32)) + sketches[owners[of], place[of]]))  # noqa: B023, E731
        every = np.ones(len(nodes), bool)
        nodes, owners = np.concatenate([down(first, every), down(second, both)]), np.concatenate([owners, owners[both]])
    return nodes, owners


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_py() for x in column), np.uint32).reshape(len(column), POSITIONS)


def _paths(n_runs: int, second: float):
    """(rep, sketch) to (node, rep) at level LEVELS of every run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            roots = mix(np.arange(1, n_runs + 1, dtype=np.uint64))
            nodes, owners = _children(np.repeat(roots, batch.num_rows), np.tile(np.arange(batch.num_rows), n_runs), _matrix(batch.column(1)), LEVELS, second)
            yield pa.RecordBatch.from_arrays([pa.array(nodes.view(np.int64)), batch.column(0).take(pa.array(owners))], ["node", "rep"])

    return run


def _deeper(second: float):
    """(node, rep, sketch) to (node, rep) MORE_LEVELS below."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                nodes = batch.column(0).to_numpy().view(np.uint64)
                nodes, owners = _children(nodes, np.arange(len(nodes)), _matrix(batch.column(2)), MORE_LEVELS, second)
                yield pa.RecordBatch.from_arrays([pa.array(nodes.view(np.int64)), batch.column(1).take(pa.array(owners))], ["node", "rep"])

    return run


def _root(parent: dict[int, int], x: int) -> int:
    while parent.setdefault(x, x) != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def _neighbours(share: float):
    """(node, rep, sketch) in order of node to edges (a, b) that join each bucket's neighbours."""

    def edges(nodes: np.ndarray, reps: np.ndarray, sketches: np.ndarray) -> pa.RecordBatch:
        a, b, parent = [], [], {}
        for d in range(1, SMALL):
            same = np.flatnonzero(nodes[d:] == nodes[:-d])
            if not len(same):
                break
            near = same[(sketches[same] == sketches[same + d]).sum(1) >= share * POSITIONS]
            for i in near.tolist():
                x, y = _root(parent, i), _root(parent, i + d)
                if x != y:
                    parent[y] = x
                    a.append(reps[i])
                    b.append(reps[i + d])
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            now = (batch.column(0).to_numpy(), batch.column(1).to_numpy(), _matrix(batch.column(2)))
            now = tuple(np.concatenate(x) for x in zip(held, now, strict=True)) if held else now
            cut = int(np.searchsorted(now[0], now[0][-1]))  # the last node may go on in the next batch
            yield edges(*(x[:cut] for x in now))
            held = tuple(x[cut:] for x in now)
        if held:
            yield edges(*held)

    return run


def _sets(n: int):
    """(place, rep, text, ...) to the same with the text's sorted shingle hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for lo, hi, offsets, data in runs(batch.column(1)):
                doc, h = _shingles(words(offsets, data), n)
                edges = np.searchsorted(doc, np.arange(hi - lo + 1))
                out += [np.unique(h[edges[k] : edges[k + 1]]).tobytes() for k in range(hi - lo)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary()), *batch.columns[2:]], ["rep", "shingles", "copies", "cluster", "blocks"])

    return run


def _verify(similarity: float):
    parts = similarity.as_integer_ratio() if similarity != 0.8 else (4, 5)

    def run(table: pa.Table) -> pa.Table:
        """All pairs of two blocks (or of one): each text's links, and the smallest text it is joined with."""
        low, high = table.column("low")[0].as_py(), table.column("high")[0].as_py()
        reps, copies, block = (table.column(c).to_numpy() for c in ("rep", "copies", "block"))
        sets = [np.frombuffer(x.as_py(), np.uint64) for x in table.column("shingles")]
        size = np.array([len(s) for s in sets])
        owner = np.repeat(np.arange(len(sets)), size)
        hashes = np.concatenate(sets)
        order = np.argsort(hashes, kind="stable")
        hashes, owner = hashes[order], owner[order]
        new = np.r_[True, hashes[1:] != hashes[:-1]]
        group = np.cumsum(new) - 1
        shared_by = np.bincount(group)
        keep = shared_by[group] > 1
        group, owner = (np.cumsum(new & keep) - 1)[keep], owner[keep]
        common = np.zeros((len(sets), len(sets)), np.float32)
        width = 4096
        edges = np.searchsorted(group, np.arange(0, (group[-1] if len(group) else -1) + 1 + width, width))
        for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
            part = np.zeros((len(sets), width), np.float32)
            part[owner[a:b], group[a:b] - k * width] = 1
            common += part @ part.T
        common = common.astype(np.int64)
        linked = common * parts[1] >= parts[0] * (size[:, None] + size[None, :] - common)
        np.fill_diagonal(linked, False)
        if low != high:
            linked &= block[:, None] != block[None, :]
        label = reps.copy()
        while True:
            least = np.minimum(label, np.where(linked, label[None, :], np.iinfo(np.int64).max).min(1))
            if (least == label).all():
                break
            label = least
        return pa.table([pa.array(reps), pa.array((linked * copies[None, :]).sum(1).astype(np.int64)), pa.array(label)], ["rep", "links", "to"])

    return run


def ngram_join(docs: DataFrame, id_column: str = "doc_id", column: str = "text", similarity: float = SIMILARITY, shingle: int = SHINGLE, recall: float = RECALL) -> DataFrame:
    """(id, class_id, copy_of, n_copies, n_links) of every row of `docs`.

    Two texts are linked if the Jaccard similarity of their shingle sets is at least `similarity`.
    class_id: the smallest id reachable by links; copy_of: the smallest id with the same shingle
    set, n_copies of which there are; n_links: how many other rows are linked to this one, copies
    included. A text of one to four words is a single shingle. Null, empty and blank texts are
    linked to nothing and their own class; so are rows without id, with class null. Rows of equal
    id are one node of the graph. Other columns are ignored; an empty table gives an empty table.
    """
    kind = docs.schema[id_column].dataType
    plain = docs.select(F.col(id_column).cast("long").alias("id"), F.coalesce(F.col(column), F.lit("")).alias("text"))
    sketched = shared.stored(plain.mapInArrow(_sketch(shingle), "id long, n_shingles long, one long, two long, sketch binary"), "sketches")
    known = sketched.where("id is not null and n_shingles > 0")
    classes = shared.stored(known.groupBy("one", "two").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.min("sketch").alias("sketch")), "classes")
    sketches = classes.select("rep", "sketch")
    nodes = sketches.mapInArrow(_paths(runs_needed(similarity, recall), second_chance(similarity)), "node long, rep long")
    edges = []
    for level in range(ROUNDS + 1):
        nodes = nodes.distinct()
        sizes = nodes.groupBy("node").agg(F.count("*").alias("n")).where("n > 1")
        members = shared.stored(nodes.join(sizes, "node"), "buckets")
        small = members.where(F.col("n") <= SMALL).select("node", "rep").join(sketches, "rep").select("node", "rep", "sketch")
        edges.append(small.repartition("node").sortWithinPartitions("node").mapInArrow(_neighbours(neighbour_share(similarity)), "a long, b long"))
        large = members.where(F.col("n") > SMALL).select("node", "rep")
        if not large.limit(1).count():
            break
        if level == ROUNDS:  # so many equal samples: all are neighbours
            least = large.groupBy("node").agg(F.min("rep").alias("b"))
            edges.append(large.join(least, "node").select(F.col("rep").alias("a"), "b"))
        else:
            nodes = large.join(sketches, "rep").select("node", "rep", "sketch").mapInArrow(_deeper(second_chance(similarity)), "node long, rep long")
    every = edges[0]
    for more in edges[1:]:
        every = every.unionByName(more)
    cluster = shared.components(every).withColumnRenamed("root", "cluster").withColumnRenamed("node", "rep")
    size = cluster.groupBy("cluster").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    near = cluster.join(size, "cluster").join(classes.groupBy("rep").agg(F.sum("copies").alias("copies")), "rep").select("rep", "copies", "cluster", "blocks")
    near = shared.stored(near, "near")
    texts = plain.join(near, plain.id == near.rep).select("rep", "text", "copies", "cluster", "blocks")
    sets = shared.stored(texts.mapInArrow(_sets(shingle), "rep long, shingles binary, copies long, cluster long, blocks int").dropDuplicates(["rep"]), "sets")
    blocks = sets.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    blocks = blocks.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    blocks = blocks.select("cluster", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "rep", "copies", "shingles")
    checked = shared.stored(blocks.groupBy("cluster", "low", "high").applyInArrow(_verify(similarity), "rep long, links long, to long"), "links")
    links = checked.groupBy("rep").agg(F.sum("links").alias("links"))
    roots = shared.components(checked.select(F.col("rep").alias("a"), F.col("to").alias("b")))
    found = classes.select("one", "two", "rep", "copies").join(links, "rep", "left").join(roots, classes.rep == roots.node, "left")
    found = found.select("one", "two", "rep", "copies", F.coalesce("root", "rep").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    some = F.col("id").isNotNull() & (F.col("n_shingles") > 0)
    key = lambda c: F.when(some, F.col(c)).otherwise(F.xxhash64(F.monotonically_increasing_id()))  # noqa: E731  blank texts match nothing, wherever they go
    out = sketched.select("id", "n_shingles", some.alias("some"), key("one").alias("_one"), key("two").alias("_two"))
    out = out.join(found, (F.col("_one") == F.col("one")) & (F.col("_two") == F.col("two")) & F.col("some"), "left")
    return out.select(
        F.col("id").cast(kind).alias(id_column),
        F.coalesce("class_id", "id").cast(kind).alias("class_id"),
        F.coalesce("rep", "id").cast(kind).alias("copy_of"),
        F.coalesce("copies", F.lit(1)).alias("n_copies"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
    )

"""Benchmark decontamination that sees through changed numbers, names and units.

Texts and benchmark items become token templates: letters lowered, edge marks dropped, and
numbers, names and units replaced by typed placeholders. Windows of templates are hash-joined
with the items' windows, of which a Bloom filter lets the tasks drop most others before the join. Matches of a text and an item that lie on one diagonal are put together,
and their slots must agree: what fills one slot value of the item must be one value of the text
throughout. So a question with other numbers or names is found, while texts that merely share
a pattern of placeholders aren't.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainlake.llm.shared import stored
from chainlake.llm.surrogates import GIVEN
from chainlake.llm.words import Words, mix, runs, utf8, words

WINDOW = 10
#: Items with fewer tokens than this are too short to tell from chance and match nothing.
SHORTEST = 5
#: Tokens that a match must cover, or the whole item where that is shorter.
COVER = 13
#: A window matches by its template only if more of its tokens than this share are literal; others match by their own tokens.
LITERAL = 0.5
#: Item windows that the Bloom filter's size follows, at BITS bits each (32 MB at most); with more of them it lets more pass, and the join decides as ever.
FILTER_WINDOWS = 16_000_000
BITS, PROBES = 16, 4
#: Bytes of the filter that are merged at a time.
PAGE = 4096
#: Unit words (fixed values).
UNITS = (
    "mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers kilometre kilometres "
    "mg g kg t lb lbs oz gram grams kilogram kilograms pound pounds ounce ounces ton tons tonne tonnes ml l dl liter liters litre litres gallon gallons "
    "s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years "
    "percent % $ € £ dollar dollars euro euros cent cents mph kmh kph hz khz mhz ghz w kw kwh v kv j kj cal kcal °c °f kelvin pa kpa bar psi"
).split()

_U = np.uint64
_NUMBER, _NAME, _UNIT = _U(1), _U(2), _U(3)
#: Sets the prints of windows of own tokens apart from those of templates.
_OWN = _U(0x5851F42D4C957F2D)
_UPPER, _LOWER_LETTER, _DIGIT, _EDGE, _BREAK = (np.zeros(256, bool) for _ in range(5))
_UPPER[65:91] = True
_LOWER_LETTER[97:123] = True
_DIGIT[48:58] = True
_EDGE[[i for i in range(33, 127) if not (48 <= i < 58 or 65 <= i < 91 or 97 <= i < 123)]] = True
_BREAK[[33, 46, 58, 63]] = True
#: Signs that are tokens where they stand alone between two numbers: + - * / = ^ < >
_SIGN = np.zeros(256, bool)
_SIGN[[43, 45, 42, 47, 61, 94, 60, 62]] = True


def _signs(data: np.ndarray) -> np.ndarray:
    """Where a sign stands between numbers, one space from each."""
    out = np.zeros(len(data), bool)
    if len(data) > 4:
        out[2:-2] = _SIGN[data[2:-2]] & (data[1:-3] == 32) & (data[3:-1] == 32) & _DIGIT[data[:-4]] & _DIGIT[data[4:]]
    return out


def _lowered(data: np.ndarray) -> np.ndarray:
    """ASCII and Latin-1 letters in lower case; other bytes as they are."""
    out = data.copy()
    out[_UPPER[data]] += 32
    if len(data) > 1:
        second = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
        out[second] += 0x20
    return out


def _term_hashes(terms: list[str]) -> np.ndarray:
    offsets, data = utf8(pa.array(terms, pa.string()))
    return np.unique(words(offsets, data).hashes[1])


_UNIT_HASHES = _term_hashes(UNITS)
#: Words that are numbers (fixed values).
NUMBER_WORDS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split()
_NUMBER_HASHES = _term_hashes(NUMBER_WORDS)
_NAME_HASHES = _term_hashes([n.lower() for group in GIVEN.values() for n in group])


def _templates(offsets: np.ndarray, data: np.ndarray, opening: bool = True) -> tuple[Words, np.ndarray]:
    """Tokens (marks at a word's edges dropped) with template hashes, and each token's own hash.

    opening: whether a text's first token opens a sentence, so that its capital tells nothing.
    $ € £ % ° stay, as they may be units; a word of marks alone is no token, but for signs between numbers, so that
    a sum has the shape of its terms.
    """
    edge = _EDGE.copy()
    edge[[36, 37]] = False
    lowered = _lowered(data)
    # a mark is dropped unless both neighbours are letters or digits
    solid = ~(edge[data] | (data <= 32))
    left, right = np.zeros(len(data), bool), np.zeros(len(data), bool)
    left[1:], right[:-1] = solid[:-1], solid[1:]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    left[inner] = False
    right[inner - 1] = False
    signs = _signs(data)
    for k in (-2, -1, 0, 1):  # a sign and its numbers lie in one text
        signs[inner[(inner + k >= 0) & (inner + k < len(data))] + k] = False
    keep = ~edge[data] | (left & right) | signs
    kept = np.concatenate([[0], np.cumsum(keep)])
    w = words(kept[offsets], lowered[keep])
    own = w.hashes[1]
    if not len(own):
        return w, own
    original = data[keep]
    digits = np.concatenate([[0], np.cumsum(_DIGIT[original], dtype=np.int32)])
    size, n_digits = w.end - w.start, digits[w.end] - digits[w.start]
    marks = np.concatenate([[0], np.cumsum(_EDGE[original], dtype=np.int32)])
    number = (n_digits > 0) & (n_digits + marks[w.end] - marks[w.start] == size) | np.isin(own, _NUMBER_HASHES)
    second = np.minimum(w.start + 1, len(original) - 1)
    title = _UPPER[original[w.start]] & (size > 1) & (_LOWER_LETTER[original[second]] | (original[second] >= 128))
    place = np.flatnonzero(keep)[w.start]  # where the token starts in the text
    doc = w.doc()
    opens = np.r_[True, doc[1:] != doc[:-1]]
    breaks = np.concatenate([[0], np.cumsum(_BREAK[data] | (data == 10), dtype=np.int32)])
    last = np.r_[0, np.flatnonzero(keep)[w.end[:-1] - 1]]
    opens |= breaks[place] - breaks[last] > 0
    opens[w.first[:-1][w.counts > 0]] = opening
    name = (title & ~opens) | np.isin(own, _NAME_HASHES)
    unit = np.isin(own, _UNIT_HASHES)
    unit[1:] &= number[:-1] & ~opens[1:] | (size[1:] > 3)
    unit[0] &= bool(size[0] > 3)
    template = own.copy()
    template[name] = _NAME
    template[unit] = _UNIT
    template[number] = _NUMBER
    w.hashes[1] = template
    return w, own


_PROBES = np.random.Generator(np.random.PCG64(5)).integers(0, 2**63, PROBES, dtype=np.uint64) * _U(2) + _U(1)


def _places(h: np.ndarray, probe: int, log_bits: int) -> np.ndarray:
    return ((h * _PROBES[probe]) >> _U(64 - log_bits)).astype(np.int64)


def _bloom(prints: DataFrame) -> tuple[np.ndarray, int]:
    """(bits, log of their number) of the filter of a column of prints. Tasks send the pages they touch, which are merged page by page."""
    log_bits = max(15, (BITS * min(prints.count(), FILTER_WINDOWS)).bit_length())

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros((1 << log_bits) // 8, np.uint8)
        for batch in batches:
            for probe in range(PROBES):
                at = _places(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64), probe, log_bits)
                np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
        pages = bits.reshape(-1, PAGE)
        at = np.flatnonzero(pages.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array([pages[i].tobytes() for i in at], pa.binary())], ["page", "bits"])

    def merge(table: pa.Table) -> pa.Table:
        every = np.frombuffer(b"".join(table.column("bits").to_pylist()), np.uint8).reshape(-1, PAGE)
        return pa.table([table.column("page")[:1], pa.array([np.bitwise_or.reduce(every, 0).tobytes()], pa.binary())], ["page", "bits"])

    out = np.zeros((1 << log_bits) // 8, np.uint8)
    for r in prints.mapInArrow(mark, "page int, bits binary").groupBy("page").applyInArrow(merge, "page int, bits binary").collect():  # at most the filter's pages
        out[r.page * PAGE : (r.page + 1) * PAGE] = np.frombuffer(r.bits, np.uint8)
    return out, log_bits


def _windows(lengths: list[int], sieve: tuple | None, opening: bool = True, items: bool = False):
    """Texts to (id, size, print, place, n_tokens, slots): their windows, all or those that the sieve (broadcast bits, log of their number) lets pass.

    Windows of few literals are there by their own tokens, all of which are then slots. Of texts all windows
    are there so as well, as it depends on a text's sentences what passes for a name.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, size, prints, places, tokens, flat, ends = [], [], [], [], [], [], []
            for lo, _hi, offsets, data in runs(batch.column(1)):
                w, own = _templates(offsets, data, opening)
                slot = np.isin(w.hashes[1], [_NUMBER, _NAME, _UNIT])
                total = np.concatenate([[0], np.cumsum(slot)])
                doc, counts = w.doc(), w.counts
                whole = replace(w, hashes={1: own})
                for n, exact in ((n, exact) for n in lengths for exact in (False, True)):
                    at, h = (whole if exact else w).windows(n)
                    h = h ^ _OWN if exact else h
                    for probe in range(PROBES) if sieve else ():
                        bit = _places(h, probe, sieve[1])
                        look = (sieve[0].value[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1
                        at, h = at[look], h[look]
                    if items or not exact:
                        literal = total[at + n] - total[at] < n * (1 - LITERAL)
                        at, h = at[literal != exact], h[literal != exact]
                    if not len(at):
                        continue
                    ids.append(batch.column(0).take(pa.array(doc[at] + lo)))
                    size.append(np.full(len(at), n, np.int32))
                    prints.append(h.view(np.int64))
                    places.append((at - w.first[doc[at]]).astype(np.int32))
                    tokens.append(counts[doc[at]].astype(np.int32))
                    held = np.arange(len(own)) if exact else np.flatnonzero(slot)
                    a, b = (at, at + n) if exact else (total[at], total[at + n])
                    ends.append(b - a)
                    flat.append(own[held[np.repeat(a - np.r_[0, np.cumsum(b - a)[:-1]], b - a) + np.arange((b - a).sum())]])
            if not ids:
                continue
            edges = np.concatenate([[0], np.cumsum(np.concatenate(ends))]).astype(np.int32)
            slots = pa.ListArray.from_arrays(pa.array(edges), pa.array(np.concatenate(flat).view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.concat_arrays(ids), *(pa.array(np.concatenate(x)) for x in (size, prints, places, tokens)), slots], ["id", "size", "print", "place", "n_tokens", "slots"])

    return run


def matches(docs: DataFrame, items: DataFrame, id_column: str = "doc_id", column: str = "text", item_id: str = "item_id", item_column: str = "text") -> DataFrame:
    """(id, item_id, covered, n_item_tokens, consistent, exact): texts and items with windows in common.

    covered: item tokens under matching windows of the best diagonal; consistent: each slot value
    of the item there stands for one value of the text; exact: for itself.
    """
    docs = docs.where(F.col(id_column).isNotNull()).select(F.col(id_column).alias("_id"), F.coalesce(F.col(column), F.lit("")).alias("_text"))
    items = items.where(F.col(item_id).isNotNull()).select(F.col(item_id).alias("_item"), F.coalesce(F.col(item_column), F.lit("")).alias("_text"))
    schema = "id {}, size int, print long, place int, n_tokens int, slots array<long>"
    of = lambda df, name: schema.format(df.schema[name].dataType.simpleString())
    lengths = list(range(SHORTEST, WINDOW + 1))
    # an item may stand within a sentence of a text: its first token then passes for a name
    both = [items.mapInArrow(_windows(lengths, None, opening, True), of(items, "_item")) for opening in (True, False)]
    wanted_rows = both[0].union(both[1]).distinct().where((F.col("size") == F.least("n_tokens", F.lit(WINDOW)))).select(F.col("id").alias("item_id"), "size", "print", F.col("place").alias("item_place"), F.col("n_tokens").alias("n_item_tokens"), F.col("slots").alias("item_slots"))
    wanted_rows = stored(wanted_rows, "items")
    sizes = {r["size"]: r["count"] for r in wanted_rows.groupBy("size").count().collect()}  # at most WINDOW rows
    lengths = sorted(sizes) or [WINDOW]
    bits, log_bits = _bloom(wanted_rows.select("print"))
    found = docs.mapInArrow(_windows(lengths, (docs.sparkSession.sparkContext.broadcast(bits), log_bits)), of(docs, "_id")).drop("n_tokens")
    # a window that many items share meets the texts' once
    folded = wanted_rows.groupBy("size", "print").agg(F.collect_list(F.struct("item_id", "item_place", "n_item_tokens", "item_slots")).alias("of"))
    hits = found.join(folded, ["size", "print"]).select("id", "size", "place", "slots", F.explode("of").alias("i")).select("id", "size", "place", "slots", "i.*").withColumn("shift", F.col("place") - F.col("item_place"))
    pairs = F.arrays_zip(F.col("item_slots").alias("a"), F.col("slots").alias("b"))
    diagonal = hits.groupBy("id", "item_id", "shift").agg(
        F.max("n_item_tokens").alias("n_item_tokens"),
        F.array_distinct(F.flatten(F.collect_set(F.sequence(F.col("item_place"), F.col("item_place") + F.col("size") - 1)))).alias("places"),
        F.array_distinct(F.flatten(F.collect_set(pairs))).alias("pairs"),
    )
    left = F.array_distinct(F.transform("pairs", lambda p: p["a"]))
    diagonal = diagonal.select(
        "id", "item_id", "n_item_tokens", F.size("places").alias("covered"), (F.size(left) == F.size("pairs")).alias("consistent"), F.forall("pairs", lambda p: p["a"] == p["b"]).alias("exact")
    )
    best = F.max(F.struct("consistent", "covered", "exact", "n_item_tokens"))
    return diagonal.groupBy("id", "item_id").agg(best.alias("m")).select(F.col("id").alias(id_column), "item_id", "m.covered", "m.n_item_tokens", "m.consistent", "m.exact")


def decontaminate(docs: DataFrame, items: DataFrame, id_column: str = "doc_id", column: str = "text", item_id: str = "item_id", item_column: str = "text") -> DataFrame:
    """(id, contaminated, n_items, item_ids, covered, reworded) of every row of `docs`.

    contaminated: some item, with consistent slots, is covered by COVER tokens, or whole.
    reworded: none of these matches is exact. Rows without id, null and empty texts are clean, as
    is everything when there are no items; rows of equal id are judged together. Items shorter
    than SHORTEST tokens match nothing. Other columns are ignored.
    """
    enough = F.col("consistent") & (F.col("covered") >= F.least(F.lit(COVER), F.col("n_item_tokens")))
    found = matches(docs, items, id_column, column, item_id, item_column).where(enough)
    found = found.groupBy(F.col(id_column).alias("_id")).agg(F.count("*").alias("n_items"), F.sort_array(F.collect_set("item_id")).alias("item_ids"), F.max("covered").alias("covered"), (~F.bool_or("exact")).alias("reworded"))
    ids = docs.select(F.col(id_column))
    return ids.join(found, ids[id_column] == found["_id"], "left").select(
        id_column, F.col("n_items").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0)).alias("n_items"), "item_ids", F.coalesce("covered", F.lit(0)).alias("covered"), F.coalesce("reworded", F.lit(False)).alias("reworded")
    )

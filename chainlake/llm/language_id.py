"""Language identification, words first, backing off to shorter and shorter character n-grams.

A known word scores by its log frequency in each language. A word that isn't known is looked at as the
n-grams of its letters, marked at both ends, of the longest length of which any is known; only then do shorter
ones count. Words and n-grams are counted on labelled texts and are cut to the commonest, so that
the model has a bounded size and can be broadcast.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chainlake.llm.shared import stored
from chainlake.llm.toxicity import held_out

LONGEST = 5
#: At most so many labelled texts of each language are learned from (by hash order of the id), and so many languages, those with most texts.
MOST_TEXTS, MOST_LANGUAGES = 5_000, 500
#: Words, and n-grams of each length, that a language keeps, and what all languages keep in all.
MOST_KEPT, MOST_ENTRIES = 20_000, 2_000_000
#: Words of a text beyond so many don't make the posterior any surer.
EVIDENCE = 50
WORKER_CACHE = 300_000
PIECE = 1 << 20

_WORD = r"\p{L}[\p{L}\p{M}]*"


def _words(text: str) -> Iterator[str]:
    """Words in lower case: letters with their marks."""
    find, begin = regex.compile(_WORD).findall, 0
    while begin < len(text):
        stop = begin + PIECE
        if stop < len(text):  # a piece ends before a space, if there is one soon
            space = text.find(" ", stop, stop + PIECE)
            stop = space if space >= 0 else stop
        yield from find(text[begin:stop].lower())
        begin = stop


def _grams(word: str, n: int) -> list[str]:
    marked = f"<{word}>" if n > 1 else word
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


def _counted(rows: DataFrame) -> DataFrame:
    """(lang, size, gram, n) of (lang, text): words as size 0, n-grams by their length; each task adds up its own first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows_of(seen: dict[str, Counter]) -> pa.RecordBatch:
            out = []
            for lang, count in seen.items():
                out += [(lang, 0, w, n) for w, n in count.items()]
                for size in range(1, LONGEST + 1):
                    grams: Counter[str] = Counter()
                    for w, n in count.items():
                        for g in _grams(w, size):
                            grams[g] += n
                    out += [(lang, size, g, n) for g, n in grams.items()]
            columns = list(zip(*out, strict=True)) or [(), (), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.string(), pa.int64()), strict=True)], ["lang", "size", "gram", "n"])

        seen: dict[str, Counter] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if t := text.as_py():
                    seen.setdefault(lang, Counter()).update(_words(t))
            if sum(map(len, seen.values())) > 200_000:
                yield rows_of(seen)
                seen = {}
        yield rows_of(seen)

    return rows.select("lang", "text").mapInArrow(run, "lang string, size int, gram string, n long").groupBy("lang", "size", "gram").agg(F.sum("n").alias("n"))


class LanguageModel:
    """Log frequencies by language of words (size 0) and n-grams (by length).

    tables[size][gram] is the place of a gram's languages, spans[place]:spans[place + 1] of `of`, and of what they add to
    `absent`, a row of each size for what a language doesn't know.
    """

    def __init__(self, languages: list[str], tables: list[dict[str, int]], spans: np.ndarray, of: np.ndarray, more: np.ndarray, absent: np.ndarray, prior: np.ndarray):
        self.languages, self.tables, self.spans, self.of, self.more, self.absent, self.prior = languages, tables, spans, of, more, absent, prior
        self.size_of = np.repeat(np.arange(LONGEST + 1), [len(t) for t in tables])

    @classmethod
    def empty(cls) -> LanguageModel:
        return cls([], [{} for _ in range(LONGEST + 1)], np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros((LONGEST + 1, 0)), np.zeros(0))

    def known(self, word: str) -> tuple[int, ...]:
        """Places of what scores a word: itself, or its longest known n-grams; none if not even a letter is known."""
        if (own := self.tables[0].get(word)) is not None:
            return (own,)
        for size in range(LONGEST, 0, -1):
            table = self.tables[size]
            if found := tuple(table[g] for g in _grams(word, size) if g in table):
                return found
        return ()

    def scores(self, texts: list[str | None], cache: dict[str, tuple[int, ...]]) -> tuple[np.ndarray, np.ndarray]:
        """(words of each text, a row of summed word scores for each): a word scores its own log frequency, or the mean of its n-grams'."""
        many, kinds, counts, found = [], [], [], []
        for text in texts:
            words = Counter(_words(text)) if text else {}
            many.append(sum(words.values()))
            kinds.append(len(words))
            counts += words.values()
            for word in words:
                if (at := cache.get(word)) is None:
                    if len(cache) >= WORKER_CACHE:
                        cache.clear()
                    at = cache[word] = self.known(word)
                found.append(at)
        n, k = len(texts), len(self.languages)
        parts = np.fromiter(map(len, found), np.int64, len(found))
        places = np.fromiter(chain.from_iterable(found), np.int64, int(parts.sum()))
        weight = np.repeat(np.array(counts, float) / np.maximum(parts, 1), parts)
        doc = np.repeat(np.repeat(np.arange(n), kinds), parts)
        by_size = np.bincount(doc * (LONGEST + 1) + self.size_of[places], weights=weight, minlength=n * (LONGEST + 1)).reshape(n, LONGEST + 1)
        total = by_size @ self.absent
        for low in range(0, len(places), 1 << 18):
            here = places[low : low + (1 << 18)]
            wide = self.spans[here + 1] - self.spans[here]
            at = np.repeat(self.spans[here] - (np.cumsum(wide) - wide), wide) + np.arange(int(wide.sum()))
            cell = np.repeat(doc[low : low + (1 << 18)] * k, wide) + self.of[at]
            total += np.bincount(cell, weights=np.repeat(weight[low : low + (1 << 18)], wide) * self.more[at], minlength=n * k).reshape(n, k)
        return np.array(many), total

    def predict(self, texts: list[str | None], cache: dict[str, tuple[int, ...]]) -> tuple[list[str], np.ndarray]:
        """(languages, posteriors). `und` and 0 for texts without letters, or where nothing was learned."""
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts))
        many, total = self.scores(texts, cache)
        total = self.prior + total * (np.minimum(many, EVIDENCE) / np.maximum(many, 1))[:, None]
        best = total.argmax(axis=1)  # ties: the first language in order
        sure = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
        return [self.languages[i] if n else "und" for i, n in zip(best, many, strict=True)], np.where(many > 0, sure, 0.0)


def fit(docs: DataFrame, where: Column | None = None, id_column: str = "doc_id", column: str = "text", lang: str = "lang", most: int = MOST_TEXTS) -> LanguageModel:
    """Learn from the texts of `docs` with a language for which `where` holds (default: all).

    A language's texts beyond about `most` don't count, by hash order of the id. Frequencies are smoothed by one;
    what a language doesn't keep counts as if it came half a time. Words and long n-grams that come once aren't kept.
    """
    rows = docs if where is None else docs.where(where)
    rows = rows.select(F.xxhash64(F.col(id_column)).alias("_h"), F.col(column).alias("text"), F.col(lang).cast("string").alias("lang")).where("lang is not null and text is not null")
    sizes = {r.lang: r["count"] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST_LANGUAGES).collect()}
    if not sizes:
        return LanguageModel.empty()
    by_lang = lambda of: F.create_map(*[F.lit(x) for pair in of.items() for x in pair])[F.col("lang")]
    # hashes are spread evenly: a bound on them is met by about `most` texts of a language, without ranking any
    share = by_lang({k: min(most / v, 2.0) for k, v in sizes.items()})
    counts = stored(_counted(rows.where(F.col("_h") / 2.0**64 + 0.5 < share)), "grams")
    totals = {(r.lang, r["size"]): r.n + r.kinds + 1 for r in counts.groupBy("lang", "size").agg(F.sum("n").alias("n"), F.count("*").alias("kinds")).collect()}
    languages = sorted({k for k, _ in totals})
    if not languages:
        return LanguageModel.empty()
    place = {k: i for i, k in enumerate(languages)}
    bound = min(MOST_KEPT, MOST_ENTRIES // ((LONGEST + 1) * len(languages)))
    commonest = Window.partitionBy("lang", "size").orderBy(F.desc("n"), "gram")
    kept = counts.where("n > 1 or size between 1 and 3").withColumn("_n", F.row_number().over(commonest)).where(F.col("_n") <= bound)
    by_gram: list[dict[str, list[tuple[int, int]]]] = [{} for _ in range(LONGEST + 1)]
    for r in kept.select("size", "gram", "lang", "n").toLocalIterator():  # at most MOST_ENTRIES rows
        by_gram[r["size"]].setdefault(r.gram, []).append((place[r.lang], r.n))
    tables, places = [], iter(range(sum(map(len, by_gram))))
    for grams in by_gram:
        tables.append({g: next(places) for g in grams})
    lists = [x for grams in by_gram for x in grams.values()]
    spans = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
    of, more = np.array([k for x in lists for k, _ in x], np.int64), np.log(np.array([n + 1 for x in lists for _, n in x], float) / 0.5)
    absent = np.log([[0.5 / totals.get((k, size), 1) for k in languages] for size in range(LONGEST + 1)])
    prior = np.array([sizes[k] for k in languages], float)
    return LanguageModel(languages, tables, spans, of, more, absent, np.log(prior / prior.sum()))


def language_id(docs: DataFrame, id_column: str = "doc_id", column: str = "text", lang: str = "lang", most: int = MOST_TEXTS) -> DataFrame:
    """(id, held_out, lang_pred, score) of every row of `docs`, repeated and null ids included.

    held_out: crc32(id as text) mod 5 is 0, or the id is null; such rows are never learned from. Only the
    text is looked at to predict. A null text, or one without letters, is `und` with score 0, as are all where there
    is nothing to learn from. Very long texts count whole. Other columns are ignored; an empty table gives an empty one.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, ~held_out(id_column), id_column, column, lang, most))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, cache = model.value, {}
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                of, score = known.predict(part.column(2).to_pylist(), cache)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(of, pa.string()), pa.array(score, pa.float64())], ["_id", "held_out", "lang_pred", "score"])

    kind = docs.schema[id_column].dataType.simpleString()
    plain = docs.select(F.col(id_column).alias("_id"), held_out(id_column).alias("held_out"), F.col(column).alias("_text"))
    return plain.mapInArrow(run, f"_id {kind}, held_out boolean, lang_pred string, score double").withColumnRenamed("_id", id_column)

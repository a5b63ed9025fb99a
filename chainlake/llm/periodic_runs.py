"""Runs of periodically repeated words, by a dictionary of basic factors.

For each power of two 2^k, every stretch of 2^k words of a text gets a name; equal stretches have
equal names. A stretch's next occurrence within 2^(k+1) words proposes their distance as a period:
inside a run of period q, consecutive stretches of at least q words all recur q words later, so that
equal distances at consecutive places (arithmetic progressions of occurrences) are what is looked for.
Proposals are extended word by word as far as they go, and each run is kept once.

Names are made only of stretches whose halves both recur, so the levels of ordinary text die out after
a few words; the work is n log n whatever the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainlake.llm.words import runs as pieces

#: A run has at least this many words, and this many periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
RUN = "struct<start:long,length:long,period:long>"


def _proposed(x: np.ndarray, end: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(period, first word, word after the last) of stretches whose next occurrences keep one distance for more than that many places.

    x: a number for each word, other texts having other numbers; end: the end of each word's text.
    """
    at, name, width = np.arange(len(x)), x, 1
    while len(at):
        order = np.argsort(name, kind="stable")
        place, sorted_names = at[order], name[order]
        same = sorted_names[1:] == sorted_names[:-1]
        gap = np.diff(place)
        near = same & (gap <= 2 * width)
        ahead = np.zeros(len(x) + 1, np.int64)
        ahead[place[:-1][near]] = gap[near]
        there = np.flatnonzero(ahead)
        if len(there):
            new = np.concatenate([[True], (np.diff(there) != 1) | (np.diff(ahead[there]) != 0)])
            first = there[new]
            many = np.diff(np.append(np.flatnonzero(new), len(there)))
            far = ahead[first]
            for k in np.flatnonzero(many > far):
                yield int(far[k]), int(first[k]), int(first[k] + many[k] - 1 + width + far[k])
        kept = np.zeros(len(place), bool)
        kept[1:] |= same
        kept[:-1] |= same
        number = np.full(len(x), -1, np.int64)
        number[place[kept]] = np.concatenate([[0], np.cumsum(~same)])[kept]
        halves = np.flatnonzero(number >= 0)
        halves = halves[halves + 2 * width <= end[halves]]
        halves = halves[number[halves + width] >= 0]
        at, name = halves, number[halves] * len(x) + number[halves + width]
        width *= 2


def _reach(x: np.ndarray, at: int, step: int, period: int) -> int:
    """How many words from `at` on, in the direction of `step` (1 or -1), equal the word a period back (or ahead)."""
    size, done = 16, 0
    while True:
        if step > 0:
            here, other = x[at + done : at + done + size], x[at + done - period : at + done + size - period]
        else:
            high = at - done + 1
            low = max(high - size, 0)
            here, other = x[low:high][::-1], x[low + period : high + period][::-1]
        differ = here != other[: len(here)]
        if differ.any():
            return done + int(differ.argmax())
        done += len(here)
        if len(here) < size:
            return done
        size *= 2


def _runs(x: np.ndarray, end: np.ndarray, least: int, periods: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start, then period."""
    found, period, until = [], 0, 0
    for p, begin, stop in sorted(_proposed(x, end)):
        if p == period and stop <= until:
            continue
        begin -= _reach(x, begin - 1, -1, p) if begin else 0
        stop += _reach(x, stop, 1, p)
        period, until = p, stop
        if stop - begin >= max(least, periods * p):
            found.append((begin, stop - begin, p))
    return sorted(set(found), key=lambda r: (r[0], r[2]))


def periodic_runs(docs: DataFrame, id_column: str = "doc_id", column: str = "text", least: int = LEAST_WORDS, periods: int = LEAST_PERIODS) -> DataFrame:
    """(id, n_words, runs, collapsed) of every row of `docs`, repeated and null ids included; other columns are ignored.

    Words are runs of characters other than space and 0x09-0x0D. runs: (start, length, period) of each
    maximal stretch of words with that smallest period and at least `least` words and `periods` periods,
    by start, then period. collapsed: the words that no run holds after its first period, one space
    apart. `periods` below 4 aren't found for certain and are refused. Null and empty texts, and texts
    without words, have no runs and an empty text. A task holds about 1 MB of texts, or one longer text.
    """
    if periods < 4:
        raise ValueError("runs of fewer than four periods aren't found for certain")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, offsets, data in pieces(batch.column(1)):
                split = [data[offsets[i] : offsets[i + 1]].tobytes().split() for i in range(hi - lo)]
                first = np.concatenate([[0], np.cumsum([len(s) for s in split])]).astype(np.int64)
                numbers, base = [], 0
                for s in split:
                    own: dict[bytes, int] = {}
                    numbers.append(np.fromiter((own.setdefault(w, len(own)) for w in s), np.int64, len(s)) + base)
                    base += len(own)
                x = np.concatenate(numbers) if numbers else np.zeros(0, np.int64)
                found = _runs(x, np.repeat(first[1:], np.diff(first)), least, periods)
                gone = np.zeros(len(x) + 1, np.int64)
                lists: list[list[dict]] = [[] for _ in split]
                for begin, length, p in found:
                    gone[begin + p] += 1
                    gone[begin + length] -= 1
                    doc = int(np.searchsorted(first, begin, side="right")) - 1
                    lists[doc].append({"start": begin - int(first[doc]), "length": length, "period": p})
                stay = np.cumsum(gone)[:-1] == 0
                kept = [b" ".join(compress(s, stay[first[i] : first[i + 1]]) if lists[i] else s) for i, s in enumerate(split)]
                kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(np.diff(first)), pa.array(lists, kind), pa.array(kept, pa.binary()).cast(pa.string())],
                    [id_column, "n_words", "runs", "collapsed"],
                )

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(id_column, column).mapInArrow(run, f"`{id_column}` {kind}, n_words long, runs array<{RUN}>, collapsed string")


def with_planted_repeats(docs: DataFrame, id_column: str = "doc_id", column: str = "text") -> DataFrame:
    """(id, text): of a tenth of the texts, by h = crc32(id as text), words from some place on repeat with some period.

    With g = h div 10 and n words: where h mod 10 is 0 and n > 0, word i >= a = g mod n becomes word
    a + (i - a) mod p, p = 1 + (n - a) div (3 + g mod 8). Other texts, and those with a null id, stay as they are.
    """
    h = F.crc32(F.col(id_column).cast("string").cast("binary"))
    split = F.filter(F.split(F.col(column), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    g, n, i = F.floor(h / 10), F.size(split).cast("long"), lambda c: c.cast("int")
    a = g % n
    p = 1 + F.floor((n - a) / (3 + g % 8))
    tail = F.slice(F.flatten(F.array_repeat(F.slice(split, i(a + 1), i(p)), i(F.ceil((n - a) / p)))), F.lit(1), i(n - a))
    planted = F.array_join(F.concat(F.slice(split, F.lit(1), i(a)), tail), " ")
    return docs.select(id_column, F.when((h % 10 == 0) & F.exists(split, lambda w: w != ""), planted).otherwise(F.col(column)).alias("text"))


def digests(found: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """(id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256) of the result of periodic_runs: its longest run (ties: smallest start, then period; nulls if none), and digests."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("n"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    line: Column = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    start, length, period = -best["s"], best["n"], -best["p"]
    return found.select(
        id_column, F.size("runs").cast("long").alias("n_runs"), start.alias("start"), length.alias("length"), period.alias("period"),
        F.floor(1000 * length / period).alias("exponent_milli"), F.sha2(line, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )

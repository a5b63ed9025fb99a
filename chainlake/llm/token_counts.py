"""Token counts by a map-side lookup in two tiers.

Tier one is a broadcast table of pre-tokens and their lengths in tokens: those that the vocabulary itself
holds, and the most frequent ones of a bounded sample of texts. Tier two encodes what is not in it, through a cache that
each Python worker keeps between tasks. Texts and pre-tokens never leave the task that reads them, and the corpus is
read once: the table decides the speed only, never a result.
"""

from __future__ import annotations

import heapq
import json
import os
from collections import Counter
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The split that the byte-level vocabularies of this family are made for (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
FREQUENT = 50_000
#: Texts whose fronts, of so many characters, are looked at for frequent pre-tokens.
SAMPLE, FRONT = 1_000, 10_000
WORKER_CACHE = 500_000
LONGEST_CACHED = 64

_cache: dict[str, dict[str, int]] = {}


@cache
def _tokenizer(path: str):
    """The tokenizer in `path`. PATTERN is how it splits texts; files that split or change them otherwise are refused."""
    with open(path, encoding="utf-8") as f:
        parts = json.load(f)
    split = parts.get("pre_tokenizer") or {}
    if parts.get("normalizer") is not None or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
        raise ValueError(f"{path} doesn't split texts by the byte-level pattern alone")
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    made.no_truncation()
    made.no_padding()
    return made


@cache
def _special(path: str) -> tuple[str, ...]:
    return tuple(x.content for x in _tokenizer(path).get_added_tokens_decoder().values())


def _lengths(path: str, pieces: list[str]) -> list[int]:
    return [len(x) for x in _tokenizer(path).encode_batch_fast(pieces, add_special_tokens=False)]


def _letters() -> dict[str, int]:
    """The byte that each sign of a byte-level vocabulary stands for: printable Latin-1 for itself, the others in order from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


def vocabulary_pretokens(path: str) -> list[str]:
    """The entries of the vocabulary that are one pre-token of the split."""
    letters, find = _letters(), regex.compile(PATTERN).findall
    out = []
    for entry in _tokenizer(path).get_vocab(with_added_tokens=False):
        if all(c in letters for c in entry):
            try:
                text = bytes(letters[c] for c in entry).decode()
            except UnicodeDecodeError:
                continue
            if len(text) <= LONGEST_CACHED and find(text) == [text]:
                out.append(text)
    return sorted(out)


def frequent_pretokens(texts: DataFrame, column: str = "text", top: int = FREQUENT, sample: int = SAMPLE, front: int = FRONT) -> list[str]:
    """The most frequent pre-tokens of the fronts of the first `sample` texts that a scan yields; at most `top`, commonest first.

    No more of a table is read than these texts need, and the driver holds `sample` times `front` characters at most.
    """
    seen: Counter[str] = Counter()
    find = regex.compile(PATTERN).findall
    for r in texts.select(F.left(column, F.lit(front)).alias("front")).limit(sample).collect():
        seen.update(p for p in find(r.front or "") if len(p) <= LONGEST_CACHED)
    return [p for _, p in heapq.nsmallest(top, ((-n, p) for p, n in seen.items() if n > 1))]


def token_counts(texts: DataFrame, path: str, id_column: str = "doc_id", column: str = "text", over: int = 1024, top: int = FREQUENT) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every whole text, as the tokenizer in `path` counts it.

    No begin, end or added special tokens; a special string inside a text is one token, as is the
    library's default. A null text counts as empty: 0 bytes, 0 tokens. Rows are kept one for one,
    repeated and null ids included; other columns of the input are ignored. The vocabulary must be a
    byte-level one without a normaliser (the split above is that of such files); others raise ValueError.
    """
    pieces = sorted({*vocabulary_pretokens(path), *frequent_pretokens(texts, column, top)})  # short strings: the vocabulary's, and at most `top`
    frequent = texts.sparkSession.sparkContext.broadcast(dict(zip(pieces, _lengths(path, pieces), strict=True)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, own = frequent.value, _cache.setdefault(path, {})
        find, special = regex.compile(PATTERN).findall, _special(path)
        for batch in batches:
            totals, sizes = [], []
            for text in batch.column(1):
                t = text.as_py() or ""
                sizes.append(len(t.encode()))
                if any(x in t for x in special):
                    totals.append(_lengths(path, [t])[0])
                    continue
                split = find(t)
                lengths = list(map(known.get, split))
                if None in lengths:
                    missing = [p for p, n in zip(split, lengths, strict=True) if n is None]
                    new = list({p for p in missing if p not in own})
                    here = dict(zip(new, _lengths(path, new), strict=True)) if new else {}
                    total = sum(n for n in lengths if n is not None) + sum(here[p] if p in here else own[p] for p in missing)
                    if len(own) + len(here) > WORKER_CACHE:
                        own.clear()
                    own.update((p, n) for p, n in here.items() if len(p) <= LONGEST_CACHED)
                else:
                    total = sum(lengths)
                totals.append(total)
            ids = batch.column(0)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(sizes, pa.int64()), pa.array(totals, pa.int64()), pa.array([n > over for n in totals], pa.bool_())],
                [id_column, "n_bytes", "n_tokens", "over_limit"],
            )

    kind = texts.schema[id_column].dataType.simpleString()
    return texts.select(id_column, column).mapInArrow(count, f"`{id_column}` {kind}, n_bytes long, n_tokens long, over_limit boolean")

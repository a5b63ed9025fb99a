"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features are rates of a text: lexicon hits (a small fixed list and a list learned from labelled
rows), hits near a second-person word, capitals, punctuation and obfuscation. Labels, language,
source and id are never features. The labelled rows are split three ways, by a hash of the id:
one part learns the lexicon, one the trees, one the calibration.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainlake.llm.shared import least_by_hash, stored
from chainlake.llm.words import runs, utf8, words

#: Fixed starting list; the learned one extends it to the corpus at hand.
LEXICON = (
    "idiot idiots stupid moron morons loser losers scum trash garbage pathetic worthless disgusting clown fool dumb "
    "ugly vermin filth imbecile jerk liar coward retard dumbass bastard bitch asshole shit fuck fucking crap "
    "idiota estúpido estúpida imbécil basura asqueroso mierda tonto inútil payaso patético "
    "idiote stupide imbécile crétin ordure dégoûtant merde nul minable connard salaud pathétique "
    "idiotisch dumm dummkopf trottel abschaum müll ekelhaft scheisse scheiße wertlos arschloch erbärmlich"
).split()
SECOND_PERSON = "you your yours yourself youre ur u tu te ti tus usted ustedes vous votre vos toi du dich dir dein deine ihr euch".split()
FEATURES = (
    "log_words", "hit_rate", "log_hits", "learned_rate", "log_learned", "near_rate", "second_rate",
    "capital_rate", "shout_rate", "bang_rate", "question_rate", "punctuation_rate", "digit_rate", "obfuscated_rate", "stretched_rate",
)
NEAR = 5
#: The most labelled rows that are used, by hash order of their id; any id is as likely as any other.
MAX_LABELLED = 30_000
MAX_LEARNED = 400
TREES, DEPTH = 15, 3

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = _UPPER.copy()
_LETTER[97:123] = True
_LETTER[128:] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
_PUNCTUATION = ~(_LETTER | _DIGIT | _BLANK)
#: What stands for a letter in disguised words (fixed values).
_DISGUISE = dict(zip("01345@$!7", "oieasasit", strict=True))


def _lower_table(punctuation: int, disguise: bool) -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    table[_PUNCTUATION] = punctuation
    if disguise:
        for a, b in _DISGUISE.items():
            table[ord(a)] = ord(b)
    return table


_PLAIN, _SQUEEZED = _lower_table(32, False), _lower_table(0, True)


def _stream(offsets: np.ndarray, data: np.ndarray, squeezed: bool):
    """Words after lowering: ASCII punctuation parts words, or is read through (disguised letters restored)."""
    changed = (_SQUEEZED if squeezed else _PLAIN)[data]
    if squeezed:
        keep = changed != 0
        offsets = np.concatenate([[0], np.cumsum(keep)])[offsets]
        changed = changed[keep]
    return words(offsets, changed)


def _plain(texts: pa.Array) -> pa.Array:
    """Texts in lower case, with a space for each mark, in any script: the words that a lexicon is learned from."""
    return pc.replace_substring_regex(pc.utf8_lower(texts), r"[^\p{L}\p{M}\p{N}\s]", " ")


def _prints(terms: list[str]) -> np.ndarray:
    return np.unique(words(*utf8(_plain(pa.array(terms, pa.string())))).hashes[1])


def _sum(flags: np.ndarray, edges: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(flags)])[edges])


def features(docs: DataFrame, learned: list[str], keys: list[str], column: str = "text") -> DataFrame:
    """`keys` and `features`, an array of doubles in the order of FEATURES. Null and empty texts: zeros."""
    fixed, extra, second = _prints(LEXICON), _prints(learned), _prints(SECOND_PERSON)
    width = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for lo, hi, offsets, data in runs(batch.column(width)):
                texts = batch.column(width).slice(lo, hi - lo)
                v, w, z = words(*utf8(_plain(texts))), _stream(offsets, data, False), _stream(*utf8(pc.utf8_lower(texts)), True)
                h = v.hashes[1]
                hit, more, you = np.isin(h, fixed), np.isin(h, extra), np.isin(h, second)
                any_hit, doc = hit | more, v.doc()
                at, near = np.flatnonzero(you), np.zeros(len(h), bool)
                for d in range(-NEAR, NEAR + 1):
                    to = at + d
                    ok = (to >= 0) & (to < len(h))
                    to, fro = to[ok], at[ok]
                    near[to[doc[to] == doc[fro]]] = True
                disguised = _sum(np.isin(z.hashes[1], fixed) | np.isin(z.hashes[1], extra), z.first)
                n = v.counts
                per_word = lambda flags, edges: _sum(flags, edges) / np.maximum(n, 1)  # noqa: B023, E731
                size = np.maximum(np.diff(offsets), 1)
                letters = np.maximum(_sum(_LETTER[data], offsets), 1)
                same = np.zeros(len(data), bool)
                if len(data) > 2:
                    same[2:] = (data[2:] == data[1:-1]) & (data[1:-1] == data[:-2]) & _LETTER[data[2:]]
                upper = _UPPER[data]
                caps = np.concatenate([[0], np.cumsum(upper)])
                letter = np.concatenate([[0], np.cumsum(_LETTER[data])])
                shout = (caps[w.end] - caps[w.start] == letter[w.end] - letter[w.start]) & (w.end - w.start > 2) & upper[w.start]
                hits, learnt = _sum(hit, v.first), _sum(more, v.first)
                out.append(np.column_stack([
                    np.log1p(n), hits / np.maximum(n, 1), np.log1p(hits), learnt / np.maximum(n, 1), np.log1p(learnt), per_word(near & any_hit, v.first), per_word(you, v.first),
                    _sum(upper, offsets) / letters, per_word(shout, w.first), per_word(data == 33, offsets), per_word(data == 63, offsets), _sum(_PUNCTUATION[data], offsets) / size,
                    _sum(_DIGIT[data], offsets) / size, np.maximum(disguised - _sum(any_hit, v.first), 0) / np.maximum(n, 1), _sum(same, offsets) / letters,
                ]))
            flat = np.concatenate(out).reshape(-1) if out else np.zeros(0)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, len(FEATURES), dtype=np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], lists], [*keys, "features"])

    kinds = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keys)
    return docs.select(*keys, column).mapInArrow(run, f"{kinds}, features array<double>")


def learned_lexicon(labelled: DataFrame, column: str = "text", label: str = "label", most: int = MAX_LEARNED) -> list[str]:
    """Words that a positive text holds far oftener than a negative one, surest first."""
    total = labelled.agg(F.sum(label).alias("p"), F.sum(1 - F.col(label)).alias("n")).first()
    if not total.p or not total.n:
        return []
    seen = labelled.select(label, F.explode(F.array_distinct(F.regexp_extract_all(F.lower(column), F.lit(r"([\p{L}]+)"), 1))).alias("word"))
    counts = seen.groupBy("word").agg(F.sum(label).alias("p"), F.sum(1 - F.col(label)).alias("n")).where("p >= 5")
    p, n = (F.col("p") + 0.5) / (total.p + 1), (F.col("n") + 0.5) / (total.n + 1)
    sure = F.log(p / n) - 2.0 * F.sqrt(1 / (F.col("p") + 0.5) + 1 / (F.col("n") + 0.5))
    return [r.word for r in counts.select("word", sure.alias("s")).where(F.col("s") > 1.0).orderBy(F.desc("s"), "word").limit(most).collect()]


def held_out(id_column: str = "doc_id"):
    """Rows whose crc32(id as text) mod 5 is 0; a null id is held out."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 5 == 0, F.lit(True))


class ToxicityModel:
    """Learned word list, trees and calibration; `trees` is None where the labels are all alike."""

    def __init__(self, learned, trees, calibration, prior):
        self.learned, self.trees, self.calibration, self.prior = learned, trees, calibration, prior

    def score(self, docs: DataFrame, id_column: str = "doc_id", column: str = "text") -> DataFrame:
        """(id, score) of every row; empty and null texts are scored as texts without words."""
        plain = docs.select(F.col(id_column).alias("_id"), F.col(column).alias("_text"))
        if self.trees is None:
            return plain.select(F.col("_id").alias(id_column), F.lit(self.prior).alias("score"))
        rows = features(plain, self.learned, ["_id"], "_text").withColumn("features", array_to_vector("features"))
        margins = self.trees.transform(rows).select("_id", vector_to_array("rawPrediction")[1].alias("margin"))
        scores = self.calibration.transform(margins)
        return scores.select(F.col("_id").alias(id_column), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("prediction"))).alias("score"))


def fit(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", column: str = "text", label: str = "toxic", most: int = MAX_LABELLED) -> ToxicityModel:
    """Fit on the labelled rows that aren't held out, at most `most` of them by hash order of the id.

    Rows with a null label or id don't count; an id labelled twice counts by its largest label.
    """
    known = labels.where(F.col(label).isNotNull() & ~held_out(id_column)).groupBy(F.col(id_column).alias("_id")).agg(F.max(label).cast("int").alias("label"))
    known = F.broadcast(stored(least_by_hash(known, "_id", most), "known"))  # at most `most` ids
    rows = docs.select(F.col(id_column).alias("_id"), F.coalesce(F.col(column), F.lit("")).alias("_text")).join(known, "_id")
    rows = stored(rows.withColumn("part", F.pmod(F.xxhash64("_id", F.lit(8)), F.lit(5))), "labelled")
    total = rows.agg(F.sum("label").alias("p"), F.count("*").alias("n"), F.count_distinct(F.when(F.col("part") >= 2, F.struct("part", "label"))).alias("kinds")).first()
    prior = ((total.p or 0) + 1) / (total.n + 2)
    if total.kinds < 6:
        return ToxicityModel([], None, None, prior)
    learned = learned_lexicon(rows.where("part < 2"), "_text")
    measured = stored(features(rows, learned, ["label", "part"], "_text").withColumn("label", F.col("label").cast("double")).coalesce(6), "features")
    vectors = measured.withColumn("features", array_to_vector("features"))
    trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, minInstancesPerNode=5, seed=1, maxBins=64).fit(vectors.where("part in (2, 3)").select("label", "features"))
    margins = trees.transform(vectors.where("part = 4")).select("label", vector_to_array("rawPrediction")[1].alias("margin"))
    calibration = IsotonicRegression(featuresCol="margin", labelCol="label").fit(margins)
    return ToxicityModel(learned, trees, calibration, prior)


def toxicity(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", column: str = "text", label: str = "toxic") -> DataFrame:
    """(id, held_out, score, predicted) of every row of `docs`, repeated rows included.

    Without labels of both kinds in every part, all scores are the share of positive labels,
    smoothed. An empty table gives an empty table; other columns are ignored.
    """
    scores = fit(docs, labels, id_column, column, label).score(docs, id_column, column)
    return scores.select(id_column, held_out(id_column).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

"""Quality rules with adaptive thresholds, in DataFrame functions only.

Base metrics come from each whole text. Instead of fixed cutoffs, each of four ratios is held
against a fence taken from mergeable quantile sketches of its own language and source. What is sketched is how high each
text's rate may be, given what was counted: (count + 1) / (size + 4), as a text without symbols says
the less of its rate the shorter it is. The fence is the upper quartile of that and a multiple of the distance
between the quartiles. The ratio itself is held against it, so that verdicts don't change with the length of a text.
The sketches are aggregates with partial results per task, so a hot source is no more than
many partial sketches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainlake.llm.shared import stored

SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Ratio: what it counts, and of how many.
RATIOS = {"symbol_ratio": ("n_symbols", "word_chars"), "dup_line_ratio": ("n_dup_lines", "_lines"), "upper_ratio": ("_upper", "word_chars"), "bang_ratio": ("_bangs", "n_words")}
ACCURACY = 10_000
#: Distances between the quartiles that a fence stands above the upper one ("far out").
SPREADS = 3.0
#: What a count and its size are taken to be more, in the rate that a text may have.
MORE, OF = 1.0, 4.0
SHORT_WORDS, LONG_WORDS = 10, 20


def _let(value: Column, body) -> Column:
    """`body` of `value`, which is computed once."""
    return F.transform(F.array(value), body).getItem(0)


def _repeat_words() -> Column:
    """Words in 5-word windows found twice or more, from `words`, `n_words` and window hashes `wins`.

    Texts whose window hashes all differ have none; the others compare the windows themselves.
    """
    windows = F.transform(F.sequence(F.lit(1), F.col("n_words").cast("int") - 4), lambda i: F.struct(F.array_join(F.slice("words", i, 5), " ").alias("w"), i.alias("i")))

    def repeated(s: Column) -> Column:
        last = F.size(s) - 1
        same = lambda x, k, d: F.when((k + d >= 0) & (k + d <= last), F.get(s, k + d)["w"] == x["w"]).otherwise(False)
        return F.array_sort(F.array_compact(F.transform(s, lambda x, k: F.when(same(x, k, F.lit(-1)) | same(x, k, F.lit(1)), x["i"]))))

    covered = _let(
        _let(F.array_sort(windows), repeated),
        lambda at: F.aggregate(at, F.struct(F.lit(0).alias("sum"), F.lit(-9).alias("last")), lambda a, i: F.struct((a["sum"] + F.least(F.lit(5), i - a["last"])).alias("sum"), i.alias("last")))["sum"],
    )
    return F.when(F.size(F.array_distinct("wins")) < F.size("wins"), covered.cast("long")).otherwise(F.lit(0).cast("long"))


def base_metrics(docs: DataFrame, keys: list[str], column: str = "text") -> DataFrame:
    """`keys` and, of each whole text: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    the ratios of RATIOS, and _<ratio>, how high each may be. A null text has no words; an empty text
    has ratios 0."""
    text = F.coalesce(F.col(column), F.lit(""))
    out = docs.select(*keys, text.alias("_t")).withColumn("words", F.array_remove(F.split("_t", SPACES), ""))
    out = out.withColumn("n_words", F.size("words").cast("long")).withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    out = out.withColumn("wins", F.when(F.col("n_words") >= 5, F.transform(F.sequence(F.lit(0), F.col("n_words").cast("int") - 5), lambda i: F.xxhash64(*[F.get("hashes", i + j) for j in range(5)]))).otherwise(F.array().cast("array<bigint>")))
    out = out.withColumn("lines", F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    n_chars = F.length("_t")
    count = lambda chars: (n_chars - F.length(F.translate("_t", chars, ""))).cast("long")
    out = out.select(
        *keys,
        "n_words",
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        count(SYMBOLS).alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _repeat_words().alias("n_repeat_words"),
        F.size("lines").cast("long").alias("_lines"),
        count(UPPER).alias("_upper"),
        count("!").alias("_bangs"),
    )
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    return out.select(
        *keys, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        *[ratio(F.col(n), F.col(of)).alias(r) for r, (n, of) in RATIOS.items()], *[((F.col(n) + F.lit(MORE)) / (F.col(of) + F.lit(OF))).alias(f"_{r}") for r, (n, of) in RATIOS.items()],
    )


def fences(metrics: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, <ratio>_fence for each ratio) of every language and source."""
    quartiles = [F.percentile_approx(f"_{r}", [0.25, 0.75], ACCURACY).alias(r) for r in RATIOS]
    low, high = (lambda r: F.get(r, F.lit(0))), (lambda r: F.get(r, F.lit(1)))
    sketched = metrics.groupBy(lang, source).agg(*quartiles)
    return sketched.select(lang, source, *[(high(r) + SPREADS * (high(r) - low(r))).alias(f"{r}_fence") for r in RATIOS])


def quality_rules(docs: DataFrame, id_column: str = "doc_id", column: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """One row for each row of `docs`: id, the base metrics, base_failed, kept, the ratios and their fences.

    base_failed: fewer than 10 words, or more than a fifth of them in repeated 5-word windows.
    kept: not base_failed, and no ratio above its fence. Null
    languages or sources are a group of their own. Ties and repeated rows get the same verdict; an
    empty table gives an empty table. Other columns of the input are ignored, whatever their names.
    """
    plain = docs.select(F.col(id_column).alias("_id"), F.col(lang).alias("_lang"), F.col(source).alias("_source"), F.col(column).alias("_text"))
    metrics = stored(base_metrics(plain, ["_id", "_lang", "_source"], "_text"), "metrics")
    limits = stored(fences(metrics, "_lang", "_source"), "fences").withColumnsRenamed({"_lang": "_of_lang", "_source": "_of_source"})
    out = metrics.join(limits, F.col("_lang").eqNullSafe(F.col("_of_lang")) & F.col("_source").eqNullSafe(F.col("_of_source")))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    within = F.lit(True)
    for r in RATIOS:
        within = within & (F.col(r) <= F.col(f"{r}_fence"))
    return out.select(
        F.col("_id").alias(id_column), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & within).alias("kept"), *RATIOS, *[f"{r}_fence" for r in RATIOS],
    )

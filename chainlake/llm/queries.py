"""Registered queries of the training-data operators, with production parameters and whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chainlake.llm import decontamination, importance, language_id, lexical_search, licences, mixing, ngram_join, periodic_runs, quality_rules, substring_dedup, surrogates, token_counts, toxicity


#: Rows of whole texts that a task holds at a time.
TEXTS_AT_ONCE = 1_000


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(TEXTS_AT_ONCE))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(_table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts.token_counts(_table(spark, sf_dir, "documents"), str(public_tokenizers.path("byte_bpe_50k.json")))


def op3_importance_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.importance_sample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.licence_scan(_table(spark, sf_dir, "documents"))


#: Wanted shares of tokens by domain.
MIX_SHARES = {"good": 0.85, "toxic": 0.08, "low": 0.07}


def domains(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) of the labelled documents."""
    return labels.select("doc_id", F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "low").alias("domain"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"), domains(_table(spark, sf_dir, "labels")), MIX_SHARES)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digests(substring_dedup.substring_dedup(_table(spark, sf_dir, "documents")))


#: A window's words in order, its first document, and the words that windows of later documents cover.
OP7_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
x AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w)),
m AS (SELECT s, min(doc_id) AS f FROM x GROUP BY s),
r AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM x JOIN m USING (s) WHERE m.f < x.doc_id),
p AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w),
k AS (SELECT p.doc_id, count(*) AS n_kept, string_agg(word, ' ' ORDER BY p.p) AS t FROM p ANTI JOIN r ON p.doc_id = r.doc_id AND p.p = r.p GROUP BY p.doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n_kept, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN k ON w.doc_id = k.doc_id
"""


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


#: A deployment sets its own key; this one makes the query repeatable.
PII_KEY = b"chainlake demonstration key"


def op9_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.pseudonymise(_table(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(_table(spark, sf_dir, "documents"))


def _op10_sql() -> str:
    """Base metrics by list functions; fences by exact discrete quartiles, which the sketches equal on small groups."""
    r = quality_rules
    of = {"n_symbols": "n_symbols", "n_dup_lines": "n_dup_lines", "_upper": "n_upper", "_bangs": "n_bangs", "word_chars": "word_chars", "_lines": "n_lines", "n_words": "n_words"}
    ratios = ", ".join(f"coalesce({of[n]} / nullif({of[d]}, 0), 0) AS {x}, ({of[n]} + {r.MORE}::DOUBLE) / ({of[d]} + {r.OF}::DOUBLE) AS r_{x}" for x, (n, d) in r.RATIOS.items())
    quartile = lambda x, q: f"quantile_disc(r_{x}, {q})"
    fences = ", ".join(f"{quartile(x, 0.75)} + {r.SPREADS}::DOUBLE * ({quartile(x, 0.75)} - {quartile(x, 0.25)}) AS {x}_fence" for x in r.RATIOS)
    within = " AND ".join(f"{x} <= {x}_fence" for x in r.RATIOS)
    columns = ", ".join(f"{x}, {x}_fence" for x in r.RATIOS)
    return rf"""
WITH w AS (SELECT doc_id, lang, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
x AS (SELECT doc_id, i, array_to_string(ws[i:i + 4], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)),
d AS (SELECT doc_id, s FROM x GROUP BY ALL HAVING count(*) > 1),
p AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT x.doc_id, unnest(range(i, i + 5)) AS k FROM x JOIN d USING (doc_id, s)) GROUP BY doc_id),
b AS (SELECT w.doc_id, lang, source, t, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars, CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines, coalesce(p.n, 0) AS n_repeat_words FROM w LEFT JOIN p ON w.doc_id = p.doc_id),
c AS (SELECT *, CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
  length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_upper, length(t) - length(replace(t, '!', '')) AS n_bangs FROM b),
m AS (SELECT *, {ratios} FROM c), g AS (SELECT lang, source, {fences} FROM m GROUP BY lang, source),
f AS (SELECT m.*, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, g.* EXCLUDE (lang, source) FROM m JOIN g ON m.lang IS NOT DISTINCT FROM g.lang AND m.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {within} AS kept, {columns} FROM f
"""


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = periodic_runs.with_planted_repeats(_table(spark, sf_dir, "documents"))
    return periodic_runs.digests(periodic_runs.periodic_runs(docs))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.lexical_search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


#: Terms of every text, the counts that weigh them, and every document's score for every item.
OP12_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark),
s AS (SELECT count(*) FILTER (len(ts) > 0) AS docs, CAST(sum(len(ts)) AS BIGINT) AS terms FROM d),
f AS (SELECT t, doc_id, CAST(any_value(n) AS BIGINT) AS n, count(*) AS tf FROM (SELECT doc_id, len(ts) AS n, unnest(ts) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY t, doc_id),
w AS (SELECT t, CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT t, count(*) AS df FROM f GROUP BY t), s),
x AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // terms)))) AS BIGINT) AS score FROM q JOIN f USING (t) JOIN w USING (t), s GROUP BY item_id, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM x WHERE score > 0 QUALIFY rank <= 50
"""


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_id(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_ngram_join": op1_ngram_join,
        "op2_token_counts": op2_token_counts,
        "op3_importance_sample": op3_importance_sample,
        "op4_decontamination": op4_decontamination,
        "op5_licence_scan": op5_licence_scan,
        "op6_mixing": op6_mixing,
        "op7_substring_dedup": op7_substring_dedup,
        "op8_toxicity": op8_toxicity,
        "op9_surrogates": op9_surrogates,
        "op10_quality_rules": op10_quality_rules,
        "op11_periodic_runs": op11_periodic_runs,
        "op12_lexical_search": op12_lexical_search,
        "op13_language_id": op13_language_id,
    }


def oracle_sql() -> dict[str, str]:
    return {"op7_substring_dedup": OP7_SQL, "op10_quality_rules": _op10_sql(), "op12_lexical_search": OP12_SQL}

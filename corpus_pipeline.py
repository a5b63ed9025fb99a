"""From raw documents to a weighted training corpus: five stages over Parquet tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chainlake.llm import shared
from chainlake.llm.decontamination import decontaminate
from chainlake.llm.importance import important_rows
from chainlake.llm.mixing import mix
from chainlake.llm.ngram_join import ngram_join
from chainlake.llm.queries import MIX_SHARES, PII_KEY, TEXTS_AT_ONCE, domains
from chainlake.llm.surrogates import KINDS, pseudonymise

#: No SQL expresses the stages; tests hold the pipeline against its parts and a brute-force version.
ORACLE_SQL = None


def _only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of `docs` whose doc_id, null included, is in `ids`."""
    ids = ids.select(F.col("doc_id").alias("_kept"))
    return docs.join(ids, docs["doc_id"].eqNullSafe(ids["_kept"]), "left_semi")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the importance sample keeps, row by row."""
    return important_rows(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group; rows without id are no one's copies."""
    return _only(docs, ngram_join(docs).where("doc_id = class_id or doc_id is null"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark items."""
    return _only(docs, decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where("not contaminated"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with surrogates for personal data, and n_chars of the new text."""
    return pseudonymise(docs, PII_KEY).drop(*[f"n_{k}" for k in KINDS]).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with n_tokens, their domain posteriors and the rate they are to be used at."""
    return mix(docs, domains(spark.read.parquet(f"{sf_dir}/labels.parquet")), MIX_SHARES, carry=docs.columns)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("PII", personal_data),
    ("mixing sources to target weights", mixture),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`; each result is written and read again."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(TEXTS_AT_ONCE))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _name, stage in STAGES[:-1]:
        docs = shared.stored(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)

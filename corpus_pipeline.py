"""A training corpus from ``documents``: language, near duplicates, personal data, mixture, tokens."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sweepfield.llm import bpe, language, mixing, near, pii
from sweepfield.llm.common import few_rows_a_batch, free_names, shared_folder

# A document goes if it has no letter or if no language holds this share of it.
LEAST_LANGUAGE = 0.4
MOST_REPEATS = 1.25
# Documents are near duplicates from this similarity of their five-word shingles on.
NEAR_PERCENT = 80


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents whose language the network recognises."""
    few_rows_a_batch(spark)
    lang, score = free_names(docs.columns, "__lang", "__score")
    said = language.predict(docs, language.train(docs), docs.columns, names=(lang, score))
    return said.where((F.col(lang) != language.UND) & (F.col(score) >= LEAST_LANGUAGE)).select(*docs.columns)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates."""
    few_rows_a_batch(spark)
    return near.keep_one(docs, percent=NEAR_PERCENT)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by its kind."""
    few_rows_a_batch(spark)
    done = pii.redact(docs, pii.train(docs))
    return done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else done


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat documents of the smaller sources, none more than ``MOST_REPEATS`` times as often as any other; none is dropped."""
    few_rows_a_batch(spark)
    clash = [c for c in docs.columns if c.lower().startswith("mix_")]
    safe = dict(zip(clash, free_names(docs.columns, *(f"__{c}" for c in clash))))
    mixed = mixing.mix(docs.withColumnsRenamed(safe), repeats=MOST_REPEATS)
    return mixed.select(*[F.col(safe.get(c, c)).alias(c) for c in docs.columns])


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every reading."""
    few_rows_a_batch(spark)
    keep = [c for c in ("doc_id", "lang", "source") if c in docs.columns]
    return bpe.digest(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep=keep)


STAGES = [("language", identify), ("near_duplicates", deduplicate), ("personal_data", redact), ("mixing", mixture), ("byte_bpe", tokenize)]
# No stage but the last could be written in SQL, and that one not either: tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for ``documents``; every stage before it is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = f"{shared_folder(docs)}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)

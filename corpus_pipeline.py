"""A corpus pipeline of five operators, each stage on all that its predecessor kept."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolloom.llm import decontamination, language_id, mixing, near_dedup, sharding
from rolloom.llm.texts import word_count
from rolloom.session import materialize, shared_dir

#: Scores of the best and second language nearer than this reject a document.
AMBIGUOUS_BELOW = 0.02
SHARDS = 16


def _apart(docs: DataFrame) -> tuple[DataFrame, dict[str, str], Callable[[DataFrame], DataFrame]]:
    """``docs`` under names that no operator gives its own columns, those names, and the way back to the columns of ``docs``.

    An input column called like one that an operator adds keeps its values.
    """
    own = {c: f"_document_{at}" for at, c in enumerate(docs.columns)}
    back = lambda rows: rows.select(*[F.col(own[c]).alias(c) for c in docs.columns])
    return docs.toDF(*own.values()), own, back


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learn from the labelled rows of the stage's own input; reject texts without a language.

    Rejected: null and empty texts, texts without a letter, and texts whose two best languages are nearly level. Repeated rows
    fare alike; null ids, languages and sources don't matter. Empty table: empty result.
    """
    model = language_id.fit(docs, "text", "lang")
    renamed, own, back = _apart(docs)
    judged = language_id.predict(renamed, own["text"], model, AMBIGUOUS_BELOW)
    return back(judged.where(~F.col("ambiguous")))


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of exact and near copies.

    Null texts count as empty ones; of equal rows one stays, ties go to the least id, nulls last. Empty table: empty result.
    """
    return near_dedup.keep_one(docs, "doc_id", "text")


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that contain an item of the benchmark.

    Null and empty texts contain none and stay; repeated rows fare alike. Empty table: empty result.
    """
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    leaks = decontamination.contaminated(docs, "doc_id", "text", items, "item_id", "text")
    texts = materialize(leaks.select(F.col("digest").alias("_leak")).distinct(), "leaks")
    return docs.join(texts, F.md5("text") == F.col("_leak"), "left_anti")


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or thin out sources to their target weights.

    A null text has no words and a null source is a source; rows of equal id are drawn alike. Empty table: empty result.
    """
    renamed, own, back = _apart(docs)
    text = F.col(own["text"])
    key = F.coalesce(F.col(own["doc_id"]).cast("string"), F.md5(text))
    return back(mixing.emit(mixing.mix_plan(renamed, own["source"], word_count(text), key)))


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contiguous shards of nearly equal bytes, in the order of doc_id.

    Null ids come first; a null text counts one byte; ties and repeated rows follow each other. Empty table: empty result.
    """
    size = F.coalesce(F.octet_length("text"), F.lit(0)) + 1
    order = [F.col("doc_id"), F.xxhash64("text", "lang", "source")]
    return sharding.assign_shards(docs, size, order, SHARDS)


STAGES = [
    ("languages", languages),
    ("distinct_texts", distinct_texts),
    ("clean_of_benchmark", clean_of_benchmark),
    ("mixture", mixture),
    ("shards", shards),
]

#: Models, sketches and factorisations can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is stored and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (name, stage) in enumerate(STAGES):
        path = f"{base}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

"""The corpus pipeline: five stages over documents, each a Parquet table that the next one reads.

Each stage keeps the columns of documents; the last gives each kept document's
tokens.  A stage judges all rows that its predecessor kept.

Cases: texts that are null, empty or without letters go with the first stage.  A
null doc_id stays where a stage drops documents by id.  Of rows with the same
doc_id and near copies one stays; texts of any length are judged whole.  An empty
table, an empty benchmark and extra columns, whatever their names, are fine.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strandline.llm import decontam, langid, parity_join, secrets, spm
from strandline.operators.scratch import Scratch, drop_since, mark
from strandline.session import table


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the models know; texts without letters or far from every model go."""
    return langid.predict(docs, langid.fit(docs), only_known=True)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, a similarity of 0.8 or more."""
    return parity_join.distinct_documents(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by what they were."""
    return secrets.redact(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and two sampled segmentations."""
    return spm.encode(docs, keep=["doc_id", "lang", "source"])


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", known_language),
    ("near_copies", distinct_documents),
    ("benchmark", without_benchmark),
    ("secrets", without_secrets),
    ("tokens", tokens),
]

#: SQL has no character models, sketches, tiling or lattices; the tests compare with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        place = mark()
        docs = scratch.save(stage(spark, docs, sf_dir), name)
        drop_since(spark, place)  # what the stage wrote for itself
    return docs

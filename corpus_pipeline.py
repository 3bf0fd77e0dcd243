"""A corpus pipeline of five stages: language, shared lines, near-duplicates, secrets, packing.

Each stage takes the documents that the stage before kept, as a written table, and returns the
same columns; the last returns the packed pieces.

1. ``language``: trained on a bounded sample of its input with a language; documents that the
   model rejects, or that have no letters, go.
2. ``lines``: lines that three documents or more share stay in one of them; ``n_chars`` follows.
3. ``near_duplicates``: one document of each class stays, the one with the smallest id.
4. ``secrets``: spans become ``<secret>``; every document stays, ``n_chars`` follows.
5. ``packing``: (doc_id, piece, n_tokens, bin_id, start) of all documents.

Rows without a doc_id or text, repeated rows and empty tables are treated as the operators say;
other columns pass through unchanged.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from filingmill.llm import language, line_dedup, order_minhash, packing, secrets
from filingmill.operators.materialize import shared_dir
from filingmill.sources.sample_views import table


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.accepted(docs, language.fit(docs))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.without_shared_lines(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return order_minhash.one_of_each(docs)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs, secrets.fit(docs))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(packing.measured(docs))


STAGES = [
    ("language", language_stage), ("lines", line_stage), ("near_duplicates", near_duplicate_stage),
    ("secrets", secret_stage), ("packing", packing_stage)]

# Training by gradient descent and sketches can't be said in SQL; tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    root = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        done = stage(spark, docs, sf_dir)
        done.write.parquet(f"{root}/{name}")
        docs = spark.read.schema(done.schema).parquet(f"{root}/{name}")
    return docs

"""Training-data pipeline: each stage applies one operator to all documents that the stage before it kept.

Every stage takes ``(spark, docs, sf_dir)``; all but the last return the columns of ``docs``. Decisions:

* quality: documents that the base rules or the posterior reject go;
* line_dedup: repeated lines are taken out of the texts, ``n_chars`` follows;
* near_dedup: of each class of near-duplicates one row of the smallest ``doc_id`` stays; rows
  without ``doc_id`` belong to no class and stay;
* decontaminate: documents that hold a benchmark window of full width go; items shorter than that are cut out of the texts;
* encode: one row of token ids per document, with the digests of the ids and of the text decoded from them.
"""

from __future__ import annotations

import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from auditlake.llm import bpe, decontaminate, lines, quality, simhash  # noqa: E402
from auditlake.llm.common import table  # noqa: E402
from auditlake.llm.queries import vocabulary  # noqa: E402
from auditlake.session import shared_dir  # noqa: E402

#: BPE, Bloom filters, fingerprints and expectation-maximisation have no plain SQL; tested against a brute-force version.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.filter_docs(docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return lines.rewrite(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.representatives(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.cut(docs, table(spark, sf_dir, "benchmark"))


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    done = bpe.encode_decode(docs, vocabulary("byte_bpe_50k.json"))
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality", quality_stage), ("line_dedup", line_stage), ("near_dedup", near_stage), ("decontaminate", benchmark_stage), ("encode", encode_stage)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``; each stage's result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_dir(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

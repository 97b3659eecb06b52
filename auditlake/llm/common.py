"""Small helpers that several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def fold(column: Column) -> Column:
    """A-Z in lower case; every other character as it is."""
    return F.translate(column, UPPER, LOWER)


def table(spark, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path.rstrip('/')}/{name}.parquet")


def id_and_text(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` alone, so that other columns of any name cannot clash; null texts are empty."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def free_name(docs: DataFrame, name: str) -> str:
    """``name`` with as many underscores before it as it takes to be none of the columns of ``docs``, in whatever case."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def packed(docs: DataFrame) -> DataFrame:
    """Each row as one struct ``row``, so that its columns cannot clash with others, beside ``doc_id`` and ``text`` (null: empty)."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def unpacked(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The columns that ``packed`` put into ``row``."""
    return rows.select(*[F.col("row")[c].alias(c) for c in columns])


def arrow_rows(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[list[list]]:
    """The named columns of each non-empty batch as Python lists."""
    for batch in batches:
        if batch.num_rows:
            yield [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in columns]

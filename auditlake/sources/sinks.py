"""Findings and report tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders per table: packages are hashed, since one folder per package would mean millions.
BUCKETS = 64


def write_by_package(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "append", buckets: int = BUCKETS) -> None:
    """Write with a hash of the package as partition, so a package is found without a full scan.

    Each task writes what it holds; there is no shuffle that would bring a large
    package to one task.
    """
    df.withColumn("package_bucket", F.pmod(F.xxhash64("package_id"), F.lit(buckets))).write.mode(mode).partitionBy("package_bucket").format(fmt).save(path)


def read_package(spark: SparkSession, path: str, package_id, fmt: str = "parquet", buckets: int = BUCKETS) -> DataFrame:
    bucket = F.pmod(F.xxhash64(F.lit(package_id)), F.lit(buckets))
    return spark.read.format(fmt).load(path).filter((F.col("package_bucket") == bucket) & (F.col("package_id") == package_id)).drop("package_bucket")

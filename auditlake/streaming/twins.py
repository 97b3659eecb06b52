"""Incremental forms of the operators; each equals its batch form on the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake import constants as K
from auditlake.operators import duplicates, rules
from auditlake.session import shared_dir


def stream_table(spark: SparkSession, path: str, name: str, files_per_trigger: int = 1) -> DataFrame:
    """Read a growing table folder as a stream; the schema comes from the files already there."""
    schema = spark.read.parquet(f"{path}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", f"{name}*.parquet").parquet(path)


def run_and_report(stream: DataFrame, name: str) -> tuple[DataFrame, list[dict]]:
    """Append the stream to a table in the shared folder until the input is used up; the table, and for each batch its rows, the rows in state and those dropped as late."""
    spark = stream.sparkSession
    base = shared_dir(spark, name)
    query = (
        stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{base}/state")
        .trigger(availableNow=True).start(f"{base}/table")
    )
    query.awaitTermination()
    progress = []
    for p in query.recentProgress:
        states = p["stateOperators"]
        progress.append({
            "batch": p["batchId"], "rows": p["numInputRows"], "watermark": p["eventTime"].get("watermark"),
            "state_rows": sum(s["numRowsTotal"] for s in states), "late_rows": sum(s["numRowsDroppedByWatermark"] for s in states)})
    return spark.read.schema(stream.schema).parquet(f"{base}/table"), progress


def run_to_table(stream: DataFrame, name: str) -> DataFrame:
    """The table that ``run_and_report`` fills."""
    return run_and_report(stream, name)[0]


def document_rules(docs: DataFrame, findings: list) -> DataFrame:
    """Stateless rules on a stream of documents."""
    return rules.emit(docs, findings)


def first_findings(findings: DataFrame, ts: str, delay: str = "13 days") -> DataFrame:
    """One finding per package and description; state is dropped ``delay`` after a finding was seen."""
    return findings.withWatermark(ts, delay).dropDuplicatesWithinWatermark(["package_id", "description"])


def merge_stream(updates: DataFrame, key: list[str], ord_col: str, fields: list[str], name: str) -> DataFrame:
    """Partial-record merge by micro-batch.

    Every batch writes, per key and field, its last usable value with its order
    to a folder of its own; reading the table takes the latest over all folders.
    Work per batch grows with the batch alone, and a batch that is run again
    overwrites its own folder, so a restart changes nothing.
    """
    spark = updates.sparkSession
    base = shared_dir(spark, name)

    def apply(batch: DataFrame, epoch: int) -> None:
        latest = batch.groupBy(*key).agg(*[
            F.max(F.when(duplicates.usable(batch, f), F.struct(F.col(ord_col).alias("o"), F.col(f).alias("v")))).alias(f) for f in fields])
        latest.write.mode("overwrite").parquet(f"{base}/parts/epoch={epoch}")

    updates.writeStream.foreachBatch(apply).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    merged = spark.read.parquet(f"{base}/parts").groupBy(*key).agg(*[F.max(f).alias(f) for f in fields])
    return merged.select(*key, *[F.col(f)["v"].alias(f) for f in fields])


def near_duplicate_pairs(invoices: DataFrame, ts: str, amount: str = "total_gross", max_days: int = K.DUPLICATE_MAX_DAYS, delay: str | None = None) -> DataFrame:
    """Near duplicates as a stream joined with itself: pairs of invoices of one issuer and amount with other numbers, at most ``max_days`` apart.

    Both sides are kept only as long as a partner may still come: an invoice leaves the state once the watermark,
    ``delay`` (by default ``max_days``) behind the latest ``ts``, is ``max_days`` past it. An invoice that comes later
    than the watermark is left out on both sides. Invoices without ``ts`` have no place in time and no partners here,
    unlike in the batch form, where a missing date rules nothing out.
    """
    own = duplicates.comparable(invoices, amount).withColumn("ts", F.date_trunc("day", F.col(ts)))
    own = own.withWatermark("ts", delay or f"{max_days} days")
    names = ["package_id", "issuer", "amount"]
    left = own.select(*names, "doc_id", "number", "ts")
    right = own.select(*[F.col(c).alias(f"other_{c}") for c in names], F.struct("doc_ord", "doc_id").alias("partner"), F.col("number").alias("other_number"), F.col("ts").alias("other_ts"))
    same = F.lit(True)
    for c in names:
        same = same & (F.col(c) == F.col(f"other_{c}"))
    span = F.expr(f"interval {max_days} days")
    near = (F.col("other_ts") >= F.col("ts") - span) & (F.col("other_ts") <= F.col("ts") + span)
    return left.join(right, same & near & (F.col("number") != F.col("other_number"))).select(*names, "doc_id", F.col("number").alias("invoice_number"), "partner")


def duplicate_candidates(invoices: DataFrame, ts: str, name: str, amount: str = "total_gross", delay: str | None = None) -> tuple[DataFrame, list[dict]]:
    """Invoices with a near duplicate, as the batch form gives them, and the progress of the stream's batches.

    Only pairs are appended by the stream; counting them and choosing the first is a partial aggregate over the table of
    pairs, so the state holds nothing but the invoices of the last days.
    """
    pairs, progress = run_and_report(near_duplicate_pairs(invoices, ts, amount, delay=delay), name)
    counted = pairs.groupBy("package_id", "issuer", "amount", "doc_id", "invoice_number").agg(F.count(F.lit(1)).alias("n_partners"), F.min("partner").alias("partner"))
    return counted.select("package_id", "issuer", "amount", "doc_id", "invoice_number", "n_partners", F.col("partner.doc_id").alias("first_partner")), progress

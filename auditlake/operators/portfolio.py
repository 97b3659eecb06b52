"""Contract-portfolio aggregates.

Lists that grow with a package stay rows with a rank; limits are parameters that
are off.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditlake import constants as K
from auditlake.functions.dates import expiring_soon


def contracts_only(docs: DataFrame) -> DataFrame:
    return docs.filter(F.col("doc_type") == "contract")


def summarise(contracts: DataFrame, findings: DataFrame) -> DataFrame:
    """Flags, risk elements and level of each contract.

    ``parties`` is an array of names; findings of high or medium severity are
    the risk elements, at most one per rule and so bounded per document.
    """
    elements = findings.filter(F.col("severity").isin("high", "medium")).groupBy("package_id", "doc_id").agg(
        F.array_sort(F.collect_list("description")).alias("risk_elements"))
    flags = F.filter(F.array(
        F.when(F.col("change_of_control"), F.lit("change-of-control clause")),
        F.when(F.col("non_compete"), F.lit("non-compete (restrictive covenant)")),
        F.when(F.col("auto_renewal"), F.lit("auto-renewal clause"))), lambda f: f.isNotNull())
    out = contracts.join(elements, ["package_id", "doc_id"], "left").withColumn("red_flags", flags).withColumn(
        "risk_elements", F.coalesce("risk_elements", F.array().cast("array<string>")))
    n = F.size("risk_elements")
    level = F.when((F.size("red_flags") > 0) | (n >= 2), "high").when(n > 0, "medium").otherwise("low")
    return (
        out.withColumn("risk_level", level).withColumn("contract_type", F.coalesce("contract_type", F.lit("unknown")))
        .withColumn("currency", F.coalesce("currency", F.lit("USD"))).withColumn("monthly_fee_currency", F.coalesce("monthly_fee_currency", F.lit("USD")))
    )


def price_anomalies(summary: DataFrame, ratio: float = K.PRICE_ANOMALY_RATIO) -> DataFrame:
    """Contracts of one set of parties whose values lie more than ``ratio`` apart."""
    valued = summary.withColumn("party_key", F.array_join(F.array_sort("parties"), " | "))
    value = F.when(F.col("total_value") != 0, F.col("total_value"))
    g = valued.groupBy("package_id", "party_key").agg(F.count(value).alias("n_values"), F.min(value).alias("min_value"), F.max(value).alias("max_value"))
    return g.filter((F.col("n_values") >= 2) & (F.col("min_value") > 0) & (F.col("max_value") / F.col("min_value") > ratio)).withColumn(
        "ratio", F.col("max_value") / F.col("min_value"))


def _ranked(df: DataFrame, partition: list[str], order: list[str], most: int | None) -> DataFrame:
    """Rows with their rank in the group; with ``most`` the first ones, limited before the shuffle."""
    w = Window.partitionBy(*partition).orderBy(*order)
    out = df.withColumn("rank", F.row_number().over(w))
    return out if most is None else out.filter(F.col("rank") <= most)


def flag_rows(summary: DataFrame) -> DataFrame:
    return summary.select("package_id", "doc_id", "file_name", F.posexplode("red_flags").alias("flag_no", "flag"))


def legal(summary: DataFrame, most: int | None = None) -> DataFrame:
    """Flags of the package with their rank, and every file with change of control or non-compete."""
    flags = flag_rows(summary)
    top = _ranked(flags, ["package_id"], ["doc_id", "flag_no"], most).select(
        "package_id", F.lit("red_flag").alias("kind"), F.concat_ws(": ", "file_name", "flag").alias("entry"), "rank")
    low = F.lower("flag")

    def files(kind: str, word: str):
        return flags.filter(F.contains(low, F.lit(word))).select("package_id", F.lit(kind).alias("kind"), F.col("file_name").alias("entry"), F.lit(None).cast("int").alias("rank"))

    return top.unionByName(files("change_of_control", "change-of-control")).unionByName(files("non_compete", "non-compete"))


def compliance(findings: DataFrame, most: int | None = None) -> DataFrame:
    """Data-protection and sanctions findings of each package with their rank."""
    kind = F.when(F.col("source_check_id") == "check_08_gdpr_28", "gdpr").when(F.col("source_check_id") == "check_13_aml_sanctions", "aml")
    hits = findings.withColumn("kind", kind).filter(F.col("kind").isNotNull())
    return _ranked(hits, ["package_id", "kind"], ["doc_id", "description"], most).select(
        "package_id", "kind", "rank", F.concat_ws(": ", "file_name", "description").alias("entry"))


def financial(summary: DataFrame, asof: Column) -> DataFrame:
    """Monthly fees by currency, files that expire within a year, high-value files."""
    fees = summary.filter(F.col("monthly_fee") > 0).groupBy("package_id", F.col("monthly_fee_currency").alias("entry")).agg(
        F.sum(F.col("monthly_fee").cast("decimal(18,2)")).cast("double").alias("amount")).select("package_id", F.lit("monthly").alias("kind"), "entry", "amount")
    none = F.lit(None).cast("double")
    soon = summary.filter(expiring_soon(F.col("expiry_date"), asof, K.EXPIRY_MONTHS)).select("package_id", F.lit("expiring").alias("kind"), F.col("file_name").alias("entry"), none.alias("amount"))
    high = summary.filter(F.col("total_value") >= K.HIGH_VALUE_CONTRACT).select("package_id", F.lit("high_value").alias("kind"), F.col("file_name").alias("entry"), F.col("total_value").alias("amount"))
    return fees.unionByName(soon).unionByName(high)


def applicable_analyses(summary: DataFrame, findings: DataFrame) -> DataFrame:
    """Which analyses run: compliance only after audit, audit only for two contracts or more."""
    n = summary.groupBy("package_id").agg(F.count(F.lit(1)).alias("n_contracts"))
    signals = findings.filter(F.col("source_check_id").isin("check_08_gdpr_28", "check_13_aml_sanctions")).select("package_id").distinct().withColumn("signal", F.lit(True))
    many = F.col("n_contracts") >= 2
    steps = F.filter(F.array(F.lit("legal"), F.lit("financial"), F.when(many, F.lit("audit")),
                             F.when(many & F.coalesce("signal", F.lit(False)), F.lit("compliance"))), lambda x: x.isNotNull())
    return n.join(signals, "package_id", "left").select("package_id", steps.alias("analyses"))


def override_ratings(summary: DataFrame, ratings: DataFrame) -> DataFrame:
    """An outside rating (file_name, rating, rationale) replaces the level if it is a known one."""
    joined = summary.join(ratings, ["package_id", "file_name"], "left")
    valid = F.coalesce(F.col("rating").isin("low", "medium", "high"), F.lit(False))
    noted = valid & (F.col("rating_rationale") != "")
    return joined.withColumn("risk_level", F.when(valid, F.col("rating")).otherwise(F.col("risk_level"))).withColumn(
        "red_flags", F.when(noted, F.array_prepend("red_flags", F.concat(F.lit("DD assessment: "), "rating_rationale"))).otherwise(F.col("red_flags"))
    ).drop("rating", "rating_rationale")


def report(summary: DataFrame, asof: Column) -> DataFrame:
    """One row per package: counts, how many contracts carry each flag, and the summary sentence.

    The flags themselves are rows (:func:`legal`); counted by text they are few.
    """
    soon = expiring_soon(F.col("expiry_date"), asof, K.EXPIRY_MONTHS)
    counts = summary.groupBy("package_id").agg(
        F.count(F.lit(1)).alias("contract_count"), F.count_if(F.col("risk_level") == "high").alias("high_risk_count"), F.count_if(soon).alias("expiring_count"))
    # an outside rating's remark is a text of its own and counts as one kind of flag
    kind = F.when(F.startswith("flag", F.lit("DD assessment: ")), "DD assessment").otherwise(F.col("flag"))
    top = flag_rows(summary).groupBy("package_id", kind.alias("flag")).agg(F.count(F.lit(1)).alias("n")).groupBy("package_id").agg(
        F.array_sort(F.collect_list(F.concat_ws(": ", "flag", F.col("n").cast("string")))).alias("red_flag_counts"))
    sentence = F.concat(F.lit("DD portfolio: "), F.col("contract_count").cast("string"), F.lit(" contracts, "), F.col("high_risk_count").cast("string"),
                        F.lit(" high-risk, "), F.col("expiring_count").cast("string"), F.lit(" expiring soon."))
    return counts.join(top, "package_id", "left").withColumn("red_flag_counts", F.coalesce("red_flag_counts", F.array().cast("array<string>"))).withColumn(
        "executive_summary", sentence)

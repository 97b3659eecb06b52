"""Package reports and listings; long lists stay rows or are cut where the report itself cuts them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditlake import constants as K
from auditlake.functions import labels


def severity_counts(findings: DataFrame) -> DataFrame:
    s = labels.severity_bucket(F.col("severity"))
    return findings.groupBy("package_id").agg(*[F.count_if(s == k).alias(f"n_{k}") for k in ("high", "medium", "low", "info")])


def document_info(docs: DataFrame, n_fields: Column) -> DataFrame:
    kind = F.coalesce("doc_type", F.lit("other"))
    return docs.select("package_id", "file_name", labels.doc_label(kind).alias("label"), n_fields.alias("extracted_fields"), labels.evidence_score(kind).alias("evidence_score"))


def effort(docs: DataFrame, runs: DataFrame) -> DataFrame:
    """Manual minutes against processing seconds (runs: package_id, started, finished)."""
    minutes = docs.groupBy("package_id").agg(F.count(F.lit(1)).alias("document_count"), F.sum(labels.manual_minutes(F.col("doc_type"))).alias("manual_minutes"))
    seconds = F.round(F.col("finished").cast("double") - F.col("started").cast("double"), 3)
    joined = minutes.join(runs.select("package_id", seconds.alias("seconds")), "package_id", "left")
    speed = F.when(F.col("seconds") > 0, F.round(F.col("manual_minutes") * 60.0 / F.col("seconds"), 1)).otherwise(0.0)
    return joined.withColumn("speedup", speed)


def split_by_origin(findings: DataFrame) -> DataFrame:
    """Rule-based, informational and model findings per package."""
    model = F.col("kind") == "llm_analysis"
    info = F.col("severity") == "info"
    return findings.groupBy("package_id").agg(
        F.count_if(~model & ~info).alias("n_rule"), F.count_if(info).alias("n_info"), F.count_if(model).alias("n_model"))


def top_findings(findings: DataFrame, limits: dict[str, int] | None = None, order=("stage", "doc_id", "rule_ord")) -> DataFrame:
    """Findings of each severity in a package with their rank: all of them, or the first by the limits given.

    With limits the rank filter runs before the shuffle.
    """
    bucket = labels.severity_bucket(F.col("severity"))
    w = Window.partitionBy("package_id", "bucket").orderBy(*order)
    ranked = findings.withColumn("bucket", bucket).withColumn("rank", F.row_number().over(w))
    if limits:
        ranked = ranked.filter(F.col("rank") <= max(limits.values()))
        allowed = F.create_map(*[F.lit(x) for kv in limits.items() for x in kv])
        ranked = ranked.filter(F.col("rank") <= F.coalesce(F.try_element_at(allowed, F.col("bucket")), F.lit(0)))
    return ranked


def list_documents(docs: DataFrame) -> DataFrame:
    pct = F.concat(F.format_number(F.col("confidence") * 100, 0), F.lit("%"))
    return docs.select("package_id", "file_name", F.coalesce("label", F.lit("unknown")).alias("label"), F.coalesce("doc_type", F.lit("other")).alias("doc_type"),
                       F.coalesce(pct, F.lit("?")).alias("confidence"))


def extraction_json(docs: DataFrame, fields: list[str]) -> DataFrame:
    body = F.to_json(F.struct(F.col("file_name").alias("file"), "doc_type", F.struct(*fields).alias("data")), {"ignoreNullFields": "false"})
    return docs.select("package_id", "file_name", body.alias("extraction"))


def insights_section(insights: DataFrame) -> DataFrame:
    """What a package analysis says, as a report shows it: a missing summary is blank, missing lists are empty, a missing type is general.

    ``insights``: package_id, executive_summary, findings and key_observations (lists of text), package_type.
    """
    none = F.array().cast("array<string>")
    return insights.select(
        "package_id", F.coalesce("executive_summary", F.lit("")).alias("executive_summary"), F.coalesce("findings", none).alias("findings"), F.coalesce("key_observations", none).alias("key_observations"),
        F.coalesce(F.when(F.col("package_type") != "", F.col("package_type")), F.lit("general")).alias("package_type"))


def assemble(docs: DataFrame, findings: DataFrame, runs: DataFrame, comparison: DataFrame | None = None, portfolio: DataFrame | None = None, insights: DataFrame | None = None) -> DataFrame:
    """One JSON report per package: counts by severity and by origin, effort, documents by type, optional sections.

    ``insights`` (one row for each package, see :func:`insights_section`) gives ``package_insights``; packages without a row have no such section.

    The findings belong to the report as rows keyed by package, severity and
    rank (:func:`top_findings` without limits), since their number has no bound.
    """
    kinds = docs.groupBy("package_id").agg(*[F.count_if(F.col("doc_type") == k).alias(f"n_{k}") for k in K.DOC_LABELS if k != "other"])
    out = effort(docs, runs).join(severity_counts(findings), "package_id", "left").join(split_by_origin(findings).drop("n_info"), "package_id", "left")
    out = out.join(kinds.select("package_id", F.struct(*[c for c in kinds.columns if c != "package_id"]).alias("documents")), "package_id", "left")
    for name, part in (("comparison", comparison), ("dd_analysis", portfolio), ("package_insights", None if insights is None else insights_section(insights))):
        if part is not None:
            rest = [c for c in part.columns if c != "package_id"]
            out = out.join(part.select("package_id", F.struct(*rest).alias(name)), "package_id", "left")
    cols = [c for c in out.columns if c != "package_id"]
    return out.select("package_id", F.to_json(F.struct("package_id", *cols)).alias("report"))

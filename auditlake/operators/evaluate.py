"""Run evaluation: pass rates, latency ranks, expectations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditlake import constants as K
from auditlake.functions import labels
from auditlake.functions.text import strip_accents


def folded(c: Column) -> Column:
    return F.lower(strip_accents(c))


def answer_passes(answer: Column, expected: Column) -> Column:
    """TRUE if any expected text occurs in the answer, accents and case ignored."""
    return F.transform(F.array(folded(answer)), lambda a: F.exists(F.transform(expected, folded), lambda e: F.contains(a, e)))[0]


def tools_match(expected: Column, called: Column) -> Column:
    return F.size(F.array_except(expected, called)) == 0


def pass_rates(results: DataFrame) -> DataFrame:
    """Per category and in total (category NULL)."""
    return results.rollup("category").agg(
        F.count(F.lit(1)).alias("total"), F.count_if("passed").alias("passed"), F.count_if("tools_ok").alias("tools_ok"))


RANKS = {"p50": 0.5, "p95": 0.95, "p99": 0.99}


def latency_stats(values: DataFrame, keys: list[str], value: str, ranks: dict[str, float] | None = None) -> DataFrame:
    """Count, min, mean, max and nearest-rank percentiles per key.

    Rank p is the value at position min(floor(n p), n - 1).  Values are counted
    first, then ranked inside narrow value bands whose totals give the offset,
    so no key is ever sorted in one task however many rows it has.
    """
    ranks = ranks or RANKS
    if not keys:
        return latency_stats(values.withColumn("_all", F.lit(0)), ["_all"], value, ranks).drop("_all")
    v = F.col(value)
    counted = values.filter(v.isNotNull()).groupBy(*keys, v.alias("v")).agg(F.count(F.lit(1)).alias("n"))
    # monotone and independent of the data, so every reading puts a value in the same band
    counted = counted.withColumn("band", F.floor(F.signum("v") * F.log1p(F.abs("v")) * 200))
    bands = counted.groupBy(*keys, "band").agg(F.sum("n").alias("band_n"))
    before = Window.partitionBy(*keys).orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    bands = bands.withColumn("offset", F.coalesce(F.sum("band_n").over(before), F.lit(0)))
    sums = values.filter(v.isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"), F.min(v).alias("min"), F.max(v).alias("max"),
        (F.sum(v.cast("decimal(28,6)")) / F.count(F.lit(1))).cast("double").alias("mean"))
    want = F.array(*[F.struct(F.lit(k).alias("name"), F.least(F.floor(F.col("n_rows") * p).cast("bigint"), F.col("n_rows") - 1).alias("pos")) for k, p in ranks.items()])
    targets = sums.select(*keys, F.explode(want).alias("t")).select(*keys, "t.*")
    on_band = (F.col("pos") >= F.col("offset")) & (F.col("pos") < F.col("offset") + F.col("band_n"))
    hit = bands.join(targets, keys).filter(on_band)
    inside = Window.partitionBy(*keys, "band", "name").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counted.join(hit.select(*keys, "band", "name", (F.col("pos") - F.col("offset")).alias("local")), keys + ["band"]).withColumn("upto", F.sum("n").over(inside))
    found = ranked.filter(F.col("upto") > F.col("local")).groupBy(*keys).agg(
        *[F.min(F.when(F.col("name") == k, F.col("v"))).alias(k) for k in ranks])
    return sums.join(found, keys, "left")


def latency_of_successes(runs: DataFrame) -> DataFrame:
    """Statistics over successful runs, or over all runs where none succeeded."""
    none_ok = runs.agg(F.coalesce(~F.bool_or("ok"), F.lit(True))).scalar()
    return latency_stats(runs.filter(F.col("ok") | none_ok), [], "latency_ms")


def throughput(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Successful runs per second between the first and the last start."""
    span = F.max("ts").cast("double") - F.min("ts").cast("double")
    return runs.groupBy(*keys).agg(F.count_if("ok").alias("ok_count"), F.count(F.lit(1)).alias("total"), span.alias("wall_seconds")).withColumn(
        "per_second", F.try_divide(F.col("ok_count"), F.col("wall_seconds")))


def check_expectations(cases: DataFrame, findings: DataFrame, docs: DataFrame) -> DataFrame:
    """One row per assertion of each case (keyed by package_id).

    Keywords are tested on each finding's text where it lies and only the flags
    are aggregated; a package's findings are never put into one text.
    """
    rank = labels.lookup(K.SEVERITY_RANK, F.lower("severity"), 0)
    facts = findings.groupBy("package_id").agg(F.count(F.lit(1)).alias("n_findings"), F.max(rank).alias("max_rank"))
    kinds = docs.groupBy("package_id").agg(F.array_sort(F.collect_set("doc_type")).alias("doc_types"))
    base = cases.join(facts, "package_id", "left").join(kinds, "package_id", "left").withColumn("n_findings", F.coalesce("n_findings", F.lit(0))).withColumn("max_rank", F.coalesce("max_rank", F.lit(0)))
    allowed = labels.lookup(K.SEVERITY_RANK, F.col("severity_max"), 3)

    def row(kind, detail, ok):
        return F.struct(F.lit(kind).alias("assertion"), detail.cast("string").alias("detail"), F.coalesce(ok, F.lit(False)).alias("passed"))

    plain = base.select("package_id", F.explode(F.array(
        row("doc_types", F.array_join("expected_types", ","), F.array_sort("expected_types") == F.col("doc_types")),
        row("risk_count_min", F.col("risks_min"), F.col("n_findings") >= F.col("risks_min")),
        row("risk_count_max", F.col("risks_max"), F.col("n_findings") <= F.col("risks_max")),
        row("severity_max", F.col("severity_max"), F.col("max_rank") <= allowed))).alias("a")).select("package_id", "a.*")
    words = cases.select("package_id", F.explode(F.concat(
        F.transform("must_all", lambda k: F.struct(F.lit("must_contain").alias("kind"), k.alias("word"))),
        F.transform("must_any", lambda k: F.struct(F.lit("any_of").alias("kind"), k.alias("word"))),
        F.transform("must_not", lambda k: F.struct(F.lit("must_not_contain").alias("kind"), k.alias("word"))))).alias("w")).select("package_id", "w.*")
    text = F.lower(F.concat_ws(" ", "description", "rationale"))
    # an inner join, which can be split on the side of a package with very many findings; only words that are found come out
    said = findings.select("package_id", text.alias("body")).join(words, "package_id").where(F.contains("body", F.lower("word"))).select("package_id", "kind", "word").distinct()
    hit = words.distinct().join(said.withColumn("hit", F.lit(True)), ["package_id", "kind", "word"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    each = hit.filter("kind <> 'any_of'").select("package_id", F.col("kind").alias("assertion"), F.col("word").alias("detail"), F.when(F.col("kind") == "must_contain", F.col("hit")).otherwise(~F.col("hit")).alias("passed"))
    some = hit.filter("kind = 'any_of'").groupBy("package_id").agg(F.bool_or("hit").alias("passed"), F.array_join(F.array_sort(F.collect_set("word")), ",").alias("detail")).select(
        "package_id", F.lit("must_contain_any_of").alias("assertion"), "detail", "passed")
    return plain.unionByName(each).unionByName(some)

"""Keyword index of chunks: a posting table with upsert and delete, read by BM25.

Every call of ``upsert`` or ``delete`` writes one generation. It holds the postings of its chunks (term, chunk, count, in
folders by a hash of the term, so that a query reads the folders of its own terms) and one row for each chunk (length,
source, package, or a mark that it is deleted). Of a chunk only the latest generation counts: an upsert replaces it as
a whole. A text is cut into words once, and what repeats in it is counted before anything is shuffled. Terms with the
number of their chunks are derived anew after each write, from the postings that count.

A generation counts once its table of terms is written; one that broke off is written over by the next call.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake import constants as K
from auditlake.functions.text import tokenise
from auditlake.operators.retrieval import best_per_query

#: Folders of a generation's postings, and parts that the rows of one folder are dealt to when they are written.
BUCKETS = 32
PARTS = 4
#: Scores are summed in this fraction of one.
UNIT = 10 ** 10


def bucket_of(term: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def term_counts(tokens: Column) -> Column:
    """Distinct tokens of a row with their number, as array of struct(term, tf)."""
    # each step is bound by a lambda, so that it is made once however often the next one reads it
    ordered = F.transform(F.array(F.array_sort(tokens)), lambda s: F.struct(s.alias("s"), F.filter(F.sequence(F.lit(1), F.size(s)), lambda i: (i == 1) | (F.get(s, i - 1) != F.get(s, i - 2))).alias("at")))
    counted = F.transform(ordered, lambda x: F.transform(x["at"], lambda i, k: F.struct(F.get(x["s"], i - 1).alias("term"), (F.coalesce(F.get(x["at"], k + 1), F.size(x["s"]) + 1) - i).alias("tf"))))
    return F.when(F.size(tokens) > 0, F.get(counted, F.lit(0)))


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def _next(spark: SparkSession, path: str) -> int:
    written = _read(spark, f"{path}/totals")
    return 0 if written is None else written.agg(F.max("gen")).first()[0] + 1


def _finish(spark: SparkSession, path: str, gen: int) -> None:
    """Terms and totals of all generations up to ``gen``, as the last step of a write."""
    live, postings = _live(spark, path, gen), _postings(spark, path, gen)
    if postings is None:
        terms = spark.createDataFrame([], "term string, df bigint")
    else:
        terms = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    terms.withColumn("bucket", bucket_of(F.col("term"))).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/terms/gen={gen}")
    n_chunks, avgdl = live.agg(F.count(F.lit(1)), F.avg("dl")).first()
    known = _read(spark, f"{path}/terms/gen={gen}")
    idf = F.log(n_chunks - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    # the floor of common terms needs the mean weight of the vocabulary; it has few different numbers of chunks
    mean = (terms if known is None else known).groupBy("df").agg(F.count(F.lit(1)).alias("many")).agg(F.sum(F.col("many") * idf).alias("sum"), F.sum("many").alias("n_terms"))
    whole = mean.select(F.lit(n_chunks).cast("bigint").alias("n_chunks"), F.lit(avgdl).cast("double").alias("avgdl"), F.coalesce("n_terms", F.lit(0)).cast("bigint").alias("n_terms"), F.try_divide("sum", "n_terms").alias("mean_idf"))
    whole.write.mode("overwrite").parquet(f"{path}/totals/gen={gen}")


def upsert(chunks: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Write chunks (chunk_id, text; package_id, source if there are) to the index at ``path``; a chunk that is there is replaced.

    A chunk id stands once in ``chunks``. Null and empty texts are chunks of length 0.
    """
    spark, gen = chunks.sparkSession, _next(chunks.sparkSession, path)
    more = [F.col(c).cast("string").alias(c) if c in chunks.columns else F.lit(None).cast("string").alias(c) for c in ("package_id", "source")]
    # exploded from an array of one: what reads the counts would else be pushed below them as a filter that makes them again
    rows = chunks.select("chunk_id", *more, F.explode(F.array(term_counts(tokenise(F.col("text"))))).alias("terms"))
    length = F.aggregate(F.coalesce("terms", F.array()), F.lit(0), lambda s, t: s + t["tf"])
    sized = rows.withColumn("dl", length)
    postings = sized.select("chunk_id", "dl", F.explode("terms").alias("t")).select("t.term", "chunk_id", "t.tf", "dl").withColumn("bucket", bucket_of(F.col("term"), buckets))
    spread = postings.repartition("bucket", F.pmod(F.xxhash64("chunk_id"), F.lit(PARTS)))
    spread.sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings/gen={gen}")
    # the length alone needs no counts
    tokens = tokenise(F.col("text"))
    n_tokens = F.when(tokens.isNull(), 0).otherwise(F.size(tokens))
    chunks.select("chunk_id", *more, n_tokens.alias("dl"), F.lit(False).alias("deleted")).write.mode("overwrite").parquet(f"{path}/chunks/gen={gen}")
    _finish(spark, path, gen)


def delete(ids: DataFrame, path: str) -> None:
    """Take the chunks with these ids (chunk_id) out of the index; ids that are not there change nothing."""
    spark, gen = ids.sparkSession, _next(ids.sparkSession, path)
    there = _live(spark, path, gen - 1)
    gone = there.join(ids.select("chunk_id").distinct(), "chunk_id", "left_semi").select("chunk_id", "package_id", "source", "dl", F.lit(True).alias("deleted"))
    gone.write.mode("overwrite").parquet(f"{path}/chunks/gen={gen}")
    _finish(spark, path, gen)


def _chunks(spark: SparkSession, path: str, gen: int) -> DataFrame:
    return spark.read.parquet(f"{path}/chunks").where(F.col("gen") <= gen)


def _live(spark: SparkSession, path: str, gen: int) -> DataFrame:
    """The chunks that count: chunk_id, package_id, source, dl, gen."""
    rows = _chunks(spark, path, gen)
    if gen == 0:
        return rows.drop("deleted")
    last = rows.groupBy("chunk_id").agg(F.max_by(F.struct("package_id", "source", "dl", "deleted"), "gen").alias("x"), F.max("gen").alias("gen"))
    return last.where("not x.deleted").select("chunk_id", "x.package_id", "x.source", "x.dl", "gen")


def _postings(spark: SparkSession, path: str, gen: int) -> DataFrame | None:
    """Postings that count: term, chunk_id, tf, dl, bucket."""
    rows = _read(spark, f"{path}/postings")
    if rows is None:
        return None
    rows = rows.where(F.col("gen") <= gen)
    if gen > 0:
        every = _chunks(spark, path, gen)
        last = every.groupBy("chunk_id").agg(F.max("gen").alias("last"))
        dead = every.where("not deleted").select("chunk_id", "gen").join(last, "chunk_id").where("gen < last").select("chunk_id", "gen")
        rows = rows.join(dead, ["chunk_id", "gen"], "left_anti")
    return rows.select("term", "chunk_id", "tf", "dl", "bucket")


@dataclass
class Index:
    """An index as it stood when it was opened."""

    chunks: DataFrame
    postings: DataFrame | None
    terms: DataFrame | None
    n_chunks: int
    n_terms: int
    avgdl: float | None
    mean_idf: float | None


def open_index(spark: SparkSession, path: str) -> Index:
    """The index after its last complete write."""
    gen = _next(spark, path) - 1
    if gen < 0:
        raise ValueError(f"no index at {path}")
    totals = spark.read.parquet(f"{path}/totals/gen={gen}").first()
    return Index(_live(spark, path, gen), _postings(spark, path, gen), _read(spark, f"{path}/terms/gen={gen}"), totals["n_chunks"], totals["n_terms"], totals["avgdl"], totals["mean_idf"])


def count(spark: SparkSession, path: str) -> int:
    """Number of chunks in the index."""
    return open_index(spark, path).n_chunks


def compact(spark: SparkSession, path: str, to: str, buckets: int = BUCKETS) -> None:
    """Write what counts to a new index at ``to``, as one generation."""
    gen = _next(spark, path) - 1
    postings = _postings(spark, path, gen)
    if postings is not None:
        postings = postings.withColumn("bucket", bucket_of(F.col("term"), buckets))
        postings.repartition("bucket", F.pmod(F.xxhash64("chunk_id"), F.lit(PARTS))).sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{to}/postings/gen=0")
    _live(spark, path, gen).select("chunk_id", "package_id", "source", "dl", F.lit(False).alias("deleted")).write.parquet(f"{to}/chunks/gen=0")
    _finish(spark, to, 0)


def bm25(index: Index, queries: DataFrame, n: int, k1: float = K.BM25_K1, b: float = K.BM25_B, epsilon: float = K.BM25_EPSILON) -> DataFrame:
    """Top ``n`` chunks per query (query_id, query): (query_id, chunk_id, score, rank from 0).

    Queries are rows, as many as there are; of the postings only those of asked terms are read. Those are shuffled by chunk,
    so that a chunk's scores for all queries are summed where they arise and no pair of query and chunk is shuffled.
    Contributions are summed as whole numbers of 10^-10, so copies of a text tie.
    """
    asked = queries.select("query_id", F.explode(term_counts(tokenise(F.col("query")))).alias("t")).select("query_id", "t.term", F.col("t.tf").alias("qtf"))
    asked = asked.withColumn("bucket", bucket_of(F.col("term")))
    if index.postings is None or index.terms is None:
        kind = index.chunks.schema["chunk_id"].dataType.simpleString()
        return asked.where(F.lit(False)).select("query_id", F.lit(None).cast(kind).alias("chunk_id"), F.lit(None).cast("double").alias("score"), F.lit(None).cast("int").alias("rank"))
    idf = F.log(index.n_chunks - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    weight = F.when(idf < 0, F.lit(index.mean_idf) * epsilon).otherwise(idf)
    wanted = asked.select("bucket", "term").distinct()
    terms = index.terms.join(wanted, ["bucket", "term"]).select("bucket", "term", weight.alias("idf"))
    gain = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.lit(index.avgdl)))
    weighted = index.postings.join(terms, ["bucket", "term"]).select("term", "chunk_id", F.round(gain.cast("decimal(20,10)") * UNIT).cast("bigint").alias("gain"))
    scored = weighted.repartition("chunk_id").join(asked.drop("bucket"), "term").groupBy("query_id", "chunk_id").agg(F.sum(F.col("gain") * F.col("qtf")).alias("score"))
    return best_per_query(scored.filter("score > 0"), [F.desc("score"), "chunk_id"], n).withColumn("score", F.col("score").cast("double") / UNIT)


def stats(index: Index) -> DataFrame:
    """Size of the index by source: source, chunk_count, token_count, document_count."""
    return index.chunks.groupBy("source").agg(F.count(F.lit(1)).alias("chunk_count"), F.sum("dl").cast("bigint").alias("token_count"), F.countDistinct("package_id").alias("document_count"))

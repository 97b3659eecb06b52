"""Chunking, keyword and vector ranking, fusion and formatting of hits."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditlake import constants as K
from auditlake.functions.text import split_words


# --- chunking -----------------------------------------------------------------

#: Breaks after which a chunk may end, best first: paragraph, sentence, line, word.
_BREAKS = ["\n\n", *K.SENTENCE_MARKERS, "\n", " "]


def _ends(text: Column, max_chars: int, overlap: int) -> Column:
    """Chunks of a text as array of struct(start, stop), by the recurrence: a chunk ends after the last of the best breaks
    in its last ``overlap`` characters, and the next one starts ``overlap`` characters before that end."""
    whole = F.char_length(text)

    def stop_of(start: Column) -> Column:
        low = start + (max_chars - overlap)
        tail = F.substr(text, low + 1, F.lit(overlap))
        turned = F.reverse(tail)
        at = [F.when(F.contains(tail, F.lit(m)), F.lit(overlap + 1) - F.locate(m[::-1], turned)) for m in _BREAKS]
        return F.when(start + max_chars >= whole, whole).otherwise(low + F.coalesce(*at, F.lit(overlap)))

    def step(state: Column, _: Column) -> Column:
        last = F.element_at(state, -1)
        start = F.greatest(last["stop"] - overlap, last["start"] + 1)
        more = (last["stop"] < whole) & (start < whole - 1)
        return F.when(more, F.concat(state, F.array(F.struct(start.alias("start"), stop_of(start).alias("stop"))))).otherwise(state)

    first = F.array(F.struct(F.lit(0).alias("start"), stop_of(F.lit(0)).alias("stop")))
    # a chunk starts at least max_chars - 2 * overlap characters after the one before it, and never less than one
    rounds = F.sequence(F.lit(0), F.ceil(whole / F.lit(max(1, max_chars - 2 * overlap))).cast("int"))
    return F.aggregate(rounds, first.cast("array<struct<start:int,stop:int>>"), step)


def chunk(docs: DataFrame, max_chars: int = K.CHUNK_MAX_CHARS, overlap: int = K.CHUNK_OVERLAP_CHARS) -> DataFrame:
    """(package_id, source, doc_type, text) to chunk rows with a 0-based index.

    Each text is cut from its start, so a document stays one unit of work, one
    expression over its row.
    """
    cols = ["package_id", "source", "doc_type"]
    spans = docs.filter(F.length("text") > 0).select(*cols, F.col("text").alias("_whole"), F.posexplode(_ends(F.col("text"), max_chars, overlap)).alias("chunk_index", "_span"))
    return spans.select(*cols, "chunk_index", F.substr("_whole", F.col("_span.start") + 1, F.col("_span.stop") - F.col("_span.start")).alias("text"))


def best_per_query(rows: DataFrame, order: list, n: int) -> DataFrame:
    """First ``n`` rows per query with their rank from 0; the limit on the row number runs before the shuffle as well."""
    w = Window.partitionBy("query_id").orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n).withColumn("rank", F.col("rank") - 1)


# --- vector ranking -------------------------------------------------------------

#: Vectors of a part, queries of a block, and how many of either are compared at a time (64 MB of similarities).
VECTOR_PART, QUERY_BLOCK = 1 << 17, 4096
AT_ONCE = (8192, 1024)


def vector_topk(vectors: DataFrame, queries: DataFrame, n: int, part: int = VECTOR_PART, block: int = QUERY_BLOCK) -> DataFrame:
    """Exact cosine top ``n`` per query: (query_id, vec_id, similarity, rank from 0).

    Queries are rows like the vectors, however many there are. Vectors are dealt to parts and queries to blocks, of
    bounded size on average; a task compares one part with one block and passes on the best ``n`` of each query, so the
    last shuffle carries top lists, not scores. Of equal similarities the smaller id comes first. Rows without a vector
    or an id are left out.
    """
    vectors = vectors.select("vec_id", F.col("vector").cast("array<double>").alias("vector")).where("vec_id is not null and vector is not null")
    queries = queries.select("query_id", F.col("vector").cast("array<double>").alias("vector")).where("query_id is not null and vector is not null")
    many, asked = vectors.count(), queries.count()
    spare = min(vectors.sparkSession.sparkContext.defaultParallelism, many // 1024)
    parts, blocks = max(1, -(-many // part), spare), max(1, -(-asked // block))

    def dealt(rows: DataFrame, key: str, own: str, other: str, own_many: int, other_many: int) -> DataFrame:
        return rows.withColumn(own, F.pmod(F.xxhash64(key), F.lit(own_many)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(other_many - 1))))

    left = dealt(vectors, "vec_id", "part", "block", parts, blocks)
    right = dealt(queries, "query_id", "block", "part", blocks, parts)
    kinds = {c: t for c, t in vectors.dtypes + queries.dtypes}
    schema = f"query_id {kinds['query_id']}, vec_id {kinds['vec_id']}, similarity double"
    hits = left.groupBy("part", "block").cogroup(right.groupBy("part", "block")).applyInArrow(_nearest(n), schema)
    return best_per_query(hits, [F.desc("similarity"), "vec_id"], n)


def _unit(vectors: pa.ChunkedArray) -> np.ndarray:
    rows = vectors.combine_chunks()
    matrix = rows.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)
    length = np.linalg.norm(matrix, axis=1, keepdims=True)
    return matrix / np.where(length == 0, 1.0, length)


def _top(query: np.ndarray, ids: np.ndarray, similarity: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The best ``n`` of each query, by similarity and id."""
    order = np.lexsort((ids, -similarity, query))
    query = query[order]
    first = np.flatnonzero(np.append(True, query[1:] != query[:-1])) if len(query) else np.zeros(0, dtype=np.int64)
    nth = np.arange(len(query)) - np.repeat(first, np.diff(np.append(first, len(query))))
    kept = order[nth < n]
    return query[nth < n], ids[kept], similarity[kept]


def _nearest(n: int):
    """Function that compares the vectors and queries of one cell."""

    def run(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        found = []
        if len(vectors) and len(queries):
            ids, own, asked = vectors["vec_id"].to_numpy(), _unit(vectors["vector"]), _unit(queries["vector"])
            for q in range(0, len(asked), AT_ONCE[1]):
                best = (np.zeros(0, dtype=np.int64), ids[:0], np.zeros(0))
                for v in range(0, len(own), AT_ONCE[0]):
                    near = np.round(asked[q : q + AT_ONCE[1]] @ own[v : v + AT_ONCE[0]].T, 12)
                    # no more than the n-th largest of each query, and its equals, need be sorted
                    least = np.partition(near, -n, axis=1)[:, -n, None] if near.shape[1] > n else -np.inf
                    i, j = np.nonzero(near >= least)
                    more = (i + q, ids[v + j], near[i, j])
                    best = _top(*(np.concatenate(x) for x in zip(best, more)), n)
                found.append(best)
        query, near_ids, similarity = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0))
        kinds = queries.schema.field("query_id").type, vectors.schema.field("vec_id").type
        return pa.table({"query_id": queries["query_id"].combine_chunks().take(pa.array(query)).cast(kinds[0]), "vec_id": pa.array(near_ids).cast(kinds[1]), "similarity": pa.array(similarity)})

    return run


# --- fusion -----------------------------------------------------------------------

def fuse(vector_hits: DataFrame, keyword_hits: DataFrame, top_k: int, k: int = K.RRF_K, text_key_chars: int | None = None) -> DataFrame:
    """Reciprocal-rank fusion of (query_id, chunk_id, text, rank) lists.

    A chunk found by both lists is one hit.  With ``text_key_chars``, hits whose
    texts begin with the same characters are one: a list's last rank counts for
    it, and its first hit gives the text.
    """
    key = F.col("chunk_id") if text_key_chars is None else F.substring("text", 1, text_key_chars)

    def side(df, name):
        return df.groupBy("query_id", key.alias("key")).agg(
            F.max("rank").alias(f"{name}_rank"), F.min("rank").alias(f"{name}_first"), F.min_by(F.struct("chunk_id", "text"), "rank").alias(f"{name}_hit"))

    both = side(vector_hits, "v").join(side(keyword_hits, "b"), ["query_id", "key"], "full_outer")
    part = lambda r: F.coalesce(F.lit(1.0) / (F.lit(k + 1) + F.col(r)), F.lit(0.0))
    hit = F.coalesce("v_hit", "b_hit")
    order = F.struct(F.when(F.col("v_first").isNull(), 1).otherwise(0).alias("s"), F.coalesce("v_first", "b_first").alias("r"))
    scored = both.select("query_id", hit["chunk_id"].alias("chunk_id"), hit["text"].alias("text"), F.col("v_rank").alias("vector_rank"), F.col("b_rank").alias("keyword_rank"),
                         (part("v_rank") + part("b_rank")).alias("score"), order.alias("o"))
    return best_per_query(scored, [F.desc("score"), "o"], top_k).drop("o")


def rerank(hits: DataFrame, queries: DataFrame, weight: float = K.RERANK_WEIGHT) -> DataFrame:
    """Add the share of distinct query words that the text contains, and reorder."""
    words = queries.select("query_id", F.array_distinct(split_words(F.lower("query"))).alias("words"))
    joined = hits.join(words, "query_id")
    low = F.transform(F.array(F.lower("text")), lambda t: F.size(F.filter("words", lambda x: F.contains(t, x))))[0]
    boosted = joined.withColumn("boosted", F.col("score") + weight * low / F.greatest(F.lit(1), F.size("words"))).drop("words")
    w = Window.partitionBy("query_id").orderBy(F.desc("boosted"), "rank")
    return boosted.withColumn("new_rank", F.row_number().over(w) - 1)


def format_hits(hits: DataFrame, snippet: int = 200) -> DataFrame:
    """One text per query: source, score and snippet of each hit in order (a list bounded by top-k)."""
    short = F.concat(F.substring("text", 1, snippet), F.when(F.length("text") > snippet, "...").otherwise(""))
    line = F.concat(F.lit("[Forrás: "), F.col("source"), F.lit(", relevancia: "), F.format_string("%.3f", F.col("score")), F.lit("]\n"), short)
    rows = hits.select("query_id", F.struct(F.col("new_rank").alias("r"), line.alias("t")).alias("x"))
    return rows.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["t"]), "\n\n---\n\n").alias("output"))

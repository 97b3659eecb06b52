"""Queries over chunking and retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditlake.operators import index, retrieval
from auditlake.plans.registry import query
from auditlake.session import shared_dir

c = F.col
SIZE, OVERLAP, TOP = 2000, 200, 5


def last(marker: str) -> str:
    """0-based end offset of the last marker in the window, NULL where absent."""
    rev = marker[::-1].replace("\n", "' || chr(10) || '")
    return f"case when strpos(reverse(w), '{rev}') > 0 then length(w) - strpos(reverse(w), '{rev}') + 1 end"


def chunk_sql() -> str:
    order = ["\n\n", ". ", "! ", "? ", ".\n", "!\n", "?\n", "\n", " "]
    cut = "coalesce(" + ", ".join(last(m) for m in order) + ", length(w))"
    return f"""with recursive r as (
  select source as package_id, doc_id, text, length(text) as n, 0 as chunk_index, 0 as pos,
    case when length(text) <= {SIZE} then length(text) else (select {SIZE - OVERLAP} + {cut} from (select substr(text, {SIZE - OVERLAP + 1}, {OVERLAP}) as w)) end as stop
  from {{documents}} where length(text) > 0
  union all
  select package_id, doc_id, text, n, chunk_index + 1, np,
    case when np + {SIZE} >= n then n else np + {SIZE - OVERLAP} + (select {cut} from (select substr(text, np + {SIZE - OVERLAP + 1}, {OVERLAP}) as w)) end
  from (select *, greatest(stop - {OVERLAP}, pos + 1) as np from r where stop < n) where np < n - 1)
select package_id, doc_id, chunk_index, length(substr(text, pos + 1, stop - pos)) as n_chars, md5(substr(text, pos + 1, stop - pos)) as digest from r"""


def docs(t):
    return t.documents.select(c("source").alias("package_id"), c("doc_id").cast("string").alias("source"), F.lit("other").alias("doc_type"), "text")


@query("chunk_docs", chunk_sql())
def _(t):
    return retrieval.chunk(docs(t), SIZE, OVERLAP).select(
        "package_id", c("source").cast("bigint").alias("doc_id"), "chunk_index", F.length("text").alias("n_chars"), F.md5("text").alias("digest"))


TOKENS = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]+')"
BM25_SQL = rf"""
 d as (select doc_id as chunk_id, {TOKENS.format('text')} as w from {{documents}}), l as (select chunk_id, len(w) as dl from d),
 st as (select count(*) as n_docs, avg(dl) as avgdl from l), p as (select chunk_id, term, count(*) as tf from (select chunk_id, unnest(w) as term from d) group by 1, 2),
 df as (select term, count(*) as df from p group by 1), i0 as (select term, ln(n_docs - df + 0.5) - ln(df + 0.5) as idf from df, st), fl as (select avg(idf) * 0.25 as floor from i0),
 i as (select term, case when idf < 0 then floor else idf end as idf from i0, fl),
 qt as (select query_id, term, count(*) as qtf from (select query_id, unnest({TOKENS.format('query')}) as term from q) group by 1, 2),
 sc as (select query_id, chunk_id, sum(cast(idf * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl)) as decimal(20,10)) * qtf) as score from qt join i using (term) join p using (term) join l using (chunk_id), st group by 1, 2),
 bm as (select * from (select *, row_number() over (partition by query_id order by score desc, chunk_id) - 1 as rank from sc) where rank < 10 and score > 0)"""


def indexed(chunks):
    """The chunks written to an index of their own."""
    path = shared_dir(chunks.sparkSession, "index")
    index.upsert(chunks, path)
    return index.open_index(chunks.sparkSession, path)


@query("bm25_topk", f"with q as (select item_id as query_id, text as query from {{benchmark}}), {BM25_SQL} select query_id, chunk_id, rank, round(cast(score as double), 5) as score from bm")
def _(t):
    chunks = t.documents.select(c("doc_id").alias("chunk_id"), "text")
    queries = t.benchmark.select(c("item_id").alias("query_id"), c("text").alias("query"))
    return index.bm25(indexed(chunks), queries, 2 * TOP).withColumn("score", F.round("score", 5))


VEC_SQL = """
 qv as (select label as query_id, arg_min(embedding, vec_id) as v from {embeddings} group by 1),
 vs as (select query_id, vec_id, round(list_cosine_similarity(cast(embedding as double[]), cast(v as double[])), 12) as similarity from {embeddings}, qv),
 vr as (select * from (select *, row_number() over (partition by query_id order by similarity desc, vec_id) - 1 as rank from vs) where rank < 10)"""


def vector_queries(t):
    return t.embeddings.groupBy(c("label").cast("bigint").alias("query_id")).agg(F.min_by("embedding", "vec_id").alias("vector"))


@query("vector_topk", f"with {VEC_SQL} select query_id, vec_id, rank, round(similarity, 5) as similarity from vr")
def _(t):
    vectors = t.embeddings.select("vec_id", c("embedding").alias("vector"))
    return retrieval.vector_topk(vectors, vector_queries(t), 2 * TOP).withColumn("similarity", F.round("similarity", 5))


FUSE_SQL = f"""q as (select label as query_id, text as query from (select distinct label from {{embeddings}}) join {{benchmark}} on item_id = label), {BM25_SQL}, {VEC_SQL},
 hv as (select query_id, vec_id as chunk_id, text, rank from vr join {{documents}} on doc_id = vec_id), hb as (select query_id, chunk_id, text, rank from bm join {{documents}} on doc_id = chunk_id),
 kv as (select query_id, chunk_id as k, max(rank) as vr, min(rank) as v1, arg_min(chunk_id, rank) as vc, arg_min(text, rank) as vt from hv group by 1, 2),
 kb as (select query_id, chunk_id as k, max(rank) as br, min(rank) as b1, arg_min(chunk_id, rank) as bc, arg_min(text, rank) as bt from hb group by 1, 2),
 fu as (select *, row_number() over (partition by query_id order by score desc, s, r) - 1 as rank from (
   select query_id, coalesce(vc, bc) as chunk_id, coalesce(vt, bt) as text, vr as vector_rank, br as keyword_rank, coalesce(1.0::double / (61 + vr), 0) + coalesce(1.0::double / (61 + br), 0) as score,
     case when v1 is null then 1 else 0 end as s, coalesce(v1, b1) as r from kv full join kb using (query_id, k))),
 top as (select * from fu where rank < 5),
 re as (select *, row_number() over (partition by query_id order by boosted desc, rank) - 1 as new_rank from (
   select top.*, score + 0.1::double * len(list_filter(words, lambda x: contains(lower(text), x))) / greatest(1, len(words)) as boosted
   from top join (select query_id, list_distinct(list_filter(regexp_split_to_array(lower(query), '\\s+'), lambda x: x <> '')) as words from q) using (query_id)))"""


def query_texts(t):
    return t.sql("select cast(label as bigint) as query_id, text as query from (select distinct label from {embeddings}) join {benchmark} on item_id = label")


def fused(t):
    texts = t.documents.select(c("doc_id").alias("chunk_id"), "text")
    vectors = retrieval.vector_topk(t.embeddings.select("vec_id", c("embedding").alias("vector")), vector_queries(t), 2 * TOP)
    hv = vectors.withColumnRenamed("vec_id", "chunk_id").join(texts, "chunk_id").select("query_id", "chunk_id", "text", "rank")
    hb = index.bm25(indexed(texts), query_texts(t), 2 * TOP).join(texts, "chunk_id").select("query_id", "chunk_id", "text", "rank")
    return retrieval.fuse(hv, hb, TOP)


@query("rrf_fuse", f"with {FUSE_SQL} select query_id, chunk_id, rank, vector_rank, keyword_rank, round(score, 6) as score from top")
def _(t):
    return fused(t).select("query_id", "chunk_id", "rank", "vector_rank", "keyword_rank", F.round("score", 6).alias("score"))


@query("rerank", f"with {FUSE_SQL} select query_id, chunk_id, new_rank, round(boosted, 6) as boosted from re")
def _(t):
    return retrieval.rerank(fused(t), query_texts(t)).select("query_id", "chunk_id", "new_rank", F.round("boosted", 6).alias("boosted"))


@query("hit_format", f"""with {FUSE_SQL} select query_id, array_to_string(list('[Forrás: ' || chunk_id || ', relevancia: ' || format('{{:.3f}}', score) || ']' || chr(10) || left(text, 200) || case when length(text) > 200 then '...' else '' end order by new_rank),
  chr(10) || chr(10) || '---' || chr(10) || chr(10)) as output from re group by 1""")
def _(t):
    hits = retrieval.rerank(fused(t), query_texts(t)).withColumn("source", c("chunk_id").cast("string"))
    return retrieval.format_hits(hits)


@query("index_stats", rf"select source, count(*) as chunk_count, cast(sum(len({TOKENS.format('text')})) as bigint) as token_count, count(distinct doc_id) as document_count from {{documents}} group by 1")
def _(t):
    return index.stats(indexed(t.documents.select("source", "text", c("doc_id").alias("package_id"), c("doc_id").alias("chunk_id"))))


#: All documents are written first; then German ones are written again with other texts, and French ones deleted.
CHANGED_SQL = rf"""
d0 as (select doc_id, case when lang = 'de' then source || ' ' || left(text, 300) else text end as text, source from {{documents}} where lang <> 'fr')"""


def changed(t):
    """An index after an upsert of all documents, an upsert of some with other texts, and a delete."""
    path = shared_dir(t.spark, "index")
    chunks = t.documents.select(c("doc_id").alias("chunk_id"), "text", "source", c("doc_id").alias("package_id"), "lang")
    index.upsert(chunks, path)
    index.upsert(chunks.where("lang = 'de'").withColumn("text", F.concat("source", F.lit(" "), F.substring("text", 1, 300))), path)
    index.delete(chunks.where("lang = 'fr'"), path)
    return index.open_index(t.spark, path)


@query("index_upsert", f"with q as (select item_id as query_id, text as query from {{benchmark}}), {CHANGED_SQL}, {BM25_SQL.replace('{documents}', 'd0')} select query_id, chunk_id, rank, round(cast(score as double), 5) as score from bm")
def _(t):
    queries = t.benchmark.select(c("item_id").alias("query_id"), c("text").alias("query"))
    return index.bm25(changed(t), queries, 2 * TOP).withColumn("score", F.round("score", 5))


@query("index_upsert_stats", rf"with {CHANGED_SQL} select source, count(*) as chunk_count, cast(sum(len({TOKENS.format('text')})) as bigint) as token_count, count(distinct doc_id) as document_count from d0 group by 1")
def _(t):
    return index.stats(changed(t))

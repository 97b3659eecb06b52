"""The keyword index: upsert, delete, compaction and interrupted writes against an index made anew."""

import random

import pytest
from pyspark.sql import functions as F

from auditlake.functions.text import tokenise
from auditlake.operators import index

WORDS = ["tax", "net", "the", "law", "fee", "due", "Öre", "x_1"]


def chunks(spark, rows):
    return spark.createDataFrame(rows, "chunk_id long, text string, package_id string, source string")


def row(r, i):
    return (i, " ".join(r.choice(WORDS) for _ in range(r.randrange(0, 14))) or None, f"p{i % 5}", f"s{i % 3}")


def answers(spark, path):
    asked = spark.createDataFrame([(1, "Tax law, tax the"), (2, "öre fee X_1"), (3, "nowhere"), (4, None)], "query_id int, query string")
    held = index.open_index(spark, path)
    hits = sorted((r.query_id, r["rank"], r.chunk_id, round(r.score, 8)) for r in index.bm25(held, asked, 6).collect())
    return hits, sorted(map(tuple, index.stats(held).collect())), held.n_chunks, held.n_terms, sorted(map(tuple, held.terms.select("term", "df").collect()) if held.terms is not None else [])


def test_changes_equal_an_index_made_anew(spark, tmp_path):
    r = random.Random(2)
    now = {i: row(r, i) for i in range(60)}
    path = str(tmp_path / "a")
    index.upsert(chunks(spark, list(now.values())), path)
    more = {i: row(r, i) for i in list(range(40, 80))}
    now.update(more)
    index.upsert(chunks(spark, list(more.values())), path)
    gone = spark.createDataFrame([(i,) for i in (3, 45, 79, 1000, 3)], "chunk_id long")
    index.delete(gone, path)
    for i in (3, 45, 79):
        del now[i]
    back = {45: row(r, 45)}
    now.update(back)
    index.upsert(chunks(spark, list(back.values())), path)
    anew, small = str(tmp_path / "b"), str(tmp_path / "c")
    index.upsert(chunks(spark, list(now.values())), anew)
    index.compact(spark, path, small)
    assert answers(spark, path) == answers(spark, anew) == answers(spark, small)
    assert index.count(spark, path) == len(now)
    assert {f.name for f in (tmp_path / "c" / "postings").iterdir() if f.is_dir()} == {"gen=0"}


def test_a_write_that_broke_off_counts_for_nothing(spark, tmp_path):
    r = random.Random(3)
    rows = [row(r, i) for i in range(20)]
    path = str(tmp_path / "a")
    index.upsert(chunks(spark, rows), path)
    before = answers(spark, path)
    # chunks and postings of a second generation, but neither terms nor totals
    later = chunks(spark, [(1, "tax tax tax", "p", "s")])
    later.select("chunk_id", "package_id", "source", F.lit(3).alias("dl"), F.lit(False).alias("deleted")).write.parquet(f"{path}/chunks/gen=1")
    later.select(F.lit("tax").alias("term"), "chunk_id", F.lit(3).alias("tf"), F.lit(3).alias("dl"), index.bucket_of(F.lit("tax")).alias("bucket")).write.partitionBy("bucket").parquet(f"{path}/postings/gen=1")
    assert answers(spark, path) == before
    index.upsert(chunks(spark, [(1, "law law", "p1", "s1")]), path)
    index.upsert(chunks(spark, [(1, "law law", "p1", "s1"), *[x for x in rows if x[0] != 1]]), str(tmp_path / "b"))
    assert answers(spark, path) == answers(spark, str(tmp_path / "b"))


def test_empty_indexes(spark, tmp_path):
    path = str(tmp_path / "a")
    with pytest.raises(ValueError):
        index.open_index(spark, path)
    index.upsert(chunks(spark, []), path)
    assert answers(spark, path) == ([], [], 0, 0, [])
    index.upsert(chunks(spark, [(1, None, "p", "s"), (2, "!!", "p", "s")]), path)
    assert answers(spark, path) == ([], [("s", 2, 0, 1)], 2, 0, [])
    index.upsert(chunks(spark, [(1, "tax", "p", "s")]), path)
    index.delete(spark.createDataFrame([(1,), (2,)], "chunk_id long"), path)
    assert answers(spark, path)[1:] == ([], 0, 0, [])


def test_term_counts(spark):
    rows = spark.createDataFrame([(1, "b a B c a b"), (2, ""), (3, None), (4, "z " * 4000 + "y")], "i int, t string")
    got = {r.i: [(x.term, x.tf) for x in r.c or []] for r in rows.select("i", index.term_counts(tokenise(F.col("t"))).alias("c")).collect()}
    assert got == {1: [("a", 2), ("b", 3), ("c", 1)], 2: [], 3: [], 4: [("y", 1), ("z", 4000)]}


def test_only_asked_folders_are_read(spark, tmp_path):
    r = random.Random(5)
    path = str(tmp_path / "a")
    index.upsert(chunks(spark, [row(r, i) for i in range(30)]), path)
    hits = index.bm25(index.open_index(spark, path), spark.createDataFrame([(1, "tax")], "query_id int, query string"), 3)
    assert "dynamicpruning" in hits._jdf.queryExecution().executedPlan().toString().lower()

import pytest
from pyspark.sql import functions as F

from auditlake.operators import index


@pytest.fixture
def shelf(spark, tmp_path):
    rows = [(i, " ".join(w for k, w in enumerate(["alpha", "beta", "gamma", "delta", "eps"]) if (i >> k) & 1) + " common") for i in range(64)] + [(64, None), (65, "")]
    index.upsert(spark.createDataFrame(rows, "chunk_id long, text string"), str(tmp_path))
    return index.open_index(spark, str(tmp_path))


def test_scores_are_summed_where_postings_of_a_chunk_lie(spark, shelf, tmp_path_factory):
    """No pair of query and chunk is shuffled before it is summed: the plan deals postings by chunk alone, and pairs by query only."""
    at = str(tmp_path_factory.mktemp("queries") / "q.parquet")
    spark.createDataFrame([(q, "alpha beta gamma") for q in range(5)], "query_id long, query string").write.parquet(at)
    queries = spark.read.parquet(at)
    plan = index.bm25(shelf, queries, 3)._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.splitlines() if "hashpartitioning(" in line]
    assert any("hashpartitioning(chunk_id" in line for line in dealt)
    assert not any("hashpartitioning(query_id" in line and "chunk_id" in line.split("hashpartitioning(")[1].split(")")[0] for line in dealt)


def test_lengths_of_null_and_empty_texts(spark, shelf):
    lengths = {r.chunk_id: r.dl for r in shelf.chunks.filter(F.col("chunk_id").isin(0, 31, 64, 65)).collect()}
    assert lengths == {0: 1, 31: 6, 64: 0, 65: 0}

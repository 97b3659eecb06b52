import duckdb
from pyspark.sql import functions as F

import __spark_entry__ as entry
from auditlake.functions.text import _uppers, upper


def test_upper_goes_character_by_character(spark):
    """As DuckDB does: one character stays one."""
    words = ["En\u00dfst", "abc", "", None, *_uppers()[0]]
    got = [r[0] for r in spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, w string").orderBy("i").select(upper(F.col("w"))).collect()]
    assert got == [duckdb.execute("select upper(?)", [w]).fetchone()[0] for w in words]


def test_question_starting_with_an_eszett_is_found(spark, tmp_path):
    rows = [(conv, turn, role, text) for conv, answer in ((1, "nau der, ber\u00df sich"), (3, "nau der, berss sich")) for turn, role, text in ((0, "user", "Er\u00df der"), (1, "assistant", answer))]
    rows += [(-7, 0, "user", "abc"), (-7, 1, "assistant", "xABCx")]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    for name in ("eval_pass", "eval_by_cat"):
        got = entry.queries()[name](spark, str(tmp_path)).toPandas()
        want = con.execute(entry.oracle_sql()[name]).df()
        key = [str(x) for x in want.columns]
        assert sorted(map(str, got[key].values.tolist())) == sorted(map(str, want.values.tolist()))

"""Validation of documents runs no rule whose findings it drops, and reads headers once for its own."""

import __spark_entry__ as entry
from auditlake.functions import numbers, text
from pyspark.sql import functions as F


def test_validate_one_leaves_dispatched_rules_out(spark):
    plan = entry.queries()["validate_one"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "CDV invalid" in plan and "Sanctions list match" not in plan


def test_strip_and_plain_decimals_as_before(spark):
    rows = ["", " a ", "a", " x y　", "é ", "1.5", "12", "1.5\n", "-3", "1.234.5", "(7)", "12d", None]
    got = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, t string").orderBy("i").select(text.strip(F.col("t")), numbers.coerce_number(F.col("t"))).collect()
    assert [r[0] for r in got] == [None if r is None else r.strip() for r in rows]
    assert [r[1] for r in got] == [None, None, None, None, None, 1.5, 12.0, 1.5, -3.0, 1234.5, -7.0, None, None]

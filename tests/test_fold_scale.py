"""Folding of quotes and texts: the same result with few tests a character."""

from pyspark.sql import functions as F

from auditlake.functions import text


def test_classes_leave_ascii_at_the_first_test_and_ranges_behind_their_hull():
    assert text._wide_class().startswith(r"[\x{80}-\x{10FFFF}&&[")
    many = [chr(0x100 + 2 * i) for i in range(5 * text.RANGES_TOGETHER)]
    assert text._ranges(many).count("&&") == 1 + 5


def test_fold_collapses_whitespace_of_any_kind(spark):
    rows = ["", " ", " a  b ", "\t\n x y  z \n", "a b c", "É 　É", "  a\r\nb ", "ﬁ\u0085 ½​ x", "가 나 다"]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string").orderBy("i").select(text.fold(F.col("t"))).collect()]
    plain = text.strip(F.regexp_replace(F.lower(text.strip_accents(F.col("t"))), r"(?U)\s+", " "))
    assert got == [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string").orderBy("i").select(plain).collect()]
    assert got[2:5] == ["a b", "x y z", "a b c"]

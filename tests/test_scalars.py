import datetime as dt

import pytest
from pyspark.sql import functions as F

from auditlake.functions import dates, labels, match, numbers, text

c = F.col


def column(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(expr(c("x")).alias("y")).collect()]


NUMBERS = [
    ("1 234 567", 1234567.0), ("1.234,56", 1234.56), ("1,234.56", 1234.56), ("190 500 Ft", 190500.0), ("$1,234", 1234.0), ("n/a", None),
    ("-", None), ("—", None), ("(1234)", -1234.0), ("1,23", 1.23), ("1,234", 1234.0), ("1.2.3", 12.3), ("12d", None), ("true", None), (None, None),
    ("", None), ("+", None), ("1e3", 1000.0), ("EUR 5", 5.0), ("5 eur", 5.0), ("inf", float("inf")), ("1_000", 1000.0), ("1,2,3,45", 123.45), ("1.234,567.89", None),
]


def test_coerce_number(spark):
    assert column(spark, [n for n, _ in NUMBERS], numbers.coerce_number) == [v for _, v in NUMBERS]


def test_parse_money_has_no_currency(spark):
    assert column(spark, ["$5", "1 234,5", "(5)", "2.500,00"], numbers.parse_money) == [None, 1234.5, None, 2500.0]


DATES = [
    ("2026-2-3", dt.date(2026, 2, 3)), ("2026.02.03.", dt.date(2026, 2, 3)), ("03.02.2026", dt.date(2026, 2, 3)), ("03/02/2026", dt.date(2026, 2, 3)),
    ("2026-02-31", None), ("2026/02/03", dt.date(2026, 2, 3)), (" 2026-02-03T10:00", dt.date(2026, 2, 3)), ("26-02-03", None), ("n/a", None), (None, None),
    ("2026-02/03", None), ("3/2/2026.", None),
]


def test_parse_date(spark):
    assert column(spark, [d for d, _ in DATES], dates.parse_date) == [v for _, v in DATES]


def test_iso_prefix_date(spark):
    got = column(spark, ["2026-03-01 late", "2026-3-1", "2026.03.01", None], dates.iso_prefix_date)
    assert got == [dt.date(2026, 3, 1), None, None, None]


def test_iso_parts_have_no_calendar(spark):
    assert column(spark, ["x"], lambda x: dates.iso_parts(F.lit("2026"), F.lit("2"), F.lit("29"))) == ["2026-02-29"]


def test_expiring(spark):
    asof = F.lit("2025-12-01").cast("date")
    got = column(spark, ["2026-08-01", "2026-12-31", "2027-01-01", "2025-11-30", "none"], lambda x: dates.expiring_soon(x, asof))
    assert got == [True, True, False, False, False]


def test_null_alias(spark):
    values = [None, "", "  ", " N/A ", "Nincs", "keine", "?", "x", "0"]
    assert column(spark, values, text.is_null_alias) == [True, True, True, True, True, True, True, False, False]


def test_fold(spark):
    got = column(spark, ["  Ár Vízi\n\nŐz ", "ﬁne ½ … Ⅳ", "éa", None], text.fold)
    assert got == ["ar vizi oz", "fine 1⁄2 ... iv", "ea", ""]


def test_tokens_and_words(spark):
    assert column(spark, ["Árvíz_1, tűrő!"], text.tokenise) == [["árvíz_1", "tűrő"]]
    assert sorted(column(spark, ["The (Invoice) and a b invoice/total"], text.content_words)[0]) == ["invoice", "total"]


def test_tax_id(spark):
    got = column(spark, ["12345676-2-41", "12345675-2-41", "1234", "12345676 2 41", None], match.tax_id_valid)
    digits = [9 * 1 + 7 * 2 + 3 * 3 + 4 + 9 * 5 + 7 * 6 + 3 * 7]
    expected = (10 - digits[0] % 10) % 10
    assert got == [expected == 6, expected == 5, None, expected == 6, None]


@pytest.mark.parametrize("a,b,want", [
    ("steel beam", "steel beam", True), ("a b c d", "a b c e", False), ("a b c d e", "a b c d f", True), ("a b c d e", "a b c d e f", True), ("a b c d e", "a b c d e f2", False),
    ("", "", False), ("one two", "one three", False),
])
def test_names_alike(spark, a, b, want):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert df.select(match.names_alike(c("a"), c("b"))).first()[0] is want


def test_name_contains(spark):
    df = spark.createDataFrame([("Gazprom Export", "gazprom"), ("bank", "VTB Bank"), ("x", ""), (None, "y")], "a string, b string")
    assert [r[0] for r in df.select(match.name_contains(c("a"), c("b"))).collect()] == [True, True, False, False]


@pytest.mark.parametrize("a,b,tier", [(0.0, 0.0, None), (None, 1.0, None), (100.0, 101.0, "ok"), (1000.0, 1010.0, "ok"), (1000.0, 1050.0, "warning"), (1000.0, 1100.0, "critical"), (0.0, 5.0, "critical")])
def test_amount_tier(spark, a, b, tier):
    df = spark.createDataFrame([(a, b)], "a double, b double")
    assert df.select(numbers.amount_tier(c("a"), c("b"))).first()[0] == tier


def test_is_round(spark):
    assert column(spark, [10417.0, 10000.0, 20000.0, -20000.0, 20001.0], numbers.is_round, "double") == [False, False, True, True, False]


def test_general(spark):
    assert column(spark, [5.0, 2.5, 0.25, -3.0], numbers.general, "double") == ["5", "2.5", "0.25", "-3"]


def test_list_markup(spark):
    got = column(spark, [None, "<item> a </item><item></item>", "- a\n2) b\n\n", " only ", "  "], text.list_markup)
    assert got == [[], ["a"], ["a", "b"], ["only"], []]


def test_labels(spark):
    assert column(spark, ["Kritikus", "INFO", "odd"], labels.severity) == ["high", "info", "odd"]
    assert column(spark, ["invoice", "letter"], labels.evidence_score) == [8, 3]
    assert column(spark, ["invoice", "letter"], labels.doc_label) == ["Invoice", "Other"]
    assert column(spark, [0.8, 0.81], labels.confidence_label, "double") == ["uncertain", "confident"]


def test_strip_accents_of_every_character(spark):
    """Each code point alone and between others equals the public decomposition without marks."""
    import unicodedata

    bare = lambda t: "".join(x for x in unicodedata.normalize("NFKD", t) if not unicodedata.combining(x))
    every = [chr(i) for i in range(1, 0x110000) if not 0xD800 <= i <= 0xDFFF]
    rows = ["".join(every[i : i + 500]) for i in range(0, len(every), 500)] + every[0x80:0x3000:7] + ["a\ufb01b\uac01c \u00bd", "", "\ud7a3\uac00"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string").repartition(8).select("i", text.strip_accents(F.col("t")).alias("b")).collect()
    assert len(got) == len(rows)
    wrong = [(rows[r.i][:5], r.b[:5]) for r in got if r.b != bare(rows[r.i])]
    assert not wrong, wrong[:5]

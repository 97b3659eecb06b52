"""Classification and extraction: one pass over the texts, patterns only where they can occur, spans only where they are asked for."""

import re

from pyspark.sql import functions as F

from auditlake import constants as K
from auditlake.operators import extract
from auditlake.plans import extraction
from auditlake.sources.views import Tables


def test_file_texts_are_the_rows_of_the_view_in_one_pass(spark):
    t = Tables(spark, "/root/testdata/sf0.001")
    rows = extraction.file_texts(t)
    assert rows.exceptAll(t.v_file_text).isEmpty() and t.v_file_text.exceptAll(rows).isEmpty()
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("Relation") < t.v_file_text._jdf.queryExecution().optimizedPlan().toString().count("Relation")


def test_unasked_fields_are_not_searched(spark):
    docs = spark.createDataFrame([("a", "invoice", "Invoice number: 7; Issue date: 2020-01-02")], "file_name string, doc_type string, text string")
    out = extract.extract_all(docs)
    assert (out.first().invoice_number, out.first().issue_date) == ("7", "2020-01-02")
    asked = out.select("invoice_number")._jdf.queryExecution().optimizedPlan().toString()
    assert "Rechnungsnummer" in asked and "Rechnungsdatum" not in asked


def test_stems_pass_every_form_of_the_patterns(spark):
    forms = ["Delivery  note", "SHIPPING note", "szallitolevel", "Lieferschein", "purchase order", "ORDER number", "order confirmation", "megrendeles", "Bestellung", "contract", "agreement",
             "NDA", "non disclosure", "szerzodest", "titoktartas", "kotber", "felmondas", "VERTRAG", "income statement", "profit & loss", "p&l", "Balance Sheet", "cash flow", "financial statement",
             "eredmenykimutatas", "merleg", "penzugyi", "Bilanz", "Gewinn- und Verlustrechnung", "invoice", "szamla", "sz.szam", "Rechnung", "non‑disclosure", "caſh flow", "Kotber", "standard", "orders", "", None]
    def plain(x):
        return next((k for k, p in K.CLASSIFY_PATTERNS if re.search(p, x, re.I)), None) if x is not None else None
    got = [r[0] for r in spark.createDataFrame([(i, f) for i, f in enumerate(forms)], "i int, f string").orderBy("i").select(extract.keyword_type(F.col("f"), F.lit(None).cast("string"))).collect()]
    assert got == [plain(f) for f in forms]

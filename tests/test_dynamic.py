"""Payloads read as VARIANT: universal fields, order of other names, nulls that are there and fields that are not."""

import json

from pyspark.sql import functions as F

from auditlake.operators import dynamic, matching


def flat(spark, payloads, doc_type="invoice"):
    rows = [(i, p if isinstance(p, str) or p is None else json.dumps(p), doc_type) for i, p in enumerate(payloads)]
    docs = spark.createDataFrame(rows, "doc_id int, payload string, doc_type string")
    got = dynamic.flat_payloads(docs).select("doc_id", F.to_json("flat").alias("flat"), "fields").orderBy("doc_id").collect()
    return [(None if r.flat is None else json.loads(r.flat), r.fields) for r in got]


WHOLE = {
    "document_number": "D-1", "document_type": "bill",
    "dates": {"issue": "2024-01-02", "fulfillment": "2024-01-03", "payment_due": "2024-02-01", "effective": "2024-03-01", "expiry": "2025-03-01", "signature": "2024-01-01"},
    "amounts": {"total_net": 100, "total_vat": 27.5, "total_gross": "127,5", "currency": "EUR"},
    "parties": [{"name": "B", "role": "The Buyer"}, {"name": "S", "role": "SELLER of goods", "tax_id": "1"}],
    "line_items": [{"name": "bolt", "qty": 2}],
    "contract_elements": {"contract_type": "lease", "termination_terms": "30 days", "penalty": {"amount": 5}, "confidentiality_clause": False, "governing_law": "HU", "key_clauses": [{"name": "Term", "content": "x"}]},
    "_quotes": ["q"], "_confidence": {"total_net": "high"}, "_source": {"file_name": "a.pdf"},
}


def test_every_field_of_a_universal_payload(spark):
    ((got, fields),) = flat(spark, [WHOLE])
    assert got == {
        "invoice_number": "D-1", "document_number": "D-1", "document_type": "bill", "issue_date": "2024-01-02", "fulfillment_date": "2024-01-03", "payment_due_date": "2024-02-01",
        "effective_date": "2024-03-01", "expiry_date": "2025-03-01", "signature_date": "2024-01-01", "total_net": 100, "total_vat": 27.5, "total_gross": "127,5", "currency": "EUR",
        "issuer": {"name": "S", "role": "SELLER of goods", "tax_id": "1"}, "customer": {"name": "B", "role": "The Buyer"}, "line_items": [{"name": "bolt", "qty": 2}], "contract_type": "lease",
        "termination_terms": "30 days", "penalty": {"amount": 5}, "confidentiality_clause": False, "governing_law": "HU", "key_clauses": [{"name": "Term", "content": "x"}],
        "_quotes": ["q"], "_confidence": {"total_net": "high"}, "_source": {"file_name": "a.pdf"}}
    assert fields == sorted(got)


def test_nulls_empties_and_other_shapes(spark):
    got = flat(spark, [
        {"amounts": {"currency": None}}, {"amounts": None}, {"amounts": {"total_net": 0, "currency": ""}}, {"dates": None, "parties": [], "line_items": [], "_source": {}},
        {"parties": [{"name": "x"}], "total": 5}, {}, "[1, 2]", "no json", None, {"document_type": "", "parties": ["a", {"name": "B"}]}])
    kinds = [f for f, _ in got]
    assert kinds[0] == {"document_type": "invoice"}  # a currency that is null stays null
    assert kinds[1] == kinds[3] == {"document_type": "invoice", "currency": "USD"}
    assert kinds[2] == {"document_type": "invoice", "total_net": 0, "currency": ""}
    assert kinds[4:9] == [None] * 5 and got[4][1] == ["parties", "total"] and got[7][1] is None and got[8][1] is None
    assert kinds[9] == {"document_type": "invoice", "currency": "USD", "customer": {"name": "B"}}


def test_parties_by_role_then_by_place(spark):
    def parties(*listed):
        ((got, _),) = flat(spark, [{"document_number": 1, "parties": list(listed)}])
        return got.get("issuer", {}).get("name"), got.get("customer", {}).get("name")

    one, two = {"name": "1", "role": "lessee"}, {"name": "2", "role": None}
    assert parties(one, two) == ("1", "1")  # no issuer by role, so the first; a customer by role
    assert parties(two, one) == ("2", "1")
    assert parties({"name": "v", "role": "vendor and buyer"}, two) == ("v", "2")
    assert parties(two) == ("2", None) and parties() == (None, None)
    assert parties({"name": "a", "role": "seller"}, {"name": "b", "role": "supplier"}, {"name": "c", "role": "Buyer"}) == ("a", "c")


def test_names_are_tried_in_order(spark):
    payloads = [
        {"gross_amount": 3, "gross_total": 2, "total_gross": 1}, {"total_gross": None, "gross_total": "2 000,50 Ft"}, {"total_gross": "n/a", "brutto_osszeg": 7}, {"brutto_vegosszeg_huf": "9"},
        {"netto_osszeg": 4, "net_total": "(5)"}, {"value": 1, "total": True, "ertek": 8}, {"amount": [], "osszeg": 0}, {}]
    docs = spark.createDataFrame([(i, json.dumps(p)) for i, p in enumerate(payloads)] + [(8, "{"), (9, None)], "i int, payload string")
    got = [(r.total_gross, r.total_net, r.amount) for r in dynamic.amounts(docs).orderBy("i").collect()]
    assert got == [(1, None, None), (2000.5, None, None), (7, None, None), (9, None, None), (None, -5, None), (None, None, 1), (None, None, 0), (None, None, None), (None, None, None), (None, None, None)]


def test_items_under_any_name(spark):
    listed = [{"sku": "", "code": "  A1 ", "name": "Bolt", "description": "", "db": "3 "}, "text", {"item_code": 0, "cikkszam": 17, "megnevezes": " Nut", "quantity": None, "qty": 2.5}, {}, None]
    docs = spark.createDataFrame([(1, json.dumps({"line_items": listed})), (2, "{}"), (3, '{"line_items": 5}'), (4, None)], "doc_id int, payload string")
    got = [tuple(r) for r in dynamic.items(docs).orderBy("ord").collect()]
    assert got == [(1, 0, "a1", "bolt", 3.0), (1, 2, "17", "nut", 2.5), (1, 3, "", "", None)]


def test_trio_from_payloads(spark):
    rows = [("p", 1, "invoice", 2, {"brutto_osszeg": 120, "net_total": 100, "issue_date": "2024-01-01"}), ("p", 1, "invoice", 1, {"total_gross": "130", "issue_date": "2024-01-05"}),
            ("p", 1, "purchase_order", 1, {"gross_amount": 130.0, "issue_date": "2024-01-09"}), ("p", 1, "delivery_note", 1, {"ertek": 5}), ("p", 2, "invoice", 1, {"total": 5})]
    docs = spark.createDataFrame([(*r[:4], json.dumps(r[4])) for r in rows], "package_id string, doc_id int, doc_type string, doc_ord int, payload string")
    heads = dynamic.trio_headers(docs, matching.KEYS)
    (got,) = heads.collect()
    assert (got.invoice_total_gross, got.invoice_total_net, got.purchase_order_total_gross, got.delivery_note_amount, got.purchase_order_date) == (130, None, 130, 5, "2024-01-09")
    results = matching.explode_results(heads, [matching.levelled_amounts(a, b, i, set(heads.columns)) for i, (a, b) in enumerate(matching.PAIRS)] + [matching.date_result(F.col("invoice_date"), F.col("purchase_order_date"), 6)])
    assert sorted((r.seq, r.severity) for r in results.collect()) == [(0, "ok"), (6, "warning")]

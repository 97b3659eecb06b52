"""Typed reading of JSON payloads by document type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PARTY = "struct<name:string,tax_id:string,address:string,role:string,contact:string>"
ITEM = ("struct<item_code:string,description:string,quantity:double,unit:string,unit_price_net:double,vat_rate:double,"
        "total_net:double,total_vat:double,total_gross:double>")
COMMON = "_quotes array<string>, _confidence map<string,string>, _source struct<file_name:string,page_number:int>"

#: Payload schema of each document type; other types use the universal one.
PAYLOADS = {
    "invoice": f"invoice_number string, issue_date string, fulfillment_date string, payment_due_date string, payment_method string, currency string, "
               f"issuer {PARTY}, customer {PARTY}, line_items array<{ITEM}>, total_net double, total_vat double, total_gross double, {COMMON}",
    "contract": f"contract_type string, parties array<{PARTY}>, effective_date string, expiry_date string, total_value double, currency string, monthly_fee double, "
                "monthly_fee_currency string, termination_terms string, termination_period_days int, penalty struct<amount:double,condition:string>, "
                "confidentiality_clause boolean, governing_law string, auto_renewal struct<enabled:boolean,condition:string>, change_of_control boolean, "
                f"non_compete boolean, key_clauses array<struct<name:string,content:string>>, {COMMON}",
    "delivery_note": f"document_number string, issue_date string, delivery_date string, purchase_order_reference string, supplier {PARTY}, customer {PARTY}, "
                     f"line_items array<{ITEM}>, notes string, {COMMON}",
    "purchase_order": f"document_number string, date string, delivery_due_date string, payment_due_date string, supplier {PARTY}, customer {PARTY}, "
                      f"line_items array<{ITEM}>, total_net double, total_vat double, total_gross double, {COMMON}",
    "financial_report": "report_type string, period_start string, period_end string, company_name string, accounting_standard string, "
                        f"line_items array<struct<description:string,value:double,value_prior_period:double>>, revenue double, net_income double, {COMMON}",
    "universal": f"document_type string, document_number string, document_language string, parties array<{PARTY}>, "
                 "dates struct<issue:string,fulfillment:string,payment_due:string,effective:string,expiry:string,signature:string>, "
                 "amounts struct<total_net:double,total_vat:double,total_gross:double,currency:string>, "
                 f"line_items array<{ITEM}>, contract_elements struct<contract_type:string,termination_terms:string,penalty:string,confidentiality_clause:boolean,"
                 f"governing_law:string,key_clauses:array<struct<name:string,content:string>>>, {COMMON}",
}


def schema_name(doc_type: Column, schemas=None) -> Column:
    known = [k for k in (schemas or PAYLOADS) if k != "universal"]
    return F.when(doc_type.isin(known), doc_type).otherwise(F.lit("universal"))


def read_payloads(docs: DataFrame, json: str = "payload", schemas: dict | None = None) -> DataFrame:
    """Add one struct column per schema, filled where the document is of that type.

    Unknown fields are ignored; a payload that does not parse keeps NULL fields
    and its text in ``_corrupt``.
    """
    schemas = schemas or PAYLOADS
    name = schema_name(F.col("doc_type"), schemas)
    out = docs.withColumn("schema_name", name)
    for k, s in schemas.items():
        out = out.withColumn(k, F.when(F.col("schema_name") == k, F.from_json(F.col(json), s, {"mode": "PERMISSIVE"})))
    bad = F.col(json).isNotNull() & F.try_parse_json(F.col(json)).isNull()
    return out.withColumn("_corrupt", F.when(bad, F.col(json)))

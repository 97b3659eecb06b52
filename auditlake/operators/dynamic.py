"""Payloads whose fields are not known beforehand, read as VARIANT: universal ones made flat, and fields under other names.

A JSON text is parsed once; every field is a path into the parsed value, so a name that a payload does not have costs
nothing but its look-up. JSON null, a missing field and an empty list differ where it matters: a field counts as there
if its key is, whatever its value.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake import constants as K
from auditlake.functions.numbers import coerce_number
from auditlake.functions.text import let, strip

NUMBERS = r"^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$"


def get(value: Column, path: str) -> Column:
    """The part of a VARIANT at ``a.b.c``; NULL if it is not there (JSON null is there)."""
    return F.try_variant_get(value, "$." + path, "variant")


def text(value: Column) -> Column:
    """A part as text; NULL for JSON null."""
    return F.try_variant_get(value, "$", "string")


def kind(value: Column) -> Column:
    """BIGINT, STRING, OBJECT<…>, ARRAY<…>, VOID …"""
    return F.schema_of_variant(value)


def number(value: Column) -> Column:
    """A JSON number as it is, a text by the tolerant reading of numbers, NULL for all else."""
    def read(v: Column, k: Column) -> Column:
        return F.when(k.rlike(NUMBERS), F.try_variant_get(v, "$", "double")).when(k == "STRING", coerce_number(text(v)))

    return let(value, lambda v: F.when(v.isNotNull(), let(kind(v), lambda k: read(v, k))))


def first_number(value: Column, names: list[str]) -> Column:
    """The first of the fields that reads as a number."""
    return F.coalesce(*[number(get(value, n)) for n in names])


def says(value: Column) -> Column:
    """Whether a part is neither null, blank, zero, false nor empty."""
    k = kind(value)
    return value.isNotNull() & (k != "VOID") & ~k.isin("ARRAY<VOID>", "OBJECT<>") & ~(
        F.when(k == "STRING", text(value) == "").when(k == "BOOLEAN", ~F.try_variant_get(value, "$", "boolean")).when(k.rlike(NUMBERS), F.try_variant_get(value, "$", "double") == 0).otherwise(False))


def first_text(value: Column, names: list[str]) -> Column:
    """The first of the fields that says something, in lower case and stripped; blank if none does."""
    return F.coalesce(*[F.when(says(get(value, n)), strip(F.lower(text(get(value, n))))) for n in names], F.lit(""))


def gross_amount(value: Column) -> Column:
    return first_number(value, K.GROSS_FIELDS)


def net_amount(value: Column) -> Column:
    return first_number(value, K.NET_FIELDS)


def plain_amount(value: Column) -> Column:
    return first_number(value, K.AMOUNT_FIELDS)


def amounts(docs: DataFrame, payload: str = "payload") -> DataFrame:
    """``docs`` with total_gross, total_net and amount of a JSON payload, whatever their names in it."""
    value = F.try_parse_json(F.col(payload))
    return docs.withColumn("_value", value).withColumns({"total_gross": gross_amount(F.col("_value")), "total_net": net_amount(F.col("_value")), "amount": plain_amount(F.col("_value"))}).drop("_value")


def items(docs: DataFrame, payload: str = "payload", listed: str = "line_items") -> DataFrame:
    """One row for each line item of a JSON payload: the other columns, ord (from 0), item_code, description and quantity, whatever their names.

    What is not an object among the items is left out; it keeps its number.
    """
    others = [F.col(c) for c in docs.columns if c != payload]
    rows = docs.select(*others, F.posexplode(F.try_variant_get(F.try_parse_json(F.col(payload)), f"$.{listed}", "array<variant>")).alias("ord", "_item"))
    item = F.col("_item")
    objects = rows.where(kind(item).startswith("OBJECT"))
    return objects.select(
        *others, "ord", first_text(item, K.CODE_FIELDS).alias("item_code"), first_text(item, K.DESCRIPTION_FIELDS).alias("description"), first_number(item, K.QUANTITY_FIELDS).alias("quantity"))


def trio_headers(docs: DataFrame, keys: list[str], payload: str = "payload", date: str = "issue_date") -> DataFrame:
    """Documents of the trio types to one row per ``keys`` with their amounts under any name, as ``matching.three_way`` reads them.

    Of several documents of a type the first by doc_ord counts. Only ``keys`` that have all three types stay.
    """
    read = amounts(docs.where(F.col("doc_type").isin(K.TRIO_TYPES)), payload).withColumn("_date", text(get(F.try_parse_json(F.col(payload)), date)))
    value = F.struct("total_gross", "total_net", "amount", F.col("_date").alias("date"))
    firsts = read.groupBy(*keys).agg(*[F.min_by(value, F.when(F.col("doc_type") == k, F.col("doc_ord"))).alias(k) for k in K.TRIO_TYPES])
    whole = firsts.where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in K.TRIO_TYPES]))
    return whole.select(*keys, *[F.col(f"{k}.{f}").alias(f"{k}_{f}") for k in K.TRIO_TYPES for f in ("total_gross", "total_net", "amount", "date")])


# --- universal payloads -----------------------------------------------------------

def is_universal(value: Column) -> Column:
    """Whether a payload has one of the parts that only the universal shape has (a null part counts)."""
    return F.coalesce(reduce(lambda a, b: a | b, [get(value, k).isNotNull() for k in K.UNIVERSAL_MARKS]), F.lit(False))


def _kept(value: Column) -> Column:
    """NULL for JSON null and for what is empty; FALSE, zero and blank text stay."""
    return F.when(~kind(value).isin("VOID", "ARRAY<VOID>", "OBJECT<>"), value)


def _with_role(parties: Column, words: list[str], but: list[str] | None = None) -> Column:
    """The first party whose role holds one of the words and none of ``but``."""
    def role_is(p: Column, listed: list[str]) -> Column:
        role = F.lower(F.coalesce(text(get(p, "role")), F.lit("")))
        return reduce(lambda a, b: a | b, [F.contains(role, F.lit(w)) for w in listed])

    fits = F.filter(parties, lambda p: kind(p).startswith("OBJECT") & role_is(p, words) & (~role_is(p, but) if but else F.lit(True)))
    return F.get(fits, F.lit(0))


def flatten(value: Column, doc_type: Column | None = None) -> Column:
    """A universal payload as a struct of VARIANT fields under the names that rules read; a field without content is NULL.

    Parties are told apart by their role, else the first is the issuer and the second the customer. A currency that is
    missing is USD, one that is null stays null. ``doc_type`` stands in for a document type that says nothing. A payload
    of another shape gives NULL.
    """
    def at(path: str) -> Column:
        return _kept(get(value, path))

    parties = F.try_variant_get(value, "$.parties", "array<variant>")
    nth = lambda i: F.when(kind(F.get(parties, F.lit(i))).startswith("OBJECT"), F.get(parties, F.lit(i)))
    given = get(value, "document_type")
    kept_type = F.when(says(given), given)
    if doc_type is not None:
        kept_type = F.coalesce(kept_type, doc_type.cast("variant"))
    fields = {"invoice_number": at("document_number"), "document_number": at("document_number"), "document_type": kept_type}
    fields |= {f"{d}_date": at(f"dates.{d}") for d in K.UNIVERSAL_DATES}
    fields |= {a: at(f"amounts.{a}") for a in ("total_net", "total_vat", "total_gross")}
    fields["currency"] = F.when(get(value, "amounts.currency").isNull(), F.parse_json(F.lit('"USD"'))).otherwise(at("amounts.currency"))
    fields["issuer"] = _kept(F.coalesce(_with_role(parties, K.ISSUER_ROLES), nth(0)))
    fields["customer"] = _kept(F.coalesce(_with_role(parties, K.CUSTOMER_ROLES, K.ISSUER_ROLES), nth(1)))
    fields["line_items"] = at("line_items")
    fields |= {e: at(f"contract_elements.{e}") for e in ("contract_type", "termination_terms", "penalty", "confidentiality_clause", "governing_law", "key_clauses")}
    fields |= {f: at(f) for f in ("_quotes", "_confidence", "_source")}
    return F.when(is_universal(value), F.struct(*[v.alias(k) for k, v in fields.items()]))


def flat_payloads(docs: DataFrame, payload: str = "payload") -> DataFrame:
    """``docs`` with ``flat`` (see ``flatten``) of their JSON payload and ``fields``, the names that have content, sorted; of a payload of another shape its own."""
    value = F.try_parse_json(F.col(payload))
    typed = F.col("doc_type") if "doc_type" in docs.columns else None
    out = docs.withColumn("_value", value).withColumn("flat", flatten(F.col("_value"), typed))
    own = F.map_keys(F.try_variant_get(F.col("_value"), "$", "map<string,variant>"))
    names = out.schema["flat"].dataType.names
    filled = F.array_compact(F.array(*[F.when(F.col("flat")[n].isNotNull(), F.lit(n)) for n in names]))
    return out.withColumn("fields", F.array_sort(F.when(F.col("flat").isNotNull(), filled).otherwise(own))).drop("_value")

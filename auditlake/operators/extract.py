"""Classification and field extraction: text columns in, typed columns out.

Every operator is one narrow projection of built-in expressions, so ingest,
classification, extraction and the rules stay in one stage.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake import constants as K
from auditlake.functions import labels
from auditlake.functions.dates import iso_parts
from auditlake.functions.numbers import parse_money
from auditlake.functions.text import let, strip

I = "(?iUd)"     # any case, Unicode classes, only \n ends a line
EXACT = "(?Ud)"


def ascii_lower(c: Column) -> Column:
    """Lower case of a text of ASCII characters only, NULL for others."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c))


def keyword_type(c: Column, default: Column) -> Column:
    """First document type whose pattern occurs, in priority order.

    Patterns are tried only on texts that hold one of their stems, or other letters than ASCII. All stands in a lambda: as
    generated code it would be one method too long for the JVM to compile.
    """
    def first(text: Column, low: Column) -> Column:
        rules = [(kind, F.coalesce(_has(low, *K.CLASSIFY_STEMS[kind]), F.lit(True)) & text.rlike(I + pattern)) for kind, pattern in K.CLASSIFY_PATTERNS]
        out = F.when(rules[0][1], rules[0][0])
        for kind, hit in rules[1:]:
            out = out.when(hit, kind)
        return out.otherwise(default)

    return let(c, lambda text: let(ascii_lower(text), lambda low: first(text, low)))


def detect_language(c: Column, prefix: int | None = None) -> Column:
    """Language with most listed words in the text (in its first ``prefix`` characters, if given); English below the minimum."""
    text = F.coalesce(c, F.lit(""))
    hits = F.transform(F.array(F.lower(text if prefix is None else F.substring(text, 1, prefix))), lambda h: F.struct(*[F.regexp_count(h, F.lit(I + p)).alias(lang) for lang, p in K.LANGUAGE_WORDS]))[0]

    def pick(h):
        best = F.greatest(h["en"], h["hu"], h["de"])
        return F.when((best < K.LANGUAGE_MIN_HITS) | (h["en"] == best), "en").when(h["hu"] == best, "hu").otherwise("de")

    return F.transform(F.array(hits), pick)[0]


def classify(docs: DataFrame) -> DataFrame:
    """Add doc_type, label, confidence, language; the file name decides before the text."""
    name = F.replace(F.replace(F.col("file_name"), F.lit("_"), F.lit(" ")), F.lit("-"), F.lit(" "))
    nothing = F.lit(None).cast("string")
    staged = docs.withColumn("_by_name", keyword_type(name, nothing)).withColumn(
        "_by_text", F.when(F.col("_by_name").isNull(), keyword_type(F.coalesce(F.col("text"), F.lit("")), nothing)))
    kind = F.coalesce("_by_name", "_by_text", F.lit("other"))
    sure = F.when(F.col("_by_name").isNotNull(), 0.85).when(F.col("_by_text").isNotNull(), 0.7).otherwise(0.5)
    return (
        staged.withColumn("doc_type", kind).withColumn("confidence", sure)
        .withColumn("label", labels.doc_label(F.col("doc_type"))).withColumn("language", detect_language(F.col("text")))
        .drop("_by_name", "_by_text")
    )


def _span(c: Column, pattern: str) -> Column:
    """Whole first match, NULL where there is none."""
    return F.nullif(F.regexp_extract(c, pattern, 0), F.lit(""))


def _staged(spans: dict[str, Column], build) -> Column:
    """Find each span once in the text, then read the fields from the short spans."""
    found = F.struct(*[v.alias(k) for k, v in spans.items()])
    return F.transform(F.array(found), lambda s: F.struct(*[v.alias(k) for k, v in build(s).items()]))[0]


def _date_pattern(label: str) -> str:
    return I + label + r"\s*[:\#]?\s*(" + K.DATE_PATTERN + ")"


def _date_of(span: Column) -> Column:
    """ISO date at the end of a labelled span."""
    tail = I + K.DATE_PATTERN + "$"
    return F.when(span.isNotNull(), iso_parts(*[F.regexp_extract(span, tail, i) for i in (1, 2, 3)]))


def _number_of(span: Column, pattern: str) -> Column:
    return F.when(span.isNotNull(), F.regexp_replace(F.regexp_extract(span, I + pattern, 1), r"[,.;]+$", ""))


def _present(items: list[Column]) -> Column:
    return F.filter(F.array(*items), lambda q: q.isNotNull())


def _invoice(c: Column) -> tuple:
    spans = {"invoice_number": _span(c, I + K.INVOICE_NUMBER_PATTERN)}
    spans |= {f: _span(c, _date_pattern(label)) for f, label in K.INVOICE_DATE_LABELS}
    spans |= {f"{f}_name": F.nullif(strip(F.regexp_extract(c, I + label + K.PARTY_TAIL, 1)), F.lit("")) for f, label in K.PARTY_LABELS}
    spans["tax_id"] = _span(c, EXACT + K.TAX_ID_PATTERN)
    spans |= {f: _span(c, I + label + K.TOTAL_TAIL) for f, label in K.TOTAL_LABELS}
    spans["currency"] = reduce(lambda acc, kv: acc.when(c.rlike(EXACT + kv[1]), kv[0]), K.CURRENCY_PATTERNS[1:],
                               F.when(c.rlike(EXACT + K.CURRENCY_PATTERNS[0][1]), K.CURRENCY_PATTERNS[0][0]))

    def build(s):
        out = {"invoice_number": _number_of(s["invoice_number"], K.INVOICE_NUMBER_PATTERN)}
        out |= {f: _date_of(s[f]) for f, _ in K.INVOICE_DATE_LABELS}
        out |= {f"{f}_name": s[f"{f}_name"] for f, _ in K.PARTY_LABELS}
        out["issuer_tax_id"] = F.when(s["issuer_name"].isNotNull(), F.regexp_replace(s["tax_id"], r"(?U)\s", ""))
        out |= {f: parse_money(F.regexp_extract(s[f], r"([\d\s.,]+)$", 1)) for f, _ in K.TOTAL_LABELS}
        out["currency"] = s["currency"]
        quoted = [(k, s[k]) for k in ("invoice_number", *[f for f, _ in K.INVOICE_DATE_LABELS])]
        quoted += [(f, F.when(out[f].isNotNull(), s[f])) for f, _ in K.TOTAL_LABELS]
        out["quotes"] = _present([q for _, q in quoted])
        out["confidence"] = F.map_from_entries(_present([
            F.when(q.isNotNull(), F.struct(F.lit(k).alias("key"), F.lit("high").alias("value"))) for k, q in quoted]))
        return out

    return spans, build


def invoice_fields(c: Column) -> Column:
    return _staged(*_invoice(c))


def _numbered(c: Column, pattern: str) -> tuple:
    return {"span": _span(c, I + pattern)}, lambda s: {
        "document_number": _number_of(s["span"], pattern), "quotes": _present([s["span"]])}


def numbered_document(c: Column, pattern: str) -> Column:
    return _staged(*_numbered(c, pattern))


def _has(c: Column, *words) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(c, F.lit(w)) for w in words])


def _contract(c: Column) -> tuple:
    spans = {"text": c, "low": F.lower(c)}
    spans |= {f: _span(c, _date_pattern(label)) for f, label in K.CONTRACT_DATE_LABELS}
    spans["law"] = F.nullif(F.regexp_extract(c, I + K.GOVERNING_LAW_PATTERN, 1), F.lit(""))
    spans["ending"] = F.when(c.rlike(I + K.TERMINATION_MENTION), _span(c, I + K.TERMINATION_PATTERN))
    flags = (("auto_renewal", K.AUTO_RENEWAL_PATTERN), ("change_of_control", K.CHANGE_OF_CONTROL_PATTERN),
             ("non_compete", K.NON_COMPETE_PATTERN), ("confidentiality_clause", K.CONFIDENTIALITY_PATTERN))

    def build(s):
        low = s["low"]
        out = {"contract_type": F.when(_has(low, "non-disclosure", "nda", "titoktart"), "NDA").when(_has(low, "lease", "rental", "lizing"), "lease")
               .when(_has(low, "service", "szolgaltatas"), "service").when(_has(low, "framework") | _has(s["text"], "MSA"), "MSA")}
        out |= {f: _date_of(s[f]) for f, _ in K.CONTRACT_DATE_LABELS}
        out["governing_law"] = strip(s["law"])
        out["termination_terms"] = F.when(s["ending"].isNotNull(), strip(F.regexp_extract(s["ending"], I + K.TERMINATION_PATTERN, 1)))
        out |= {f: F.when(s["text"].rlike(I + p), F.lit(True)) for f, p in flags}
        out["quotes"] = _present([s[f] for f, _ in K.CONTRACT_DATE_LABELS] + [s["ending"]])
        return out

    return spans, build


def contract_fields(c: Column) -> Column:
    return _staged(*_contract(c))


def _report(c: Column) -> tuple:
    spans = {"text": c, "low": F.lower(c)} | {f: _span(c, _date_pattern(label)) for f, label in K.REPORT_PERIOD_LABELS}
    return spans, lambda s: {
        "report_type": F.when(_has(s["low"], "income statement", "p&l", "profit"), "income_statement").when(_has(s["low"], "balance sheet", "merleg"), "balance_sheet")
        .when(_has(s["low"], "cash flow"), "cash_flow"),
        "accounting_standard": F.when(_has(s["text"], "IFRS"), "IFRS").when(_has(s["text"], "US-GAAP", "US GAAP"), "US-GAAP")
        .when(_has(s["text"], "HU-GAAP", "HÁR"), "HU-GAAP").when(_has(s["text"], "HGB"), "DE-HGB"),
        **{f: _date_of(s[f]) for f, _ in K.REPORT_PERIOD_LABELS}}


def report_fields(c: Column) -> Column:
    return _staged(*_report(c))


def _universal(c: Column) -> tuple:
    return {"span": _span(c, EXACT + K.DATE_PATTERN)}, lambda s: {"signature_date": _date_of(s["span"])}


def universal_fields(c: Column) -> Column:
    return _staged(*_universal(c))


def extract_all(docs: DataFrame) -> DataFrame:
    """Extractor by doc_type: spans in one projection, fields in the next, each NULL for other types.

    Spans and fields are columns of their own, so that those nobody asks for are not searched.
    """
    kind = F.col("doc_type")
    by_type = {
        "invoice": _invoice, "delivery_note": lambda c: _numbered(c, K.DELIVERY_NOTE_PATTERN),
        "purchase_order": lambda c: _numbered(c, K.PURCHASE_ORDER_PATTERN), "contract": _contract,
        "financial_report": _report, "other": _universal,
    }

    def span(t: str, k: str) -> Column:
        return F.when(of_type[t], let(F.col("text"), lambda x: by_type[t](x)[0][k])).alias(f"_{t}_{k}")

    others = [k for k in by_type if k != "other"]
    of_type = {t: ~kind.isin(others) if t == "other" else kind == t for t in by_type}
    kept = [x for x in docs.columns if x != "text"]
    read = {t: extractor(F.col("text")) for t, extractor in by_type.items()}
    staged = docs.select(*kept, F.col("file_name").alias("source_file"), *[span(t, k) for t, (spans, _) in read.items() for k in spans])
    holders: dict[str, list[Column]] = {}
    for t, (spans, build) in read.items():
        for f, field in build({k: F.col(f"_{t}_{k}") for k in spans}).items():
            holders.setdefault(f, []).append(F.when(of_type[t], field))
    return staged.select(*kept, "source_file", *[F.coalesce(*v).alias(k) for k, v in holders.items()])


def flatten_universal(docs: DataFrame) -> DataFrame:
    """Nested universal payload to the flat field names the rules read.

    Input columns: document_number, document_type, dates, amounts, parties
    (array of name, role, tax_id), contract_elements.  Rows without any of the
    universal parts keep NULL fields.
    """
    d, a, p, e = F.col("dates"), F.col("amounts"), F.col("parties"), F.col("contract_elements")
    universal = F.coalesce(d.isNotNull() | a.isNotNull() | e.isNotNull() | F.col("document_type").isNotNull() | F.col("document_number").isNotNull(), F.lit(False))

    def role_is(x, words):
        role = F.lower(F.coalesce(x["role"], F.lit("")))
        return reduce(lambda m, n: m | n, [F.contains(role, F.lit(w)) for w in words])

    issuers = F.filter(p, lambda x: role_is(x, K.ISSUER_ROLES))
    customers = F.filter(p, lambda x: ~role_is(x, K.ISSUER_ROLES) & role_is(x, K.CUSTOMER_ROLES))
    issuer = F.coalesce(F.get(issuers, F.lit(0)), F.get(p, F.lit(0)))
    customer = F.coalesce(F.get(customers, F.lit(0)), F.get(p, F.lit(1)))
    fields = {
        "invoice_number": F.col("document_number"), "issue_date": d["issue"], "fulfillment_date": d["fulfillment"], "payment_due_date": d["payment_due"],
        "effective_date": d["effective"], "expiry_date": d["expiry"], "total_net": a["total_net"], "total_vat": a["total_vat"], "total_gross": a["total_gross"],
        "currency": F.coalesce(a["currency"], F.lit("USD")), "issuer_name": issuer["name"], "issuer_tax_id": issuer["tax_id"],
        "customer_name": customer["name"], "termination_terms": e["termination_terms"], "governing_law": e["governing_law"],
        "confidentiality_clause": e["confidentiality_clause"],
    }
    return docs.select("package_id", "doc_id", *[F.when(universal, v).alias(k) for k, v in fields.items()])


def merge_parts(parts: DataFrame, key: list[str], ord_col: str, scalars: list[str], lists: list[str]) -> DataFrame:
    """Chunk-wise extractions to one record: first value that is set, lists in chunk order.

    A list field of a document is collected because it is one value of that
    document; nothing is collected across documents.
    """
    aggs = [F.min_by(s, F.when(F.col(s).isNotNull(), F.col(ord_col))).alias(s) for s in scalars]
    aggs += [F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(F.col(ord_col).alias("o"), F.col(x).alias("v")))), lambda z: z["v"])).alias(x) for x in lists]
    return parts.groupBy(*key).agg(*aggs)


def business_fields(payload: Column) -> Column:
    """Payload map without bookkeeping fields."""
    return F.map_filter(payload, lambda k, _: ~k.startswith("_"))


def package_view(docs: DataFrame, payload: str = "payload") -> DataFrame:
    """Documents of a package as they are shown: package_id, doc_id, label and the names of their business fields, sorted.

    Documents without a type, or without a payload or with an empty one, are left out.
    """
    kept = docs.where(F.col("doc_type").isNotNull() & (F.col("doc_type") != "") & (F.coalesce(F.size(payload), F.lit(0)) > 0))
    return kept.select("package_id", "doc_id", labels.doc_label(F.col("doc_type")).alias("label"), F.array_sort(F.map_keys(business_fields(F.col(payload)))).alias("fields"))

"""Business-document views over the star-schema tables.

Each view is one SQL text that Spark and an ANSI engine read alike; table and
view names stand in braces.  No view needs a window or an ordered group, so a
document holding a large share of all lines costs no single task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from auditlake.session import READ_PARTITIONS

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

VIEWS: dict[str, str] = {}

# invoice lines; a third have no code, some carry VAT and gross errors
VIEWS["v_line"] = """
select o_custkey as package_id, l_orderkey as doc_id, l_linenumber as line_no,
  case when l_partkey % 3 = 0 then '' else concat('P', cast(l_partkey as string)) end as item_code,
  concat(p_name, ' ', p_brand) as description, l_quantity as quantity,
  case when l_orderkey % 7 = 0 then '' else 'pcs' end as unit,
  case when l_orderkey % 9 = 0 then null else p_retailprice end as unit_price_net,
  round(l_tax * 100) as vat_rate, l_extendedprice as total_net,
  floor((l_extendedprice * (l_tax + case when l_returnflag = 'R' and l_linenumber = 7 then 0.02 else 0.0 end)) * 100 + 0.5) / 1e2 as total_vat,
  floor((l_extendedprice * (1 + l_tax) + case when l_returnflag = 'A' and l_linenumber = 1 then 5 else 0 end) * 100 + 0.5) / 1e2 as total_gross,
  l_returnflag, l_linestatus
from {lineitem} join {orders} on l_orderkey = o_orderkey join {part} on l_partkey = p_partkey"""

# invoice headers
VIEWS["v_invoice"] = """
select o_custkey as package_id, o_orderkey as doc_id, 'invoice' as doc_type,
  case when n_regionkey = 3 then 'hu' when n_regionkey = 2 then 'de' else 'en' end as language,
  concat('INV-', cast(o_orderkey % 50 as string)) as invoice_number,
  cast(cast(o_orderdate as date) as string) as issue_date,
  case when o_orderkey % 8 = 0 then null else cast(cast(o_orderdate as date) as string) end as fulfillment_date,
  cast(cast(o_orderdate as date) + cast(o_orderkey % 40 - 5 as int) as string) as payment_due_date,
  case when o_orderkey % 4 = 0 then 'n/a' else 'transfer' end as payment_method,
  lower(c_mktsegment) as issuer_name,
  case when o_orderkey % 3 = 0 then null else concat('Main street ', cast(c_nationkey as string)) end as issuer_address,
  case when o_orderkey % 6 = 0 then '' else concat(lpad(cast((o_orderkey * 7919) % 10000000 as string), 7, '0'), cast(o_orderkey % 10 as string), '-2-4', cast(o_orderkey % 10 as string)) end as issuer_tax_id,
  c_name as customer_name, n_name as customer_address,
  case when o_orderkey % 2 = 0 then null else concat('12345676-2-4', cast(o_orderkey % 10 as string)) end as customer_tax_id,
  floor((o_totalprice / 1.2) * 100 + 0.5) / 1e2 as total_net,
  (floor(o_totalprice * 100 + 0.5) - floor(o_totalprice / 1.2 * 100 + 0.5)) / 1e2 + case when o_orderkey % 25 = 0 then 2 else 0 end as total_vat,
  o_totalprice as total_gross, round(o_totalprice / 20000) * 20000 as gross_bucket
from {orders} join {customer} on o_custkey = c_custkey join {nation} on c_nationkey = n_nationkey"""

# contract payloads
VIEWS["v_contract"] = """
select o_custkey as package_id, o_orderkey as doc_id, 'contract' as doc_type, 'en' as language,
  case when o_orderkey % 4 = 0 then 'NDA' when o_orderkey % 4 = 1 then 'service' else 'lease' end as contract_type,
  c_name as party_a, concat('Vendor ', cast(o_orderkey % 5 as string)) as party_b,
  concat(split_part('RU BY IR KP DE FR US HU AT IT ES PL CZ RO SK SI HR BG GR PT NL BE SE DK FI', ' ', cast(c_nationkey as int) + 1), lpad(cast(c_custkey as string), 9, '0')) as party_a_tax_id,
  case when o_orderkey % 3 = 0 then null else '12345676-2-41' end as party_b_tax_id,
  o_totalprice * case when o_orderkey % 10 = 0 then 30 else 1 end as total_value,
  case when o_orderkey % 2 = 0 then 'USD' else 'EUR' end as currency,
  case when o_orderkey % 6 = 0 then null else cast(penalty as double) end as penalty,
  cast(cast(o_orderdate as date) as string) as effective_date,
  case when o_orderkey % 19 = 0 then 'Indefinite' else cast(cast(last_ship as date) as string) end as expiry_date,
  case when o_orderkey % 3 = 0 then null else 'termination by notice' end as termination_terms,
  case when o_orderkey % 5 = 0 then 'none' else 'local law' end as governing_law,
  case when o_orderkey % 14 = 0 then null else o_orderkey % 7 <> 0 end as confidentiality_clause,
  o_orderkey % 11 = 0 as change_of_control, o_orderkey % 13 = 0 as non_compete, o_orderkey % 17 = 0 as auto_renewal,
  case when o_orderpriority = '1-URGENT' then floor((o_totalprice / 12) * 100 + 0.5) / 1e2 end as monthly_fee,
  case when o_orderkey % 2 = 0 then 'USD' else 'EUR' end as monthly_fee_currency
from {orders} join {customer} on o_custkey = c_custkey
  join (select l_orderkey, sum(cast(floor(l_extendedprice * l_discount * 100 + 0.5) as bigint)) / 1e2 as penalty, max(l_shipdate) as last_ship
        from {lineitem} group by l_orderkey) on o_orderkey = l_orderkey"""

# purchase-order lines and headers; delivery-note lines (some missing, some short) and headers
VIEWS["v_po_line"] = """
select package_id, doc_id, item_code, description, sum(quantity) as quantity
from {v_line} group by package_id, doc_id, item_code, description"""
VIEWS["v_dn_line"] = """
select package_id, doc_id, item_code, description, sum(quantity - line_no % 3) as quantity
from {v_line} where l_returnflag <> 'R' group by package_id, doc_id, item_code, description"""
VIEWS["v_inv_line"] = """
select package_id, doc_id, item_code,
  case when item_code = '' then concat(description, ' - delivered') else description end as description,
  sum(quantity) as quantity
from {v_line} group by package_id, doc_id, item_code, description"""
VIEWS["v_po"] = """
select o_custkey as package_id, o_orderkey as doc_id, 'purchase_order' as doc_type, 'en' as language,
  cast(cast(o_orderdate as date) + cast(o_orderkey % 5 - 2 as int) as string) as order_date,
  floor((o_totalprice / 1.2) * 100 + 0.5) / 1e2 as total_net,
  case when o_orderkey % 9 = 0 then null else floor((o_totalprice * (1 + (o_orderkey % 8) * 0.01)) * 100 + 0.5) / 1e2 end as total_gross
from {orders}"""
VIEWS["v_dn"] = """
select o_custkey as package_id, o_orderkey as doc_id, 'delivery_note' as doc_type, 'en' as language,
  case when o_orderkey % 2 = 0 then floor((o_totalprice / 1.2) * 100 + 0.5) / 1e2 end as total_net,
  cast(null as double) as total_gross
from {orders} where o_orderkey in (select l_orderkey from {lineitem} where l_returnflag <> 'R')"""

# one row per document of every kind
VIEWS["v_document"] = """
select package_id, doc_id * 4 as doc_ord, concat('invoice_', cast(doc_id as string), '.pdf') as file_name,
  doc_type, language, total_gross as amount from {v_invoice}
union all
select package_id, doc_id * 4 + 1, concat('delivery_', cast(doc_id as string), '.docx'), doc_type, language, total_net from {v_dn}
union all
select package_id, doc_id * 4 + 2, concat('order_', cast(doc_id as string), '.png'), doc_type, language, total_gross from {v_po}
union all
select package_id, doc_id * 4 + 3, concat('contract_', cast(doc_id as string), '.txt'), doc_type, language, total_value from {v_contract}"""

# contract wording: the whole text of each document with one clause appended
VIEWS["v_clause_text"] = """
select source as package_id, doc_id, lang as language,
  concat(text, ' ', case doc_id % 12
    when 0 then 'The processor handles personal data under documented instructions.'
    when 1 then 'Personal data: see ANNEX 2. Sub-processor rules and audit right apply.'
    when 2 then 'Delivery CIP Budapest (Incoterms 2020).'
    when 3 then 'A non-compete applies. The contract is not assignable.'
    when 4 then 'Automatic renewal each year; change of control must be notified.'
    when 5 then 'Under IFRS the goodwill amortization is shown.'
    when 6 then 'Operating lease under IFRS 16 in the balance sheet.'
    when 7 then 'Delivery FOB or DDP. Versenytilalom. GDPR applies, 72 hours notice, Verarbeitungszweck.'
    when 8 then 'Személyes adat: titoktartás, törlés, ellenőrzés.'
    else '' end) as text,
  cast(n_chars as double) * case when doc_id % 4 = 0 then 10000 else 100 end as total_value
from {documents}"""

# rendered business texts, one per order
VIEWS["v_text"] = """
select package_id, doc_id,
  concat('Invoice number: ', invoice_number, '/', cast(doc_id as string), ';
Issue date: ', replace(issue_date, '-', case when doc_id % 3 = 0 then '.' when doc_id % 3 = 1 then '/' else '-' end), '
Fulfillment date: ', coalesce(fulfillment_date, 'n/a'), '
Payment due: ', payment_due_date, '
Issuer: ', issuer_name, ' ltd
Tax ID: ', issuer_tax_id, '
Customer: ', replace(customer_name, '#', ' no '), '
Total net: ', cast(cast(total_net as decimal(18,2)) as string), case when doc_id % 2 = 0 then ' EUR' else ' USD' end, '
Total VAT: ', cast(cast(total_vat as decimal(18,2)) as string), '
Total gross: $', cast(cast(total_gross as decimal(18,2)) as string)) as invoice_text,
  concat('Delivery note number: DN-', cast(doc_id as string), ', goods received in full') as delivery_text,
  concat('Purchase order number: PO-', cast(doc_id as string), '; please confirm') as order_text,
  concat(case doc_id % 4 when 0 then 'Non-Disclosure agreement. ' when 1 then 'Lease agreement. ' when 2 then 'Service agreement. ' else 'Framework contract. ' end,
    'Effective date: ', issue_date, '. Expiry date: ', payment_due_date, '. Governing law: Delaware, USA. ',
    case when doc_id % 3 = 0 then 'Termination terms: either party may end it with thirty days notice.' else '' end,
    case when doc_id % 5 = 0 then ' Change of control applies.' else '' end,
    case when doc_id % 7 = 0 then ' Non-compete for 5 years.' else '' end,
    case when doc_id % 11 = 0 then ' Automatically renewed.' else '' end) as contract_text,
  concat(case doc_id % 3 when 0 then 'Income statement ' when 1 then 'Balance sheet ' else 'Cash flow ' end,
    case doc_id % 4 when 0 then 'under IFRS. ' when 1 then 'under US GAAP. ' when 2 then 'under HGB. ' else '' end,
    'Period start: ', issue_date, ' Period end: ', payment_due_date) as report_text,
  concat('Letter of ', issue_date, ' about order ', cast(doc_id as string)) as letter_text
from {v_invoice}"""

# proposed findings, one per order line position
VIEWS["v_candidate"] = """
select package_id, doc_id, concat('invoice_', cast(doc_id as string), '.pdf') as file_name,
  case doc_id % 10
    when 0 then concat('Fulfillment ', coalesce(fulfillment_date, '?'), ' precedes issue date ', issue_date, ' on the invoice')
    when 1 then concat('Payment due ', payment_due_date, ' follows the invoice issue date by 30 days')
    when 2 then concat(cast(doc_id % 30 as string), '% VAT rate on the invoice is unusual')
    when 3 then 'High unit price detected on invoice item 3'
    when 4 then concat('High unit price: item costs ', cast(doc_id % 50 as string), '% more than other invoice items')
    when 5 then concat('Missing purchase order reference ', cast(doc_id as string), ' on the delivery note')
    when 6 then 'Delivery note 7 has no amount field'
    when 7 then concat('Invoice number ', invoice_number, ' total amount has a mismatch between net and gross')
    when 8 then 'too short'
    else concat('Invoice ', invoice_number, ' payment total is above the contract value') end as description,
  case when doc_id % 6 = 0 then '' when doc_id % 6 = 1 then null else concat('net ', cast(cast(total_net as decimal(18,2)) as string)) end as rationale,
  case doc_id % 5 when 0 then 'high' when 1 then 'low' when 2 then 'critical' when 3 then null else 'medium' end as severity,
  case when doc_id % 2 = 0 then concat('invoice_', cast(doc_id as string), '.pdf') end as affected_document,
  issue_date, fulfillment_date, payment_due_date
from {v_invoice}"""

# one table of machine-made findings: totals and dates of every invoice
VIEWS["v_finding"] = """
select package_id, doc_id, concat('invoice_', cast(doc_id as string), '.pdf') as file_name, description, severity, kind, regulation,
  source_check_id, stage, rule_ord
from (
  select package_id, doc_id, concat('Invoice ', invoice_number, ' payment due date is earlier than its issue date') as description, 'medium' as severity,
    'validation' as kind, cast(null as string) as regulation, 'basic_date_error' as source_check_id, 1 as stage, 3 as rule_ord
  from {v_invoice} where payment_due_date < issue_date
  union all
  select package_id, doc_id, concat('Missing mandatory invoice element: Payment method'), 'medium', 'domain_rule', 'HU VAT Act §169', 'check_01_invoice_mandatory', 2, 1
  from {v_invoice} where language = 'hu' and payment_method = 'n/a'
  union all
  select package_id, doc_id, concat('Invoice number ', invoice_number, ' net and gross amount mismatch'), 'high', 'validation', null, 'basic_math_error', 1, 2
  from {v_invoice} where abs(total_net + total_vat - total_gross) > 1
  union all
  select package_id, doc_id, concat('Materiality threshold for ', invoice_number), 'info', 'domain_rule', 'ISA 320', 'check_07_materiality', 2, 7
  from {v_invoice} where total_gross > 0
  union all
  select package_id, doc_id, concat('GDPR elements missing in contract ', cast(doc_id % 9 as string)), 'high', 'domain_rule', 'GDPR Article 28', 'check_08_gdpr_28', 2, 8
  from {v_invoice} where doc_id % 21 = 0
  union all
  select package_id, doc_id, concat('Sanctions list match: ', customer_name), 'CRITICAL', 'domain_rule', 'AML / Sanctions screening', 'check_13_aml_sanctions', 2, 13
  from {v_invoice} where doc_id % 33 = 0
)"""

# document quotes: one verbatim up to letter case, one from the benchmark, one short, one made up
VIEWS["v_quote"] = """
select source as package_id, doc_id, d.text as text, lower(substr(d.text, 1, 60)) as q1,
  case when doc_id % 4 = 1 then null else b.text end as q2, case when doc_id % 2 = 0 then 'short ü' end as q3,
  case when doc_id % 3 = 0 then concat('passage made up for ', source) end as q4
from {documents} d left join {benchmark} b on b.item_id = d.doc_id % 40"""

# one row per rendered text with the file it came in
VIEWS["v_file_text"] = """
select package_id, doc_id, concat(case when doc_id % 2 = 0 then 'tax-invoice_' else 'scan_' end, cast(doc_id as string), '.pdf') as file_name, 'invoice' as true_type, invoice_text as text from {v_text}
union all select package_id, doc_id, concat('scan_', cast(doc_id as string), '.PNG'), 'delivery_note', delivery_text from {v_text}
union all select package_id, doc_id, concat(case when doc_id % 2 = 0 then 'purchase-order_' else 'scan_' end, cast(doc_id as string), '.docx'), 'purchase_order', order_text from {v_text}
union all select package_id, doc_id, concat('scan_', cast(doc_id as string), '.txt'), 'contract', contract_text from {v_text}
union all select package_id, doc_id, concat('scan_', cast(doc_id as string)), 'financial_report', report_text from {v_text}
union all select package_id, doc_id, concat('letter_', cast(doc_id as string), '.eml'), 'other', letter_text from {v_text}"""

# universal payloads as JSON text (with <> for braces until the end): parties with and without roles, a null and a missing currency, other shapes, and broken ones
VIEWS["v_universal"] = """
select package_id, doc_id, 'invoice' as doc_type,
  translate(case when doc_id % 11 = 0 then concat('<"parties":[<"name":"', customer_name, '">],"total_gross":5>')
    when doc_id % 23 = 0 then '<"dates": broken'
    else concat('<"document_number":"', invoice_number, '","document_type":', case doc_id % 4 when 0 then 'null' when 1 then '""' else '"bill"' end,
      ',"dates":<"issue":"', issue_date, '","payment_due":"', payment_due_date, '"', case when fulfillment_date is null then '' else concat(',"fulfillment":"', fulfillment_date, '"') end,
      ',"signature":', case when doc_id % 2 = 0 then 'null' else concat('"', issue_date, '"') end, '>',
      case when doc_id % 13 = 0 then '' else concat(',"amounts":<"total_net":', cast(cast(total_net as decimal(18,2)) as string), ',"total_gross":"', cast(cast(total_gross as decimal(18,2)) as string), '"',
        case doc_id % 3 when 0 then ',"currency":null' when 1 then '' else ',"currency":"EUR"' end, '>') end,
      ',"parties":[', case doc_id % 5
        when 0 then concat('<"name":"', issuer_name, '","role":"Lessee">,<"name":"', customer_name, '","role":"main Vendor">')
        when 1 then concat('<"name":"', issuer_name, '","role":null>,<"name":"', customer_name, '">')
        when 2 then concat('"', issuer_name, '",<"name":"', customer_name, '","role":"BUYER">')
        when 3 then concat('<"name":"', issuer_name, '","role":"supplier of the customer">') else '' end, ']',
      ',"line_items":', case when doc_id % 2 = 0 then '[]' else concat('[<"qty":"', cast(doc_id % 9 as string), ' ","name":" Bolt ','M', cast(doc_id % 7 as string), '","sku":', cast(doc_id % 3 as string), '>,"text",<"mennyiseg":2.5,"megnevezes":"","name":"Nut">]') end,
      ',"contract_elements":<"contract_type":"lease","penalty":<"amount":', cast(doc_id % 2 as string), '>,"confidentiality_clause":false,"key_clauses":', case when doc_id % 6 = 0 then '[]' else '[<"name":"Term","content":"one year">]' end, '>',
      ',"_quotes":["a","b"],"_confidence":<>,"_source":<"file_name":"f', cast(doc_id as string), '.pdf">>') end, '<>', concat(chr(123), chr(125))) as payload
from {v_invoice}"""

# trio documents as payloads that name their amounts in different ways
VIEWS["v_alias"] = """
select package_id, doc_id, doc_type, doc_ord, translate(payload, '<>', concat(chr(123), chr(125))) as payload from (
select package_id, doc_id, 'invoice' as doc_type, 1 as doc_ord, concat('<"issue_date":"', issue_date, '","total":77,',
  case doc_id % 4 when 0 then '"total_gross":null,"gross_total":' when 1 then '"total_gross":"n/a","brutto_vegosszeg":' when 2 then '"brutto_osszeg":' else '"total_gross":' end, case when doc_id % 2 = 0 then concat('"', cast(cast(total_gross as decimal(18,2)) as string), ' Ft"') else cast(cast(total_gross as decimal(18,2)) as string) end,
  ',', case doc_id % 3 when 0 then '"net_amount":' when 1 then '"total_net":[],"netto_osszeg":' else '"total_net":' end, cast(cast(total_net as decimal(18,2)) as string), '>') as payload from {v_invoice}
union all
select package_id, doc_id, 'purchase_order', 1, concat('<"issue_date":"', order_date, '","gross_amount":', case when total_gross is null then 'null' else cast(cast(total_gross as decimal(18,2)) as string) end, ',"netto_vegosszeg":"', cast(cast(total_net as decimal(18,2)) as string), '">') from {v_po}
union all
select package_id, doc_id, 'delivery_note', 1, concat('<"notes":"none"', case when total_net is null then '' else concat(',"net_total":', cast(cast(total_net as decimal(18,2)) as string)) end, '>') from {v_dn})"""

# amounts and dates the way people type them
VIEWS["v_messy"] = """
select o_orderkey as doc_id, case o_orderkey % 16
    when 0 then amount when 1 then concat('$', amount) when 2 then concat(replace(amount, '.', ','), ' Ft')
    when 3 then concat('(', amount, ')') when 4 then ' N/A ' when 5 then ' — '
    when 6 then concat(cast(o_orderkey % 90 + 10 as string), '.000,50')
    when 7 then concat('1 ', lpad(cast(o_orderkey % 1000 as string), 3, '0'), ' 250 HUF')
    when 8 then concat(cast(o_orderkey as string), 'd') when 9 then concat('eur 1,', lpad(cast(o_orderkey % 1000 as string), 3, '0'), ',567.8')
    when 10 then concat('1.', cast(o_orderkey % 100 as string), '.3') when 11 then concat(cast(o_orderkey % 100 as string), ',5')
    when 12 then concat(cast(o_orderkey % 100 as string), ',123') when 13 then 'Missing' when 14 then null
    else concat(cast(o_orderkey % 9 as string), 'e3') end as raw_amount,
  case o_orderkey % 11
    when 0 then iso when 1 then concat(replace(iso, '-', '.'), '.') when 2 then replace(iso, '-', '/')
    when 3 then concat(substr(iso, 9, 2), '.', substr(iso, 6, 2), '.', substr(iso, 1, 4), '.')
    when 4 then concat(substr(iso, 9, 2), '/', substr(iso, 6, 2), '/', substr(iso, 1, 4))
    when 5 then concat(substr(iso, 1, 4), '-02-31') when 6 then 'null' when 7 then concat(' ', iso, 'T10:00 ')
    when 8 then concat(substr(iso, 1, 4), '-', cast(o_orderkey % 9 + 1 as string), '-', cast(o_orderkey % 28 + 1 as string))
    when 9 then null else concat('day ', cast(o_orderkey as string)) end as raw_date
from (select o_orderkey, cast(cast(o_totalprice as decimal(18,2)) as string) as amount,
  cast(cast(o_orderdate as date) as string) as iso from {orders})"""


def tables_in(sql: str) -> list[str]:
    names = []
    for name in list(VIEWS) + TABLES:
        if "{" + name + "}" in sql:
            names.append(name)
    return names


def view_closure(names: list[str]) -> list[str]:
    """The named views and every view they build on, dependencies first."""
    out: list[str] = []

    def visit(name: str) -> None:
        if name in VIEWS and name not in out:
            for dep in tables_in(VIEWS[name]):
                visit(dep)
            out.append(name)

    for n in names:
        visit(n)
    return out


def with_views(sql: str) -> str:
    """Plain SQL text: the views ``sql`` names in braces become a WITH prelude."""
    needed = view_closure(tables_in(sql))
    plain = sql
    prelude = []
    for n in list(VIEWS) + TABLES:
        plain = plain.replace("{" + n + "}", n)
    for v in needed:
        body = VIEWS[v]
        for n in list(VIEWS) + TABLES:
            body = body.replace("{" + n + "}", n)
        prelude.append(f"{v} as ({body})")
    if not prelude:
        return plain
    head = ", ".join(prelude)
    stripped = plain.lstrip()
    if stripped.lower().startswith("with recursive "):
        return "with recursive " + head + ", " + stripped[len("with recursive "):]
    if stripped.lower().startswith("with "):
        return "with " + head + ", " + stripped[len("with "):]
    return f"with {head} {plain}"


#: Tables whose rows cost real work each (long texts, many rules).
WIDE_TABLES = ("documents", "lineitem", "orders", "pages")


def dealt(df: DataFrame) -> DataFrame:
    """Dealt out to the number of partitions that a local session asks for; as it is where it asks for none.

    The test tables are single row groups that no split size can divide; a
    cluster leaves the setting out and reads its files as they are split.
    """
    wanted = df.sparkSession.conf.get(READ_PARTITIONS, None)
    return df.repartition(int(wanted)) if wanted else df


class Tables:
    """The tables of one scale-factor folder and the views over them."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path.rstrip("/")

    def table(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.path}/{name}.parquet")
        return dealt(df) if name in WIDE_TABLES else df

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.table(name)
        if name in VIEWS:
            return self.sql("select * from {" + name + "}")
        raise AttributeError(name)

    def sql(self, text: str) -> DataFrame:
        """Run SQL over the views; only the tables it reads are bound."""
        sql = with_views(text)
        needed = [t for t in TABLES if t in _base_tables(text)]
        frames = {t: self.table(t) for t in needed}
        for t in needed:
            sql = _bind(sql, t)
        return self.spark.sql(sql, **frames)


def _base_tables(text: str) -> set[str]:
    names = set(tables_in(text))
    for v in view_closure(sorted(names)):
        names.update(tables_in(VIEWS[v]))
    return names & set(TABLES)


def _bind(sql: str, table: str) -> str:
    import re

    return re.sub(rf"\b(from|join)\s+{table}\b", rf"\1 {{{table}}}", sql)

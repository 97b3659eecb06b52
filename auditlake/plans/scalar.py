"""Queries over the scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditlake import constants as K
from auditlake.functions import dates, labels, match, numbers, text
from auditlake.plans.registry import query, sql_list

ALIASES = sql_list(K.NULL_ALIASES)

SEPARATORS_SQL = """case
    when contains(s, '.') and contains(s, ',') then
      case when strpos(reverse(s), '.') < strpos(reverse(s), ',') then replace(s, ',', '')
           else replace(replace(s, '.', ''), ',', '.') end
    when contains(s, ',') then
      case when strpos(reverse(s), ',') in (2, 3)
           then replace(left(s, length(s) - strpos(reverse(s), ',')), ',', '') || '.' || right(s, strpos(reverse(s), ',') - 1)
           else replace(s, ',', '') end
    when s like '%.%.%' then replace(left(s, length(s) - strpos(reverse(s), '.')), '.', '') || '.' || right(s, strpos(reverse(s), '.') - 1)
    else s end"""
FLOAT_SQL = r"case when regexp_full_match(t, '[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?') then try_cast(t as double) end"


@query("fn_null_alias", f"""
select doc_id, coalesce(lower(trim(raw_amount)) in ({ALIASES}), true) as amount_alias,
  coalesce(lower(trim(raw_date)) in ({ALIASES}), true) as date_alias from {{v_messy}}""")
def _(t):
    return t.v_messy.select(
        "doc_id",
        text.is_null_alias(F.col("raw_amount")).alias("amount_alias"),
        text.is_null_alias(F.col("raw_date")).alias("date_alias"),
    )


@query("fn_coerce_number", f"""
with a as (select doc_id, raw_amount,
    trim(regexp_replace(trim(regexp_replace(trim(raw_amount), '\\s*(USD|EUR|HUF|GBP|CHF|CZK|PLN|RON|JPY|Ft|€|\\$|£)\\s*$', '', 'i')),
      '^\\s*([€$£]|USD|EUR|HUF|GBP|CHF|CZK|PLN|RON|JPY|Ft)\\s*', '', 'i')) as b from {{v_messy}}),
  b as (select doc_id, raw_amount, replace(case when b like '(%)' then '-' || substr(b, 2, length(b) - 2) else b end, ' ', '') as s from a),
  c as (select doc_id, raw_amount, {SEPARATORS_SQL} as t from b)
select doc_id, case when coalesce(lower(trim(raw_amount)) in ({ALIASES}), true) then null else {FLOAT_SQL} end as amount from c""")
def _(t):
    return t.v_messy.select("doc_id", numbers.coerce_number(F.col("raw_amount")).alias("amount"))


@query("fn_parse_money", f"""
with b as (select doc_id, replace(trim(raw_amount), ' ', '') as s from {{v_messy}}),
  c as (select doc_id, {SEPARATORS_SQL} as t from b)
select doc_id, {FLOAT_SQL} as amount from c""")
def _(t):
    return t.v_messy.select("doc_id", numbers.parse_money(F.col("raw_amount")).alias("amount"))


DATE_SQL = r"""case when coalesce(lower(trim({c})) in (""" + ALIASES.replace("{", "{{") + r"""), true) then null
  when regexp_full_match(left(trim({c}), 10), '\d{{4}}-\d{{1,2}}-\d{{1,2}}') then try_cast(left(trim({c}), 10) as date)
  when regexp_full_match(left(trim({c}), 10), '\d{{4}}\.\d{{1,2}}\.\d{{1,2}}\.?') then try_cast(replace(rtrim(left(trim({c}), 10), '.'), '.', '-') as date)
  when regexp_full_match(left(trim({c}), 10), '\d{{4}}/\d{{1,2}}/\d{{1,2}}') then try_cast(replace(left(trim({c}), 10), '/', '-') as date)
  when regexp_full_match(left(trim({c}), 10), '\d{{1,2}}\.\d{{1,2}}\.\d{{4}}\.?') or regexp_full_match(left(trim({c}), 10), '\d{{1,2}}/\d{{1,2}}/\d{{4}}')
    then try_cast(regexp_replace(left(trim({c}), 10), '^(\d+)[./](\d+)[./](\d+)\.?$', '\3-\2-\1') as date) end"""


@query("fn_parse_date", "select doc_id, cast(" + DATE_SQL.format(c="raw_date") + " as varchar) as parsed from {v_messy}")
def _(t):
    return t.v_messy.select("doc_id", dates.parse_date(F.col("raw_date")).cast("string").alias("parsed"))


@query("fn_fold", r"""
select doc_id, trim(regexp_replace(lower(strip_accents(text)), '\s+', ' ', 'g')) as folded from {documents}""")
def _(t):
    return t.documents.select("doc_id", text.fold(F.col("text")).alias("folded"))


@query("fn_tokenise", r"""
select doc_id, len(x) as n_tokens, len(list_distinct(x)) as n_distinct, x[1] as first_token, x[len(x)] as last_token
from (select doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') as x from {documents})""")
def _(t):
    x = F.col("x")
    return t.documents.select("doc_id", text.tokenise(F.col("text")).alias("x")).select(
        "doc_id",
        F.size(x).cast("bigint").alias("n_tokens"),
        F.size(F.array_distinct(x)).cast("bigint").alias("n_distinct"),
        F.try_element_at(x, F.lit(1)).alias("first_token"),
        F.try_element_at(x, F.lit(-1)).alias("last_token"),
    )


STOP = sql_list(K.STOPWORDS)
WORDS_SQL = (
    "list_distinct(list_filter(regexp_split_to_array(translate(lower({c}), '"
    + K.COMPARE_PUNCTUATION.replace("'", "''").replace("{", "{{").replace("}", "}}")
    + "', '" + " " * len(K.COMPARE_PUNCTUATION) + "'), '\\s+'), lambda w: length(w) >= 2 and w not in (" + STOP + ")))"
)


@query("fn_content_words", "select doc_id, len(w) as n_words, array_to_string(list_sort(w), ' ') as words from (select doc_id, "
       + WORDS_SQL.format(c="text") + " as w from {documents})")
def _(t):
    return t.documents.select("doc_id", text.content_words(F.col("text")).alias("w")).select(
        "doc_id",
        F.size("w").cast("bigint").alias("n_words"),
        F.array_join(F.array_sort("w"), " ").alias("words"),
    )


@query("fn_severity", """
select doc_id, raw, case lower(raw) when 'alacsony' then 'low' when 'kozepes' then 'medium' when 'magas' then 'high'
  when 'kritikus' then 'high' when 'critical' then 'high' when 'low' then 'low' when 'medium' then 'medium' when 'high' then 'high'
  when 'info' then 'info' else raw end as severity
from (select o_orderkey as doc_id, case when o_orderkey % 5 = 0 then 'Kritikus' when o_orderkey % 5 = 1 then 'magas' when o_orderkey % 5 = 2 then 'INFO' else o_orderpriority end as raw from {orders})""")
def _(t):
    raw = t.sql("""select o_orderkey as doc_id, case when o_orderkey % 5 = 0 then 'Kritikus' when o_orderkey % 5 = 1 then 'magas'
        when o_orderkey % 5 = 2 then 'INFO' else o_orderpriority end as raw from {orders}""")
    return raw.withColumn("severity", labels.severity(F.col("raw")))


@query("fn_contains_any", "select doc_id, "
       + " or ".join(f"contains(lower(text), '{w.lower()}')" for w in K.PERSONAL_DATA_WORDS) + " as has_personal, "
       + " or ".join(f"contains(lower(text), '{w.lower()}')" for w in K.SCHEDULE_WORDS) + " as has_schedule from {v_clause_text}")
def _(t):
    low = t.v_clause_text.select("doc_id", F.lower("text").alias("low"))
    return low.select(
        "doc_id",
        text.contains_any(F.col("low"), K.PERSONAL_DATA_WORDS).alias("has_personal"),
        text.contains_any(F.col("low"), K.SCHEDULE_WORDS).alias("has_schedule"),
    )


TAX_SQL = r"""case when regexp_full_match(translate({c}, '- ', ''), '\d{{11}}') then
  (10 - (""" + " + ".join(
    f"cast(substr(translate({{c}}, '- ', ''), {i + 1}, 1) as int) * {w}" for i, w in enumerate(K.TAX_ID_WEIGHTS)
) + r""") % 10) % 10 = cast(substr(translate({c}, '- ', ''), 8, 1) as int) end"""


@query("fn_tax_cdv", "select doc_id, " + TAX_SQL.format(c="issuer_tax_id") + " as issuer_valid, "
       + TAX_SQL.format(c="customer_tax_id") + " as customer_valid from {v_invoice}")
def _(t):
    return t.v_invoice.select(
        "doc_id",
        match.tax_id_valid(F.col("issuer_tax_id")).alias("issuer_valid"),
        match.tax_id_valid(F.col("customer_tax_id")).alias("customer_valid"),
    )


@query("fn_fuzzy_strict", r"""
with p as (select doc_id, line_no, item_code, lower(description) as a,
    case when line_no % 3 = 0 then lower(description) || ' x' || case when line_no = 3 then '' else '1' end
         when line_no % 3 = 1 then 'big ' || lower(description) || ' new long' else lower(description) end as b, quantity, total_net from {v_line}),
  q as (select *, list_distinct(string_split(a, ' ')) as wa, list_distinct(string_split(b, ' ')) as wb from p)
select doc_id, line_no, quantity, total_net, a = b or (len(list_intersect(wa, wb)) / greatest(len(wa), len(wb)) >= 0.8
  and len(list_filter(list_concat(list_filter(wa, lambda x: not list_contains(wb, x)), list_filter(wb, lambda x: not list_contains(wa, x))), lambda x: regexp_matches(x, '\d'))) = 0) as alike from q""")
def _(t):
    p = t.sql("""select doc_id, line_no, lower(description) as a, quantity, total_net,
        case when line_no % 3 = 0 then concat(lower(description), ' x', case when line_no = 3 then '' else '1' end)
             when line_no % 3 = 1 then concat('big ', lower(description), ' new long') else lower(description) end as b from {v_line}""")
    return p.select("doc_id", "line_no", "quantity", "total_net", match.names_alike(F.col("a"), F.col("b")).alias("alike"))


@query("fn_expiring", """
select doc_id, coalesce(case when lower(expiry_date) = 'indefinite' then null else
  (year(cast(expiry_date as date)) - 1998) * 12 + month(cast(expiry_date as date)) - 6 between 0 and 12 end, false) as expiring
from (select doc_id, case when lower(expiry_date) = 'indefinite' then null else expiry_date end as expiry_date from {v_contract})""")
def _(t):
    return t.v_contract.select(
        "doc_id", dates.expiring_soon(F.col("expiry_date"), F.lit("1998-06-15").cast("date"), K.EXPIRY_MONTHS).alias("expiring")
    )


def _case(table: dict, col: str, default) -> str:
    def q(x):
        return str(x) if isinstance(x, int) else f"'{x}'"
    return f"case {col} " + " ".join(f"when '{k}' then {q(v)}" for k, v in table.items()) + f" else {q(default)} end"


@query("fn_evidence", "select package_id, file_name, doc_type, " + _case(K.EVIDENCE_SCORES, "doc_type", 3) + " as evidence_score from {v_document}")
def _(t):
    return t.v_document.select(
        "package_id", "file_name", "doc_type", labels.evidence_score(F.col("doc_type")).alias("evidence_score")
    )


@query("fn_list_markup", r"""
with r as (select doc_id, case doc_id % 4 when 0 then '<item> flag ' || invoice_number || ' </item><item></item><item>late</item>'
    when 1 then '- first ' || invoice_number || chr(10) || '2) second' || chr(10) || ' * third' when 2 then ' only ' || invoice_number else null end as raw from {v_invoice})
select doc_id, case when raw is null then '' 
  when raw like '%<item>%' then array_to_string(list_filter(list_transform(regexp_extract_all(raw, '<item>\s*(.*?)\s*</item>', 1), lambda x: trim(x)), lambda x: x <> ''), '|')
  when contains(raw, chr(10)) then array_to_string(list_transform(list_filter(list_transform(string_split(raw, chr(10)), lambda x: trim(x)), lambda x: x <> ''),
      lambda x: regexp_replace(regexp_replace(x, '^[-*•]\s+', ''), '^\d+[.)]\s+', '')), '|')
  else trim(raw) end as items, coalesce(nullif(trim(raw), '') || '|', '') || 'end' as listed from r""")
def _(t):
    raw = t.sql("""select doc_id, case doc_id % 4 when 0 then concat('<item> flag ', invoice_number, ' </item><item></item><item>late</item>')
        when 1 then concat('- first ', invoice_number, chr(10), '2) second', chr(10), ' * third')
        when 2 then concat(' only ', invoice_number) else null end as raw from {v_invoice}""")
    return raw.select("doc_id", F.array_join(text.list_markup(F.col("raw")), "|").alias("items"),
                      F.array_join(text.list_markup_array(F.array("raw", F.lit(" "), F.lit(None).cast("string"), F.lit(" end\n"))), "|").alias("listed"))


TIER_SQL = """case when {a} is null or {b} is null or ({a} = 0 and {b} = 0) then null
  when abs({a} - {b}) <= 1 then 'ok' when abs({a} - {b}) / greatest(abs({a}), abs({b})) * 100 <= 1 then 'ok'
  when abs({a} - {b}) / greatest(abs({a}), abs({b})) * 100 <= 5 then 'warning' else 'critical' end"""


@query("fn_amount_tier", "select doc_id, line_no, quantity, total_net, total_gross, "
       + TIER_SQL.format(a="total_net", b="total_gross") + " as tier from {v_line}")
def _(t):
    return t.v_line.select(
        "doc_id", "line_no", "quantity", "total_net", "total_gross",
        numbers.amount_tier(F.col("total_net"), F.col("total_gross")).alias("tier"),
    )


@query("fn_doc_label", "select file_name, " + _case(K.DOC_LABELS, "doc_type", "Other") + """ as label,
  case when doc_ord % 10 > 8 then 'confident' else 'uncertain' end as certainty, case when language = 'hu' then 'Invoice' else """ + _case(K.DOC_LABELS, "doc_type", "Other") + """ end as shown,
  case when language = 'de' then 'other' else doc_type end as known from {v_document}""")
def _(t):
    given = F.when(F.col("language") == "hu", "Invoice").otherwise("Rechnung")
    return t.v_document.select(
        "file_name", labels.doc_label(F.col("doc_type")).alias("label"),
        labels.confidence_label(F.col("doc_ord") % 10 / 10).alias("certainty"),
        labels.display_label(given, F.col("doc_type")).alias("shown"),
        labels.known_type(F.when(F.col("language") == "de", "Beleg").otherwise(F.col("doc_type"))).alias("known"),
    )


@query("fn_conf_triage", """
select doc_id, array_to_string(list_sort(list_filter([case when doc_id % 2 = 0 then 'issue_date' end, case when doc_id % 3 = 0 then 'total_net' end,
    case when doc_id % 5 = 0 then 'invoice_number' end], lambda x: x is not null)), ',') as low_fields,
  array_to_string(list_sort(list_filter([case when doc_id % 2 = 1 and doc_id % 7 = 0 then 'issue_date' end, case when doc_id % 3 > 0 then 'total_net' end], lambda x: x is not null)), ',') as medium_fields
from {v_invoice}""")
def _(t):
    c = t.sql("""select doc_id, map('issue_date', case when doc_id % 2 = 0 then 'low' when doc_id % 7 = 0 then 'medium' else 'high' end,
        'total_net', case when doc_id % 3 = 0 then 'low' else 'medium' end,
        'invoice_number', case when doc_id % 5 = 0 then 'low' else 'high' end) as confidence from {v_invoice}""")
    return c.select(
        "doc_id",
        F.array_join(labels.confidence_fields(F.col("confidence"), "low"), ",").alias("low_fields"),
        F.array_join(labels.confidence_fields(F.col("confidence"), "medium"), ",").alias("medium_fields"),
    )

"""Queries over the rule engine."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditlake import constants as K
from auditlake.functions import labels, numbers
from auditlake.operators import rules
from auditlake.operators.names import contains_join
from auditlake.plans.registry import query, sql_list
from auditlake.plans.scalar import ALIASES, DATE_SQL, TAX_SQL

c = F.col
CORE = ["package_id", "doc_id", "source_check_id", "regulation", "severity", "description", "rationale"]
SHORT = ["package_id", "doc_id", "source_check_id", "severity", "description"]


def empty(col: str) -> str:
    return f"coalesce(lower(trim({col})) in ({ALIASES}), true)"


def union(parts: list[str]) -> str:
    return " union all ".join(parts)


def any_word(low: str, words) -> str:
    return "(" + " or ".join("contains(" + low + ", '" + w.lower().replace("'", "''") + "')" for w in words) + ")"


def dispatch_sql() -> str:
    parts = []
    for check, reg, hu, applies in K.CHECKS:
        if check in K.NOT_DISPATCHED:
            continue
        cond = f"doc_type in ({sql_list(applies)})" + (f" and lower(language) in ({sql_list(K.HU_LANGUAGES)})" if hu else "")
        parts.append(f"select package_id, file_name, doc_type, language, '{check}' as check_id, '{reg}' as regulation from {{v_document}} where {cond}")
    return union(parts)


@query("rule_dispatch", dispatch_sql())
def _(t):
    return rules.dispatch(t.v_document)


@query("rule_registry", "select check_id, regulation, count(*) as n_documents from (" + dispatch_sql() + ") group by all")
def _(t):
    return rules.dispatch(t.v_document).groupBy("check_id", "regulation").agg(F.count(F.lit(1)).alias("n_documents"))


@query("rule_mandatory", union(
    [f"select package_id, doc_id, 'check_01_invoice_mandatory' as source_check_id, '{sev}' as severity, 'Missing mandatory invoice element: {label}' as description from {{v_invoice}} where language = 'hu' and {empty(f)}"
     for f, label, sev in K.INVOICE_HEADER_FIELDS]
    + [f"select package_id, doc_id, 'check_01_invoice_mandatory', '{sev}', 'Missing mandatory invoice element: {label}' from {{v_invoice}} where language = 'hu' and {empty(p + '_' + f)}"
       for p, f, label, sev in K.INVOICE_PARTY_FIELDS]))
def _(t):
    return rules.emit(t.v_invoice, rules.masked("check_01_invoice_mandatory", rules.mandatory_fields())).select(*SHORT)


@query("rule_mandatory_lines", "with f as (select package_id, doc_id, "
       + ", ".join(f"bool_and({empty(f) if f in ('description', 'unit') else f + ' is null'}) as {f}" for f, _, _ in K.INVOICE_LINE_FIELDS)
       + " from {v_line} group by 1, 2) "
       + union([f"select package_id, doc_id, 'check_01_invoice_mandatory' as source_check_id, '{sev}' as severity, 'Missing mandatory line-item element: {label}' as description from f where {f}"
                for f, label, sev in K.INVOICE_LINE_FIELDS]))
def _(t):
    return rules.mandatory_line_fields(t.v_line).select(*SHORT)


@query("rule_buyer_taxid", f"""select package_id, doc_id, 'check_01_invoice_mandatory' as source_check_id, 'medium' as severity, total_vat * 2 as vat
from {{v_invoice}} where language = 'hu' and total_vat * 2 >= 100417 and {empty('customer_tax_id')}""")
def _(t):
    doubled = t.v_invoice.withColumn("vat", c("total_vat") * 2)
    return rules.emit(doubled, rules.masked("check_01_invoice_mandatory", [rules.buyer_tax_id(c("vat"), c("customer_tax_id"))]),
                      ("package_id", "doc_id", "vat")).select("package_id", "doc_id", "source_check_id", "severity", "vat")


@query("rule_tax_cdv", union([
    f"select package_id, doc_id, 'check_02_tax_cdv' as source_check_id, 'high' as severity, '{label} tax ID check digit invalid: ' || {p}_tax_id as description from {{v_invoice}} "
    f"where language = 'hu' and not {empty(p + '_tax_id')} and not coalesce({TAX_SQL.format(c=p + '_tax_id')}, true)"
    for p, label in (("issuer", "Issuer"), ("customer", "Customer"))]))
def _(t):
    return rules.emit(t.v_invoice, rules.masked("check_02_tax_cdv", rules.invoice_tax_ids())).select(*SHORT)


PARTIES_SQL = """select package_id, doc_id, case doc_id % 5 when 0 then 'contract' when 1 then 'delivery_note' when 2 then 'purchase_order' when 3 then 'other' else 'financial_report' end as doc_type,
  case when doc_id % 2 = 0 then 'hu' else 'en' end as language, party_a, party_b, party_a_tax_id, case when doc_id % 4 = 0 then '12345675-2-41' else party_b_tax_id end as party_b_tax_id from {v_contract}"""


@query("rule_tax_parties", "with p as (" + PARTIES_SQL + ") " + union([
    f"select package_id, doc_id, 'high' as severity, 'Party tax ID check digit invalid: ' || coalesce({p}, 'unknown') || ' (' || {p}_tax_id || ')' as description from p "
    f"where language = 'hu' and doc_type <> 'financial_report' and not {empty(p + '_tax_id')} and not coalesce({TAX_SQL.format(c=p + '_tax_id')}, true)" for p in ("party_a", "party_b")]))
def _(t):
    named = [(c(p), c(f"{p}_tax_id")) for p in ("party_a", "party_b")]
    return rules.emit(t.sql(PARTIES_SQL), rules.masked("check_02_tax_cdv", rules.party_tax_ids(named))).select("package_id", "doc_id", "severity", "description")


SCREENED = [("issuer", "issuer_name", "v_invoice"), ("customer", "customer_name", "v_invoice"), ("party", "party_a", "v_contract"), ("party", "party_b", "v_contract")]


def screened_sql() -> str:
    shown = "case when doc_id % 40 = 0 then 'JSC vtb bank and ROSNEFT' when doc_id % 40 = 1 then 'bank' else {name} end"
    return " union all ".join(f"select package_id, doc_id, '{source}' as source, {shown.format(name=name)} as name from {{{view}}}" for source, name, view in SCREENED)


@query("screen_parties", "with p as (" + screened_sql() + "), e as (select unnest(" + "[" + ", ".join(f"struct_pack(name := '{e}', country := '{k}')" for e, k in K.SANCTIONED_ENTITIES) + "], recursive := true)) " + """
select package_id, doc_id, 'Sanctions list match: ' || p.name || ' ~ ' || e.name || ' (' || country || ')' as description, source from p join e
on p.name <> '' and (contains(lower(p.name), lower(e.name)) or contains(lower(e.name), lower(p.name)))""")
def _(t):
    """Issuers, customers and contract parties against a list that is a table."""
    entities = t.spark.createDataFrame([(e, k) for e, k in K.SANCTIONED_ENTITIES], "name string, country string")
    found = rules.screen_parties(t.sql(screened_sql()), entities)
    return found.select("package_id", "doc_id", "description", F.regexp_extract("rationale", r"' \((issuer|customer|party)\) matches", 1).alias("source"))


@query("rule_completeness", union([
    f"select package_id, doc_id, regulation, severity, description from (select *, '{reg}' as regulation, '{sev}' as severity, '{d}' as description from {{v_contract}}) where {w}"
    for w, sev, d, reg in [
        (empty("termination_terms"), "high", "Missing contract element: Termination terms", K.REG_COMPLETENESS),
        (empty("governing_law"), "medium", "Missing contract element: Governing law", K.REG_COMPLETENESS),
        ("penalty is null and total_value > 1000000", "medium", "No penalty clause defined in a high-value contract", K.REG_PROPORTIONALITY),
        ("confidentiality_clause is false", "low", "Confidentiality clause missing", K.REG_COMPLETENESS)]]))
def _(t):
    return rules.emit(t.v_contract, rules.completeness(c("termination_terms"), c("governing_law"), c("penalty"), c("total_value"), c("currency"), c("confidentiality_clause"))).select(
        "package_id", "doc_id", "regulation", "severity", "description")


@query("rule_proportionality", """select package_id, doc_id, 'high' as severity,
  'Disproportionate penalty: penalty (' || format('{:,.0f}', penalty) || ') exceeds 30% of the contract value (' || format('{:,.0f}', total_value) || ' ' || currency || ')' as description
from {v_contract} where total_value > 0 and penalty > total_value * 0.317""")
def _(t):
    return rules.emit(t.v_contract, [rules.proportionality(c("penalty"), c("total_value"), c("currency"))]).select("package_id", "doc_id", "severity", "description")


@query("rule_rounded", """
with a as (select package_id, doc_id, unnest([total_net, total_gross]) as x from (
    select package_id, doc_id, total_net, round(total_gross / 30000) * 10000 as total_gross from {v_line}
    union all select package_id, doc_id, total_net, total_gross from {v_invoice})),
  b as (select package_id, doc_id, count(*) filter (x <> 0) as n_amounts, count(*) filter (abs(x) > 10417 and abs(x) % 10000 = 0) as n_round from a group by 1, 2)
select package_id, doc_id, n_amounts, n_round, case when n_round / n_amounts > 0.243 then 'medium' else 'low' end as severity
from b where n_amounts >= 3 and n_round / n_amounts > 0.147""")
def _(t):
    lines = t.v_line.withColumn("total_gross", F.round(c("total_gross") / 30000) * 10000)
    return rules.rounded_amounts(t.v_invoice, lines).select("package_id", "doc_id", "n_amounts", "n_round", "severity")


@query("rule_materiality", """select o_custkey as package_id, o_orderkey as doc_id, 'info' as severity,
  'Materiality threshold (ISA 320): ' || format('{:,.0f}', o_totalprice * 0.0193::double) || ' (document total: ' || format('{:,.0f}', o_totalprice) || ', ~2%)' as description
from {orders} where o_totalprice > 0""")
def _(t):
    docs = t.orders.select(c("o_custkey").alias("package_id"), c("o_orderkey").alias("doc_id"), "o_totalprice")
    return rules.emit(docs, [rules.materiality(c("o_totalprice"))]).select("package_id", "doc_id", "severity", "description")


def gdpr_sql() -> str:
    low = "low"
    flags = ", ".join(
        f"case when not {any_word(low, kws)} then '{name}' end as e{i}, " f"'{sev}' as s{i}"
        for i, (name, sev, kws) in enumerate(K.DATA_PROCESSING_ELEMENTS))
    every = "[" + ", ".join(f"e{i}" for i in range(10)) + "]"
    crit = "[" + ", ".join(f"e{i}" for i, e in enumerate(K.DATA_PROCESSING_ELEMENTS) if e[1] == "critical") + "]"
    high = "[" + ", ".join(f"e{i}" for i, e in enumerate(K.DATA_PROCESSING_ELEMENTS) if e[1] == "high") + "]"
    keep = "list_filter({0}, lambda x: x is not null)"
    return f"""
with t as (select package_id, doc_id, lower(text) as low from {{v_clause_text}}),
  f as (select package_id, doc_id, {any_word(low, K.PERSONAL_DATA_WORDS)} as personal, {any_word(low, K.SCHEDULE_WORDS)} as sched, {flags} from t),
  n as (select *, {keep.format(every)} as a, {keep.format(crit)} as k, {keep.format(high)} as h from f where personal)
select package_id, doc_id, 'medium' as severity, 'GDPR Article 28: ' || len(a) || ' element(s) not found in the main text (separate-schedule reference detected)' as description,
  array_to_string(a, ', ') as missing from n where sched and len(a) > 0
union all select package_id, doc_id, 'high', 'GDPR Article 28: ' || len(k) || ' critical element(s) missing from the data-processing agreement', array_to_string(k, ', ') from n where not sched and len(k) > 0
union all select package_id, doc_id, 'medium', 'GDPR Article 28: ' || len(h) || ' important element(s) missing from the data-processing agreement', array_to_string(h, ', ') from n where not sched and len(h) > 0"""


@query("rule_gdpr", gdpr_sql())
def _(t):
    docs = t.v_clause_text.select("package_id", "doc_id", F.lower("text").alias("low"))
    out = rules.emit(docs, rules.data_processing(c("low")))
    names = F.regexp_extract("rationale", r"(?:missing|main text|contract): (.*?)\.(?: To be verified in the schedule\.)?$", 1)
    return out.select("package_id", "doc_id", "severity", "description", names.alias("missing"))


@query("rule_red_flags", union([
    f"select package_id, doc_id, '{sev}' as severity, '{d}' as description from (select *, lower(text) as low from {{v_clause_text}}) where {w}"
    for w, sev, d in [
        (f"total_value > 4830000 and not {any_word('low', K.CHANGE_OF_CONTROL_WORDS)}", "medium", "Missing change-of-control clause in a high-value contract"),
        (any_word("low", K.AUTO_RENEWAL_WORDS), "medium", "Auto-renewal clause detected"),
        (any_word("low", K.NON_COMPETE_WORDS), "medium", "Non-compete clause detected"),
        (any_word("low", K.NO_ASSIGNMENT_WORDS), "high", "Contract assignment restriction")]]))
def _(t):
    docs = t.v_clause_text.select("package_id", "doc_id", "total_value", F.lower("text").alias("low"))
    return rules.emit(docs, rules.red_flags(c("low"), c("total_value"))).select("package_id", "doc_id", "severity", "description")


@query("rule_incoterms", union([
    rf"select package_id, doc_id, 'info' as severity, 'Incoterms 2020 term detected: {code} ({name})' as description from {{v_clause_text}} where regexp_matches(upper(text), '(^|[^\p{{L}}\p{{N}}_]){code}($|[^\p{{L}}\p{{N}}_])')"
    for code, name, _ in K.INCOTERMS]))
def _(t):
    return rules.emit(t.v_clause_text, rules.incoterms(c("text"))).select("package_id", "doc_id", "severity", "description")


@query("rule_ifrs", union([
    f"select package_id, doc_id, 'medium' as severity, '{title}' as description from (select *, lower(text) as low from {{v_clause_text}}) where {any_word('low', K.IFRS_WORDS)} and {any_word('low', a)} and {any_word('low', b)}"
    for a, b, title, _ in K.IFRS_ANOMALIES]))
def _(t):
    docs = t.v_clause_text.select("package_id", "doc_id", F.lower("text").alias("low"))
    return rules.emit(docs, rules.ifrs_anomalies(c("low"))).select("package_id", "doc_id", "severity", "description")


@query("rule_sanctions", """
with s as (select s_suppkey, s_name || ' of ' || n_name as party from {supplier} join {nation} on s_nationkey = n_nationkey)
select s_suppkey, party, n_name as entity, r_name as country, 'high' as severity
from s join {nation} on contains(lower(party), lower(n_name)) or contains(lower(n_name), lower(party)) join {region} on n_regionkey = r_regionkey""")
def _(t):
    parties = t.sql("select s_suppkey, concat(s_name, ' of ', n_name) as party from {supplier} join {nation} on s_nationkey = n_nationkey")
    entities = t.sql("select n_name as entity, r_name as country from {nation} join {region} on n_regionkey = r_regionkey")
    names = parties.select(F.lower("party").alias("name")).distinct()
    listed = entities.select(F.lower("entity").alias("other")).distinct()
    hits = contains_join(names, listed, "name", "other")
    return (
        parties.withColumn("name", F.lower("party")).join(hits, "name")
        .join(entities.withColumn("other", F.lower("entity")), "other")
        .select("s_suppkey", "party", "entity", "country", F.lit("high").alias("severity"))
    )


@query("rule_sanctions_list", union([
    f"select package_id, doc_id, 'Sanctions list match: ' || party || ' ~ {e} ({k})' as description from (select package_id, doc_id, case when doc_id % 40 = 0 then 'JSC vtb bank and ROSNEFT' when doc_id % 40 = 1 then 'bank' else party_a end as party from {{v_contract}}) where contains(lower(party), lower('{e}')) or contains(lower('{e}'), lower(party))"
    for e, k in K.SANCTIONED_ENTITIES]))
def _(t):
    docs = t.v_contract.withColumn("party", F.when(c("doc_id") % 40 == 0, "JSC vtb bank and ROSNEFT").when(c("doc_id") % 40 == 1, "bank").otherwise(c("party_a")))
    return rules.emit(docs, [], arrays=[rules.sanctions(c("party"), "party")]).select("package_id", "doc_id", "description")


@query("rule_risk_country", rf"""
select package_id, doc_id, 'medium' as severity, 'High-risk country: ' || party_a || ' (' || upper(left(party_a_tax_id, 2)) || ')' as description
from {{v_contract}} where regexp_matches(party_a_tax_id, '^\p{{L}}{{{{2}}}}') and upper(left(party_a_tax_id, 2)) in ({sql_list(K.HIGH_RISK_COUNTRIES)})""".replace("{{2}}", "{2}"))
def _(t):
    return rules.emit(t.v_contract, [rules.risk_country(c("party_a_tax_id"), c("party_a"), 0), rules.risk_country(c("party_b_tax_id"), c("party_b"), 1)]).select(
        "package_id", "doc_id", "severity", "description")


@query("rule_contract_dates", f"""
select package_id, doc_id, 'high' as severity, 'Date logic contradiction: expiry date (' || expiry_date || ') precedes effective date (' || effective_date || ')' as description, k as kind
from {{v_contract}}, (values ('domain_rule'), ('validation')) as x(k)
where expiry_date < effective_date and lower(expiry_date) not in ({sql_list(K.INDEFINITE_TOKENS)})""")
def _(t):
    e, x = c("effective_date"), c("expiry_date")
    return rules.emit(t.v_contract, [rules.contract_dates(e, x), rules.contract_dates(e, x, "validation")]).select("package_id", "doc_id", "severity", "description", "kind")


@query("applied_standards", f"""
with s as (select distinct package_id, regulation from {{v_finding}} where regulation is not null union select package_id, 'ISA 500' from {{v_finding}})
select package_id, array_to_string(list(regulation order by coalesce(list_position([{sql_list(K.STANDARD_ORDER)}], regulation), 100), regulation), ' | ') as standards from s group by 1""")
def _(t):
    return rules.applied_standards(t.v_finding)


# --- validation and plausibility ----------------------------------------------

@query("val_line_sum", """
with s as (select package_id, doc_id, sum(cast(total_net as decimal(18,2))) as n from {v_line} group by 1, 2)
select package_id, doc_id, cast(n as double) as line_net, total_net, 'high' as severity from s join {v_invoice} using (package_id, doc_id) where n > 0 and abs(cast(n as double) - total_net) > 1""")
def _(t):
    return rules.line_sum(t.v_invoice, t.v_line).select("package_id", "doc_id", "line_net", "total_net", "severity")


@query("val_totals", """select package_id, doc_id, 'high' as severity,
  'Net (' || format('{:.0f}', total_net) || ') + VAT (' || format('{:.0f}', total_vat) || ') = ' || format('{:.0f}', total_net + total_vat) || ', but gross = ' || format('{:.0f}', total_gross) as description
from {v_invoice} where abs(total_net + total_vat - total_gross) > 1""")
def _(t):
    return rules.emit(t.v_invoice, [rules.totals(c("total_net"), c("total_vat"), c("total_gross"))]).select("package_id", "doc_id", "severity", "description")


LINE_KEYS = ("package_id", "doc_id", "line_no", "quantity", "total_net", "total_vat", "total_gross", "vat_rate")


@query("val_line_vat", """select package_id, doc_id, line_no, quantity, total_net, total_vat, total_gross, vat_rate, 'high' as severity from {v_line}
where vat_rate > 0 and abs(total_net * vat_rate / 100 - total_vat) > greatest(1.0, total_net * 0.01::double)""")
def _(t):
    return rules.emit(t.v_line, rules.line_math()[:1], LINE_KEYS).select(*LINE_KEYS, "severity")


@query("val_line_gross", """select package_id, doc_id, line_no, quantity, total_net, total_vat, total_gross, vat_rate, 'high' as severity,
  'Line ''' || description || ''': net (' || format('{:.0f}', total_net) || ') + VAT (' || format('{:.0f}', total_vat) || ') = ' || format('{:.0f}', total_net + total_vat) || ', but gross = ' || format('{:.0f}', total_gross) as description
from {v_line} where abs(total_net + total_vat - total_gross) > 1""")
def _(t):
    return rules.emit(t.v_line, rules.line_math()[1:], LINE_KEYS).select(*LINE_KEYS, "severity", "description")


@query("val_due_before_issue", """select package_id, doc_id, 'medium' as severity, 'Payment due date (' || payment_due_date || ') is earlier than the issue date (' || issue_date || ')' as description
from {v_invoice} where payment_due_date < issue_date""")
def _(t):
    return rules.emit(t.v_invoice, [rules.due_before_issue(c("issue_date"), c("payment_due_date"))]).select("package_id", "doc_id", "severity", "description")


@query("plaus_vat", f"""
select package_id, doc_id, line_no, quantity, rate, case when rate < 0 or rate > 50 then 'medium' else 'low' end as severity
from (select *, case when line_no = 7 then vat_rate - 4 when line_no = 6 then vat_rate * 9 else vat_rate end as rate from {{v_line}})
where rate < 0 or rate > 50 or (trunc(rate) not in ({', '.join(map(str, K.KNOWN_VAT_RATES))}) and rate <> 0)""")
def _(t):
    lines = t.v_line.withColumn("rate", F.when(c("line_no") == 7, c("vat_rate") - 4).when(c("line_no") == 6, c("vat_rate") * 9).otherwise(c("vat_rate")))
    return rules.emit(lines, [rules.vat_rate_plausible(c("rate"), c("description"))], ("package_id", "doc_id", "line_no", "quantity", "rate")).select(
        "package_id", "doc_id", "line_no", "quantity", "rate", "severity")


@query("plaus_negative", """
select 'customer' as package_id, c_custkey as doc_id, 'Negative amount: amount = ' || format('{:.0f}', c_acctbal) as description, 'medium' as severity from {customer} where c_acctbal < 0
union all select 'supplier', s_suppkey, 'Negative amount: amount = ' || format('{:.0f}', s_acctbal), 'medium' from {supplier} where s_acctbal < 0""")
def _(t):
    parties = t.sql("""select 'customer' as package_id, c_custkey as doc_id, c_acctbal as amount from {customer}
        union all select 'supplier', s_suppkey, s_acctbal from {supplier}""")
    return rules.emit(parties, rules.negative_amounts(["amount"])).select("package_id", "doc_id", "description", "severity")


def plaus_date_sql() -> str:
    parts = []
    for f in ("issue_date", "expiry_date"):
        future = "false" if f in K.FAR_FUTURE_ALLOWED else "year(d) > 2030"
        parts.append(f"""select doc_id, 'low' as severity, case when d is null then 'Unparseable date: {f} = ''' || raw || '''' when year(d) < 2000 then 'Old date: {f} = ' || raw || ' (before 2000)'
            else 'Future date: {f} = ' || raw || ' (after 2030)' end as description
          from (select doc_id, raw, {DATE_SQL.format(c='raw')} as d from (select doc_id, case when doc_id % 5 = 0 then regexp_replace(raw_date, '(19|20)(\\d\\d)', '20\\2') else raw_date end as raw from {{v_messy}}))
          where not {empty('raw')} and (d is null or year(d) < 2000 or {future})""")
    return union(parts)


@query("plaus_dates", plaus_date_sql())
def _(t):
    raw = t.v_messy.select(F.lit(0).alias("package_id"), "doc_id", F.when(c("doc_id") % 5 == 0, F.regexp_replace("raw_date", r"(19|20)(\d\d)", "20$2")).otherwise(c("raw_date")).alias("issue_date"))
    docs = raw.withColumn("expiry_date", c("issue_date"))
    return rules.emit(docs, rules.plausible_dates(docs.columns)).select("doc_id", "severity", "description")


@query("finding_dedup", """
select package_id, description, doc_id, severity, source_check_id from (select *, row_number() over (partition by package_id, description order by stage, doc_id, rule_ord) as rn from {v_finding}) where rn = 1""")
def _(t):
    first = rules.first_per_package(t.v_finding, ("stage", "doc_id", "rule_ord"))
    return first.select("package_id", "description", "doc_id", "severity", "source_check_id")


@query("audit_report", """
with lines as (select package_id, doc_id, sum(cast(total_net as decimal(18,2))) as n from {v_line} group by 1, 2),
 f as (
  select package_id, 'Net (' || format('{:.0f}', total_net) || ') + VAT (' || format('{:.0f}', total_vat) || ') = ' || format('{:.0f}', total_net + total_vat) || ', but gross = ' || format('{:.0f}', total_gross) as d, 'high' as severity
    from {v_invoice} where abs(total_net + total_vat - total_gross) > 1
  union all select package_id, 'Line items'' net total (' || format('{:.0f}', cast(n as double)) || ') does not match the document total (' || format('{:.0f}', total_net) || ')', 'high'
    from lines join {v_invoice} using (package_id, doc_id) where n > 0 and abs(cast(n as double) - total_net) > 1
  union all select package_id, 'Materiality threshold (ISA 320): ' || format('{:,.0f}', total_gross * 0.0193::double) || ' (document total: ' || format('{:,.0f}', total_gross) || ', ~2%)', 'info' from {v_invoice} where total_gross > 0)
select package_id, count(distinct d) filter (severity = 'high') as n_high, count(distinct d) filter (severity = 'info') as n_info, count(*) as n_seen from f group by 1""")
def _(t):
    """Totals, line sums and materiality of every package after description dedup."""
    headers = t.v_invoice
    found = rules.emit(headers, [rules.totals(c("total_net"), c("total_vat"), c("total_gross")), rules.materiality(c("total_gross"))])
    found = found.unionByName(rules.line_sum(headers, t.v_line).select(*found.columns))
    return rules.first_per_package(found).groupBy("package_id").agg(
        F.count_if(c("severity") == "high").alias("n_high"), F.count_if(c("severity") == "info").alias("n_info"), F.sum("n_seen").alias("n_seen"))

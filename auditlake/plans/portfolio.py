"""Queries over the contract portfolio."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditlake.operators import portfolio, rules
from auditlake.plans.registry import query
from auditlake.plans.rules import empty

c = F.col


def asof():
    """Fixed reference day of the portfolio queries."""
    return F.lit("1998-06-15").cast("date")


SOON = "expiry_date <> 'Indefinite' and (year(try_cast(expiry_date as date)) - 1998) * 12 + month(try_cast(expiry_date as date)) - 6 between 0 and 12"

SUMMARY_SQL = f"""e as (
  select package_id, doc_id, 'contract_' || doc_id || '.txt' as file_name, expiry_date, total_value, monthly_fee, monthly_fee_currency,
    case when party_a < party_b then party_a || ' | ' || party_b else party_b || ' | ' || party_a end as party_key,
    cast({empty('termination_terms')} as int) + cast({empty('governing_law')} as int) + cast(penalty is null and total_value > 1000000 as int)
      + cast(coalesce(total_value > 0 and penalty > total_value * 0.317, false) as int)
      + cast(coalesce(expiry_date < effective_date and expiry_date <> 'Indefinite', false) as int) as n_elements,
    list_filter([case when change_of_control then 'change-of-control clause' end, case when non_compete then 'non-compete (restrictive covenant)' end,
      case when auto_renewal then 'auto-renewal clause' end], lambda x: x is not null) as red_flags from {{v_contract}}),
 s as (select *, case when len(red_flags) > 0 or n_elements >= 2 then 'high' when n_elements > 0 then 'medium' else 'low' end as risk_level from e)"""


def findings(t):
    k = t.v_contract
    return rules.emit(k, rules.completeness(c("termination_terms"), c("governing_law"), c("penalty"), c("total_value"), c("currency"), c("confidentiality_clause"))
                      + [rules.proportionality(c("penalty"), c("total_value"), c("currency")), rules.contract_dates(c("effective_date"), c("expiry_date"))])


def summary(t):
    k = t.v_contract.withColumn("file_name", F.concat(F.lit("contract_"), c("doc_id").cast("string"), F.lit(".txt"))).withColumn("parties", F.array("party_a", "party_b"))
    return portfolio.summarise(k, findings(t))


@query("dd_filter", "select package_id, file_name from {v_document} where doc_type = 'contract'")
def _(t):
    return portfolio.contracts_only(t.v_document).select("package_id", "file_name")


@query("dd_summary", f"with {SUMMARY_SQL} select package_id, doc_id, file_name, n_elements, array_to_string(red_flags, ', ') as red_flags, risk_level from s")
def _(t):
    return summary(t).select("package_id", "doc_id", "file_name", F.size("risk_elements").cast("bigint").alias("n_elements"), F.array_join("red_flags", ", ").alias("red_flags"), "risk_level")


@query("dd_price_anomaly", f"""with {SUMMARY_SQL} select package_id, party_key, count(*) as n_values, min(total_value) as min_value, max(total_value) as max_value
from s where total_value <> 0 group by 1, 2 having count(*) >= 2 and min(total_value) > 0 and max(total_value) / min(total_value) > 1.3""")
def _(t):
    return portfolio.price_anomalies(summary(t)).drop("ratio")


FLAGS_SQL = "f as (select package_id, doc_id, file_name, unnest(red_flags) as flag, generate_subscripts(red_flags, 1) as flag_no from s)"


@query("dd_legal", f"""with {SUMMARY_SQL}, {FLAGS_SQL}
select package_id, 'red_flag' as kind, file_name || ': ' || flag as entry, row_number() over (partition by package_id order by doc_id, flag_no) as rank from f
union all select package_id, 'change_of_control', file_name, null from f where flag like 'change%' union all select package_id, 'non_compete', file_name, null from f where flag like 'non-compete%'""")
def _(t):
    return portfolio.legal(summary(t))


@query("dd_compliance", """
select package_id, kind, rank, file_name || ': ' || description as entry from (select *, row_number() over (partition by package_id, kind order by doc_id, description) as rank
  from (select * exclude (kind), case source_check_id when 'check_08_gdpr_28' then 'gdpr' when 'check_13_aml_sanctions' then 'aml' end as kind from {v_finding}) where kind is not null)""")
def _(t):
    return portfolio.compliance(t.v_finding)


@query("dd_financial", f"""with {SUMMARY_SQL}
select package_id, 'monthly' as kind, monthly_fee_currency as entry, cast(sum(cast(monthly_fee as decimal(18,2))) as double) as amount from s where monthly_fee > 0 group by 1, 3
union all select package_id, 'expiring', file_name, null from s where {SOON} union all select package_id, 'high_value', file_name, total_value from s where total_value >= 10000000""")
def _(t):
    return portfolio.financial(summary(t), asof())


@query("dd_applicable", f"""with {SUMMARY_SQL}, n as (select package_id, count(*) as n from s group by 1),
 g as (select distinct package_id from {{v_finding}} where source_check_id in ('check_08_gdpr_28', 'check_13_aml_sanctions'))
select n.package_id, 'legal,financial' || case when n >= 2 then ',audit' || case when g.package_id is not null then ',compliance' else '' end else '' end as analyses from n left join g using (package_id)""")
def _(t):
    return portfolio.applicable_analyses(t.v_contract, t.v_finding).select("package_id", F.array_join("analyses", ",").alias("analyses"))


def rated(t):
    ratings = t.v_contract.filter(c("doc_id") % 3 == 0).select(
        "package_id", F.concat(F.lit("contract_"), c("doc_id").cast("string"), F.lit(".txt")).alias("file_name"),
        F.when(c("doc_id") % 2 == 0, "low").otherwise("extreme").alias("rating"), F.when(c("doc_id") % 5 == 0, "").otherwise("checked").alias("rating_rationale"))
    return portfolio.override_ratings(summary(t), ratings)


RATED_SQL = """r as (select * replace (case when doc_id % 3 = 0 and doc_id % 2 = 0 then 'low' else risk_level end as risk_level,
  case when doc_id % 3 = 0 and doc_id % 2 = 0 and doc_id % 5 <> 0 then list_concat(['DD assessment: checked'], red_flags) else red_flags end as red_flags) from s)"""


@query("dd_override", f"with {SUMMARY_SQL}, {RATED_SQL} select package_id, doc_id, risk_level, array_to_string(red_flags, ', ') as red_flags from r")
def _(t):
    return rated(t).select("package_id", "doc_id", "risk_level", F.array_join("red_flags", ", ").alias("red_flags"))


@query("dd_report", f"""with {SUMMARY_SQL}, {RATED_SQL}, f as (select package_id, unnest(red_flags) as flag from r),
 t as (select package_id, array_to_string(list(flag || ': ' || n order by flag || ': ' || n), '; ') as top from (select package_id, case when starts_with(flag, 'DD assessment: ') then 'DD assessment' else flag end as flag, count(*) as n from f group by 1, 2) group by 1),
 n as (select package_id, count(*) as contract_count, count(*) filter (risk_level = 'high') as high_risk_count, count(*) filter ({SOON}) as expiring_count from r group by 1)
select n.*, coalesce(top, '') as red_flag_counts, 'DD portfolio: ' || contract_count || ' contracts, ' || high_risk_count || ' high-risk, ' || expiring_count || ' expiring soon.' as executive_summary from n left join t using (package_id)""")
def _(t):
    return portfolio.report(rated(t), asof()).withColumn("red_flag_counts", F.array_join("red_flag_counts", "; "))

"""Queries over sources, reports, turns, evaluation and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditlake import constants as K
from auditlake.functions.text import upper
from auditlake.operators import evaluate, matching, portfolio, report, rules, turns
from auditlake.plans import matching as match_plans
from auditlake.plans import portfolio as dd_plans
from auditlake.plans.registry import query
from auditlake.plans.scalar import _case
from auditlake.session import shared_dir
from auditlake.sources import ingest, payloads, sinks
from auditlake.streaming import twins

c = F.col


# --- sources ------------------------------------------------------------------

@query("src_route", r"""
select page_id, path, case regexp_extract(lower(path), '[^/]\.([^./]+)$', 1) when 'pdf' then 'pdf' when 'docx' then 'docx' when 'png' then 'image' when 'jpg' then 'image' when 'jpeg' then 'image' else 'txt' end as route
from (select page_id, url || case page_id % 7 when 0 then '.PDF' when 1 then '/scan.jpeg' when 2 then '/a.b.docx' when 3 then '/x.tar.gz' when 4 then '.PnG' else '' end as path from {pages})""")
def _(t):
    tail = F.when(c("page_id") % 7 == 0, ".PDF").when(c("page_id") % 7 == 1, "/scan.jpeg").when(c("page_id") % 7 == 2, "/a.b.docx").when(c("page_id") % 7 == 3, "/x.tar.gz").when(
        c("page_id") % 7 == 4, ".PnG").otherwise("")
    return t.pages.select("page_id", F.concat("url", tail).alias("path")).withColumn("route", ingest.route(c("path")))


_A, _B = ingest.latin2_table()


@query("src_decode", rf"""
select doc_id, case when doc_id % 2 = 0 or regexp_full_match(text, '[\x00-\x7f]*') then text else translate(regexp_replace(text, '[^\x{{0000}}-\x{{00ff}}]', '?', 'g'), '{_A}', '{_B}') end as text from {{documents}}""")
def _(t):
    raw = F.when(c("doc_id") % 2 == 0, F.encode("text", "UTF-8")).otherwise(F.encode(F.regexp_replace("text", r"[^\u0000-ÿ]", "?"), "ISO-8859-1"))
    return t.documents.select("doc_id", raw.alias("content")).select("doc_id", ingest.decode_text(c("content")).alias("text"))


@query("page_assemble", """
select conv_id, array_to_string(list(case when turn % 4 = 3 then '' else text end order by turn) filter (turn % 4 <> 3 and text <> ''), chr(10) || chr(10)) as full_text, bool_or(role = 'system') as is_scanned, count(*) as page_count
from {conversations} group by 1""")
def _(t):
    pages = t.conversations.select("conv_id", c("turn").alias("page_no"), F.when(c("turn") % 4 == 3, "").otherwise(c("text")).alias("text"), (c("role") == "system").alias("is_scanned"))
    return ingest.assemble_pages(pages, ["conv_id"])


@query("page_triage", """
with p as (select doc_id, trim(case doc_id % 4 when 0 then '' when 1 then ' short' else text end, ' ' || chr(10)) as n, case when doc_id % 3 = 0 then text when doc_id % 3 = 1 then 'noise' end as o from {documents})
select doc_id, case when length(n) >= 50 then n when length(coalesce(o, '')) >= 50 then o when n <> '' then n else coalesce(o, '') end as text,
  length(n) < 50 and length(coalesce(o, '')) < 50 as is_scanned from p""")
def _(t):
    native = F.when(c("doc_id") % 4 == 0, "").when(c("doc_id") % 4 == 1, " short").otherwise(c("text"))
    ocr = F.when(c("doc_id") % 3 == 0, c("text")).when(c("doc_id") % 3 == 1, "noise")
    return t.documents.select("doc_id", ingest.triage_page(native, ocr).alias("p")).select("doc_id", "p.text", "p.is_scanned")


#: Customers of one Markdown table: a table is a block of a nation's customers, so that its size is bounded.
TABLE_ROWS = 50


@query("table_markdown", rf"""
with r as (select c_nationkey, c_custkey // {TABLE_ROWS} as block, c_custkey, replace(trim(c_name || chr(10) || 'x'), chr(10), ' ') as a, case when c_custkey % 3 = 0 then '' else c_mktsegment || ' with a very long trailing remark' end as b, c_custkey % 4 as w from {{customer}} where c_custkey % 11 <> 5),
 h as (select c_nationkey, block, min(c_custkey) as h, arg_min(case when w = 0 then 1 else 2 end, c_custkey) as n from r group by 1, 2),
 l as (select c_nationkey, block, c_custkey, case when n = 1 then '| ' || a || ' |' else '| ' || a || ' | ' || case when w = 0 then '' else b end || ' |' end
   || case when c_custkey = h then chr(10) || case when n = 1 then '| --- |' else '| --- | --- |' end else '' end as line from r join h using (c_nationkey, block))
select c_nationkey, block, array_to_string(list(line order by c_custkey), chr(10)) as markdown from l group by 1, 2""")
def _(t):
    cells = t.sql(f"""select c_nationkey, c_custkey div {TABLE_ROWS} as block, c_custkey as row_no, case when c_custkey % 11 = 5 then array('', ' ') when c_custkey % 4 = 0 then array(concat(c_name, chr(10), 'x '))
        else array(concat(' ', c_name, chr(10), 'x'), case when c_custkey % 3 = 0 then null else concat(c_mktsegment, ' with a very long trailing remark') end) end as cells from {{customer}}""")
    return ingest.table_markdown(cells, ["c_nationkey", "block"])


@query("src_files", """select source, count(*) as n_texts, cast(sum(length(text)) as bigint) as n_chars, 'txt' as route from {documents} where text <> '' group by 1""")
def _(t):
    """Texts written as files by source, then taken in from the folder: route, decoding, texts."""
    path = shared_dir(t.spark, "texts")
    t.documents.where("text <> ''").select("source", F.replace("text", F.lit("\n"), F.lit("\u0001")).alias("value")).write.partitionBy("source").text(path)
    files = ingest.read_files(t.spark, path, "*.txt")
    texts = files.select(F.regexp_extract("path", "/source=([^/]+)/", 1).alias("source"), "route", F.explode(F.split(F.regexp_replace(ingest.decode_text(c("content")), "\n$", ""), "\n")).alias("text"))
    return texts.groupBy("source", "route").agg(F.count(F.lit(1)).alias("n_texts"), F.sum(F.length("text")).alias("n_chars"))


@query("sink_findings", """select package_id, severity, count(*) as n, min(description) as first from {v_finding} group by 1, 2""")
def _(t):
    """Findings written by package in two appends, and read back."""
    path = shared_dir(t.spark, "findings")
    for part in (c("severity") == "high", c("severity") != "high"):
        sinks.write_by_package(t.v_finding.where(part), path)
    back = t.spark.read.parquet(path)
    return back.groupBy("package_id", "severity").agg(F.count(F.lit(1)).alias("n"), F.min("description").alias("first"))


@query("payload_read", r"""
select event_id, case when event_type in ('view', 'click') then event_type else 'universal' end as schema_name, case when event_id % 10 = 0 then null else cast(regexp_extract(props, '"k": *(\d+)', 1) as bigint) end as k,
  case when event_id % 10 = 0 then 'broken ' || props end as corrupt from {events}""")
def _(t):
    docs = t.events.select("event_id", c("event_type").alias("doc_type"), F.when(c("event_id") % 10 == 0, F.concat(F.lit("broken "), c("props"))).otherwise(c("props")).alias("payload"))
    out = payloads.read_payloads(docs, "payload", {"view": "k bigint, extra string", "click": "k bigint", "universal": "k bigint, note string"})
    return out.select("event_id", "schema_name", F.coalesce("view.k", "click.k", "universal.k").alias("k"), c("_corrupt").alias("corrupt"))


# --- reports --------------------------------------------------------------------

@query("report_buckets", """select package_id, count(*) filter (lower(severity) = 'high') as n_high, count(*) filter (lower(severity) = 'medium') as n_medium,
  count(*) filter (lower(severity) not in ('high', 'medium', 'info')) as n_low, count(*) filter (lower(severity) = 'info') as n_info from {v_finding} group by 1""")
def _(t):
    return report.severity_counts(t.v_finding)


@query("report_docs", "select package_id, file_name, " + _case(K.DOC_LABELS, "doc_type", "Other") + " as label, case when amount is null then 3 else 4 end as extracted_fields, "
       + _case(K.EVIDENCE_SCORES, "doc_type", 3) + " as evidence_score from {v_document}")
def _(t):
    payload = F.map_filter(F.create_map(F.lit("doc_type"), c("doc_type"), F.lit("language"), c("language"), F.lit("file_name"), c("file_name"), F.lit("amount"), c("amount").cast("string")), lambda _, v: v.isNotNull())
    return report.document_info(t.v_document, F.size(F.map_keys(payload)))


def runs(t):
    return t.sql("select package_id, min(cast(doc_ord as double)) as started, min(cast(doc_ord as double)) + count(*) * 0.5 as finished from {v_document} where package_id % 9 <> 0 group by package_id")


_MINUTES_SQL = "select package_id, count(*) as document_count, sum(" + _case(K.MANUAL_MINUTES, "doc_type", 15) + ") as manual_minutes from {v_document} group by 1"


@query("report_effort", "select d.package_id, document_count, manual_minutes, case when d.package_id % 9 <> 0 then round(document_count * 0.5::double, 3) end as seconds, case when d.package_id % 9 <> 0 then round(manual_minutes * 60.0::double / (document_count * 0.5::double), 1) else 0 end as speedup from (select package_id, count(*) as document_count, sum("
       + _case(K.MANUAL_MINUTES, "doc_type", 15) + ") as manual_minutes from {v_document} group by 1) d")
def _(t):
    return report.effort(t.v_document, runs(t))


@query("report_split", "select package_id, count(*) filter (kind <> 'llm_analysis' and severity <> 'info') as n_rule, count(*) filter (severity = 'info') as n_info, count(*) filter (kind = 'llm_analysis') as n_model from (select package_id, case when doc_id % 5 = 0 then 'llm_analysis' else kind end as kind, severity from {v_finding}) group by 1")
def _(t):
    return report.split_by_origin(t.v_finding.withColumn("kind", F.when(c("doc_id") % 5 == 0, "llm_analysis").otherwise(c("kind"))))


@query("report_topn", """select package_id, bucket, rank, doc_id, description from (select *, row_number() over (partition by package_id, bucket order by stage, doc_id, rule_ord) as rank
  from (select *, case when lower(severity) in ('high', 'medium', 'info') then lower(severity) else 'low' end as bucket from {v_finding})) where rank <= case bucket when 'high' then 3 when 'medium' then 3 else 0 end""")
def _(t):
    return report.top_findings(t.v_finding, {"high": 3, "medium": 3}).select("package_id", "bucket", "rank", "doc_id", "description")


@query("report_findings", """select package_id, bucket, row_number() over (partition by package_id, bucket order by stage, doc_id, rule_ord) as rank, doc_id, description
  from (select *, case when lower(severity) in ('high', 'medium', 'info') then lower(severity) else 'low' end as bucket from {v_finding})""")
def _(t):
    """Every finding of the report, ranked within its severity."""
    return report.top_findings(t.v_finding).select("package_id", "bucket", "rank", "doc_id", "description")


@query("list_docs", "select package_id, file_name, " + _case(K.DOC_LABELS, "doc_type", "Other") + " as label, doc_type, format('{:.0f}%', (doc_ord % 100) * 1.0) as confidence from {v_document}")
def _(t):
    from auditlake.functions import labels
    docs = t.v_document.withColumn("label", labels.doc_label(c("doc_type"))).withColumn("confidence", c("doc_ord") % 100 / 100)
    return report.list_documents(docs)


@query("get_extraction", """select package_id, file_name, '{"file":"' || file_name || '","doc_type":"' || doc_type || '","data":{"doc_ord":' || doc_ord || ',"language":"' || language || '"}}' as extraction from {v_document}""")
def _(t):
    return report.extraction_json(t.v_document, ["doc_ord", "language"])


@query("report_json", f"""with {dd_plans.SUMMARY_SQL}, m as ({_MINUTES_SQL}), n as (select package_id, count(*) filter (lower(severity) = 'high') as n_high from {{v_finding}} group by 1),
 k as (select package_id, count(*) as contract_count from s group by 1)
select m.package_id, m.document_count, m.manual_minutes, n_high, contract_count from m left join n using (package_id) left join k using (package_id)""")
def _(t):
    """One JSON report per package with the three-way amounts and the contract portfolio; four of its fields are read back."""
    h = match_plans.headers(t)
    cols = set(h.columns)
    res = matching.explode_results(h, [matching.levelled_amounts(a, b, i, cols) for i, (a, b) in enumerate(matching.PAIRS)])
    out = report.assemble(t.v_document, t.v_finding, runs(t), matching.roll_up(res, ["package_id"]), portfolio.report(dd_plans.summary(t), dd_plans.asof()))

    def number(path):
        return F.get_json_object("report", "$." + path).cast("bigint")

    return out.select("package_id", number("document_count").alias("document_count"), number("manual_minutes").alias("manual_minutes"),
                      number("n_high").alias("n_high"), number("dd_analysis.contract_count").alias("contract_count"))


INSIGHTS_SQL = """select c_custkey as package_id, case when c_custkey % 4 = 0 then null else concat('Summary of ', c_name) end as executive_summary,
  case c_custkey % 3 when 0 then null when 1 then array('late payment', c_mktsegment) else array('one') end as findings, case when c_custkey % 2 = 0 then array(c_name) end as key_observations,
  case c_custkey % 5 when 0 then '' when 1 then null else c_mktsegment end as package_type from {customer} where c_custkey % 7 <> 0"""


@query("report_insights", """
select d.package_id, case when c_custkey % 7 <> 0 then case when c_custkey % 4 = 0 then '' else 'Summary of ' || c_name end end as executive_summary,
  case when c_custkey % 7 <> 0 then case c_custkey % 3 when 0 then 0 when 1 then 2 else 1 end end as n_findings, case when c_custkey % 7 <> 0 and c_custkey % 3 = 1 then c_mktsegment end as second_finding,
  case when c_custkey % 7 <> 0 and c_custkey % 2 = 0 then c_name end as observation, case when c_custkey % 7 <> 0 then case when c_custkey % 5 < 2 then 'general' else c_mktsegment end end as package_type
from (select distinct package_id from {v_document}) d join {customer} on c_custkey = d.package_id""")
def _(t):
    """The insights section of the report, read back from its JSON; packages without an analysis have none."""
    out = report.assemble(t.v_document, t.v_finding, runs(t), insights=t.sql(INSIGHTS_SQL))
    part = F.from_json(F.get_json_object("report", "$.package_insights"), "executive_summary string, findings array<string>, key_observations array<string>, package_type string")
    read = out.select("package_id", part.alias("p"))
    return read.select("package_id", c("p.executive_summary").alias("executive_summary"), F.size("p.findings").alias("n_findings"), F.get("p.findings", F.lit(1)).alias("second_finding"),
                       F.get("p.key_observations", F.lit(0)).alias("observation"), c("p.package_type").alias("package_type")).withColumn("n_findings", F.when(c("n_findings") >= 0, c("n_findings")))


# --- turns -------------------------------------------------------------------------

CHAT_SQL = """select conv_id, turn, role, concat(case (conv_id + turn) % 9 when 0 then 'Compare these: ' when 1 then 'Ellenőrizd, check: ' when 2 then 'Where is the penalty? ' when 3 then 'Which documents are there? '
    when 4 then 'What is the GROSS amount? ' when 5 then 'Mennyivel drágább? ' when 6 then 'Missing key ' when 7 then '' else 'hello ' end, case when turn % 5 = 4 then '' else text end) as text from {conversations}"""


def intent_sql(col: str) -> str:
    return "case " + " ".join(f"when regexp_matches(strip_accents({col}), '{p}', 'i') then '{k}'" for k, p in K.INTENT_PATTERNS) + " else 'chat' end"


@query("chat_intent", f"select conv_id, turn, {intent_sql('text')} as intent from ({CHAT_SQL}) where role = 'user'")
def _(t):
    return t.sql(CHAT_SQL).filter("role = 'user'").select("conv_id", "turn", turns.intent(c("text")).alias("intent"))


@query("chat_plan", f"select conv_id, turn, case intent " + " ".join(f"when '{k}' then '{','.join(v)}'" for k, v in K.PLAN_BY_INTENT.items()) + f" end as steps from (select conv_id, turn, {intent_sql('text')} as intent from ({CHAT_SQL}) where role = 'user')")
def _(t):
    staged = t.sql(CHAT_SQL).filter("role = 'user'").select("conv_id", "turn", turns.intent(c("text")).alias("intent"))
    return staged.select("conv_id", "turn", F.array_join(turns.plan(c("intent")), ",").alias("steps"))


@query("chat_clean", f"select conv_id, turn, role, text from ({CHAT_SQL}) where not (role = 'assistant' and (" + " or ".join(f"starts_with(text, '{p}')" for p in K.ERROR_PREFIXES) + "))")
def _(t):
    return turns.without_errors(t.sql(CHAT_SQL))


@query("chat_last", f"select conv_id, arg_max(text, turn) filter (role = 'user') as question, coalesce(arg_max(text, turn) filter (role = 'assistant' and trim(text) <> ''), '(empty answer)') as answer from ({CHAT_SQL}) group by 1")
def _(t):
    return turns.last_turns(t.sql(CHAT_SQL))


@query("chat_citations", """
select doc_id, case when doc_id % 7 = 0 then 'skipped' when doc_id % 7 = 1 then 'too_short' when doc_id % 7 = 2 then 'no_source' when doc_id % 7 = 4 then 'unknown_source' else 'ok' end as verdict,
  case doc_id % 7 when 3 then 'invoice_' || doc_id || '.pdf' when 4 then 'invoice_' || doc_id || '.pdf,other.pdf' when 5 then 'invoice_' || doc_id || '.pdf' when 6 then 'invoice_' || doc_id else '' end as cited from {v_invoice}""")
def _(t):
    rows = t.sql("""select doc_id, case doc_id % 7 when 0 then 'thank you very much for the help' when 1 then 'yes' when 2 then 'no source is named in this long answer'
        when 3 then concat('The total is on [Source: Invoice_', cast(doc_id as string), '.PDF] as given') when 4 then concat('Both [Forrás: other.pdf; invoice_', cast(doc_id as string), '.pdf] say so')
        when 5 then concat('The file invoice_', cast(doc_id as string), '.pdf shows it all') else concat('See [source: invoice_', cast(doc_id as string), '] for the amounts') end as answer,
        case when doc_id % 7 > 0 then concat('found invoice_', cast(doc_id as string), '.pdf and order_1.png') end as tool_output from {v_invoice}""")
    out = turns.citation_verdict(rows)
    return out.select("doc_id", "verdict", F.array_join("cited", ",").alias("cited"))


QUESTION_SQL = """select package_id, doc_id as question_id, case doc_id % 4 when 0 then concat('What is on INVOICE_', cast(doc_id as string), '.pdf and delivery_', cast(doc_id as string), '.docx?')
    when 1 then concat('show me number ', cast(doc_id as string), ' again') when 2 then 'thanks' else concat('missing_', cast(doc_id as string), '.pdf please') end as question from {v_invoice}"""


@query("chat_files", f"""
with q as (select *, lower(question) as low from ({QUESTION_SQL})),
 e as (select distinct q.package_id, question_id, file_name from q join {{v_document}} d on d.package_id = q.package_id and list_contains(regexp_extract_all(low, '[a-z0-9_\\-]+\\.(?:pdf|docx|png|jpg|jpeg|txt)'), lower(file_name))),
 w as (select package_id, file_name, unnest(string_split(translate(regexp_replace(lower(file_name), '\\.[^.]*$', ''), '_-', '  '), ' ')) as word from {{v_document}})
select * from e union all
select distinct q.package_id, question_id, file_name from q join w on w.package_id = q.package_id and length(word) > 3 and contains(low, word) where not exists (select 1 from e where e.question_id = q.question_id and e.package_id = q.package_id)""")
def _(t):
    return turns.resolve_files(t.sql(QUESTION_SQL), t.v_document)


# --- evaluation ----------------------------------------------------------------------

EVAL_SQL = """select conv_id, case conv_id % 5 when 0 then 'list' when 1 then 'extract' when 2 then 'search' when 3 then 'compare' else 'validate' end as category,
  max(case when role = 'assistant' then text else '' end) as answer, upper(substr(max(case when role = 'user' then text else '' end), 1, 3)) as e1, case when conv_id % 2 = 0 then 'ánd' else 'zzz' end as e2 from {conversations} group by conv_id"""
EVAL_TOOLS = "(conv_id % 3 = 0 or conv_id % 3 = 1 and conv_id % 4 < 2 or conv_id % 3 = 2 and conv_id % 4 in (1, 2))"


def evaluated(t):
    """Runs of EVAL_SQL; its upper case goes character by character, as in the engine of the check text."""
    said = {role: F.max(F.when(c("role") == role, c("text")).otherwise("")) for role in ("assistant", "user")}
    categories = F.array(*[F.lit(x) for x in ("list", "extract", "search", "compare")])
    runs_ = t.conversations.groupBy("conv_id").agg(said["assistant"].alias("answer"), F.substring(said["user"], 1, 3).alias("asked")).select(
        "conv_id", "answer", F.coalesce(F.get(categories, (c("conv_id") % 5).cast("int")), F.lit("validate")).alias("category"),
        upper(c("asked")).alias("e1"), F.when(c("conv_id") % 2 == 0, "ánd").otherwise("zzz").alias("e2"))
    called = F.when(c("conv_id") % 4 == 0, F.array(F.lit("a"))).when(c("conv_id") % 4 == 1, F.array(F.lit("a"), F.lit("b"), F.lit("b"))).when(c("conv_id") % 4 == 2, F.array(F.lit("b"))).otherwise(F.array().cast("array<string>"))
    expected = F.when(c("conv_id") % 3 == 0, F.array().cast("array<string>")).when(c("conv_id") % 3 == 1, F.array(F.lit("a"))).otherwise(F.array(F.lit("b")))
    return runs_.select("conv_id", "category", evaluate.answer_passes(c("answer"), F.array("e1", "e2")).alias("passed"), evaluate.tools_match(expected, called).alias("tools_ok"))


PASS_SQL = f"(select conv_id, category, contains(lower(strip_accents(answer)), lower(strip_accents(e1))) or contains(lower(strip_accents(answer)), lower(strip_accents(e2))) as passed, {EVAL_TOOLS} as tools_ok from ({EVAL_SQL}))"


@query("eval_pass", f"select conv_id, category, passed from {PASS_SQL}")
def _(t):
    return evaluated(t).select("conv_id", "category", "passed")


@query("eval_tools", f"select conv_id, tools_ok from {PASS_SQL}")
def _(t):
    return evaluated(t).select("conv_id", "tools_ok")


@query("eval_by_cat", f"select category, count(*) as total, count(*) filter (passed) as passed, count(*) filter (tools_ok) as tools_ok from {PASS_SQL} group by rollup (category)")
def _(t):
    return evaluate.pass_rates(evaluated(t))


def rank_sql(keys: str, where: str) -> str:
    p = ", ".join(f"s[least(cast(floor(n_rows * {v}::double) as bigint), n_rows - 1) + 1] as {k}" for k, v in evaluate.RANKS.items())
    k = keys + ", " if keys else ""
    g = f" group by {keys}" if keys else ""
    return f"select {k} n_rows, min, max, round(mean, 4) as mean, {p} from (select {k} count(*) as n_rows, min(value) as min, max(value) as max, cast(sum(cast(value as decimal(28,6))) as double) / count(*) as mean, list_sort(list(value)) as s from {{events}} where {where}{g})"


@query("latency_stats", rank_sql("", "event_type <> 'error'"))
def _(t):
    r = t.events.select(c("value").alias("latency_ms"), (c("event_type") != "error").alias("ok"))
    return evaluate.latency_of_successes(r).withColumn("mean", F.round("mean", 4))


@query("latency_by_key", rank_sql("event_type", "value < 50"))
def _(t):
    """Statistics of the successful runs of each kind."""
    return evaluate.latency_stats(t.events.filter("value < 50"), ["event_type"], "value").withColumn("mean", F.round("mean", 4))


@query("throughput", """select event_type, count(*) filter (value < 50) as ok_count, count(*) as total, round(count(*) filter (value < 50) / (epoch(max(ts)) - epoch(min(ts))), 6) as per_second from {events} group by 1""")
def _(t):
    r = t.events.select("event_type", c("ts").cast("timestamp").alias("ts"), (c("value") < 50).alias("ok"))
    return evaluate.throughput(r, ["event_type"]).select("event_type", "ok_count", "total", F.round("per_second", 6).alias("per_second"))


CASES_SQL = """select c_custkey as package_id, cast(c_custkey % 4 as int) as risks_min, cast(c_custkey % 30 + 5 as int) as risks_max,
  case c_custkey % 3 when 0 then 'medium' when 1 then 'high' else 'info' end as severity_max from {customer}"""


@query("expectations", f"""
with k as ({CASES_SQL}), f as (select package_id, count(*) as n, max(case lower(severity) when 'high' then 3 when 'medium' then 2 when 'low' then 1 else 0 end) as r, bool_or(contains(lower(description), 'payment')) as pay,
    bool_or(contains(lower(description), 'mismatch')) as mis, bool_or(contains(lower(description), 'gdpr') or contains(lower(description), 'sanctions')) as any_ from {{v_finding}} group by 1),
 d as (select package_id, list_sort(list(distinct doc_type)) as kinds from {{v_document}} group by 1),
 b as (select k.*, coalesce(n, 0) as n, coalesce(r, 0) as r, coalesce(pay, false) as pay, coalesce(mis, false) as mis, coalesce(any_, false) as any_, kinds from k left join f using (package_id) left join d using (package_id))
select package_id, 'doc_types' as assertion, 'invoice,contract' as detail, coalesce(kinds = ['contract', 'invoice'], false) as passed from b
union all select package_id, 'risk_count_min', cast(risks_min as varchar), n >= risks_min from b union all select package_id, 'risk_count_max', cast(risks_max as varchar), n <= risks_max from b
union all select package_id, 'severity_max', severity_max, r <= case severity_max when 'high' then 3 when 'medium' then 2 else 0 end from b
union all select package_id, 'must_contain', 'Payment', pay from b union all select package_id, 'must_not_contain', 'mismatch', not mis from b union all select package_id, 'must_contain_any_of', 'GDPR,sanctions', any_ from b""")
def _(t):
    cases = t.sql(CASES_SQL).withColumn("expected_types", F.array(F.lit("invoice"), F.lit("contract"))).withColumn("must_all", F.array(F.lit("Payment"))).withColumn(
        "must_any", F.array(F.lit("GDPR"), F.lit("sanctions"))).withColumn("must_not", F.array(F.lit("mismatch")))
    return evaluate.check_expectations(cases, t.v_finding.withColumn("rationale", F.lit("")), t.v_document)


# --- streams --------------------------------------------------------------------------

@query("stream_rules", """select o_custkey as package_id, o_orderkey as doc_id, 'info' as severity,
  'Materiality threshold (ISA 320): ' || format('{:,.0f}', o_totalprice * 0.0193::double) || ' (document total: ' || format('{:,.0f}', o_totalprice) || ', ~2%)' as description from {orders} where o_totalprice > 0""")
def _(t):
    docs = twins.stream_table(t.spark, t.path, "orders").select(c("o_custkey").alias("package_id"), c("o_orderkey").alias("doc_id"), "o_totalprice")
    return twins.run_to_table(twins.document_rules(docs, [rules.materiality(c("o_totalprice"))]), "stream-rules").select("package_id", "doc_id", "severity", "description")


@query("stream_dedup", "select distinct user_id as package_id, event_type || ' failed' as description from {events}")
def _(t):
    found = twins.stream_table(t.spark, t.path, "events").select(c("user_id").alias("package_id"), F.concat("event_type", F.lit(" failed")).alias("description"), c("ts").cast("timestamp").alias("ts"))
    return twins.run_to_table(twins.first_findings(found, "ts"), "stream-dedup").select("package_id", "description")


@query("stream_merge", """
with u as (select user_id, event_id, case when event_id % 3 = 0 then null when event_id % 3 = 1 then '' else event_type end as status, case when event_id % 2 = 0 then 0 else value end as amount from {events})
select user_id, arg_max(status, event_id) filter (status <> '') as status, arg_max(amount, event_id) filter (amount <> 0) as amount from u group by 1""")
def _(t):
    u = twins.stream_table(t.spark, t.path, "events").select(
        "user_id", "event_id", F.when(c("event_id") % 3 == 0, F.lit(None)).when(c("event_id") % 3 == 1, "").otherwise(c("event_type")).alias("status"),
        F.when(c("event_id") % 2 == 0, 0.0).otherwise(c("value")).alias("amount"))
    return twins.merge_stream(u, ["user_id"], "event_id", ["status", "amount"], "stream-merge")


@query("stream_near_dup", """
with o as (select o_custkey as package_id, 'all' as issuer, round(o_totalprice / 20000) * 20000 as amount, o_orderkey as doc_id, 'inv-' || (o_orderkey % 50) as invoice_number, cast(o_orderdate as date) as d from {orders})
select a.package_id, a.issuer, a.amount, a.doc_id, a.invoice_number, count(*) as n_partners, min(b.doc_id) as first_partner from o a join o b on a.package_id = b.package_id and a.amount = b.amount and a.invoice_number <> b.invoice_number
  and abs(date_diff('day', a.d, b.d)) <= 13 group by all""")
def _(t):
    docs = twins.stream_table(t.spark, t.path, "orders").select(
        c("o_custkey").alias("package_id"), c("o_orderkey").alias("doc_id"), c("o_orderkey").alias("doc_ord"), F.lit("all").alias("issuer_name"),
        F.concat(F.lit("INV-"), (c("o_orderkey") % 50).cast("string")).alias("invoice_number"), c("o_orderdate").cast("date").cast("string").alias("issue_date"),
        (F.round(c("o_totalprice") / 20000) * 20000).alias("total_gross"), c("o_orderdate").cast("timestamp").alias("ts"))
    return twins.duplicate_candidates(docs, "ts", "stream-invoices")[0]

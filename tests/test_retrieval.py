import math
import random
import re

import pytest
from pyspark.sql import functions as F

from auditlake.operators import evaluate, extract, index, portfolio, report, retrieval, turns
from auditlake.plans.retrieval import indexed
from auditlake.sources import ingest, sinks

c = F.col


def test_chunk_breaks_and_overlap(spark):
    docs = spark.createDataFrame([("p", "s", "t", "First part. Second part here\n\nThird one goes on and on"), ("p", "e", "t", ""), ("p", "k", "t", "tiny")],
                                 "package_id string, source string, doc_type string, text string")
    got = {}
    for r in retrieval.chunk(docs, 32, 8).orderBy("source", "chunk_index").collect():
        got.setdefault(r.source, []).append(r.text)
    assert got["k"] == ["tiny"] and "e" not in got
    assert got["s"][0] == "First part. Second part here\n\n"
    assert got["s"][1].startswith("t here\n\n") and got["s"][-1].endswith("and on")


def test_bm25_against_formula(spark):
    rng = random.Random(1)
    texts = {i: " ".join(rng.choices(["tax", "net", "the", "law", "fee", "due"], weights=[1, 2, 9, 1, 1, 3], k=rng.randint(3, 12))) for i in range(30)}
    tok = {i: re.findall(r"\w+", t) for i, t in texts.items()}
    n, avg = len(tok), sum(map(len, tok.values())) / len(tok)
    vocab = {w for t in tok.values() for w in t}
    raw = {w: math.log(n - d + 0.5) - math.log(d + 0.5) for w in vocab for d in [sum(w in t for t in tok.values())]}
    floor = 0.25 * sum(raw.values()) / len(raw)
    idf = {w: floor if v < 0 else v for w, v in raw.items()}
    def score(q, t):
        return sum(idf.get(w, 0) * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / avg)) for w in q)
    query = ["tax", "law", "tax", "the"]
    want = sorted(((-round(score(query, t), 5), i) for i, t in tok.items()))[:8]
    got = index.bm25(indexed(spark.createDataFrame(list(texts.items()), "chunk_id int, text string")), spark.createDataFrame([(1, "Tax law, tax the")], "query_id int, query string"), 8)
    assert [(-round(r.score, 5), r.chunk_id) for r in got.orderBy("rank").collect()] == [w for w in want if w[0] < 0]


def test_vector_topk_in_batches(spark):
    rng = random.Random(4)
    vec = {i: [rng.uniform(-1, 1) for _ in range(8)] for i in range(50)}
    v = spark.createDataFrame(list(vec.items()), "vec_id int, vector array<double>").repartition(4)
    q = spark.createDataFrame([(i, vec[i]) for i in range(5)], "query_id bigint, vector array<double>")
    one = {tuple(r) for r in retrieval.vector_topk(v, q, 3).select("query_id", "vec_id", "rank").collect()}
    many = {tuple(r) for r in retrieval.vector_topk(v, q, 3, part=7, block=2).select("query_id", "vec_id", "rank").collect()}
    assert one == many and all((i, i, 0) in one for i in range(5))


def test_vector_topk_of_equal_vectors_and_odd_rows(spark):
    v = spark.createDataFrame([(i, [1.0, float(i % 2)]) for i in range(40)] + [(99, None), (None, [1.0, 1.0]), (77, [0.0, 0.0])], "vec_id bigint, vector array<float>")
    q = spark.createDataFrame([(1, [2.0, 0.0]), (2, [0.0, 0.0]), (3, None)], "query_id int, vector array<double>")
    for sizes in ({}, {"part": 6, "block": 1}):
        got = [(r.query_id, r.vec_id, r["rank"]) for r in retrieval.vector_topk(v, q, 4, **sizes).orderBy("query_id", "rank").collect()]
        assert got == [(1, i, k) for k, i in enumerate((0, 2, 4, 6))] + [(2, i, k) for k, i in enumerate((0, 1, 2, 3))]
    assert retrieval.vector_topk(v.limit(0), q, 4).count() == retrieval.vector_topk(v, q.limit(0), 4).count() == 0


def test_vector_topk_of_many_queries(spark):
    """More queries than a block holds: no driver, no error, and no product of rows in the plan."""
    q = spark.range(25_000).select(c("id").alias("query_id"), F.array(F.cos(c("id")), F.sin(c("id")), F.lit(0.5)).alias("vector"))
    v = spark.range(300).select(c("id").alias("vec_id"), F.array(F.cos(c("id") * 7), F.sin(c("id") * 7), F.lit(0.5)).alias("vector"))
    hits = retrieval.vector_topk(v, q, 2)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "WindowGroupLimit" in plan
    got = hits.where("rank = 0")
    assert got.count() == 25_000
    near = {r.query_id: r.vec_id for r in got.where("query_id < 300").collect()}
    assert all(near[i] == min(range(300), key=lambda j: (-round(math.cos(i - 7 * j), 9), j)) for i in range(0, 300, 37))


def test_fuse_and_rerank(spark):
    hit = "query_id int, chunk_id int, text string, rank int"
    v = spark.createDataFrame([(1, 10, "alpha", 0), (1, 11, "beta", 1)], hit)
    b = spark.createDataFrame([(1, 11, "beta", 0), (1, 12, "gamma penalty", 1)], hit)
    got = retrieval.fuse(v, b, 5).orderBy("rank").collect()
    assert [r.chunk_id for r in got] == [11, 10, 12]
    assert got[0].score == pytest.approx(1 / 61 + 1 / 62)
    q = spark.createDataFrame([(1, "Penalty amount")], "query_id int, query string")
    again = retrieval.rerank(retrieval.fuse(v, b, 5), q).orderBy("new_rank").collect()
    assert again[0].chunk_id == 12
    out = retrieval.format_hits(retrieval.rerank(retrieval.fuse(v, b, 5), q).withColumn("source", c("chunk_id").cast("string"))).first().output
    assert out.startswith("[Forrás: 12, relevancia: 0.016]\ngamma penalty\n\n---\n\n")


@pytest.mark.parametrize("n", [1, 2, 20, 100, 101])
def test_latency_nearest_rank(spark, n):
    rng = random.Random(n)
    values = [round(rng.choice([rng.uniform(0, 10), 5.0, -3.0, rng.uniform(0, 1e6)]), 2) for _ in range(n)]
    row = evaluate.latency_stats(spark.createDataFrame([("k", x) for x in values], "k string, x double"), ["k"], "x").first()
    s = sorted(values)
    assert (row.min, row.max, row.n_rows) == (s[0], s[-1], n)
    assert [row.p50, row.p95, row.p99] == [s[min(int(n * p), n - 1)] for p in (0.5, 0.95, 0.99)]


def test_latency_falls_back_to_all_runs(spark):
    runs = spark.createDataFrame([(1.0, False), (3.0, False)], "latency_ms double, ok boolean")
    assert evaluate.latency_of_successes(runs).first().n_rows == 2


def test_extract_invoice_golden(spark):
    text = ("Invoice number: 2026/001\nIssue date: 2026-01-31\nPayment due: 2026-02-29\nIssuer: AcmeSoft Inc.\nTax ID: 12345676-2-41\nCustomer: Beta Corp\n"
            "Total net: $20,000.00\nTotal VAT: 4,000.00\nTotal gross: 24,000.00 USD")
    row = spark.createDataFrame([(text,)], "t string").select(extract.invoice_fields(c("t")).alias("f")).select("f.*").first()
    assert (row.invoice_number, row.issue_date, row.payment_due_date) == ("2026/001", "2026-01-31", "2026-02-29")
    assert (row.issuer_name, row.issuer_tax_id, row.customer_name) == ("AcmeSoft Inc.", "12345676-2-41", "Beta Corp")
    assert (row.total_net, row.total_vat, row.total_gross, row.currency) == (20000.0, 4000.0, 24000.0, "USD")
    assert row.confidence["total_net"] == "high" and len(row.quotes) == 6


def test_extract_contract_golden(spark):
    text = "NDA between A and B. Effective date: 2026-01-15. Expiry date: 2027.1.15. Governing law: Delaware, US. Penalty $50,000"
    row = spark.createDataFrame([(text,)], "t string").select(extract.contract_fields(c("t")).alias("f")).select("f.*").first()
    assert (row.contract_type, row.effective_date, row.expiry_date, row.governing_law, row.confidentiality_clause) == ("NDA", "2026-01-15", "2027-01-15", "Delaware, US", True)
    assert row.non_compete is None and row.termination_terms is None


def test_classify_and_language(spark):
    df = spark.createDataFrame([("delivery-note_1.pdf", "invoice"), ("x.pdf", "Rechnung der die das und ist"), ("y.txt", "nothing")], "file_name string, text string")
    got = [(r.doc_type, r.confidence, r.language) for r in extract.classify(df).collect()]
    assert got == [("delivery_note", 0.85, "en"), ("invoice", 0.7, "de"), ("other", 0.5, "en")]


def test_portfolio_golden(spark):
    rows = [("p", 1, "a.pdf", "service", ["A", "B"], "2026-08-01", 60000.0, "USD", 5000.0, "USD", False, False, False),
            ("p", 2, "b.pdf", None, ["B", "A"], "2027-01-01", 240000.0, None, 20000.0, None, True, False, False)]
    k = spark.createDataFrame(rows, "package_id string, doc_id int, file_name string, contract_type string, parties array<string>, expiry_date string, total_value double, currency string, "
                                    "monthly_fee double, monthly_fee_currency string, change_of_control boolean, non_compete boolean, auto_renewal boolean")
    none = spark.createDataFrame([], "package_id string, doc_id int, file_name string, severity string, description string, source_check_id string")
    s = portfolio.summarise(k, none)
    asof = F.lit("2025-12-01").cast("date")
    assert [(r.risk_level, r.contract_type, r.currency) for r in s.orderBy("doc_id").collect()] == [("low", "service", "USD"), ("high", "unknown", "USD")]
    assert round(portfolio.price_anomalies(s).first().ratio, 1) == 4.0
    fin = {(r.kind, r.entry): r.amount for r in portfolio.financial(s, asof).collect()}
    assert fin == {("monthly", "USD"): 25000.0, ("expiring", "a.pdf"): None}
    rep = portfolio.report(s, asof).first()
    assert rep.executive_summary == "DD portfolio: 2 contracts, 1 high-risk, 1 expiring soon." and rep.red_flag_counts == ["change-of-control clause: 1"]
    assert portfolio.applicable_analyses(s, none).first().analyses == ["legal", "financial", "audit"]


@pytest.mark.parametrize("question,want", [
    ("How many documents are uploaded and what types are they?", "list"), ("What is the gross total on x.pdf?", "extract"), ("Find the penalty", "search"),
    ("Compare the two", "compare"), ("Ellenőrizd az adószámot", "validate"), ("hello", "chat"),
])
def test_intents(spark, question, want):
    assert spark.createDataFrame([(question,)], "q string").select(turns.intent(c("q"))).first()[0] == want


def test_pages_and_tables(spark):
    pages = spark.createDataFrame([("d", 2, "two", False), ("d", 1, "one", True), ("d", 3, "", False)], "d string, page_no int, text string, is_scanned boolean")
    row = ingest.assemble_pages(pages, ["d"]).first()
    assert (row.full_text, row.is_scanned) == ("one\n\ntwo", True)
    table = spark.createDataFrame([("t", 1, [" a\nb ", "c"]), ("t", 2, [None, ""]), ("t", 3, ["x" * 40, "y", "z"]), ("t", 4, ["q"])], "t string, row_no int, cells array<string>")
    assert ingest.table_markdown(table, ["t"]).first().markdown == "| a b | c |\n| --- | --- |\n| " + "x" * 40 + " | y |\n| q |  |"
    assert ingest.table_markdown(table, ["t"], cell_chars=30).first().markdown == "| a b | c |\n| --- | --- |\n| " + "x" * 30 + " | y |\n| q |  |"
    assert ingest.table_markdown(table, ["t"], widest=True).first().markdown.startswith("| a b | c |  |\n| --- | --- | --- |")


def test_decode(spark):
    df = spark.createDataFrame([("Ő".encode(),), ("Árvíztűrő".encode("iso8859-2"),)], "b binary")
    assert [r[0] for r in df.select(ingest.decode_text(c("b"))).collect()] == ["Ő", "Árvíztűrő"]


def test_sink_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("p", 1), ("q", 2)], "package_id string, n int")
    sinks.write_by_package(df, str(tmp_path / "t"))
    assert [r.n for r in sinks.read_package(spark, str(tmp_path / "t"), "q").collect()] == [2]


def test_report_assembly(spark):
    docs = spark.createDataFrame([("p", "a", "invoice"), ("p", "b", "contract")], "package_id string, file_name string, doc_type string")
    found = spark.createDataFrame([("p", 1, "x", "HIGH", 1, 1, "domain_rule"), ("p", 2, "y", "odd", 1, 1, "domain_rule")], "package_id string, doc_id int, description string, severity string, stage int, rule_ord int, kind string")
    runs = spark.createDataFrame([("p", 0.0, 10.0)], "package_id string, started double, finished double")
    import json
    out = json.loads(report.assemble(docs, found, runs).first().report)
    assert (out["manual_minutes"], out["speedup"], out["n_high"], out["n_low"]) == (43, 258.0, 1, 1)
    assert (out["n_rule"], out["documents"]) == (2, {"n_invoice": 1, "n_delivery_note": 0, "n_purchase_order": 0, "n_contract": 1, "n_financial_report": 0})
    assert [(r.description, r["rank"]) for r in report.top_findings(found).orderBy("doc_id").collect()] == [("x", 1), ("y", 1)]


def test_reference_lists_with_and_without_file(spark, tmp_path):
    entities, countries = ingest.reference_lists(spark, str(tmp_path / "none.json"))
    assert entities.count() == countries.count() == 0
    (tmp_path / "list.json").write_text('{"entities": [{"name": "Acme", "country": "XX", "type": "firm"}], "high_risk_countries": ["YY", "ZZ"]}')
    entities, countries = ingest.reference_lists(spark, str(tmp_path / "list.json"))
    assert [tuple(r) for r in entities.collect()] == [("Acme", "XX", "firm")] and sorted(r.country for r in countries.collect()) == ["YY", "ZZ"]
    (tmp_path / "empty").mkdir()
    assert ingest.reference_lists(spark, str(tmp_path / "empty"))[0].count() == 0


def test_top_lists_are_limited_before_the_shuffle(spark):
    hits = spark.createDataFrame([(1, 10, "a", 0)], "query_id int, chunk_id int, text string, rank int")
    texts = spark.createDataFrame([(1, "tax law")], "chunk_id int, text string")
    asked = spark.createDataFrame([(1, "tax")], "query_id bigint, query string")
    vectors = spark.createDataFrame([(1, [1.0, 0.0])], "vec_id bigint, vector array<double>")
    for df in (retrieval.fuse(hits, hits, 3), index.bm25(indexed(texts), asked, 3), retrieval.vector_topk(vectors, vectors.withColumnRenamed("vec_id", "query_id"), 3)):
        assert "WindowGroupLimit" in df._jdf.queryExecution().executedPlan().toString()


def test_language_reads_the_whole_text(spark):
    from auditlake.operators import extract

    long = "x " * 20000 + "der die und das ist nicht ein eine mit der"
    row = spark.createDataFrame([(long,)], "t string").select(extract.detect_language(c("t")).alias("whole"), extract.detect_language(c("t"), 5000).alias("head")).first()
    assert (row.whole, row.head) == ("de", "en")


def test_near_duplicates_read_one_digit_dates(spark):
    from auditlake.operators import duplicates

    rows = [("p", 1, 1, "A", "n1", "2026-2-3", 5.0), ("p", 2, 2, "A", "n2", "2026-4-10", 5.0), ("p", 3, 3, "A", "n3", "2026-02-05", 5.0)]
    docs = spark.createDataFrame(rows, "package_id string, doc_id int, doc_ord int, issuer_name string, invoice_number string, issue_date string, total_gross double")
    assert {(r.doc_id, r.n_partners) for r in duplicates.near_duplicates(docs).collect()} == {(1, 1), (3, 1)}

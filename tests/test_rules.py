import pytest
from pyspark.sql import functions as F

from auditlake import constants as K
from auditlake.operators import rules

c = F.col


def run(spark, schema, row, findings, **kw):
    df = spark.createDataFrame([("p", 1, *row)], "package_id string, doc_id int, " + schema)
    return [(r.severity, r.description) for r in rules.emit(df, findings, **kw).orderBy("seq").collect()]


@pytest.mark.parametrize("net,vat,gross,hit", [(100.0, 20.0, 121.0, False), (100.0, 20.0, 121.01, True), (55000.0, 11000.0, 67500.0, True), (None, 1.0, 5.0, False)])
def test_totals(spark, net, vat, gross, hit):
    got = run(spark, "net double, vat double, gross double", (net, vat, gross), [rules.totals(c("net"), c("vat"), c("gross"))])
    assert bool(got) is hit
    if net == 55000.0:
        assert got == [("high", "Net (55000) + VAT (11000) = 66000, but gross = 67500")]


@pytest.mark.parametrize("penalty,value,hit", [(317.0, 1000.0, False), (317.01, 1000.0, True), (500.0, 0.0, False), (None, 10.0, False)])
def test_proportionality(spark, penalty, value, hit):
    assert bool(run(spark, "p double, v double", (penalty, value), [rules.proportionality(c("p"), c("v"), F.lit("USD"))])) is hit


@pytest.mark.parametrize("value,penalty,found", [(1_000_000.0, None, False), (1_000_001.0, None, True), (2_000_000.0, 1.0, False)])
def test_penalty_clause(spark, value, penalty, found):
    got = run(spark, "v double, p double", (value, penalty), rules.completeness(F.lit("x"), F.lit("law"), c("p"), c("v"), F.lit("USD"), F.lit(True)))
    assert [d for _, d in got] == (["No penalty clause defined in a high-value contract"] if found else [])


def test_completeness_null_and_false_differ(spark):
    def sev(flag):
        return [s for s, _ in run(spark, "k boolean", (flag,), rules.completeness(F.lit("n/a"), F.lit(None), F.lit(1.0), F.lit(5.0), F.lit("USD"), c("k")))]
    assert sev(None) == ["high", "medium"]
    assert sev(False) == ["high", "medium", "low"]


@pytest.mark.parametrize("vat,tax,hit", [(100_416.0, None, False), (100_417.0, None, True), (200_000.0, "1", False)])
def test_buyer_tax_id(spark, vat, tax, hit):
    assert bool(run(spark, "v double, t string", (vat, tax), [rules.buyer_tax_id(c("v"), c("t"))])) is hit


@pytest.mark.parametrize("rate,sev", [(-1.0, "medium"), (51.0, "medium"), (50.0, "low"), (20.0, None), (9.0, "low"), (0.0, None), (27.9, None)])
def test_vat_rate(spark, rate, sev):
    got = run(spark, "r double", (rate,), [rules.vat_rate_plausible(c("r"), F.lit("beam"))])
    assert [s for s, _ in got] == ([sev] if sev else [])


@pytest.mark.parametrize("eff,exp,hit", [("2026-01-01", "2025-12-15", True), ("2026-01-01", "2026-01-01", False), ("2026-01-01", "Indefinite", False), ("2026-01-01", "n/a", False), (None, "2025-01-01", False)])
def test_contract_dates(spark, eff, exp, hit):
    assert bool(run(spark, "a string, b string", (eff, exp), [rules.contract_dates(c("a"), c("b"))])) is hit


def test_dates_plausible(spark):
    got = run(spark, "issue_date string, expiry_date string", ("1999-01-01", "2040-01-01"), rules.plausible_dates(["issue_date", "expiry_date"]))
    assert got == [("low", "Old date: issue_date = 1999-01-01 (before 2000)")]
    got = run(spark, "issue_date string, expiry_date string", ("2031-01-01", "soon"), rules.plausible_dates(["issue_date", "expiry_date"]))
    assert got == [("low", "Future date: issue_date = 2031-01-01 (after 2030)"), ("low", "Unparseable date: expiry_date = 'soon'")]


@pytest.mark.parametrize("amounts,sev", [([20000.0, 1.5], None), ([20000.0, 1.5, 2.5, 3.5], "medium"), ([20000.0] + [1.5] * 5, "low"), ([20000.0] + [1.5] * 6, None)])
def test_rounded(spark, amounts, sev):
    lines = spark.createDataFrame([("p", 1, a, None) for a in amounts], "package_id string, doc_id int, total_net double, total_gross double")
    got = [r.severity for r in rules.rounded_amounts(lines.limit(0), lines).collect()]
    assert got == ([sev] if sev else [])


def test_line_fields_missing_everywhere_only(spark):
    lines = spark.createDataFrame([("p", 1, "a", 1.0, "", None, 5.0), ("p", 1, "", None, "n/a", 3.0, 5.0)],
                                  "package_id string, doc_id int, description string, quantity double, unit string, unit_price_net double, vat_rate double")
    assert [r.description for r in rules.mandatory_line_fields(lines).collect()] == ["Missing mandatory line-item element: Unit of measure"]


def test_data_processing(spark):
    low = F.lower(c("t"))
    assert run(spark, "t string", ("nothing here",), rules.data_processing(low)) == []
    got = run(spark, "t string", ("Personal data, audit right, encryption",), rules.data_processing(low))
    assert [(s, d[:42]) for s, d in got] == [("high", "GDPR Article 28: 5 critical element(s) mis"), ("medium", "GDPR Article 28: 3 important element(s) mi")]
    assert [s for s, _ in run(spark, "t string", ("personal data, see Annex",), rules.data_processing(low))] == ["medium"]


def test_incoterms_whole_word(spark):
    got = run(spark, "t string", ("CIP Budapest (Incoterms 2020), principal fob.",), rules.incoterms(c("t")))
    assert [d for _, d in got] == ["Incoterms 2020 term detected: CIP (Carriage and Insurance Paid)", "Incoterms 2020 term detected: FOB (Free on Board)"]


def test_sanctions_and_country(spark):
    got = run(spark, "n string", ("Volga Industrial Holdings Ltd",), [], arrays=[rules.sanctions(c("n"), "party")])
    assert [d for _, d in got] == ["Sanctions list match: Volga Industrial Holdings Ltd ~ Volga Industrial Holdings (RU)"]
    assert run(spark, "n string", (None,), [], arrays=[rules.sanctions(c("n"), "party")]) == []
    assert run(spark, "t string", ("ru123",), [rules.risk_country(c("t"), F.lit("X"), 0)]) == [("medium", "High-risk country: X (RU)")]


def test_rule_text_and_report_text(spark):
    df = spark.createDataFrame([(["a q"], [("n", None)], ["el"], None, ["d", ""], "x", None)],
                               "q array<string>, k array<struct<name:string,content:string>>, e array<string>, t string, l array<string>, r string, s string")
    body = rules.rule_text(c("q"), c("k"), c("e"), c("t"))
    assert df.select(rules.report_rule_text(body, c("l"), c("r"), c("s"))).first()[0] == "a q n el d x"


def test_first_per_package_order(spark):
    rows = [("p", 2, "same", 1, 1, 0), ("p", 1, "same", 2, 1, 0), ("p", 3, "same", 1, 1, 0), ("q", 1, "same", 1, 1, 0)]
    df = spark.createDataFrame(rows, "package_id string, doc_id int, description string, stage int, rule_ord int, seq int")
    got = {(r.package_id, r.doc_id, r.n_seen) for r in rules.first_per_package(df).collect()}
    assert got == {("p", 2, 3), ("q", 1, 1)}


def test_dispatch_masks(spark):
    docs = spark.createDataFrame([("p", "a", "invoice", "HU"), ("p", "b", "invoice", "en"), ("p", "c", "letter", "hu")], "package_id string, file_name string, doc_type string, language string")
    got = rules.dispatch(docs).groupBy("file_name").count().collect()
    assert {r.file_name: r["count"] for r in got} == {"a": 5, "b": 3}
    assert len(K.CHECKS) == 14


def test_standards_order(spark):
    df = spark.createDataFrame([("p", "Zeta"), ("p", "ISA 320"), ("p", None), ("p", "Alpha"), ("p", "HU VAT Act §169")], "package_id string, regulation string")
    assert rules.applied_standards(df).first().standards == "HU VAT Act §169 | ISA 500 | ISA 320 | Alpha | Zeta"

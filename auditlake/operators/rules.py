"""Per-document audit rules.

A rule is a function of columns that returns nullable finding structs.  All
rules of a table run in one projection: the structs are put in one array,
NULLs are filtered and the rest exploded, so a document is read once however
many rules apply.  Line rules work on the flat line table; rules over all
lines of a document are partial aggregates, never collected line lists.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake import constants as K
from auditlake.functions import dates, match, numbers, text
from auditlake.functions.numbers import general, plain_whole, whole
from auditlake.functions.text import is_empty, is_null_alias

#: Order of the stages whose findings are merged per package.
STAGES = {"quote": 0, "compare": 1, "validation": 2, "domain_rule": 3, "candidate": 4, "plausibility": 5, "duplicate": 6}

CHECK = {c[0]: c for c in K.CHECKS}
REGULATION = {c[0]: c[1] for c in K.CHECKS}
FINDING_COLUMNS = [
    "package_id", "doc_id", "description", "severity", "rationale", "kind",
    "regulation", "source_check_id", "stage", "rule_ord", "seq",
]


@dataclass(frozen=True)
class Rule:
    """A registered rule: ``build`` takes the column names of its scope's table and returns finding structs, or arrays of them if ``several``."""

    check_id: str
    scope: str
    build: Callable[[list[str]], list[Column]]
    several: bool = False


#: Registered rules by scope, in order. Scopes are the tables that rules run on: invoice, contract, wording, line.
RULES: dict[str, list[Rule]] = {"invoice": [], "contract": [], "wording": [], "line": []}


def register(check_id: str, scope: str, regulation: str | None = None, applies_to: list[str] | None = None, hungarian_only: bool = False, several: bool = False):
    """Add a rule to the audit: the decorated function builds its findings from the columns of the scope's table.

    A ``check_id`` that is not known yet brings its ``regulation`` and the document types that it ``applies_to`` ("*"
    for all), and is dispatched like the others from then on. A rule of a dispatched check runs only where that applies.
    """
    if check_id not in CHECK and regulation is not None:
        CHECK[check_id] = (check_id, regulation, hungarian_only, applies_to or ["*"])
        REGULATION[check_id] = regulation

    def add(build):
        RULES[scope].append(Rule(check_id, scope, build, several))
        return build

    return add


def unregister(check_id: str) -> None:
    """Take a check and its rules out again."""
    CHECK.pop(check_id, None)
    REGULATION.pop(check_id, None)
    for scope, kept in RULES.items():
        RULES[scope] = [r for r in kept if r.check_id != check_id]


def run_scope(scope: str, table: DataFrame, keys: tuple = ("package_id", "doc_id"), dispatched: bool = True, also: list[Column] | None = None) -> DataFrame:
    """Findings of all rules of a scope on its table, in one pass; rules of dispatched checks need ``doc_type`` and ``language``.

    ``dispatched=False`` runs validation and plausibility only, ``also`` adds findings of the caller.
    """
    single, arrays = list(also or []), []
    for rule in RULES[scope]:
        if rule.check_id in CHECK and not dispatched:
            continue
        made = rule.build(table.columns)
        (arrays if rule.several else single).extend(masked(rule.check_id, made) if rule.check_id in CHECK else made)
    return emit(table, single, keys, arrays or None).select(*keys, *[c for c in FINDING_COLUMNS if c not in keys])


def text_of(*parts) -> Column:
    """Message text from strings and columns; a NULL part counts as blank."""
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def finding(when: Column, severity, description, rationale, check_id: str, seq: int = 0,
            kind: str = "domain_rule", regulation: str | None = None) -> Column:
    """A finding struct where ``when`` holds, else NULL."""
    def col(x):
        return x if isinstance(x, Column) else F.lit(x)

    number = re.match(r"check_(\d+)", check_id)
    rule_ord = int(number.group(1)) if number else 0
    reg = regulation or REGULATION.get(check_id)
    return F.when(
        when,
        F.struct(
            col(description).alias("description"),
            col(severity).alias("severity"),
            col(rationale).alias("rationale"),
            F.lit(kind).alias("kind"),
            F.lit(reg).cast("string").alias("regulation"),
            F.lit(check_id).alias("source_check_id"),
            F.lit(STAGES[kind]).alias("stage"),
            F.lit(rule_ord).alias("rule_ord"),
            F.lit(seq).alias("seq"),
        ),
    )


def emit(df: DataFrame, findings: list[Column], keys: tuple = ("package_id", "doc_id"), arrays: list[Column] | None = None) -> DataFrame:
    """One row per non-NULL finding of each input row; ``arrays`` hold several findings each."""
    every = F.filter(F.array(*findings), lambda f: f.isNotNull()) if findings else F.array()
    if arrays:
        # NULL arrays (nothing to test) count as empty
        more = F.flatten(F.filter(F.array(*arrays), lambda a: a.isNotNull()))
        every = F.concat(every, more) if findings else more
    # exploded from an array of one first: a test for empty arrays would else be pushed to the scan and run all rules twice
    return df.select(*keys, F.explode(F.array(every)).alias("_every")).select(*keys, F.explode("_every").alias("f")).select(*keys, "f.*")


def applicable(check_id: str, doc_type: Column, language: Column) -> Column:
    """Dispatch test: not skipped, type listed, and Hungarian rules for Hungarian documents only."""
    _, _, hu_only, applies = CHECK[check_id]
    if check_id in K.NOT_DISPATCHED:
        return F.lit(False)
    ok = F.lit(True) if "*" in applies else doc_type.isin(applies)
    return ok & F.lower(language).isin(K.HU_LANGUAGES) if hu_only else ok


def dispatch(docs: DataFrame) -> DataFrame:
    """Document x applicable rule rows."""
    dt, lang = F.col("doc_type"), F.col("language")
    pairs = F.filter(
        F.array(*[
            F.when(applicable(c, dt, lang), F.struct(F.lit(c).alias("check_id"), F.lit(reg).alias("regulation")))
            for c, reg, _, _ in CHECK.values()
        ]),
        lambda x: x.isNotNull(),
    )
    return docs.select("package_id", "file_name", "doc_type", "language", F.explode(pairs).alias("r")).select(
        "package_id", "file_name", "doc_type", "language", "r.*"
    )


# --- invoices ---------------------------------------------------------------

def mandatory_fields(field=F.col) -> list[Column]:
    check = "check_01_invoice_mandatory"
    out = []
    for name, label, sev in K.INVOICE_HEADER_FIELDS:
        out.append(finding(
            is_empty(field(name)), sev, f"Missing mandatory invoice element: {label}",
            f"Per {K.REG_INVOICE}, '{label}' is a mandatory element on every invoice. The field is null or empty.",
            check, len(out)))
    for party, sub, label, sev in K.INVOICE_PARTY_FIELDS:
        out.append(finding(
            is_empty(field(f"{party}_{sub}")), sev, f"Missing mandatory invoice element: {label}",
            f"Per {K.REG_INVOICE}, '{label}' is mandatory. The '{party}.{sub}' field is null or empty.",
            check, len(out)))
    return out


def buyer_tax_id(total_vat: Column, customer_tax_id: Column) -> Column:
    return finding(
        (total_vat >= K.BUYER_TAX_ID_VAT) & is_empty(customer_tax_id), "medium",
        "Customer tax ID missing while VAT exceeds 100,000 HUF threshold",
        text_of(f"Per {K.REG_INVOICE}(e), the customer tax ID is mandatory when the VAT total reaches 100,000 HUF. VAT total: ",
                whole(total_vat), "."),
        "check_01_invoice_mandatory", 20)


def mandatory_line_fields(lines: DataFrame) -> DataFrame:
    """An element missing on every line of the document; partial aggregation by document."""
    def missing(c: str) -> Column:
        kind = lines.schema[c].dataType.typeName()
        return is_empty(F.col(c)) if kind == "string" else F.col(c).isNull()

    flags = lines.groupBy("package_id", "doc_id").agg(
        *[F.bool_and(missing(c)).alias(c) for c, _, _ in K.INVOICE_LINE_FIELDS]
    )
    return emit(flags, lines_without(F.col))


def tax_id_digit(tax_id: Column, who, seq: int) -> Column:
    """``who`` is the start of the message, up to the id."""
    return finding(
        ~is_empty(tax_id) & ~F.coalesce(match.tax_id_valid(tax_id), F.lit(True)), "high",
        who(tax_id), text_of("The tax ID ", tax_id, " has an invalid mod-11 check digit."),
        "check_02_tax_cdv", seq)


def invoice_tax_ids() -> list[Column]:
    return [
        tax_id_digit(F.col("issuer_tax_id"), lambda x: text_of("Issuer tax ID check digit invalid: ", x), 0),
        tax_id_digit(F.col("customer_tax_id"), lambda x: text_of("Customer tax ID check digit invalid: ", x), 1),
    ]


def party_tax_ids(parties: list[tuple[Column, Column]]) -> list[Column]:
    """Check digits of named parties: (name, tax id) of each."""
    return [
        tax_id_digit(tax_id, lambda x, name=name: text_of("Party tax ID check digit invalid: ", F.coalesce(name, F.lit("unknown")), " (", x, ")"), 2 + i)
        for i, (name, tax_id) in enumerate(parties)
    ]


def rounded_amounts(headers: DataFrame, lines: DataFrame) -> DataFrame:
    """Share of suspiciously round amounts among all net and gross amounts of a document."""
    amounts = lines.select("package_id", "doc_id", "total_net", "total_gross").unionByName(
        headers.select("package_id", "doc_id", "total_net", "total_gross")
    )
    def used(c):
        return _rounds(c)[0]

    def rounds(c):
        return _rounds(c)[1]

    counts = amounts.groupBy("package_id", "doc_id").agg(
        F.sum(used("total_net") + used("total_gross")).alias("n_amounts"),
        F.sum(rounds("total_net") + rounds("total_gross")).alias("n_round"),
    )
    return emit(counts, round_amounts(F.col("n_amounts"), F.col("n_round")), ("package_id", "doc_id", "n_amounts", "n_round"))


def materiality(total: Column) -> Column:
    overall = total * K.MATERIALITY_OVERALL
    return finding(
        total > 0, "info",
        text_of("Materiality threshold (ISA 320): ", whole(overall), " (document total: ", whole(total), ", ~2%)"),
        text_of("Per ISA 320, the materiality threshold for this document is ", whole(overall), ". Trivial: ",
                whole(overall * K.MATERIALITY_TRIVIAL), ", performance: ", whole(overall * K.MATERIALITY_PERFORMANCE), "."),
        "check_07_materiality")


# --- contracts --------------------------------------------------------------

def completeness(termination: Column, law: Column, penalty: Column, value: Column, currency: Column,
                 confidentiality: Column) -> list[Column]:
    check = "check_03_contract_completeness"
    return [
        finding(is_empty(termination), "high", "Missing contract element: Termination terms",
                "Without termination terms, the contract carries unpredictable risk.", check, 0),
        finding(is_empty(law), "medium", "Missing contract element: Governing law",
                "Missing governing law creates uncertainty in any dispute.", check, 1),
        finding(penalty.isNull() & (value > K.PENALTY_CLAUSE_VALUE), "medium",
                "No penalty clause defined in a high-value contract",
                text_of("Contract value is ", whole(value), " ", F.coalesce(currency, F.lit("")),
                        " but no penalty clause is present. For high-value contracts, a penalty clause is best practice "
                        "for predictable enforcement."),
                check, 2, regulation=K.REG_PROPORTIONALITY),
        finding(confidentiality.eqNullSafe(False), "low", "Confidentiality clause missing",
                "The contract has no confidentiality clause. In B2B relationships, protecting business information is recommended.",
                check, 3),
    ]


def proportionality(penalty: Column, value: Column, currency: Column) -> Column:
    return finding(
        (value > 0) & (penalty > value * K.PENALTY_RATIO), "high",
        text_of("Disproportionate penalty: penalty (", whole(penalty), ") exceeds 30% of the contract value (", whole(value), " ",
                F.coalesce(currency, F.lit("")), ")"),
        text_of("The penalty is ", plain_whole(penalty / value * 100), "% of the contract value. Court practice across many "
                "jurisdictions allows reduction of penalties exceeding 30% as disproportionate. This may qualify as a striking "
                "value imbalance under contract law."),
        "check_04_proportionality")


def rule_text(quotes: Column, clauses: Column, risk_elements: Column, contract_type: Column) -> Column:
    """Searchable contract text: quotes, clause names and contents, risk elements, type."""
    wording = F.transform(clauses, lambda c: F.concat_ws(" ", c["name"], c["content"]))
    return F.concat_ws(" ", quotes, wording, risk_elements, contract_type)


def report_rule_text(base: Column, line_descriptions: Column, report_type: Column, standard: Column) -> Column:
    """The same for financial reports, with line descriptions and the report's own labels."""
    return F.concat_ws(" ", base, F.filter(line_descriptions, lambda d: d != ""), F.nullif(report_type, F.lit("")),
                       F.nullif(standard, F.lit("")))


def data_processing(low: Column) -> list[Column]:
    """Required elements of a data-processing agreement; ``low`` is the lower-case text."""
    check = "check_08_gdpr_28"
    def absent(level=None):
        return F.filter(
            F.array(*[F.when(~text.contains_any(low, kws), F.lit(name))
                      for name, sev, kws in K.DATA_PROCESSING_ELEMENTS if level in (None, sev)]),
            lambda x: x.isNotNull())

    personal = text.contains_any(low, K.PERSONAL_DATA_WORDS)
    schedule = text.contains_any(low, K.SCHEDULE_WORDS)

    def group(level, word, sev, seq):
        names = absent(level)
        lead = ("The contract involves processing of personal data, but the following GDPR Article 28(3) mandatory elements are missing: "
                if level == "critical" else "The following GDPR Article 28 elements are not found in the contract: ")
        return finding(personal & ~schedule & (F.size(names) > 0), sev,
                       text_of("GDPR Article 28: ", F.size(names).cast("string"), f" {word} element(s) missing from the data-processing agreement"),
                       text_of(lead, F.array_join(names, ", "), "."), check, seq)

    names = absent()
    return [
        finding(personal & schedule & (F.size(names) > 0), "medium",
                text_of("GDPR Article 28: ", F.size(names).cast("string"),
                        " element(s) not found in the main text (separate-schedule reference detected)"),
                text_of("The contract processes personal data and references a separate schedule/DPA document. "
                        "The following are not found in the main text: ", F.array_join(names, ", "), ". To be verified in the schedule."),
                check, 0),
        group("critical", "critical", "high", 1),
        group("high", "important", "medium", 2),
    ]


def red_flags(low: Column, value: Column) -> list[Column]:
    check = "check_09_dd_red_flags"
    return [
        finding((value > K.RED_FLAG_VALUE) & ~text.contains_any(low, K.CHANGE_OF_CONTROL_WORDS), "medium",
                "Missing change-of-control clause in a high-value contract",
                text_of("Contract value is ", whole(value), ", but no change-of-control clause is present. In an acquisition, "
                        "the contract's future would be uncertain."), check, 0),
        finding(text.contains_any(low, K.AUTO_RENEWAL_WORDS), "medium", "Auto-renewal clause detected",
                "The contract contains an auto-renewal clause. From a DD perspective, this creates an open-ended obligation.", check, 1),
        finding(text.contains_any(low, K.NON_COMPETE_WORDS), "medium", "Non-compete clause detected",
                "The contract contains a non-compete clause. In an M&A context, EU practice limits these to a maximum of 2 years.", check, 2),
        finding(text.contains_any(low, K.NO_ASSIGNMENT_WORDS), "high", "Contract assignment restriction",
                "The contract is non-assignable. After an acquisition, the new owner cannot automatically step into the contract.", check, 3),
    ]


def incoterms(body: Column) -> list[Column]:
    upper = F.upper(body)
    return [
        finding(upper.rlike(rf"(?U)\b{code}\b"), "info", f"Incoterms 2020 term detected: {code} ({name})",
                f"{risk}. Incoterms 2020 defines the allocation of shipping risk and cost between the parties.",
                "check_10_incoterms", i)
        for i, (code, name, risk) in enumerate(K.INCOTERMS)
    ]


def ifrs_anomalies(low: Column) -> list[Column]:
    context = text.contains_any(low, K.IFRS_WORDS)
    return [
        finding(context & text.contains_any(low, subject) & text.contains_any(low, conflict), "medium", title, why,
                "check_11_ifrs_har", i)
        for i, (subject, conflict, title, why) in enumerate(K.IFRS_ANOMALIES)
    ]


def sanctions(name: Column, source: str, entities=None) -> Column:
    """Findings of a name against a short fixed list, as an array; a list held in a table is joined
    with ``operators.names.contains_join`` instead."""
    listed = F.array(*[
        F.struct(F.lit(e).alias("name"), F.lit(e.lower()).alias("low"), F.lit(k).alias("country")) for e, k in (entities or K.SANCTIONED_ENTITIES)])
    low = F.lower(name)
    hits = F.when(low != "", F.filter(listed, lambda e: F.contains(low, e["low"]) | F.contains(e["low"], low)))

    def to_finding(e, i):
        return finding(
            F.lit(True), "high", text_of("Sanctions list match: ", name, " ~ ", e["name"], " (", e["country"], ")"),
            text_of("'", name, f"' ({source}) matches the EU/OFAC sanctioned entity '", e["name"], "' (country: ", e["country"],
                    "). Verify whether the sanctions status is current."),
            "check_13_aml_sanctions", 0)

    return F.transform(hits, to_finding)


def screen_parties(parties: DataFrame, entities: DataFrame) -> DataFrame:
    """Names against a sanctions list held in a table: one finding for each party and entity that contain each other.

    ``parties``: package_id, doc_id, source, name; ``entities``: name, country.
    Only the distinct names meet the list, by substring look-up.
    """
    from auditlake.operators.names import contains_join

    low = F.lower("name")
    named = parties.filter(F.col("name") != "").withColumn("_low", low)
    listed = entities.filter(F.col("name") != "").select(low.alias("_entity"), F.col("name").alias("entity"), "country")
    hits = contains_join(named.select("_low").distinct(), listed.select("_entity").distinct(), "_low", "_entity")
    return named.join(hits, "_low").join(listed, "_entity").select(
        "package_id", "doc_id", text_of("Sanctions list match: ", F.col("name"), " ~ ", F.col("entity"), " (", F.col("country"), ")").alias("description"),
        F.lit("high").alias("severity"),
        text_of("'", F.col("name"), "' (", F.col("source"), ") matches the EU/OFAC sanctioned entity '", F.col("entity"), "' (country: ", F.col("country"),
                "). Verify whether the sanctions status is current.").alias("rationale"),
        F.lit("domain_rule").alias("kind"), F.lit(REGULATION["check_13_aml_sanctions"]).alias("regulation"), F.lit("check_13_aml_sanctions").alias("source_check_id"))


def risk_country(tax_id: Column, name: Column, seq: int) -> Column:
    code = F.upper(F.substring(tax_id, 1, 2))
    return finding(
        tax_id.rlike(r"^\p{L}{2}") & code.isin(K.HIGH_RISK_COUNTRIES), "medium",
        text_of("High-risk country: ", F.coalesce(name, F.lit("?")), " (", code, ")"),
        text_of("The party tax-ID prefix (", code, ") indicates a high-risk country (FATF/EU list). Enhanced Due Diligence is required."),
        "check_13_aml_sanctions", seq)


def dates_reversed(effective: Column, expiry: Column) -> Column:
    return (
        ~is_null_alias(effective) & ~is_null_alias(expiry)
        & ~F.lower(expiry).isin(K.INDEFINITE_TOKENS) & (expiry < effective)
    )


def contract_dates(effective: Column, expiry: Column, kind: str = "domain_rule") -> Column:
    """Lexical order of ISO dates; ``kind='validation'`` is the same test in the earlier stage."""
    message = text_of("Date logic contradiction: expiry date (", expiry, ") precedes effective date (", effective, ")")
    if kind == "validation":
        return finding(dates_reversed(effective, expiry), "high", message, K.MSG_VALIDATION, "basic_date_error", 9, kind="validation")
    return finding(
        dates_reversed(effective, expiry), "high", message,
        text_of("The contract's expiry date (", expiry, ") is earlier than its effective date (", effective,
                "). This is logically impossible and threatens the contract's enforceability."),
        "check_14_contract_dates")


# --- deterministic validation ------------------------------------------------

def math_error(when: Column, message: Column, seq: int) -> Column:
    return finding(when, "high", message, K.MSG_VALIDATION, "basic_math_error", seq, kind="validation")


def totals(net: Column, vat: Column, gross: Column) -> Column:
    return math_error(
        F.abs(net + vat - gross) > 1,
        text_of("Net (", plain_whole(net), ") + VAT (", plain_whole(vat), ") = ", plain_whole(net + vat), ", but gross = ", plain_whole(gross)), 1)


def line_sum(headers: DataFrame, lines: DataFrame) -> DataFrame:
    """Sum of line nets against the document net; lines are summed before the join."""
    sums = lines.groupBy("package_id", "doc_id").agg(F.sum(numbers.money(F.col("total_net"))).cast("double").alias("line_net"))
    joined = headers.select("package_id", "doc_id", "total_net").join(sums, ["package_id", "doc_id"])
    return emit(joined, [sum_of_lines(F.col("line_net"), F.col("total_net"))], ("package_id", "doc_id", "line_net", "total_net"))


def line_math() -> list[Column]:
    net, vat, gross, rate = F.col("total_net"), F.col("total_vat"), F.col("total_gross"), F.col("vat_rate")
    name = F.coalesce(F.col("description"), F.lit("item"))
    expected = net * rate / 100
    return [
        math_error((rate > 0) & (F.abs(expected - vat) > F.greatest(F.lit(1.0), net * 0.01)),
                   text_of("Line '", name, "': net (", plain_whole(net), ") × ", plain_whole(rate), "% = ", plain_whole(expected),
                           ", but VAT = ", plain_whole(vat)), 2),
        math_error(F.abs(net + vat - gross) > 1,
                   text_of("Line '", name, "': net (", plain_whole(net), ") + VAT (", plain_whole(vat), ") = ", plain_whole(net + vat),
                           ", but gross = ", plain_whole(gross)), 3),
    ]


def due_before_issue(issue: Column, due: Column) -> Column:
    return finding((issue != "") & (due != "") & (due < issue), "medium",
                   text_of("Payment due date (", due, ") is earlier than the issue date (", issue, ")"),
                   K.MSG_VALIDATION, "basic_date_error", 8, kind="validation")


def plausible(when: Column, severity, message: Column, seq: int) -> Column:
    return finding(when, severity, message, K.MSG_PLAUSIBILITY, "plausibility_plausibility", seq, kind="plausibility")


def vat_rate_plausible(rate: Column, name: Column) -> Column:
    label = text_of(" (", general(rate), "%) on line '", F.coalesce(name, F.lit("?")), "'")
    lead = F.when(rate < 0, F.lit("Negative VAT rate")).when(rate > 50, F.lit("Unusually high VAT rate")).otherwise(F.lit("Non-standard VAT rate"))
    odd = (rate < 0) | (rate > 50) | (~rate.cast("int").isin(K.KNOWN_VAT_RATES) & (rate != 0))
    return plausible(odd, F.when((rate < 0) | (rate > 50), F.lit("medium")).otherwise(F.lit("low")), text_of(lead, label), 0)


def negative_amounts(columns: list[str]) -> list[Column]:
    return [plausible(F.col(c) < 0, "medium", text_of(f"Negative amount: {c} = ", plain_whole(F.col(c))), 1 + i)
            for i, c in enumerate(columns)]


def date_plausible(field: str, c: Column, seq: int) -> Column:
    present = ~is_null_alias(c)
    parsed = dates.parse_date(c)
    year = F.year(parsed)
    future = F.lit(False) if field in K.FAR_FUTURE_ALLOWED else (year > 2030)
    message = (
        F.when(parsed.isNull(), text_of(f"Unparseable date: {field} = '", c, "'"))
        .when(year < 2000, text_of(f"Old date: {field} = ", c, " (before 2000)"))
        .otherwise(text_of(f"Future date: {field} = ", c, " (after 2030)"))
    )
    return plausible(present & (parsed.isNull() | (year < 2000) | future), "low", message, seq)


def plausible_dates(columns: list[str]) -> list[Column]:
    return [date_plausible(f, F.col(f), 10 + i) for i, f in enumerate(K.PLAUSIBLE_DATE_FIELDS) if f in columns]


# --- whole stages -------------------------------------------------------------

def masked(check_id: str, findings: list[Column]) -> list[Column]:
    on = applicable(check_id, F.col("doc_type"), F.col("language"))
    return [F.when(on, f) for f in findings]


def _rounds(c: str) -> tuple[Column, Column]:
    """Whether an amount counts, and whether it is suspiciously round."""
    return (F.coalesce(F.col(c), F.lit(0.0)) != 0).cast("int"), F.coalesce(numbers.is_round(F.col(c)), F.lit(False)).cast("int")


def with_line_totals(headers: DataFrame, lines: DataFrame) -> DataFrame:
    """``headers`` with what the rules need of all lines of a document, from one partial aggregation of the lines.

    ``line_net`` (sum), ``amounts`` and ``rounds`` (amounts of lines and header that count, and those that are round),
    and for each mandatory element ``without_<element>`` (missing on every line); null or 0 for a document without lines.
    """
    used, rounds = zip(*[_rounds(c) for c in ("total_net", "total_gross")])

    def missing(c: str) -> Column:
        return is_empty(F.col(c)) if lines.schema[c].dataType.typeName() == "string" else F.col(c).isNull()

    per_document = lines.groupBy("package_id", "doc_id").agg(
        F.sum(numbers.money(F.col("total_net"))).cast("double").alias("line_net"), F.sum(used[0] + used[1]).alias("amounts"), F.sum(rounds[0] + rounds[1]).alias("rounds"),
        *[F.bool_and(missing(c)).alias(f"without_{c}") for c, _, _ in K.INVOICE_LINE_FIELDS])
    joined = headers.join(per_document, ["package_id", "doc_id"], "left")
    return joined.withColumns({"amounts": F.coalesce("amounts", F.lit(0)) + used[0] + used[1], "rounds": F.coalesce("rounds", F.lit(0)) + rounds[0] + rounds[1]})


def round_amounts(amounts: Column, rounds: Column) -> list[Column]:
    """Findings of a document by the number of its amounts and of round ones among them."""
    ratio = F.try_divide(rounds, amounts)
    pct = F.concat(plain_whole(ratio * 100), F.lit("%"))
    shown = F.concat(rounds.cast("string"), F.lit("/"), amounts.cast("string"), F.lit(" ("), pct, F.lit(")"))
    enough, high = amounts >= K.ROUNDED_MIN_AMOUNTS, ratio > K.ROUNDED_HIGH_RATIO
    return [
        finding(enough & high, "medium", text_of("High proportion of rounded amounts: ", shown),
                text_of(pct, " of the amounts are suspiciously rounded (divisible by 10,000 and >10,000). "
                             "Above 25% may indicate fraud (Journal of Accountancy, 2018)."),
                "check_05_rounded_amounts"),
        finding(enough & ~high & (ratio > K.ROUNDED_LOW_RATIO), "low", text_of("Notable proportion of rounded amounts: ", shown),
                text_of(pct, " of the amounts are rounded. Above 15% is higher than the typical baseline."), "check_05_rounded_amounts"),
    ]


def lines_without(field=lambda c: F.col(f"without_{c}")) -> list[Column]:
    """Findings of a document none of whose lines has an element; ``field`` tells whether that is so."""
    return [
        finding(field(c), sev, f"Missing mandatory line-item element: {label}",
                f"Per {K.REG_INVOICE}, '{label}' is mandatory for every line item. None of the items contain it.", "check_01_invoice_mandatory", 10 + i)
        for i, (c, label, sev) in enumerate(K.INVOICE_LINE_FIELDS)
    ]


def sum_of_lines(calc: Column, net: Column) -> Column:
    return math_error(
        (calc > 0) & (F.abs(calc - net) > 1),
        text_of("Line items' net total (", plain_whole(calc), ") does not match the document total (", plain_whole(net), ")"), 0)


def _register() -> None:
    """The rules that come with the library."""
    c = F.col
    for check_id, scope, build, several in [
        ("basic_math_error", "invoice", lambda _: [totals(c("total_net"), c("total_vat"), c("total_gross")), sum_of_lines(c("line_net"), c("total_net"))], False),
        ("basic_date_error", "invoice", lambda _: [due_before_issue(c("issue_date"), c("payment_due_date"))], False),
        ("check_01_invoice_mandatory", "invoice", lambda _: [*mandatory_fields(), buyer_tax_id(c("total_vat"), c("customer_tax_id")), *lines_without()], False),
        ("check_02_tax_cdv", "invoice", lambda _: invoice_tax_ids(), False),
        ("check_05_rounded_amounts", "invoice", lambda _: round_amounts(c("amounts"), c("rounds")), False),
        ("check_07_materiality", "invoice", lambda _: [materiality(c("total_gross"))], False),
        ("check_13_aml_sanctions", "invoice", lambda _: [sanctions(c("issuer_name"), "issuer"), sanctions(c("customer_name"), "customer")], True),
        ("plausibility_plausibility", "invoice", lambda columns: negative_amounts(["total_net", "total_vat", "total_gross"]) + plausible_dates(columns), False),
        ("basic_math_error", "line", lambda _: line_math(), False),
        ("plausibility_plausibility", "line", lambda _: [vat_rate_plausible(c("vat_rate"), c("description"))], False),
        ("basic_date_error", "contract", lambda _: [contract_dates(c("effective_date"), c("expiry_date"), "validation")], False),
        ("check_02_tax_cdv", "contract", lambda _: party_tax_ids([(c("party_a"), c("party_a_tax_id")), (c("party_b"), c("party_b_tax_id"))]), False),
        ("check_03_contract_completeness", "contract",
         lambda _: completeness(c("termination_terms"), c("governing_law"), c("penalty"), c("total_value"), c("currency"), c("confidentiality_clause")), False),
        ("check_04_proportionality", "contract", lambda _: [proportionality(c("penalty"), c("total_value"), c("currency"))], False),
        ("check_13_aml_sanctions", "contract", lambda _: [risk_country(c("party_a_tax_id"), c("party_a"), 200), risk_country(c("party_b_tax_id"), c("party_b"), 201)], False),
        ("check_13_aml_sanctions", "contract", lambda _: [sanctions(c("party_a"), "party"), sanctions(c("party_b"), "party")], True),
        ("check_14_contract_dates", "contract", lambda _: [contract_dates(c("effective_date"), c("expiry_date"))], False),
        ("check_08_gdpr_28", "wording", lambda _: data_processing(c("low")), False),
        ("check_09_dd_red_flags", "wording", lambda _: red_flags(c("low"), c("total_value")), False),
        ("check_10_incoterms", "wording", lambda _: incoterms(c("body")), False),
        ("check_11_ifrs_har", "wording", lambda _: ifrs_anomalies(c("low")), False),
    ]:
        register(check_id, scope, several=several)(build)


_register()


def invoice_findings(headers: DataFrame, lines: DataFrame, keys: tuple = ("package_id", "doc_id"), dispatched: bool = True, also: list[Column] | None = None) -> DataFrame:
    """Every rule that applies to invoices: one pass over headers with the totals of their lines, one over lines.

    A ``file_name`` among ``keys`` must be in both tables. ``dispatched`` and ``also`` (findings on headers) as in ``run_scope``.
    """
    return run_scope("invoice", with_line_totals(headers, lines), keys, dispatched, also).unionByName(run_scope("line", lines, keys, dispatched))


def contract_findings(contracts: DataFrame, keys: tuple = ("package_id", "doc_id")) -> DataFrame:
    return run_scope("contract", contracts, keys)


def wordings(documents: DataFrame) -> DataFrame:
    """Contracts and reports as the wording rules read them: ``body`` (the searchable text) and ``low`` (in lower case).

    Needs quotes and risk_elements (arrays of text), clauses (array of name and content), contract_type, and for
    financial reports line_descriptions (array), report_type and standard.
    """
    base = rule_text(F.concat_ws(" ", "quotes"), F.col("clauses"), F.concat_ws(" ", "risk_elements"), F.col("contract_type"))
    report = report_rule_text(base, F.col("line_descriptions"), F.col("report_type"), F.col("standard"))
    # put together once, however many rules read it
    once = documents.withColumn("body", F.explode(F.array(F.when(F.col("doc_type") == "financial_report", report).otherwise(base))))
    return once.withColumn("low", F.explode(F.array(F.lower("body"))))


def wording_findings(documents: DataFrame, keys: tuple = ("package_id", "doc_id")) -> DataFrame:
    """Rules on what contracts and reports say."""
    return run_scope("wording", wordings(documents), keys)


def first_per_package(findings: DataFrame, order=("stage", "doc_id", "rule_ord", "seq")) -> DataFrame:
    """One finding per package and description, the first in stage order.

    ``min_by`` over an order struct is a partial aggregate: repeated
    descriptions shrink before the shuffle, so one wide-spread message is no
    hot key.
    """
    rest = [c for c in findings.columns if c not in ("package_id", "description")]
    best = findings.groupBy("package_id", "description").agg(
        F.min_by(F.struct(*rest), F.struct(*order)).alias("f"), F.count(F.lit(1)).alias("n_seen")
    )
    return best.select("package_id", "description", "f.*", "n_seen")


def applied_standards(findings: DataFrame) -> DataFrame:
    """Per package the standards to show: a fixed order first, the rest by name."""
    rank = F.create_map(*[F.lit(x) for i, s in enumerate(K.STANDARD_ORDER) for x in (s, i)])
    seen = findings.select("package_id", "regulation").union(
        findings.select("package_id", F.lit(K.REG_EVIDENCE).alias("regulation"))
    ).filter(F.col("regulation").isNotNull() & (F.col("regulation") != "")).distinct()
    ranked = seen.select("package_id", F.struct(F.coalesce(F.try_element_at(rank, F.col("regulation")), F.lit(99)).alias("r"), F.col("regulation").alias("s")).alias("x"))
    return ranked.groupBy("package_id").agg(F.array_sort(F.collect_list("x")).alias("x")).select(
        "package_id", F.array_join(F.col("x.s"), " | ").alias("standards"))

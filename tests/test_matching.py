import itertools
import random

import pytest
from pyspark.sql import functions as F

from auditlake.operators import duplicates, matching, names

c = F.col
ITEM = "package_id string, doc_id int, item_code string, description string, quantity double"


def items(spark, rows, ordered=True):
    df = spark.createDataFrame([("p", 1, *r) for r in rows], ITEM)
    return df.withColumn("ord", F.monotonically_increasing_id()) if ordered else df


def test_three_way_golden(spark):
    x = {"invoice": items(spark, [(None, "HI-100 I-beam 6m", 40.0)]), "delivery_note": items(spark, [("HI-100", "I-beam 6m", 38.0)]), "purchase_order": items(spark, [("HI-100", "I-beam 6m", 40.0)])}
    head = spark.createDataFrame([("p", 1, 7400.0, "2026-04-18", 7400.0, "2026-04-01")],
                                 "package_id string, doc_id int, invoice_total_gross double, invoice_date string, purchase_order_total_gross double, purchase_order_date string")
    got = sorted((r.seq, r.severity, r.status) for r in matching.three_way(head, x).collect())
    assert got == [(0, "ok", "match"), (3, "ok", "match"), (4, "critical", "mismatch"), (5, "critical", "mismatch")]
    roll = matching.roll_up(matching.three_way(head, x), ["package_id"]).first()
    assert (roll.total_checks, roll.critical_count, roll.overall_status) == (4, 2, "critical")


def find(a, b):
    """Brute force over the four passes."""
    def alike(m, n):
        wm, wn = set(m.split()), set(n.split())
        return m == n or bool(wm and wn) and len(wm & wn) / max(len(wm), len(wn)) >= 0.8 and not any(ch.isdigit() for w in wm ^ wn for ch in w)

    tests = [lambda y: a[0] and y[0] == a[0], lambda y: y[1] == a[1], lambda y: y[1] and (a[1] in y[1] or y[1] in a[1]), lambda y: y[1] and alike(a[1], y[1])]
    for i, test in enumerate(tests, 1):
        for y in b:
            if test(y):
                return i, y[2]
    return 0, None


@pytest.mark.parametrize("small", [32, 0])
def test_match_items_against_brute_force(spark, monkeypatch, small):
    monkeypatch.setattr(matching, "SMALL_SCOPE", small)
    rng = random.Random(7)
    words = ["steel", "beam", "red", "bolt", "x1", "x2", "set", "of", "big", "a", "it"]
    def make(n):
        return [(rng.choice(["", "", "c1", "c2", "c3"]), " ".join(rng.sample(words, rng.randint(1, 6))), float(rng.randint(1, 5) + i / 100)) for i in range(n)]
    a, b = make(40), make(30)
    # one row per distinct item on the left, as documents state them
    a = list({(x[0], x[1]): x for x in a}.values())
    got = matching.match_items(items(spark, a, False), items(spark, b)).collect()
    assert {(r.item_code, r.description, r["pass"], r.b_quantity) for r in got} == {(x[0], x[1], *find(x, b)) for x in a}


def test_missing_and_warning(spark):
    rows = matching.match_items(items(spark, [("a", "one", 5.0), ("b", "two", 5.0), ("c", "zzz", 1.0), ("d", "four", None)], False),
                                items(spark, [("a", "one", 6.99), ("b", "two", 5.005), ("d", "four", 1.0)]))
    got = {r.message: r.severity for r in matching.explode_results(rows, [matching.item_result("invoice", "purchase_order", 0)]).collect()}
    assert got == {
        "Quantity discrepancy: 'one' — invoice: 5, purchase_order: 6.99 (diff: 1.99)": "warning", "Item matches: 'two' (invoice vs purchase_order)": "ok",
        "Item not found: 'zzz' present in invoice but missing from purchase_order": "warning"}


def test_contains_join_is_exact(spark):
    rng = random.Random(3)
    left = sorted({"".join(rng.choices("ab c", k=rng.randint(1, 9))) for _ in range(80)} - {""})
    right = sorted({"".join(rng.choices("ab c", k=rng.randint(1, 9))) for _ in range(80)} - {""})
    got = names.contains_join(spark.createDataFrame([(x,) for x in left], "a string"), spark.createDataFrame([(x,) for x in right], "b string"), "a", "b").collect()
    assert {(r.a, r.b) for r in got} == {(x, y) for x in left for y in right if x in y or y in x}


@pytest.mark.parametrize("larger", [False, True])
def test_share_at_least_is_exact(spark, larger):
    rng = random.Random(5)
    def sets(n):
        return {i: sorted(set(rng.choices("abcdefgh", k=rng.randint(1, 7)))) for i in range(n)}
    a, b = sets(60), sets(60)
    def frame(d, k):
        return spark.createDataFrame([(i, v) for i, v in d.items()], f"{k} int, tokens array<string>")
    got = names.share_at_least(frame(a, "a"), frame(b, "b"), "a", "b", 0.7, of_larger=larger).collect()
    want = {(i, j) for i, x in a.items() for j, y in b.items() if len(set(x) & set(y)) / (max(len(x), len(y)) if larger else len(x)) >= 0.7}
    assert {(r.a, r.b) for r in got} == want


def invoice_frame(spark, n=120, seed=11):
    rng = random.Random(seed)
    rows = [(rng.choice("pq"), i, i, rng.choice(["acme", "Acme ", "", None, "other"]), rng.choice(["A1", "a1 ", "B2", "C3", "", None]), rng.choice([100.0, 100.0, 200.0, None]),
             rng.choice(["2026-01-01", "2026-01-10", "2026-01-14", "2026-01-15", "2026-03-01", "junk", None])) for i in range(n)]
    return rows, spark.createDataFrame(rows, "package_id string, doc_id int, doc_ord int, issuer_name string, invoice_number string, total_gross double, issue_date string")


def clean(x):
    return (x or "").strip().lower()


def test_exact_duplicates_stand_for_all_pairs(spark):
    rows, df = invoice_frame(spark)
    pairs = {(a[1], b[1]) for a, b in itertools.combinations(rows, 2) if a[0] == b[0] and clean(a[4]) and clean(a[4]) == clean(b[4]) and clean(a[3]) == clean(b[3])}
    got = duplicates.exact_duplicates(df).collect()
    groups = {}
    for r in got:
        groups.setdefault((r.package_id, r.issuer, r.number, r.first_doc), set()).add(r.doc_id)
    unfolded = {p for (*_, first), rest in groups.items() for p in itertools.combinations(sorted({first, *rest}), 2)}
    assert unfolded == pairs
    assert sum({(r.package_id, r.issuer, r.number): r.n_pairs for r in got}.values()) == len(pairs)


def test_near_duplicates_against_brute_force(spark):
    import datetime as dt
    rows, df = invoice_frame(spark)
    def day(x):
        try:
            return dt.date.fromisoformat((x or "")[:10])
        except ValueError:
            return None
    want = {}
    for a in rows:
        hits = [b[1] for b in rows if b[0] == a[0] and clean(a[3]) and clean(b[3]) == clean(a[3]) and a[5] is not None and a[5] == b[5] and clean(a[4]) != clean(b[4])
                and (day(a[6]) is None or day(b[6]) is None or abs((day(a[6]) - day(b[6])).days) <= 13)]
        if hits:
            want[a[1]] = (len(hits), min(hits))
    got = {r.doc_id: (r.n_partners, r.first_partner) for r in duplicates.near_duplicates(df).collect()}
    assert got == want


def test_amount_band_against_brute_force(spark):
    rng = random.Random(2)
    rows = [("p", i, "acme", round(rng.uniform(50, 500), 2)) for i in range(60)]
    df = spark.createDataFrame(rows, "package_id string, doc_id int, issuer_name string, total_gross double")
    want = {a[1] for a in rows for b in rows if a is not b and abs(a[3] - b[3]) / max(a[3], b[3]) <= 0.01}
    assert {r.doc_id for r in duplicates.amount_band(df).collect()} == want


def test_price_drift_golden(spark):
    df = spark.createDataFrame([("T", "i", "2026-01-31", 787.40), ("T", "i", "2026-02-28", 826.77), ("T", "i", "2026-03-31", 1240.16)], "s string, i string, d string, p double")
    got = duplicates.price_drift(df, ["s", "i"], "p", ["d"]).collect()
    assert [(r.d, round(r.drift_pct, 1)) for r in got] == [("2026-03-31", 57.5)]


def test_spelling_variants(spark):
    df = spark.createDataFrame([("acme ltd", 9), ("acme Ltd", 2), ("acmeltd", 1), ("other", 4), ("acme lt", 3)], "name string, n int")
    got = {r.name: r.variant for r in duplicates.spelling_variants(df).collect()}
    assert got == {"acme Ltd": "acme ltd", "acmeltd": "acme ltd", "acme lt": "acme ltd", "acme ltd": "acme lt"}


def test_diff_documents(spark):
    def long(rows, v):
        return spark.createDataFrame([(1, *r) for r in rows], f"k int, field_name string, {v} string")
    a = long([("net", "1,000"), ("name", " Acme "), ("date", "x"), ("both", None), ("obj", "{}")], "value_a")
    b = long([("net", "1100"), ("name", "acme"), ("only", "z"), ("both", None), ("obj", "[]")], "value_b")
    got = {r.field_name: (r.status, r.severity) for r in matching.diff_documents(a, b, ["k"], ["obj"]).collect()}
    assert got == {"net": ("mismatch", "critical"), "name": ("match", "ok"), "date": ("missing", "warning"), "only": ("missing", "warning")}


def test_merge_records(spark):
    df = spark.createDataFrame([("f", 1, "a", 5.0), ("f", 2, None, 0.0), ("f", 3, "", None), ("g", 1, None, None)], "f string, o int, s string, v double")
    got = {r.f: (r.s, r.v) for r in duplicates.merge_records(df, ["f"], "o", ["s", "v"]).collect()}
    assert got == {"f": ("a", 5.0), "g": (None, None)}

import random

from pyspark.sql import functions as F

from auditlake.operators import matching
from auditlake.plans import matching as plans
from auditlake.sources.views import Tables
from tests.test_matching import find

PATH = "/root/testdata/sf0.001"


def test_items_of_all_kinds_in_one_pass(spark):
    """The rows of the three views, from one reading of the lines."""
    t = Tables(spark, PATH)
    columns = ["package_id", "doc_id", "item_code", "description", "quantity"]
    got = plans.items(t)
    for kind, view in (("invoice", t.v_inv_line), ("purchase_order", t.v_po_line), ("delivery_note", t.v_dn_line)):
        mine = got.filter(F.col("kind") == kind).select(*columns)
        assert mine.exceptAll(view.select(*columns)).isEmpty() and view.select(*columns).exceptAll(mine).isEmpty()
    assert len([f for f in got.inputFiles() if "lineitem" in f]) == 1


def test_large_and_small_documents_together(spark):
    """Documents below, at and above the limit, each against brute force; items of one document stay in it."""
    rng = random.Random(3)
    words = ["steel", "beam", "red", "bolt", "x1", "x2", "set", "of", "big", "a", "it"]
    sides, rows = {}, {"a": [], "b": []}
    for doc, size in ((1, 3), (2, matching.SMALL_SCOPE), (3, matching.SMALL_SCOPE + 1), (4, 60)):
        for side in "ab":
            made = [(rng.choice(["", "c1", "c2", "c3"]), " ".join(rng.sample(words, rng.randint(1, 6))), float(i)) for i in range(size)]
            sides[doc, side] = list({(x[0], x[1]): x for x in made}.values()) if side == "a" else made
            rows[side] += [("p", doc, *x, i) for i, x in enumerate(sides[doc, side])]
    schema = "package_id string, doc_id int, item_code string, description string, quantity double, ord int"
    a, b = (spark.createDataFrame(rows[side], schema) for side in "ab")
    got = matching.match_items(a.drop("ord"), b).collect()
    assert {(r.doc_id, r.item_code, r.description, r["pass"], r.b_quantity) for r in got} == {
        (doc, x[0], x[1], *find(x, sides[doc, "b"])) for doc in (1, 2, 3, 4) for x in sides[doc, "a"]}


def test_results_of_items_are_made_as_columns(spark):
    """Besides pairs and items nothing is unfolded: no array of results for each item."""
    t = Tables(spark, PATH)
    plan = matching.item_results(plans.items(t), plans.headers(t).select(*matching.KEYS))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode") == 2


def test_numbers_of_names_rule_out_no_pair(spark):
    rng = random.Random(9)
    words = ["a1", "1a", "12", "b", "c", "d", "e", "f", "٣", "x٣", "2", "１"]
    b = [("", " ".join(rng.choices(words, k=rng.randint(1, 7))), float(i)) for i in range(30)]
    a = list({x[1]: x for x in [("", " ".join(rng.sample(y[1].split(), len(y[1].split()))), 0.0) for y in b] + [("", " ".join(rng.choices(words, k=6)), 0.0) for _ in range(30)]}.values())[:30]
    schema = "package_id string, doc_id int, item_code string, description string, quantity double, ord int"
    left, right = (spark.createDataFrame([("p", 1, *x, i) for i, x in enumerate(side)], schema) for side in (a, b))
    got = {(r.description, r["pass"], r.b_quantity) for r in matching.match_items(left.drop("ord"), right).collect()}
    assert got == {(x[1], *find(x, b)) for x in a} and {p for _, p, _ in got} >= {3, 4}

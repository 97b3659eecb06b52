"""Merkle manifest against a slow version that holds whole trees, at block sizes that make several tiers."""

import random
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from auditlake.llm import merkle
from auditlake.llm.queries import MERKLE_SQL, op11_merkle
from tests.compare import rows as compared

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def slow_tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([merkle.digest(*levels[-1][i : i + 2]) for i in range(0, len(levels[-1]), 2)])
    return levels


def slow_path(levels, i):
    out = []
    for level in levels[:-1]:
        if i ^ 1 < len(level):
            out.append(level[i ^ 1])
        i >>= 1
    return out


def slow_leaf(r):
    said = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    return merkle.digest(*[said(r[k]) for k in merkle.FIELDS])


def slow(rows):
    """(doc_id, leaf, siblings, subroot, root) of each row, sorted."""
    first = lambda v: (v is not None, v if v is not None else 0)
    group = lambda r: (r["lang"] is not None, (r["lang"] or "").encode())
    ordered = sorted(rows, key=lambda r: (group(r), first(r["doc_id"]), slow_leaf(r)))
    trees = [(list(g), None) for _, g in groupby(ordered, key=group)]
    trees = [(g, slow_tree([slow_leaf(r) for r in g])) for g, _ in trees]
    top = slow_tree([t[-1][0] for _, t in trees])
    out = []
    for k, (g, t) in enumerate(trees):
        for i, r in enumerate(g):
            out.append((str(r["doc_id"]), t[0][i], slow_path(t, i) + slow_path(top, k), t[-1][0], top[-1][0]))
    return sorted(out)


@pytest.mark.parametrize("n", [1, 2, 3, 5, 6, 7, 8, 11, 16, 23])
def test_positions_are_those_of_the_log(n):
    made = list(merkle.append([str(i) for i in range(n)], 0, 0, merkle.height(n), n))
    level, index = [m[0] for m in made], [m[1] for m in made]
    assert merkle.position(level, index, n).tolist() == list(range(len(made)))
    levels = slow_tree([str(i) for i in range(n)])
    assert {(lv, i): d for lv, i, d in made} == {(lv, i): d for lv, nodes in enumerate(levels) for i, d in enumerate(nodes)}
    for i in range(n):
        assert merkle.fold(str(i), i, n, slow_path(levels, i)) == (levels[-1][0], len(slow_path(levels, i)))


def table(spark, seed=5):
    r = random.Random(seed)
    rows = []
    for i in range(90):
        lang = r.choice(["en", "en", "en", "de", "Fr", "é", None])
        rows.append({"doc_id": i * 2**50 + 1, "text": r.choice([None, "", "ünï\ncode", "x" * r.randrange(300)]), "lang": lang, "source": r.choice(["a", None]), "n_chars": r.choice([None, i])})
    rows += [{"doc_id": None, "text": t, "lang": "en", "source": None, "n_chars": None} for t in ("a", "b")]
    rows += [dict(rows[3]), dict(rows[3]), {**rows[3], "text": "another text"}, {"doc_id": 7, "text": "one", "lang": "zz", "source": "s", "n_chars": 3}]
    return rows, spark.createDataFrame([tuple(x[c] for c in ("doc_id", "text", "lang", "source", "n_chars")) for x in rows], SCHEMA).repartition(4)


@pytest.mark.parametrize("bits", [1, 2, 3, 10])
def test_equals_slow_version(spark, bits):
    rows, docs = table(spark)
    # names that the operator uses itself; they play no part
    docs = docs.selectExpr("*", "1 as digest", "2 as n", "3 as tree", "4 as claim", "5 as _at", "6 as _group", "7 as _order", "8 as rank", "9 as siblings", "text as root")
    found = merkle.manifest(docs, bits=bits)
    assert found.schema["doc_id"].dataType.simpleString() == "bigint"
    got = sorted((str(r.doc_id), r.leaf, r.siblings, r.subroot, r.root) for r in found.collect())
    assert got == slow(rows)


def test_a_changed_row_is_found(spark):
    rows, docs = table(spark)
    claim = merkle.leaf_digest([F.when(F.col("doc_id") == 1, F.lit("forged")).otherwise(F.col(f)) if f == "text" else F.col(f) for f in merkle.FIELDS])
    judged = merkle.verify(merkle.manifest(docs, claim, bits=2), "claim").collect()
    assert {r.doc_id for r in judged if not r.verified} == {1}
    assert all((r.folded_root == r.root) == r.verified for r in judged) and len(judged) == len(rows)


def test_log_holds_each_node_once(spark):
    leaves = spark.createDataFrame([(t, n, i, f"{t}:{i}") for t, n in ((0, 1), (1, 4), (2, 9)) for i in range(n)], "tree long, n long, rank long, digest string")
    log = merkle.build(leaves, 9, [], "log", bits=1)
    assert len(log.tiers) == 4
    for tree, n in ((0, 1), (1, 4), (2, 9)):
        nodes = sorted((r.pos, r.level, r["index"], r.digest) for r in log.nodes().where(F.col("tree") == tree).collect())
        want = list(merkle.append([f"{tree}:{i}" for i in range(n)], 0, 0, merkle.height(n), n))
        assert nodes == [(p, *w) for p, w in enumerate(want)]
    assert {r.tree: r.root for r in log.roots().collect()} == {t: slow_tree([f"{t}:{i}" for i in range(n)])[-1][0] for t, n in ((0, 1), (1, 4), (2, 9))}


def test_one_row_and_none(spark):
    _, docs = table(spark)
    (one,) = merkle.manifest(docs.where("doc_id = 7")).collect()
    assert one.leaf == one.subroot == one.root and one.siblings == []
    assert merkle.verify(merkle.manifest(docs.limit(0)), "leaf").count() == 0


def test_query_equals_its_sql(spark, tmp_path):
    import duckdb

    rows, _ = table(spark)
    seen, kept = set(), []
    for r in rows:
        if r["doc_id"] is not None and r["doc_id"] not in seen:
            seen.add(r["doc_id"])
            kept.append(tuple(r[c] for c in ("doc_id", "text", "lang", "source", "n_chars")))
    spark.createDataFrame(kept, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert compared(op11_merkle(spark, str(tmp_path)).toPandas()) == compared(con.execute(MERKLE_SQL).df())

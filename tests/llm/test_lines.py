import hashlib
import random

import numpy as np

from auditlake.llm import lines
from auditlake.llm.queries import ORACLE, QUERIES
from tests.compare import compare, duck


def slow(docs):
    """docs: [(doc_id, text)] -> {doc_id: (n_lines, n_dropped, kept)}"""
    key = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    held = {}
    for d, t in docs:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 20 and d is not None:
                held.setdefault(key(x), set()).add(d)
    out = []
    for d, t in docs:
        own = (t or "").split("\n")
        left = [x for x in own if not (d is not None and len(held.get(key(x), ())) >= 3 and d != max(held[key(x)]))]
        out.append((d, len(own), len(own) - len(left), "\n".join(left)))
    return out


def fixture():
    r = random.Random(3)
    pool = [f"  Line number {i} with Some É text " for i in range(40)] + ["short", "x" * 19, "X" * 20, "\tx" + "x" * 19 + "\r", "", "\xa0" + "y" * 20]
    docs = [(i, "\n".join(r.choice(pool) + ("" if r.random() < 0.5 else f" {r.random()}") for _ in range(r.randrange(0, 30)))) for i in range(150)]
    return docs + [(7, docs[7][1]), (200, None), (201, ""), (202, "\n\n"), (None, docs[3][1]), (None, docs[3][1]), (300, "a very long line " * 9000 + "\n" + pool[0])]


def test_equals_brute_force(spark):
    docs = fixture()
    frame = spark.createDataFrame([(d, t, "k", 1) for d, t in docs], "doc_id long, text string, key string, lost int").repartition(5)
    for most in (lines.MOST_BITS, 1 << 10):  # the second filter is full: everything is suspected
        got = [tuple(r) for r in lines.drop_repeats(frame, most_bits=most).collect()]
        assert sorted(got, key=str) == sorted(slow(docs), key=str)
    assert lines.drop_repeats(frame.limit(0)).count() == 0


def test_filter_never_misses():
    r = np.random.default_rng(0)
    f = lines.Filters(1 << 16)
    hashes = r.integers(0, 1 << 63, 5000, dtype=np.uint64)
    for part in np.split(np.concatenate([hashes, hashes[:900]]), 10):
        f.add(part)
    at = lines.places(hashes, 1 << 16)
    assert f.twice[at[:900]].all() and f.twice[at[900:]].all(axis=1).mean() < 0.1


def test_query_equals_brute_force_and_check_text(spark):
    path = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{path}/documents.parquet").collect()]
    got = {(r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in QUERIES["op5_lines"](spark, path).collect()}
    assert got == {(d, n, m, hashlib.sha256(k.encode()).hexdigest()) for d, n, m, k in slow(docs)}
    message, _, ok = compare(spark, duck(path), "op5_lines", QUERIES["op5_lines"], ORACLE["op5_lines"], path)
    assert ok, message

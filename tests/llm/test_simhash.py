import random

import numpy as np
import xxhash

from auditlake.llm import components, simhash
from auditlake.llm.queries import QUERIES


def slow_print(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_classes(prints):
    """prints: {doc_id: fingerprint}; smallest reachable id, by all pairs."""
    up = {d: d for d in prints}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(prints)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 4:
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {d: root(d) for d in ids}


def test_fingerprint():
    r = random.Random(4)
    for t in ["", " \n", "One", "a b c", "a b c d", "a b c d e", "É x\x0by z w Q", *(" ".join(r.choice("abcdefgh") for _ in range(n)) for n in (5, 50, 9000))]:
        assert simhash.fingerprint(t) == slow_print(t)


def test_golay_code_is_perfect_and_parts_meet():
    words, begin = simhash.patterns(23, 3)
    assert len(words) == 2048 and (np.diff(begin) == 1).all()
    r = np.random.default_rng(1)
    a = r.integers(0, 1 << 63, 3000, dtype=np.uint64)
    flips = np.array([sum(1 << int(b) for b in r.choice(64, r.integers(0, 5), replace=False)) for _ in a], dtype=np.uint64)
    b = a ^ flips
    home, seen = {}, {}
    for who, anchor, at_home in zip(*simhash.visits(a)):
        if at_home:
            home.setdefault(int(who), set()).add(int(anchor))
    for who, anchor, _ in zip(*simhash.visits(b)):
        seen.setdefault(int(who), set()).add(int(anchor))
    assert all(home[i] & seen[i] for i in range(len(a)))
    assert all(len(home[i]) == 3 for i in home)


def near(n, seed=7):
    """Fingerprints in clusters, chains and alone."""
    r = random.Random(seed)
    out = []
    while len(out) < n:
        x = r.getrandbits(64)
        for _ in range(r.choice([1, 1, 2, 30])):
            out.append(x)
            for b in r.sample(range(64), r.randrange(0, 6)):
                x ^= 1 << b
    return out[:n]


def check_links(spark, prints, homes):
    rows = {}
    for d, p in enumerate(prints):
        rows.setdefault(p, d)
    signed = [(d, int(np.uint64(p).astype(np.int64))) for p, d in rows.items()]
    found = components.components(simhash.links(spark.createDataFrame(signed, "node long, bits long"), homes)).collect()
    got = {d: d for d in rows.values()} | {r.node: r.root for r in found}
    assert got == slow_classes({d: p for p, d in rows.items()})


def test_links_equal_all_pairs(spark):
    check_links(spark, near(900), simhash.HOMES)


def test_crowded_anchor_is_dealt_out(spark):
    r = random.Random(2)
    base = r.getrandbits(64)
    crowd = [base ^ sum(1 << b for b in r.sample(range(30, 64), r.randrange(0, 7))) for _ in range(400)]
    check_links(spark, crowd + near(100), 40)


def test_components_of_chain_and_star(spark):
    pairs = [(i, i + 1) for i in range(0, 200)] + [(500, i) for i in range(501, 700)] + [(800, 900), (850, 900)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(pairs, "low long, high long")).collect()}
    assert got == {i: 0 for i in range(201)} | {i: 500 for i in range(500, 700)} | {i: 800 for i in (800, 850, 900)}
    assert components.components(spark.createDataFrame([], "low long, high long")).count() == 0


def test_rows(spark):
    text = "one two three four five six seven"
    rows = [(5, text, 1), (3, text, 2), (3, text, 2), (9, None, 0), (8, " ", 0), (None, text, 0), (None, "else what and so on then", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, bits int")
    got = [(r.doc_id, r.component_id) for r in simhash.classes(docs).collect()]
    assert sorted(got, key=str) == sorted([(5, 3), (3, 3), (3, 3), (9, 8), (8, 8), (None, 3), (None, None)], key=str)
    assert simhash.classes(docs.limit(0)).count() == 0


def test_query_equals_all_pairs(spark):
    path = "/root/testdata/sf0.001"
    prints = {r.doc_id: slow_print(r.text) for r in spark.read.parquet(f"{path}/documents.parquet").collect()}
    got = QUERIES["op1_simhash"](spark, path).collect()
    assert {r.doc_id: r.fingerprint for r in got} == {d: f"{p:016x}" for d, p in prints.items()} and len(got) == len(prints)
    assert {r.doc_id: r.component_id for r in got} == slow_classes(prints)

"""Jaccard join against all pairs, with lists dealt out in small parts and with sets that only a chain of links joins."""

import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from auditlake.llm import jaccard
from auditlake.llm.queries import JACCARD_SQL, op12_jaccard
from tests.compare import rows as compared

SCHEMA = "doc_id long, text string"


def slow_set(text):
    words = "".join(c.lower() if c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else c for c in text or "").encode().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def similar(a, b):
    return bool(a) and bool(b) and 100 * len(a & b) >= 80 * len(a | b)


def slow(rows):
    sets = [slow_set(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if rows[i][0] is not None and rows[j][0] is not None and similar(sets[i], sets[j]):
                up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    out = []
    for i, (d, _) in enumerate(rows):
        if d is not None:
            out.append((d, len(sets[i]), least[root(i)] if sets[i] else d))
        else:
            twins = [least[root(j)] for j, (e, _) in enumerate(rows) if e is not None and sets[j] == sets[i]]
            out.append((None, len(sets[i]), twins[0] if twins and sets[i] else None))
    return sorted(out, key=str)


def texts(seed, base_words=60, clusters=6, size=14):
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randrange(2, 8))) for _ in range(900)]
    say = lambda n: [r.choice(vocab) for _ in range(n)]
    passage, out = say(30), []
    for _ in range(clusters):
        base = say(r.randrange(base_words // 2, base_words * 2))
        walk = list(base)
        for k in range(size):
            copy = list(walk if k % 2 else base)
            for _ in range(r.randrange(0, 3)):
                copy[r.randrange(len(copy))] = r.choice(vocab)
            if k % 2:
                walk = copy
            out.append(" ".join(copy))
        out += [" ".join(base).upper()] * r.randrange(0, 4)
    out += [" ".join(say(r.randrange(5, 40)) + passage + say(r.randrange(0, 20))) for _ in range(40)]
    out += [None, "", " \n\t ", "one", "One", "one two", "a b c d", "a b c d e", "ünï Ünï a b c d e f", "w " * 3000, "w " * 2000 + "v"]
    r.shuffle(out)
    return out


@pytest.mark.parametrize("seed,homes,most", [(1, 20_000, 1 << 17), (2, 3, 64), (3, 1, 1 << 17), (4, 5, 0)])
def test_equals_all_pairs(spark, monkeypatch, seed, homes, most):
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    monkeypatch.setattr(jaccard, "PAIRS", 5)
    rows = [(i + 1, t) for i, t in enumerate(texts(seed))]
    rows += [(None, rows[5][1]), (None, "nobody else says this at all here"), (None, None), rows[3], (rows[4][0], rows[9][1])]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5).selectExpr("*", "1 as node", "2 as n", "'x' as digest", "3 as doc", "4 as list", "5 as root", "6 as a", "7 as _a", "8 as component", "9 as _digest")
    got = sorted(((x.doc_id, x.n_shingles, x.component_id) for x in jaccard.classes(docs, homes, most or 1).collect()), key=str)
    assert got == slow(rows)
    assert len({c for _, n, c in got if n}) < len(rows) - 30


def test_long_chain(spark):
    words = [f"w{i}" for i in range(500)]
    rows = [(1000 - k, " ".join(words[10 * k : 10 * k + 100])) for k in range(40)]
    got = {x.doc_id: x.component_id for x in jaccard.classes(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert set(got.values()) == {961} and len(got) == 40


def test_bounds():
    for n in range(1, 200):
        for m in range(n, 300):
            least = next(o for o in range(n + 1) if 100 * o >= 80 * (n + m - o)) if 100 * n >= 80 * m else None
            if least is not None:
                assert jaccard.enough(n, m) == least
                # leaving out what follows the prefix can never leave enough
                assert n - jaccard.prefix_length(n) < least and m - jaccard.prefix_length(m) < least
    assert jaccard.prefix_length(0) == 0


def test_similar_sets_share_enough_of_their_prefixes():
    r = random.Random(11)
    close = 0
    for _ in range(3000):
        n = r.randrange(5, 60)
        x = set(r.sample(range(200), n))
        y = set(x)
        for _ in range(r.randrange(0, max(2, n // 5))):
            y.discard(r.choice(sorted(y))) if r.random() < 0.5 else y.add(r.randrange(200))
        if not similar(x, y):
            continue
        close += 1
        first = lambda s: set(sorted(s)[: jaccard.prefix_length(len(s))])
        assert len(first(x) & first(y)) >= jaccard.shared(len(x), len(y))
    assert close > 500


def test_blocks_skip_no_pair(monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    r = np.random.default_rng(1)
    for _ in range(30):
        n = np.sort(r.integers(5, 90, 70))
        pos, away = (n * r.random(70) * 0.2).astype(np.int64), r.random(70) < 0.2
        got = {(i, j) for x, y in jaccard.fitting(n, pos, away) for i, j in zip(x.tolist(), y.tolist())}
        want = {
            (i, j)
            for i in range(70)
            for j in range(i + 1, 70)
            if 80 * n[j] <= 100 * n[i] and min(pos[i], pos[j]) + min(n[i] - pos[i], n[j] - pos[j]) >= jaccard.enough(n[i], n[j]) and not (away[i] and away[j])
        }
        assert got == want


def test_counters_keep_what_is_frequent():
    own = jaccard.Counters(50)
    r = np.random.default_rng(2)
    for _ in range(40):
        own.add(np.concatenate([r.integers(1000, 10**9, 200).astype(np.uint64), np.repeat(np.arange(5, dtype=np.uint64), 20)]))
    assert set(range(5)) <= set(own.tokens.tolist()) and len(own.tokens) <= 50 and own.counts.max() <= 800


def listed(r, lists, sizes, classes, width):
    """Lists of sets of about ``width`` tokens in ``classes`` classes, as one sorted batch of rows."""
    many = [r.integers(*sizes) for _ in range(lists)]
    key = np.repeat(np.arange(lists), many)
    n = r.integers(width * 9 // 10, width, len(key))
    place = (n << 32) | (n * r.random(len(key)) * 0.2).astype(np.int64) | np.where(r.random(len(key)) < 0.1, jaccard.AWAY, 0)
    node = np.concatenate([r.permutation(10 * m)[:m] for m in many])
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (key, node, place, node % classes)], ["list", "node", "place", "root"])


def test_classes_met_equal_all_pairs(monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    monkeypatch.setattr(jaccard, "CELLS", 100)
    rows = listed(np.random.default_rng(5), 60, (1, 70), 12, 60)
    got = sorted(tuple(x.values()) for b in jaccard._classes_met(iter([rows])) for x in b.to_pylist())
    want, lists = [], {}
    for x in rows.to_pylist():
        n, pos, away = (int(v) for v in jaccard._unpack(np.int64(x["place"])))
        lists.setdefault(x["list"], []).append((x["node"], x["root"], n, pos, away))
    for of in lists.values():
        met = {}
        for a, r, n, p, away in of:
            for _, q, m, o, too in of:
                if r > q and not (away and too) and 80 * max(n, m) <= 100 * min(n, m) and min(p, o) + min(n - p, m - o) >= jaccard.enough(n, m):
                    k, first = met.get((a, q), (n, False))
                    met[a, q] = (min(k, int(jaccard.shared(n, m))), first or min(n - p, m - o) >= jaccard.enough(n, m))
        want += [(*k, *v) for k, v in met.items()]
    assert got == sorted(want) and len({len(x) > jaccard.SMALL for x in lists.values()}) == 2


def test_a_list_of_many_classes_takes_little_memory():
    rows = listed(np.random.default_rng(6), 1, (1500, 1501), 10**6, 400)
    tracemalloc.start()
    assert sum(b.num_rows for b in jaccard._classes_met(iter([rows]))) > 500_000
    assert tracemalloc.get_traced_memory()[1] < 64e6
    tracemalloc.stop()


def test_counters_equal_counts_that_all_lose_alike():
    r, own, want = np.random.default_rng(7), jaccard.Counters(30), Counter()
    for _ in range(60):
        batch = np.concatenate([r.integers(0, 10**6, r.integers(0, 60)), r.integers(0, 25, r.integers(0, 40))]).astype(np.uint64)
        want.update(batch.tolist())
        least = sorted(want.values())[len(want) - 31] if len(want) > 30 else 0
        want = Counter({k: v - least for k, v in want.items() if v > least})
        own.add(batch)
        assert dict(zip(own.tokens.tolist(), own.counts.tolist())) == want


def test_counting_a_batch_takes_little_memory():
    own, batch = jaccard.Counters(), np.random.default_rng(8).integers(0, 1 << 62, 1 << 21).astype(np.uint64)
    tracemalloc.start()
    own.add(batch)
    assert tracemalloc.get_traced_memory()[1] < 2 * batch.nbytes
    tracemalloc.stop()


def test_empty_table(spark):
    assert jaccard.classes(spark.createDataFrame([], SCHEMA)).count() == 0
    assert [tuple(x) for x in jaccard.classes(spark.createDataFrame([(4, None), (3, "")], SCHEMA)).orderBy("doc_id").collect()] == [(3, 0, 3), (4, 0, 4)]


def test_query_equals_its_sql(spark, tmp_path):
    import duckdb

    rows = [(i + 1, t) for i, t in enumerate(texts(9)) if t is None or len(t) < 3000]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert compared(op12_jaccard(spark, str(tmp_path)).toPandas()) == compared(con.execute(JACCARD_SQL).df())

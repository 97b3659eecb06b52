import hashlib
import random
import re

import numpy as np
import pytest

from auditlake.llm import decontaminate as dc
from auditlake.llm.queries import QUERIES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def fold(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute(docs, items):
    wanted = {}
    for item, text in items:
        w = WORD.findall(fold(text))
        for i in range(max(1, len(w) - 9) if w else 0):
            wanted.setdefault(tuple(w[i : i + 10]), set()).add(item)
    sizes = {len(k) for k in wanted}
    out = {}
    for doc, text in docs:
        w = WORD.findall(fold(text))
        hit, found = set(), set()
        for size in sizes:
            for i in range(len(w) - size + 1):
                got = wanted.get(tuple(w[i : i + size]))
                if got:
                    hit.update(range(i, i + size))
                    found |= got
        out[doc] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit))
    return out


def test_suffix_order_and_ranks():
    r = np.random.default_rng(3)
    for n in (1, 2, 3, 65, 700):
        seq = np.append(r.integers(0, 5, n - 1), 0).astype(np.int32)
        ends = {int(p): i for i, p in enumerate(np.flatnonzero(seq == 0))}
        suffix = lambda p: [(int(seq[q]), ends.get(q, 0)) for q in range(p, n)]
        assert dc.suffix_order(seq).tolist() == sorted(range(n), key=suffix)
        wavelet = dc.Wavelet(seq, 3)
        for c in range(5):
            at = np.arange(n + 1)
            assert wavelet.ranks(np.full(n + 1, c), at)[0].tolist() == np.concatenate([[0], np.cumsum(seq == c)]).tolist()


def test_words():
    for t in ("Ab c-d_é日本 x9", "\x00a\x7fb", None, "", "ÀB"):
        assert [w.decode() for w in dc.words_of(t)] == WORD.findall(fold(t))


def fixture():
    r = random.Random(2)
    vocab = [f"w{i}" for i in range(12)] + ["É", "Zz"]
    say = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    items = [(i, say(r.choice([0, 1, 3, 10, 12, 40]))) for i in range(1, 30)] + [(77, None), (78, "..."), (79, "w1 w1 w1"), (5, say(11))]
    docs = [(i, say(r.randrange(0, 300)) + (" " + r.choice(items)[1] if i % 3 and r.random() < 0 else "")) for i in range(120)]
    docs += [(200 + i, say(20) + ", " + (items[i % 29][1] or "").upper() + " " + say(20)) for i in range(60)]
    docs += [(300, None), (301, ""), (302, "w1 " * 4000), (303, docs[5][1])]
    return docs, items


def test_equals_brute_force(spark):
    docs, items = fixture()
    bench = spark.createDataFrame(items, "item_id long, text string")
    for shard in (64, 700, dc.SHARD_WORDS):
        frame = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], "doc_id long, text string, items string, n_words int").repartition(3)
        got = dc.occurrences(frame, bench, shard_words=shard).collect()
        seen = {r.doc_id: (r.n_words, sum(s.end - s.start for s in r.spans), len(r.items), hashlib.sha256(",".join(sorted(map(str, r.items))).encode()).hexdigest(), bool(r.spans)) for r in got}
        assert len(got) == len(docs) and seen == brute(docs, items)
        assert all(a.end < b.start for r in got for a, b in zip(r.spans, r.spans[1:]))
    kept = dc.clean(frame, bench)
    assert kept.schema == frame.schema
    assert {r.doc_id for r in kept.collect()} == {d for d, v in brute(docs, items).items() if not v[4]}


def test_suffix_order_refuses_what_does_not_fit():
    with pytest.raises(ValueError):
        dc.suffix_order(np.zeros(dc.MOST_SYMBOLS + 1, dtype=np.int32))


def test_pieces(monkeypatch):
    monkeypatch.setattr(dc, "SLICE", 7)
    r = random.Random(6)
    for n in (0, 1, 11, 12, 13, 14, 15, 16, 90):
        text = " " * (n % 3) + " ".join(r.choice(["a", "Bc", "é日本", "longer-than", "x" * 20]) for _ in range(n))
        words, pieces = dc.words_of(text), list(dc.pieces_of(text, 12, 5))
        assert all(p == words[s : s + 12] for s, p in pieces) and [s for s, _ in pieces] == list(range(0, max(1, len(words) - 4) if words else 0, 8))


def test_short_items_at_piece_borders(spark):
    """Pieces of 63 words start 54 words apart: the short item is in the first, the one around it only in the second."""
    filler = lambda n: ["w"] * n
    docs = []
    for at in range(40, 70):
        docs.append((at, " ".join(filler(at) + [f"a{k}" for k in range(9)] + filler(80))))
        docs.append((100 + at, " ".join(filler(at) + ["a4", "a5", "w", "a4", "a5"] + filler(80))))
    items = [(1, " ".join(f"a{k}" for k in range(9))), (2, "a4 a5")]
    got = dc.occurrences(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), spark.createDataFrame(items, "item_id long, text string"), shard_words=64).collect()
    assert [r.doc_id for r in got] == [d for d, _ in docs]
    for r in got:
        at = r.doc_id % 100
        assert [tuple(s) for s in r.spans] == ([(at, at + 9)] if r.doc_id < 100 else [(at, at + 2), (at + 3, at + 5)])
        assert r.items == ([1, 2] if r.doc_id < 100 else [2])


def test_document_of_more_words_than_an_order_can_hold(spark):
    n, step = dc.MOST_SYMBOLS + 70_000, dc.SHARD_WORDS - 1
    r = np.random.default_rng(8)
    words = np.array([f"w{i}" for i in range(3000)])[r.integers(0, 3000, n)].tolist()
    item, want = [f"leak{k}" for k in range(14)], []
    for at in (0, 900, *(k * (step - dc.WINDOW + 1) + d for k in (1, 2, 3, 4) for d in (-30, -3, 20)), n - 14):
        words[at : at + 14] = item
        want.append((at, at + 14))
    docs = [(1, "w1 " * 400_000), (2, " ".join(words)), (3, "w2 w3"), (4, " ".join(item[2:13]))]
    frame = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    bench = spark.createDataFrame([(7, " ".join(item)), (8, "w1 " * 30 + "none")], "item_id long, text string")
    got = {x.doc_id: (x.n_words, [tuple(s) for s in x.spans], x.items) for x in dc.occurrences(frame, bench).collect()}
    assert got == {1: (400_000, [(0, 400_000)], [8]), 2: (n, want, [7]), 3: (2, [], []), 4: (11, [(0, 11)], [7])}
    assert [x.doc_id for x in dc.clean(frame, bench).select("doc_id").collect()] == [3]


def test_blocks_and_empty_tables(spark, monkeypatch):
    docs, items = fixture()
    bench = spark.createDataFrame(items, "item_id long, text string")
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    whole = sorted(dc.occurrences(frame, bench).collect())
    sent = dc.blocks(bench, most=50)
    assert len(sent) >= 3
    monkeypatch.setattr(dc, "blocks", lambda *a, **b: sent)
    assert sorted(dc.occurrences(frame, bench).collect()) == whole
    monkeypatch.undo()
    assert dc.occurrences(frame.limit(0), bench).count() == 0
    assert all(not r.spans for r in dc.occurrences(frame, bench.limit(0)).collect())
    again = dc.occurrences(spark.createDataFrame([(None, docs[150][1])] * 2, "doc_id long, text string"), bench).collect()
    assert len(again) == 2 and again[0] == again[1]


def test_query_equals_brute_force(spark):
    path = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{path}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{path}/benchmark.parquet").collect()]
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in QUERIES["op8_decontaminate"](spark, path).collect()}
    want = brute(docs, items)
    assert got == want and any(v[4] for v in want.values())

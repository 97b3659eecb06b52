import random
import re

from auditlake.llm import tokens
from auditlake.llm.queries import QUERIES, vocabulary

PATH = vocabulary("piece_bpe_32k.model")


def slow(word, initial, following):
    n, start, own = 0, 0, initial
    while start < len(word):
        end = next((e for e in range(len(word), start, -1) if word[start:e] in own), None)
        if end is None:
            return 0
        n, start, own = n + 1, end, following
    return n


def test_automaton_equals_greedy_search():
    r = random.Random(5)
    for _ in range(150):
        say = lambda: "".join(r.choice("abc") for _ in range(r.randrange(1, 6)))
        initial, following = {say() for _ in range(r.randrange(1, 12))}, {say() for _ in range(r.randrange(0, 12))}
        automaton = tokens.Automaton(initial, following)
        for _ in range(150):
            word = "".join(r.choice("abcd" if r.random() < 0.1 else "abc") for _ in range(r.randrange(0, 14)))
            assert automaton.count(word) == slow(word, initial, following), (word, initial, following)


def text_counts(text, initial, following):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    counts = [slow(w, initial, following) for w in words]
    return len(words), sum(counts) + counts.count(0), counts.count(0)


def test_rows(spark):
    initial, following = map(set, tokens.pieces_of(PATH))
    texts = [None, "", " \n", "The cat's naïve 🙂 \x85x\x1cy", "word▁piece", "a" * 30000, "é 日本語 \U0001f9ff"]
    frame = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(None, "Hello", 1)] * 2, "doc_id long, text string, n_words int")
    rows = tokens.token_counts(frame, PATH).collect()
    assert len(rows) == len(texts) + 2
    got = {r.doc_id: (r.n_words, r.n_tokens, r.n_unknown) for r in rows}
    assert {d: v for d, v in got.items() if d not in (None, 5)} == {i: text_counts(t, initial, following) for i, t in enumerate(texts) if i != 5}
    assert got[5][0] == 1 and tokens.token_counts(frame.limit(0), PATH).count() == 0


def test_kept_words_stay_bounded(monkeypatch):
    monkeypatch.setattr(tokens, "KEPT_WORDS", 10)
    counter = tokens.Counter(PATH)
    text = " ".join(f"word{i % 37}" for i in range(500))
    assert counter.text(text) == tokens.Counter(PATH).text(text) and len(counter.kept) <= 10


def test_query_equals_greedy_search(spark):
    path = "/root/testdata/sf0.001"
    initial, following = map(set, tokens.pieces_of(PATH))
    want = {r.doc_id: text_counts(r.text, initial, following) for r in spark.read.parquet(f"{path}/documents.parquet").collect()}
    assert {r.doc_id: (r.n_words, r.n_tokens, r.n_unknown) for r in QUERIES["op3_tokens"](spark, path).collect()} == want

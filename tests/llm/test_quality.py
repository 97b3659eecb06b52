import random
import re
from collections import Counter

from auditlake.llm import quality
from auditlake.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow(text):
    text = text or ""
    w = WORD.findall(text)
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    many = Counter(windows)
    inside = {i + k for i, x in enumerate(windows) if many[x] > 1 for k in range(8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside)


def fixture():
    r = random.Random(8)
    vocab = ["one", "two", "Three", "é", "#", "x<y>", "🙂", "end.", "日本"]
    say = lambda n: "".join(r.choice(vocab) + r.choice([" ", " ", "\n", "\t", "  ", "\x0b"]) for _ in range(n))
    out = [say(r.randrange(0, 120)) for _ in range(60)]
    out += [x + x for x in out[:20]] + [None, "", " \n ", "a\n\n\na\n a", "a b c d e f g h " * 5, "w " * 30000, " ".join(f"w{i}" for i in range(30000)), "\xa0a\x1cb"]
    return out


def test_counts_equal_brute_force(spark):
    texts = fixture()
    frame = spark.createDataFrame([(i, t, "n") for i, t in enumerate(texts)], "doc_id long, text string, n_words string").repartition(3)
    got = {r.doc_id: tuple(r["_f"])[:5] for r in quality.features(frame).collect()}
    assert got == {i: slow(t) for i, t in enumerate(texts)}
    assert quality.features(frame).columns == [*frame.columns, "_f"]


def test_estimates_find_the_better_rule(spark):
    r = random.Random(1)
    patterns, truth = Counter(), Counter()
    for _ in range(20000):
        y = 1 if r.random() < 0.7 else -1
        votes = tuple(y if r.random() < a else -y for a in (0.9, 0.85, 0.8, 0.6))
        patterns[votes] += 1
        truth[votes, y] += 1
    good, on_good, on_bad = quality.estimate(list(patterns.items()))
    assert abs(good - 0.7) < 0.05
    assert all(abs(g[1] - a) < 0.05 and abs(b[-1] - a) < 0.05 for g, b, a in zip(on_good, on_bad, (0.9, 0.85, 0.8, 0.6)))
    right = sum(n for (votes, y), n in truth.items() if (quality.score(votes, good, on_good, on_bad) >= 0) == (y > 0))
    assert right > 0.9 * 20000
    assert quality.estimate([])[0] == quality.START_GOOD and list(quality.rules(quality.F.col("x"))) == quality.RULES


def test_verdicts_and_empty_table(spark):
    frame = spark.createDataFrame([(None, None), (1, "word " * 30), (1, "word " * 30), (2, " ".join(f"Word{i} goes here." for i in range(40)))], "doc_id long, text string")
    counted = quality.features(frame)
    got = quality.verdicts(counted, quality.fit(counted)).select("doc_id", "_kept", "_base_failed").collect()
    assert sorted(map(tuple, got), key=str) == sorted([(None, False, True), (1, False, True), (1, False, True), (2, True, False)], key=str)
    none = quality.features(frame.limit(0))
    assert quality.verdicts(none, quality.fit(none)).count() == 0


def test_query_equals_brute_force(spark):
    path = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{path}/documents.parquet").collect()}
    rows = QUERIES["op9_quality"](spark, path).collect()
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows}
    assert got == {d: slow(t) for d, t in docs.items()}
    assert all(r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) and not (r.kept and r.base_failed) and (r.base_failed or r.kept == (r.quality >= 0.5)) for r in rows)
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{path}/labels.parquet").collect()}
    kept = {r.doc_id: r.kept for r in rows}
    clean = [kept[d] for d, q in label.items() if q == 1]
    assert sum(clean) >= 0.95 * len(clean)

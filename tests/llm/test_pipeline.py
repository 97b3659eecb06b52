"""The pipeline against a brute-force version of its stages, on a small table with planted cases."""

import hashlib
import random
import re

import corpus_pipeline
from auditlake.llm import quality
from tests.llm.test_decontaminate import brute as leaks
from tests.llm.test_lines import slow as dedup_lines
from tests.llm.test_simhash import slow_classes, slow_print


def fixture(spark, path):
    r = random.Random(12)
    vocab = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randrange(2, 9))) for _ in range(400)]
    say = lambda n: " ".join(r.choice(vocab) + r.choice(["", "", "", ".", ","]) for _ in range(n))
    line = [say(8) for _ in range(5)]
    items = [(i, say(30)) for i in range(10)] + [(10, " ".join(vocab[:2])), (11, vocab[3])]
    docs = []
    for i in range(150):
        text = "\n".join(say(r.randrange(15, 40)) + "." for _ in range(r.randrange(2, 8)))
        if i % 4 == 0:
            text += "\n" + r.choice(line)
        if i % 10 == 1:
            text += "\n" + items[i % 7][1].upper()
        if i % 10 == 2:
            text = "### $$$ %%% " * 30
        docs.append((i, text))
    docs += [(200 + i, docs[i][1]) for i in range(0, 40, 3)] + [(300, None), (301, ""), (302, say(5)), (None, say(60))]
    rows = [(d, t, "en", f"src{i % 3}", len(t or "")) for i, (d, t) in enumerate(docs)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return docs, items


def test_equals_brute_force(spark, tmp_path):
    path = str(tmp_path)
    docs, items = fixture(spark, path)
    frame = spark.read.parquet(f"{path}/documents.parquet")
    counted = quality.features(frame)
    kept = {(x.doc_id, x.text) for x in quality.verdicts(counted, quality.fit(counted)).where("_kept").collect()}
    left = [(d, t) for d, t in docs if (d, t) in kept]
    assert 0 < len(left) < len(docs) - 15
    left = [(d, t) for d, _, _, t in dedup_lines(left)]
    named = {d: slow_print(t) for d, t in left if d is not None}
    group = slow_classes(named)
    left = [(d, t) for d, t in left if d is None or group[d] == d]
    assert len(left) < len(named)
    bad = leaks(left, items[:10])
    assert any(v[4] for v in bad.values())
    short = [words_of(t) for _, t in items[10:]]
    left = [(d, without(t, short)) for d, t in left if not bad[d][4]]
    from tokenizers import Tokenizer

    public = Tokenizer.from_file(corpus_pipeline.vocabulary("byte_bpe_50k.json"))
    want = {}
    for d, t in left:
        ids = public.encode(t, add_special_tokens=False).ids
        want[d] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    rows = corpus_pipeline.run(spark, path).collect()
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows} == want and len(rows) == len(want)


def words_of(text):
    return [m.group() for m in re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))]


def without(text, phrases):
    """The text less all occurrences of the phrases."""
    found = list(re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text)))
    words, gone = [m.group() for m in found], set()
    for p in phrases:
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                gone.update(range(i, i + len(p)))
    out, i = text, len(words) - 1
    while i >= 0:
        if i in gone:
            j = i
            while j - 1 in gone:
                j -= 1
            out = out[: found[j].start()] + out[found[i].end() :]
            i = j
        i -= 1
    return out


#: Names that stages use themselves, in their code of now or before.
INTERNAL = ["_w", "_k", "_o", "_l", "_f", "_kept", "_quality", "_base_failed", "_once", "_lost", "_loser", "lost", "loser", "row", "said", "kept_id", "kept_text", "print", "component_id", "best", "words", "items", "spans", "ROW", "n_words"]


def test_stages_with_internal_names(spark, tmp_path):
    fixture(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    more = docs.selectExpr("*", *[f"{k} as `{n}`" for k, n in enumerate(INTERNAL) if n != "ROW"])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, more, str(tmp_path))
        assert got.dtypes == more.dtypes, name
        plain = sorted(map(tuple, stage(spark, docs, str(tmp_path)).collect()), key=str)
        rows = got.collect()
        assert sorted([tuple(r)[:5] for r in rows], key=str) == plain, name
        assert {tuple(r)[5:] for r in rows} == {tuple(k for k, n in enumerate(INTERNAL) if n != "ROW")}, name


def test_near_stage_loses_no_text(spark, tmp_path):
    fixture(spark, str(tmp_path))
    same, other = "one two three four five six seven", "quite another text that shares no words with it at all"
    docs = spark.createDataFrame([(1, same, "en", "s", 1), (5, same, "en", "s", 1), (5, other, "en", "s", 1), (5, other, "en", "t", 1), (None, same, "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    stage = dict(corpus_pipeline.STAGES)["near_dedup"]
    assert sorted(((r.doc_id, r.text) for r in stage(spark, docs, str(tmp_path)).collect()), key=str) == sorted([(1, same), (5, other), (None, same)], key=str)


def test_short_items_take_no_document(spark, tmp_path):
    docs = spark.createDataFrame([(1, "Say: Yes, it is so."), (2, "no"), (3, None), (4, "yes"), (5, "a b yes. YES c é_yes")], "doc_id long, text string")
    spark.createDataFrame([(1, "yes"), (2, "it is")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: r.text for r in dict(corpus_pipeline.STAGES)["decontaminate"](spark, docs, str(tmp_path)).collect()}
    assert got == {1: "Say:  so.", 2: "no", 3: None, 4: "", 5: "a b  c é_"}


def test_stages_keep_the_columns(spark, tmp_path):
    fixture(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").selectExpr("*", "lang as key", "n_chars as lost", "doc_id as node", "n_chars as bits", "source as hash", "1 as n_words", "text as kept")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, str(tmp_path))
        assert got.dtypes == docs.dtypes, name
        rows = got.collect()
        assert rows and all(r.n_chars == len(r.text or "") for r in rows), name
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_dedup", "decontaminate", "encode"]


def test_empty_table(spark, tmp_path):
    fixture(spark, str(tmp_path))
    none = spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, str(tmp_path)).count() == 0, name

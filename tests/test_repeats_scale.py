"""Repeats: compared where they lie, words of existing texts looked up by rare words; the same result in every way."""

import random

import pytest
from pyspark.sql import functions as F

from auditlake.functions import text
from auditlake.operators import candidates, names
from auditlake.plans import extraction
from auditlake.sources.views import Tables

VOCABULARY = [f"w{i}" for i in range(12)] + ["The", "a", "of"]


def rows(rng, n):
    return [(rng.choice([1, 1, 1, 1, 2, 3, None]), i, rng.choice([None, "", "the a"]) if rng.random() < 0.1 else " ".join(rng.choices(VOCABULARY, k=rng.randint(1, 9)))) for i in range(n)]


def words(said):
    return {w for w in (said or "").lower().split() if len(w) > 1 and w not in ("the", "a", "of")}


@pytest.mark.parametrize("scope,limit,writes", [(["p"], 512, 1), (["p"], 20, 6), ([], 512, 4)])
def test_repeats_like_brute_force(spark, monkeypatch, scope, limit, writes):
    rng, written, materialise = random.Random(8), [], candidates.materialise

    def noted(df, what):
        written.append(what)
        return materialise(df, what)

    new, old = rows(rng, 60), rows(rng, 25) * 2
    monkeypatch.setattr(candidates, "SMALL_SCOPE", limit, raising=False)
    for module in (candidates, names):
        monkeypatch.setattr(module, "materialise", noted, raising=False)
    frames = [spark.createDataFrame(x, "p int, id int, description string") for x in (new, old)]
    got = sorted(r.id for r in candidates.drop_repeats(*frames, scope).collect())
    told = [(p, words(d)) for p, _, d in old]
    kept = [i for p, i, d in new if not any((not scope or p is not None and p == q) and words(d) and len(words(d) & w) / len(words(d)) >= 0.7 for q, w in told)]
    assert got == kept and 0 < len(kept) < len(new) and len(written) == writes


def test_words_at_every_kind_of_whitespace_and_punctuation(spark):
    every = [chr(i) for i in [*range(1, 0x250), 0x1680, 0x180E, *range(0x2000, 0x2070), 0x3000, 0xFEFF]]
    df = spark.createDataFrame([(f"ab{x}cd the{x}x cd",) for x in every], "t string")
    cleaned = F.translate(F.lower("t"), text.K.COMPARE_PUNCTUATION, " " * len(text.K.COMPARE_PUNCTUATION))
    plain = F.filter(F.array_except(F.split(cleaned, r"(?U)\s+"), F.array(*[F.lit(w) for w in text.K.STOPWORDS])), lambda w: F.length(w) >= 2)
    assert df.filter(text.content_words(F.col("t")) != plain).count() == 0


def test_findings_from_one_reading(spark):
    t = Tables(spark, "/root/testdata/sf0.001")
    got, want = extraction.told(t), t.v_finding.select("package_id", "description")
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Union") == 0

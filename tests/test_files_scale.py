"""Files that a question names: one shuffle by package, and the same result for large packages."""

import random
import re

import pytest

from auditlake.operators import turns

WORDS = ["invoice", "order", "2024", "tax", "Report", "final_copy", "a-b", "12345"]


def brute(questions, docs):
    rows = set()
    for package in {p for p, _, _ in questions if p is not None}:
        files = {f for p, f in docs if p == package and f is not None}
        mine = [(i, q.lower()) for p, i, q in questions if p == package and q is not None]
        full = {(i, f) for i, q in mine for f in files if f.lower() in re.findall(r"[\w\-]+\.(?:pdf|docx|png|jpg|jpeg|txt)", q)}
        named = {i for i, _ in full}
        loose = {(i, f) for i, q in mine if i not in named for f in files
                 for w in re.split(r"\s+", re.sub(r"[_-]", " ", re.sub(r"\.[^.]*$", "", f.lower()))) if len(w) > 3 and w in q}
        rows |= {(package, *x) for x in full | loose}
    return rows


@pytest.mark.parametrize("limit,writes", [(512, 1), (12, 4), (0, 4)])
def test_small_and_large_packages_alike(spark, monkeypatch, limit, writes):
    rng, written, materialise = random.Random(5), [], turns.materialise

    def name():
        return "_".join(rng.sample(WORDS, rng.randint(1, 2))) + rng.choice([".pdf", ".PNG", ".txt", ""])

    questions, docs = [(None, 1, "invoice.pdf"), (9, 1, "no files in this package"), (1, 7, None)], [(None, "invoice.pdf"), (8, "invoice.pdf"), (1, None)]
    for package, size in ((1, 3), (2, 6), (3, 30)):
        docs += [(package, name()) for _ in range(size)]
        for i in range(size):
            # some questions come in two wordings, some rows twice
            questions += [(package, i // 2, rng.choice(["show me ", "What is on "]) + rng.choice([name(), " ".join(rng.sample(WORDS, 2)), "that"]) + rng.choice(["", " and invoice.pdf", "?"]))] * rng.randint(1, 2)
    monkeypatch.setattr(turns, "SMALL_PACKAGE", limit, raising=False)
    monkeypatch.setattr(turns, "materialise", lambda df, what: written.append(what) or materialise(df, what))
    got = [tuple(r) for r in turns.resolve_files(
        spark.createDataFrame(questions, "package_id int, question_id int, question string"), spark.createDataFrame(docs, "package_id int, file_name string")).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(questions, docs) and len(got) > 20
    assert len(written) == writes

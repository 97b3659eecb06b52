import random
import re

from auditlake.llm import licenses
from auditlake.llm.queries import ORACLE, QUERIES
from tests.compare import compare, duck

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def slow(text):
    """(n_words, base places, detections left) with every rule tried on every text and every pair of detections compared."""
    w = words_of(text)
    base = sorted((i, label) for phrase, label in licenses.BASE for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split())
    norm, found = " ".join(w), []
    for n, (priority, score, label, _, regex) in enumerate(licenses.RULES):
        for m in re.finditer(f"(?<![^ ]){regex}(?![^ ])", norm):
            found.append((m.start(), -m.end(), priority, n, label, score))
    found.sort()
    left = [d for i, d in enumerate(found) if not any(e[0] <= d[0] and e[1] <= d[1] and e[2] <= d[2] and (j < i) for j, e in enumerate(found))]
    return len(w), base, [(a, -b, p, label, s) for a, b, p, _, label, s in left]


TEXTS = [
    "Licensed under the Apache License, Version 2.0. More.", "UNDER the MIT license under the mit-license", "CC BY-NC 4.0", "cc.by\nnc", "this file is under gpl v3", "Released under GPLv2", "SPDX-License-Identifier: MIT", "SPDX-License-Identifier: GPL-3.0-or-later",
    "Permission is hereby granted, free of charge, to any person obtaining a copy", "all rights reserved", "see the BSD 3-clause license", "License: MIT", "the isc license", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0", "this work is licensed under cc-by-sa 4.0",
    "mit der Lizenz unter", "governed by the apache 2", "in the public domain", "www.apache.org/licenses/LICENSE-2.0", "under an apache license version 2", "GNU Lesser General Public License v2.1 license", "éunder the mit license", "K", "İ under the mit license",
]


def fixture():
    r = random.Random(9)
    out = list(TEXTS)
    for _ in range(80):
        out.append(r.choice([" ", "\n", ". ", "x "]).join(r.choice([*TEXTS, "plain words", "Ünder", "42"]) for _ in range(r.randrange(1, 12))))
    return out + [None, "", " .. ", "word " * 30000 + TEXTS[0], (TEXTS[1] + "\n") * 400]


def test_equals_brute_force(spark):
    texts = fixture()
    frame = spark.createDataFrame([(i, t, "n", 1) for i, t in enumerate(texts)] + [(None, TEXTS[0], "n", 1)] * 2, "doc_id long, text string, norm string, n_words int").repartition(4)
    rows = licenses.scan(frame).collect()
    assert len(rows) == len(texts) + 2
    for r in rows:
        want = slow(texts[r.doc_id] if r.doc_id is not None else TEXTS[0])
        assert (r.n_words, [tuple(b) for b in r.base], [tuple(d) for d in r.found]) == want, texts[r.doc_id][:200]
    assert licenses.scan(frame.limit(0)).count() == 0


def test_rules_are_ordered_and_gated(spark):
    assert len(licenses.RULES) >= 300 and len({r[4] for r in licenses.RULES}) == len(licenses.RULES)
    found = {r.doc_id: [d.label for d in r.found] for r in licenses.scan(spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")).collect()}
    assert found[0] == ["apache-2"] and found[13] == [] and found[14] == ["cc-by-sa"] and found[15] == []
    gated = spark.createDataFrame(list(enumerate(fixture())), "doc_id long, text string").where(~licenses.gate(licenses.F.lower("text"))).select("text").collect()
    assert all(not slow(r.text)[1] and not slow(r.text)[2] for r in gated)


def shortest(regex):
    """The shortest text of a rule's regex, by its parse tree: optional parts left out, first branches taken."""
    from re import _constants as c, _parser

    def text(items):
        out = []
        for op, arg in items:
            if op is c.LITERAL:
                out.append(chr(arg))
            elif op is c.IN:
                out.append(chr(arg[0][1] if arg[0][0] is c.LITERAL else arg[0][1][0]))
            elif op is c.SUBPATTERN:
                out.append(text(arg[3]))
            elif op is c.BRANCH:
                out.append(min((text(b) for b in arg[1]), key=lambda t: ("under" in t, len(t))))
            elif op is c.MAX_REPEAT:
                out.append(text(arg[2]) * arg[0])
            else:
                raise ValueError(op)
        return "".join(out)

    return text(_parser.parse(regex))


def test_every_rule_passes_the_gate_with_any_separator(spark):
    rules = [shortest(regex) for *_, regex in licenses.RULES]
    assert all(re.fullmatch(r[4], t) for r, t in zip(licenses.RULES, rules)) and any(" by " in t and "under" not in t for t in rules)
    texts = [t.replace(" ", by) for t in rules for by in ("\n", "\t", "-", "] (")] + ["this program is covered\nby the gnu gpl 3"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert frame.where(~licenses.gate(licenses.F.lower("text"))).collect() == []
    assert [[d.label for d in r.found] for r in licenses.scan(frame.where(f"doc_id = {len(texts) - 1}")).collect()] == [["gpl-3"]]


def test_query(spark):
    path = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{path}/documents.parquet").collect()}
    rows = {r.doc_id: r for r in QUERIES["op7_licenses"](spark, path).collect()}
    for d, text in docs.items():
        n, base, found = slow(text)
        r = rows[d]
        places = [i for i, _ in base]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (n, len(base), min(places, default=None), max(places, default=None))
        assert r.base_labels == ",".join(sorted({x for _, x in base})) and r.labels == ",".join(sorted({x for _, x in base} | {x[3] for x in found}))
        assert r.score == max([1.0 if base else 0.0, *[x[4] for x in found]])
    if "op7_licenses" in ORACLE:
        message, _, ok = compare(spark, duck(path), "op7_licenses", QUERIES["op7_licenses"], ORACLE["op7_licenses"], path)
        assert ok, message

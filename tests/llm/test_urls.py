import random

import pytest

from auditlake.llm import urls
from auditlake.llm.queries import ORACLE, QUERIES
from tests.compare import compare, duck


def slow(url, rules):
    host, path = "", ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, tail = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end]), rest[end:]
        path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    best = None
    for rule, action in rules:
        h, slash, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith(slash + p):
            key = (len(rule), len(h))
            if best is None or key > best[0]:
                best = (key, rule, action)
    return host, path, best and best[1], best[2] if best else "allow"


def fixture():
    r = random.Random(3)
    labels = ["com", "net", "example", "www", "a", "b", "co", "EXAMPLE", "é"]
    host = lambda: ".".join(r.choice(labels) for _ in range(r.randrange(1, 5)))
    path = lambda: "".join(r.choice(["/en", "/", "/es/", "x", "/en/é", ".html"]) for _ in range(r.randrange(0, 4)))
    found = ["http://" + host() + path() + r.choice(["", "?q=/en/", "#f", "?", ":80/en"]) for _ in range(600)]
    found += [None, "", "example.com/en/", "://", "http://", "http:///en/", "http://?x", "a://b://c/en", "http://..com/en/", "http://a.com/" + "x" * 50000]
    rules = {}
    for _ in range(60):
        p = path()
        rules[host().lower() + ("/" + p.lstrip("/") if p else "")] = r.choice(["allow", "block"])
    return found, list(rules.items())


@pytest.mark.parametrize("size", [urls.SLICE_BYTES, 300])
def test_equals_brute_force(spark, size, monkeypatch):
    found, rules = fixture()
    pages = spark.createDataFrame([(i, u, "r") for i, u in enumerate(found)], "page_id long, url string, rule string").repartition(3)
    got = urls.judge(pages, spark.createDataFrame([*rules, (None, "block"), ("x/", "other")], "rule string, action string"), slice_bytes=size).collect()
    assert {r.page_id: tuple(r)[1:] for r in got} == {i: slow(u, rules) for i, u in enumerate(found)} and len(got) == len(found)


def test_colliding_digests_are_told_apart(monkeypatch):
    monkeypatch.setattr(urls, "digest", lambda host, path: len(host) % 2)
    found, rules = fixture()
    mapped = [urls.Mapped(urls.Digests([(r, a == "block") for r, a in rules]))]
    lengths = sorted({len(urls.parse_rule(r)[1]) for r, _ in rules})
    parsed = [urls.parse(u) for u in found[:200]]
    got = urls.match(parsed, mapped, lengths)
    assert [(g and g[0]) for g in got] == [slow(u, rules)[2] for u in found[:200]]


def test_rows(spark):
    none = spark.createDataFrame([], "rule string, action string")
    pages = spark.createDataFrame([(None, "http://A.com/x"), (None, "http://A.com/x"), (1, None)], "page_id long, url string")
    assert sorted(map(tuple, urls.judge(pages, none).collect()), key=str) == sorted([(None, "a.com", "/x", None, "allow")] * 2 + [(1, "", "", None, "allow")], key=str)
    both = spark.createDataFrame([("a.com/", "allow"), ("a.com/", "block"), ("A.com/", "allow")], "rule string, action string")
    assert {(r.rule, r.verdict) for r in urls.judge(pages, both, "block").collect()} == {("a.com/", "block"), (None, "block")}
    assert urls.judge(pages.limit(0), both).count() == 0


def test_query(spark):
    path = "/root/testdata/sf0.001"
    message, _, ok = compare(spark, duck(path), "op4_urls", QUERIES["op4_urls"], ORACLE["op4_urls"], path)
    assert ok, message

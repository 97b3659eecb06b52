import hashlib
import random
import re
import time

from auditlake.llm import secrets
from auditlake.llm.queries import QUERIES

PLAIN = {
    "assign": r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": "(AKIA[A-Z0-9]+)",
    "hex": "([0-9a-f]+)",
}


def slow(text):
    out = []
    for n, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text or ""):
            if len(m[1]) >= {"assign": 6, "access": 20, "hex": 24}[kind]:
                out.append((m.start(), n, kind, m.end()))
    return [f"{k}:{a}:{b}" for a, _, k, b in sorted(out)]


def fixture():
    r = random.Random(11)
    bits = ["password: ", "PassWd='", "api_key=", "apiKEY\" : ", "secret=token=", "tokKen=abcdefg", "AKIA", "AKIA" + "Z9" * 8, "deadbeef" * 3, "0" * 23, "hunter22", "ab", " ", "\n", "é🙂", "x", "=", "Q7", "pwd is ", "Xk9#mQ2$vL7p", "Bearer "]
    return ["".join(r.choice(bits) for _ in range(r.randrange(0, 40))) for _ in range(400)] + [None, "", "a" * 100000, "password=" + "A" * 50000, "secret=token = abcdefg"]


def test_base_spans_equal_plain_patterns():
    for t in fixture():
        found = secrets.find(t or "")
        assert [f"{k}:{a}:{b}" for k, a, b, c in found if c is None] == slow(t)
        assert found == sorted(found, key=lambda s: (s[1], secrets.KINDS.index(s[0]), s[2]))


def slow_cost(value):
    """Least cost over all cuts, by recursion."""
    from functools import lru_cache

    pieces = dict(secrets._pieces(value))

    @lru_cache(None)
    def best(start):
        if start == len(value):
            return 0.0
        return min([secrets.BRUTE + best(start + 1), *[c + secrets.PIECE_COST + best(e) for e, c, _ in pieces[start]]])

    return best(0)


def test_guess_cost():
    r = random.Random(4)
    pieces = ["password", "P@ssw0rd", "2019-04-01", "1999", "qwerty", "aaaa", "abab", "xK", "9#", "monkey", "12345", "zxcv", "é"]
    for _ in range(200):
        v = "".join(r.choice(pieces) for _ in range(r.randrange(1, 6)))
        assert abs(secrets.segments(v)[0] - slow_cost(v)) < 1e-9
        cut = secrets.segments(v)[1]
        assert [a for a, _, _ in cut] == [0, *[b for _, b, _ in cut[:-1]]] and cut[-1][1] == len(v)
    kinds = {k for _, _, k in secrets.segments("password2019-04-01asdfghaaaaaa#%")[1]}
    assert kinds == {"word", "date", "walk", "repeat", "brute"}
    assert secrets.guess_cost("password1999") < secrets.guess_cost("xK9#mQ2vL7pd") and secrets.segments("") == (0.0, [])


def test_context_values():
    assert secrets.find("pwd is xK9#mQ2vL7pd.") == [("guess", 7, 19, secrets.guess_cost("xK9#mQ2vL7pd"))]
    assert secrets.find("pwd is password1999") == [] and secrets.find("the xK9#mQ2vL7pd") == []
    assert [s[0] for s in secrets.find("password=xK9mQ2vL7pd")] == ["assign"]


def test_letters_only_and_values_that_overlap_base_spans():
    for text, value in (("client_key=qXvBnMzLpTrWkJhG", "qXvBnMzLpTrWkJhG"), ("pwd: KdmQzRvTpLxWn", "KdmQzRvTpLxWn")):
        assert secrets.find(text) == [("guess", text.index(value), len(text), secrets.guess_cost(value))]
    found = secrets.find("password=Tr0ub4dor&3xK9#mQ")
    assert [s[:3] for s in found] == [("assign", 0, 18), ("guess", 9, 26)]
    assert [s[0] for s in secrets.find("password=Tr0ub4dorX3xK9.")] == ["assign"]


def test_ordinary_words_are_cheap():
    for word in ("responsibilities", "encryption", "authentication", "Documentation", "international", "management", "representation", "required"):
        assert secrets.guess_cost(word) < secrets.LEAST_COST and secrets.find(f"the token {word} of it") == []
    assert 20_000 < len(secrets.RANK) <= 25_200 and all(3 <= len(w) <= 20 or w in secrets.WORDS for w in secrets.RANK)


def test_context_words_in_a_row_and_names_with_spaces_or_changes_of_case():
    value = "xK9#mQ2vL7pd"
    names = ["secret token: ", "auth token: ", "login password: ", "password is: ", "secret token:", "API key: ", "access key: ", "private key: ", "api key ", "client secret = ", "pwd is ", "secret token is "]
    names += ["dbPassword= ", "userToken=", "DBPassword: ", "db_password=", "login db_password=", "bearer token ", "secret token password: ", "passphrase => ", 'config[apiKey] = "']
    for name in names:
        found = [s for s in secrets.find(name + value) if s[0] == "guess"]
        assert found == [("guess", len(name), len(name + value), secrets.guess_cost(value))], name
    assert secrets.find("compass: " + value) == [] and secrets.find("the token: of the secret key: here") == []
    assert [s[:3] for s in secrets.find(f"login {value}-token: x")] == [("guess", 6, 24)]
    text = f"secret {value} token: {value[::-1]}, pass {value}"
    assert [text[a:b] for kind, a, b, _ in secrets.find(text) if kind == "guess"] == [value, value[::-1], value]


def test_costs_of_suffixes():
    for value in ("password2019-04-01asdfghaaaaaa#%", "token:token:xK9#mQ2v", "P@ssw0rdabab", "é🙂x1999"):
        assert list(secrets.suffix_costs(value))[:-1] == [secrets.guess_cost(value[i:]) for i in range(len(value))]
    begin = time.time()
    assert secrets.find("pwd=" * 20_000) == [] and secrets.find("secret " * 20_000) == []
    assert time.time() - begin < 20


def test_long_values_take_linear_time():
    for unit in ("a", "ab", "abcdefgh", "Xk9#mQ2v"):
        value = (unit * 60_000)[:60_000]
        begin = time.time()
        secrets.find("pwd: " + value)
        assert time.time() - begin < 20


def test_rows(spark):
    texts = fixture()
    frame = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)] + [(None, "pwd: aaa", "s")] * 2, "doc_id long, text string, spans string")
    rows = secrets.scan(frame).collect()
    assert len(rows) == len(texts) + 2
    assert all([f"{s.kind}:{s.start}:{s.end}" for s in r.spans if s.cost is None] == slow(texts[r.doc_id]) for r in rows if r.doc_id is not None)
    assert secrets.scan(frame.limit(0)).count() == 0


def test_query_equals_plain_patterns(spark):
    path = "/root/testdata/sf0.001"
    docs = {r.doc_id: slow(r.text) for r in spark.read.parquet(f"{path}/documents.parquet").collect()}
    rows = QUERIES["op6_secrets"](spark, path).collect()
    for r in rows:
        base = docs[r.doc_id]
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest() and set(base) <= set(r.spans.split(","))
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(b.startswith(k) for b in base) for k in PLAIN)
    assert len(rows) == len(docs)


def test_a_very_long_value_takes_little_memory():
    """Ten million characters behind a context; a tenth of them is run here, and what is kept for each character is counted."""
    import tracemalloc

    r = random.Random(1)
    value = "".join(r.choice("abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789+/") for _ in range(200_000))
    text = "client_key: " + value
    tracemalloc.start()
    (found,) = [s for s in secrets.find(text) if s[0] == "guess"]
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found[1:3] == (12, len(text))
    # some 15 bytes a character: 150 MB for ten million
    assert most < 60 * len(value)


def planted(kind, r):
    letters = "abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789"
    common = ["summer", "winter", "dragon", "monday", "welcome", "sunshine", "password", "london", "coffee", "yellow"]
    if kind == "random":
        return "".join(r.choice(letters) for _ in range(r.randrange(12, 25)))
    if kind == "signs":
        return "".join(r.choice(letters + "!#%&*+-_") for _ in range(r.randrange(12, 20)))
    if kind == "passphrase":
        return "-".join(r.choice(common) for _ in range(2)) + str(r.randrange(10, 99))
    if kind == "date":
        return f"{r.choice(common)}{r.randrange(1950, 2025)}-{r.randrange(1, 13):02d}-{r.randrange(1, 29):02d}"
    if kind == "walk":
        return r.choice(["qwertyuiop", "asdfghjkl", "1234567890", "zxcvbnm123", "qwerty123456"])
    return r.choice(["changeme", "your-token-here", "example-password", "xxxxxxxxxxxx", "my_secret_key", "default123", "password"])


def measured(n=300):
    """Share of values of each class that are reported, behind contexts that the base patterns do not know."""
    r, out = random.Random(5), {}
    for kind in ("random", "signs", "passphrase", "date", "walk", "placeholder"):
        hits = 0
        for _ in range(n):
            value = planted(kind, r)
            text = r.choice(["client_key: ", "The private key is ", "pwd=", "Authorization: ", "login credentials -> "]) + value + r.choice(["", "\nnext", " and so on"])
            hits += any(k == "guess" and text[a:b] == value for k, a, b, _ in secrets.find(text))
        out[kind] = hits / n
    return out


def test_recall_and_false_alarms_by_class():
    got = measured()
    print(got)
    assert got["random"] > 0.98 and got["signs"] > 0.9
    assert got["date"] == got["walk"] == got["placeholder"] == 0
    assert got["passphrase"] < 0.1

import random

from auditlake.llm import bpe
from auditlake.llm.queries import vocabulary

PATH = vocabulary("byte_bpe_50k.json")
WORDS = ["the", "don't", "we're", "x", "straße", "été", "naïve,", "12345", "½", "²", "日本語", "🙂", "<|endoftext|>", "<|endof", "text|>", "'re", "a'", " ", "\x1c", "\x85", "\xa0", "՘", "\t", "\n\n", "  ", "   ", "!!", "re"]


def texts(n=400):
    r = random.Random(5)
    out = ["", " ", "  ", "a", " a", "a ", "<|endoftext|>", "x<|endoftext|>y", "a" * 3000, " " * 700, "ab " * 900]
    shared = " ".join(r.choice(WORDS) for _ in range(600))
    for _ in range(n):
        own = "".join(r.choice(WORDS) + r.choice([" ", " ", " ", "", "\n"]) for _ in range(r.randrange(1, 500)))
        out.append(own + shared[r.randrange(300):] + own[::-1] if r.random() < 0.3 else own)
    return out


def test_encode_equals_the_public_library():
    from tokenizers import Tokenizer

    public, own = Tokenizer.from_file(PATH), bpe.Codec(PATH)
    for t in texts():
        want = public.encode(t, add_special_tokens=False).ids
        assert own.encode(t) == want, repr(t[:80])
        assert own.decode(want) == public.decode(want, skip_special_tokens=False)


def test_the_two_libraries_agree_below_the_bound():
    from tokenizers import Tokenizer

    public, own = Tokenizer.from_file(PATH), bpe.Codec(PATH)
    for c in range(bpe._AGREED_BELOW):
        for s in (f"a{chr(c)}1{chr(c)} .{chr(c)}", f"a {chr(c)} {chr(c)}{chr(c)} b"):
            assert own.quick.encode_ordinary(s) == public.encode(s, add_special_tokens=False).ids


def test_cuts_depend_on_content():
    r = random.Random(1)
    passage = "".join(r.choice("abcdefgh ") for _ in range(20000))
    a = {passage[x - 16 : x] for x in bpe.cuts(passage)}
    b = bpe.cuts("zz" * 33 + passage)
    assert len(b) > 10 and sum(("zz" * 33 + passage)[x - 16 : x] in a for x in b) >= len(b) - 3


def test_stores_stay_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "PIECES", 50)
    monkeypatch.setattr(bpe, "STORED_CHARS", 5000)
    own, fresh = bpe.Codec(PATH), bpe.Codec(PATH)
    for t in texts(60):
        assert own.encode(t) == fresh.exact.encode(t, add_special_tokens=False).ids
        assert len(own.pieces) <= 50 and sum(map(len, own.chunks)) <= 5000 + len(t)


def test_rows(spark):
    rows = [(1, None, 5), (None, "the the", 5), (2, "", 5), (2, "", 5), (3, "x<|endoftext|>", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = sorted(bpe.encode_decode(docs, PATH).collect(), key=str)
    assert len(got) == 5 and [r.ids for r in got if r.doc_id in (1, 2)] == [[], [], []]
    assert [(r.ids, r.decoded) for r in got if r.doc_id == 3] == [([87, 50256], "x<|endoftext|>")]
    assert bpe.encode_decode(docs.limit(0), PATH).count() == 0


def test_query_equals_the_public_library(spark):
    import hashlib

    from tokenizers import Tokenizer

    from auditlake.llm.queries import QUERIES

    path = "/root/testdata/sf0.001"
    public = Tokenizer.from_file(PATH)
    want = {}
    for r in spark.read.parquet(f"{path}/documents.parquet").collect():
        ids = public.encode(r.text or "", add_special_tokens=False).ids
        want[r.doc_id] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(public.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in QUERIES["op2_bpe"](spark, path).collect()}
    assert got == want

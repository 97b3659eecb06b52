import hashlib
import random

from auditlake.llm import chat
from auditlake.llm.queries import ORACLE, QUERIES
from tests.compare import compare, duck


def slow(rows):
    """rows: (conv, turn, role, text) -> {conv: (n_turns, turns digest, loss chars, loss digest)}"""
    by = {}
    for c, n, role, text in rows:
        by.setdefault(c, []).append((-1 if n is None else n, role or "", text or ""))
    out = {}
    for c, turns in by.items():
        turns.sort()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        out[c] = (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


BITS = ["hello", "[INST]", "[/INST]", "</s>", "<", "/s>", "\\", "\\s", "\\l", "\\b", "[", "INST]", " ", "\n", "🙂", "é", ""]


def fixture():
    r = random.Random(6)
    rows = [(i % 40, i // 40, r.choice(["user", "assistant", "system", "tool", "</s>", None]), r.choice([None, "", *("".join(r.choice(BITS) for _ in range(r.randrange(0, 9))) for _ in range(8))])) for i in range(500)]
    rows += [(900, n, r.choice(["user", "assistant"]), "".join(r.choice(BITS) for _ in range(4))) for n in range(3000)]
    rows += [(None, 1, "assistant", "x"), (None, 1, "assistant", "x"), (901, None, "user", "a"), (901, 0, "assistant", "b"), (902, 5, "assistant", "long " * 50000)]
    r.shuffle(rows)
    return rows


def test_round_trip(spark):
    rows = fixture()
    frame = spark.createDataFrame([(*x, "f", 1) for x in rows], "conv_id long, turn long, role string, text string, formatted string, block int").repartition(4)
    made = chat.format_chats(frame)
    got = chat.read_back(made).collect()
    seen = {r.conv_id: (len(r.turns), hashlib.sha256("".join(f"{t.role}\n{t.text}\n" for t in r.turns).encode()).hexdigest(), len(r.loss_text), hashlib.sha256(r.loss_text.encode()).hexdigest()) for r in got}
    assert len(got) == len(seen) and seen == slow(rows)
    assert all(r.n_turns == slow(rows)[r.conv_id][0] for r in made.collect())
    assert chat.format_chats(frame.limit(0)).count() == 0


def test_only_conflicting_turns_are_escaped(spark):
    frame = spark.createDataFrame([(1, 1, "user", "plain [x] <y> \\n"), (1, 2, "user", "a</s>"), (1, 3, "assistant", "\\l")], "conv_id long, turn long, role string, text string")
    row = chat.format_chats(frame).first()
    assert row.formatted == "[INST]user[/INST]plain [x] <y> \\n</s>[INST]user[/INST]a\\l/s></s>[INST]assistant[/INST]\\bl</s>" and row.n_escaped == 2
    assert row.formatted[row.loss_spans[0].start : row.loss_spans[0].end] == "\\bl"


def test_query(spark):
    path = "/root/testdata/sf0.001"
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{path}/conversations.parquet").collect()]
    clash = "</s>[INST] ok [/INST]"
    want = slow(rows + [(-7, 1, "user", clash), (-7, 2, "assistant", clash)])
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in QUERIES["op10_chat"](spark, path).collect()}
    assert got == want
    message, _, ok = compare(spark, duck(path), "op10_chat", QUERIES["op10_chat"], ORACLE["op10_chat"], path)
    assert ok, message

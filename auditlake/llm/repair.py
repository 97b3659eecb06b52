"""Conversation structure repair by a run-length dynamic programme.

Roles are to read ``(s?(ua)+)?`` by their initials: an optional system turn, then user and assistant in turns. Turns may
be kept, given the role that is due (rerole), deleted or inserted without text; blank and repeated turns must go. A row
is a symbol (the role's initial and whether the text breaks off), and what a symbol costs between the four states of
the grammar is a 4 x 4 matrix over minimum and plus. Equal consecutive symbols are one run; a run of length n is passed by the
binary powers of its matrix, which are cached. From the costs left behind each run the choices are unrolled from the
left, the ASCII-least letter first among those of least cost; a power's choices, too, are cached by state and costs left.

Only symbols travel for the plan: a conversation is sorted into one task as runs, and its texts are then streamed past
the plan, never gathered. Nulls: a text without value is blank, a role without value has no initial.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.llm.common import arrow_rows

SPACE = " \t\n\x0b\x0c\r"
ENDS = ".!?"
DELETE, INSERT, REROLE, BREAK = 2, 5, 1, 5
NEVER = 1 << 60
#: States of the grammar: nothing yet, after system, after user, after assistant; the first and last may end.
READ = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}
DUE = ("u", "u", "a", "u")
ENDING = (0, 3)
ROLE = {"u": "user", "a": "assistant"}
#: Longest power (as an exponent) whose choices are kept in the cache.
KEPT_POWER = 12

Costs = tuple[int, ...]


def _times(matrix: tuple[Costs, ...], costs: Costs) -> Costs:
    return tuple(min(m + c for m, c in zip(row, costs)) for row in matrix)


def _closed(row_edits: list[list[int]]) -> tuple[Costs, ...]:
    """Cheapest way from state to state over any inserts before one row."""
    out = []
    for state in range(4):
        best, at = [NEVER] * 4, state
        for many in range(4):
            best = [min(b, many * INSERT + e) for b, e in zip(best, row_edits[at])]
            at = READ[DUE[at], at]
        out.append(tuple(best))
    return tuple(out)


def edits(symbol: str, state: int) -> list[tuple[str, int, int]]:
    """Edits of one row (letter, cost, next state). Symbols: ``x`` must go; s, u, a or o (other) are roles, in capitals if the text breaks off."""
    out = [("D", DELETE, state)]
    if symbol != "x":
        extra, role = BREAK if symbol.isupper() else 0, symbol.lower()
        if (role, state) in READ:
            out.append(("K", extra, READ[role, state]))
        out.append(("R", REROLE + extra, READ[DUE[state], state]))
    return out


@lru_cache(maxsize=None)  # nine symbols, some sixty powers each
def power(symbol: str, exponent: int) -> tuple[Costs, ...]:
    """Matrix of 2^exponent rows of one symbol."""
    if exponent:
        half = power(symbol, exponent - 1)
        columns = list(zip(*half))
        return tuple(tuple(min(NEVER, min(a + b for a, b in zip(row, column))) for column in columns) for row in half)
    table = [[NEVER] * 4 for _ in range(4)]
    for state in range(4):
        for _, cost, to in edits(symbol, state):
            table[state][to] = min(table[state][to], cost)
    return _closed(table)


def _end() -> Costs:
    out = []
    for state in range(4):
        cost = 0
        while state not in ENDING:
            state, cost = READ[DUE[state], state], cost + INSERT
        out.append(cost)
    return tuple(out)


END = _end()


def _powers(length: int) -> list[int]:
    return [k for k in range(length.bit_length()) if length >> k & 1]


def _relative(costs: Costs) -> Costs:
    least = min(costs)
    return tuple(c - least for c in costs)


def _step(symbol: str, state: int, after: Costs) -> tuple[str, int]:
    """Edits at one row (inserts before it and its own), ASCII-least among the cheapest, and the state behind it."""
    before, letters = _times(power(symbol, 0), after), ""
    while True:
        options = [(e, c + after[to], to) for e, c, to in edits(symbol, state)]
        due = READ[DUE[state], state]
        options.append(("I", INSERT + before[due], due))
        edit, _, state = min((o for o in options if o[1] == before[state]), key=lambda o: o[0])
        letters += edit
        if edit != "I":
            return letters, state


def _choices(symbol: str, exponent: int, state: int, after: Costs) -> tuple[str, int]:
    if exponent > KEPT_POWER:
        return _halves(symbol, exponent, state, after)
    return _kept_choices(symbol, exponent, state, after)


@lru_cache(maxsize=4096)
def _kept_choices(symbol: str, exponent: int, state: int, after: Costs) -> tuple[str, int]:
    return _halves(symbol, exponent, state, after) if exponent else _step(symbol, state, after)


def _halves(symbol: str, exponent: int, state: int, after: Costs) -> tuple[str, int]:
    middle = _relative(_times(power(symbol, exponent - 1), after))
    left, state = _choices(symbol, exponent - 1, state, middle)
    right, state = _choices(symbol, exponent - 1, state, after)
    return left + right, state


def plan(runs: list[tuple[str, int]]) -> tuple[int, str]:
    """(cost, audit) of a conversation given as runs (symbol, length)."""
    parts = [(symbol, k) for symbol, length in runs for k in _powers(length)]
    behind, costs, total = [], END, 0
    for symbol, k in reversed(parts):
        behind.append(costs)
        costs = _times(power(symbol, k), costs)
        total += min(costs)
        costs = _relative(costs)
    cost, state, letters = total + costs[0], 0, []
    for (symbol, k), after in zip(parts, reversed(behind)):
        made, state = _choices(symbol, k, state, after)
        letters.append(made)
    while state not in ENDING:
        letters.append("I")
        state = READ[DUE[state], state]
    return cost, "".join(letters)


def _key() -> Column:
    return F.unhex(F.sha2(F.concat(F.coalesce("role", F.lit("")), F.lit("\0"), F.coalesce("text", F.lit(""))), 256)).alias("key")


def _columns(chats: DataFrame) -> DataFrame:
    """The four columns by name, so that others cannot clash."""
    return chats.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))


def symbols(chats: DataFrame) -> DataFrame:
    """One row for all equal rows of a turn: conv_id, turn, key, initial, blank, broken, n (how many), first (none like it earlier)."""
    text = F.rtrim(F.coalesce("text", F.lit("")), F.lit(SPACE))
    blank = F.btrim(F.coalesce("text", F.lit("")), F.lit(SPACE)) == ""
    rows = _columns(chats).select("conv_id", "turn", _key(), F.left(F.coalesce("role", F.lit("")), F.lit(1)).alias("initial"), blank.alias("blank"), (~F.substring(text, -1, 1).isin(*ENDS)).alias("broken"))
    rows = rows.groupBy("conv_id", "turn", "key", "initial", "blank", "broken").agg(F.count("*").alias("n"))
    when = F.struct(F.col("turn").isNotNull().alias("given"), F.col("turn").alias("turn"))
    earliest = rows.groupBy(F.col("conv_id").alias("_conv"), F.col("key").alias("_key")).agg(F.min(when).alias("_when"))
    same = rows["conv_id"].eqNullSafe(F.col("_conv")) & (rows["key"] == F.col("_key"))
    return rows.join(earliest, same).select(*rows.columns, when.eqNullSafe(F.col("_when")).alias("first"))


class _Open:
    """A conversation while its rows come in order: runs of symbols, and counts."""

    def __init__(self):
        self.runs: list[list] = []
        self.counts = {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
        self.last, self.turn, self.turns, self.span = None, None, 0, [None, None]

    def add(self, symbol: str, many: int) -> None:
        if not many:
            return
        if self.runs and self.runs[-1][0] == symbol:
            self.runs[-1][1] += many
        else:
            self.runs.append([symbol, many])

    def row(self, turn: int | None, initial: str, blank: bool, broken: bool, many: int, first: bool) -> None:
        if turn is not None and turn != self.turn:
            self.turn, self.turns = turn, self.turns + 1
            self.span = [turn if self.span[0] is None else self.span[0], turn]
        if self.last is not None:
            self.counts["illegal"] += self.last + initial not in ("su", "ua", "au")
        self.last = initial
        self.counts["illegal"] += many - 1
        fresh = 1 if first and not blank else 0
        self.counts["blank" if blank else "duplicate"] += many - fresh
        self.counts["truncated"] += fresh and broken
        symbol = initial if initial in ("s", "u", "a") else "o"
        self.add(symbol.upper() if broken else symbol, fresh)
        self.add("x", many - fresh)

    def result(self) -> tuple:
        cost, audit = plan([(s, n) for s, n in self.runs])
        gaps = 0 if self.span[0] is None else self.span[1] - self.span[0] + 1 - self.turns
        return gaps, *self.counts.values(), cost, audit


PLAN = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _plans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, chat, done = None, None, []

    def flush() -> pa.RecordBatch:
        columns = list(zip(*done))
        kinds = [pa.int64()] * 7 + [pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], [f.split()[0] for f in PLAN.split(", ")])

    for columns in arrow_rows(batches, "conv_id", "turn", "initial", "blank", "broken", "n", "first"):
        for conv, *row in zip(*columns):
            if chat is None or conv != now:
                if chat is not None:
                    done.append((now, *chat.result()))
                now, chat = conv, _Open()
            chat.row(*row)
        if done:
            yield flush()
            done.clear()
    if chat is not None:
        done.append((now, *chat.result()))
        yield flush()


def plans(chats: DataFrame) -> DataFrame:
    """One row per conversation: gaps, faults, cost and audit.

    Rows stand by turn (nulls first), those of one turn by a digest of role and text. ``gaps`` are turn numbers missing
    between the first and the last; each row counts under its first fault of blank, duplicate (role and text seen
    earlier) and truncated; ``illegal`` counts neighbours whose initials are none of su, ua, au. The audit has a letter
    for each edit: K(eep), R(erole), D(elete), I(nsert). Rows without ``conv_id`` are one conversation. A null text is
    blank; a null or empty role has no initial and is never kept. Columns other than the four play no part. An empty
    table has no conversations.
    """
    order = ["conv_id", "turn", "key"]
    return symbols(chats).repartition("conv_id").sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in order]).mapInArrow(_plans, PLAN)


TURN = "conv_id long, pos long, turn long, edit string, role string, text string"


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conversation, its plan first: the turns that are left, in order."""
    conv, audit, at, state, pos, out = None, "", 0, 0, 0, []

    def inserts(out: list) -> None:
        nonlocal at, state, pos
        while at < len(audit) and audit[at] == "I":
            out.append((conv, pos, None, "I", ROLE[DUE[state]], ""))
            at, pos, state = at + 1, pos + 1, READ[DUE[state], state]

    def flush() -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out), kinds)], [f.split()[0] for f in TURN.split(", ")])

    for columns in arrow_rows(batches, "conv_id", "planned", "audit", "turn", "role", "text"):
        for c, planned, letters, turn, role, text in zip(*columns):
            if planned:
                conv, audit, at, state, pos = c, letters, 0, 0, 0
                if set(letters) <= {"I"}:
                    inserts(out)
                continue
            inserts(out)
            edit, at = audit[at], at + 1
            if edit == "D":
                pass
            elif edit == "K":
                out.append((conv, pos, turn, edit, role, text))
                state, pos = READ[role[0], state], pos + 1
            else:
                due = DUE[state]
                out.append((conv, pos, turn, edit, ROLE[due], text))
                state, pos = READ[due, state], pos + 1
            # the last inserts stand behind the last row's letter
            inserts(out)
        if out:
            yield flush()
            out.clear()


def repaired(chats: DataFrame, planned: DataFrame) -> DataFrame:
    """The turns after repair: conv_id, pos (from 0), turn (null if inserted), edit, role, text. ``planned`` as ``plans`` gives it.

    The rows of a conversation come one after the other in order, within one partition.
    """
    rows = _columns(chats).select("conv_id", F.lit(False).alias("planned"), F.lit(None).cast("string").alias("audit"), "turn", _key(), "role", "text")
    heads = planned.select("conv_id", F.lit(True), "audit", F.lit(None).cast("long"), F.lit(None).cast("binary"), F.lit(None).cast("string"), F.lit(None).cast("string"))
    order = [F.col("conv_id").asc_nulls_first(), F.col("planned").desc(), F.col("turn").asc_nulls_first(), F.col("key")]
    return rows.union(heads).repartition("conv_id").sortWithinPartitions(*order).mapInArrow(_apply, TURN)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, state, done = None, None, []
    flush = lambda: pa.RecordBatch.from_arrays([pa.array([c for c, _ in done], pa.int64()), pa.array([d for _, d in done], pa.string())], ["conv_id", "sha256"])
    for columns in arrow_rows(batches, "conv_id", "role", "text"):
        for conv, rows in groupby(zip(*columns), key=lambda r: r[0]):
            if state is None or conv != now:
                if state is not None:
                    done.append((now, state.hexdigest()))
                now, state, between = conv, hashlib.sha256(), b""
            for _, role, text in rows:
                state.update(between + f"{role}:{text}".encode("utf-8"))
                between = b"\n"
        if done:
            yield flush()
            done.clear()
    if state is not None:
        done.append((now, state.hexdigest()))
        yield flush()


def digests(turns: DataFrame) -> DataFrame:
    """conv_id, sha256 of ``role:text`` of its turns, joined by line feeds; ``turns`` straight from ``repaired``, in its order."""
    return turns.mapInArrow(_digests, "conv_id long, sha256 string")

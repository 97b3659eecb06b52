"""Secret scan: three base patterns, and a guess-cost search over values that stand in a credential's context.

The guess cost of a value is the least sum, over all ways of cutting it into pieces, of the pieces' costs in powers of
ten: common words by rank, dates, repeats, walks over the keyboard or the alphabet, and single characters that have to
be tried. It is found by dynamic programming over the value's length. A value that is expensive to guess is a secret
even where no base pattern knows its form; one made of words and dates is a placeholder. What is a word says a list of
at most 25,100: about 110 of passwords and placeholders, then ``words.txt``, 25,000 words and parts of words of 3 to 20
letters in the order in which the byte-pair vocabulary ``byte_bpe_50k`` learned them, which is about that of their use.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate
from math import log10
from pkgutil import get_data

import pyarrow as pa
from pyspark.sql import DataFrame

from auditlake.llm.common import arrow_rows, id_and_text

#: Base kinds in their order, each with the least length that counts (of the value for ``assign``, else of the match).
LEAST = {"assign": 6, "access": 20, "hex": 24}
KINDS = [*LEAST, "guess"]
#: A context's value counts from this length and this guess cost (a power of ten) on.
LEAST_VALUE, LEAST_COST = 8, 9.0

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
# A context word starts a word, also one that a change of case starts; longer names come first. What stands behind the
# match is the value. The separator is a sign, `` is`` with or without a sign, or (group ``bare``) a space alone.
CONTEXT = re.compile(
    r"""(?-i:(?<![A-Za-z])|(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z]))(?:(?:api|access|private|client|secret|account|auth)[\x20_-]?(?:key|secret|token)|pass(?:word|wd|phrase|code)?|pwd|secret|token|credentials?|auth(?:orization)?|bearer|login)[\]"']?(?:[\x20\t]*(?::=|=>|->|[:=])|[\x20\t]*\x20is(?:[\x20\t]*[:=]|\x20)|(?P<bare>[\x20\t]*\x20))[\x20\t]*["'`]?(?=[^\s"'`<>,;])""",
    re.I | re.A,
)
VALUE = re.compile(r"""[^\s"'`<>,;]+""", re.A)
_CONTEXT_SIGNS = ("pass", "pwd", "secret", "token", "credential", "key", "auth", "bearer", "login")
_ASSIGN_SIGNS = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: Common words of passwords and placeholders, by how early they are tried.
WORDS = """
password 123456 qwerty letmein welcome admin login abc123 monkey dragon master hello freedom whatever shadow sunshine princess football baseball
secret test user root pass guest changeme default example sample demo temp dummy value token key your my the and for this that with here
love money happy summer winter spring autumn monday friday january june july august december house home world office company computer
internet server system service access account private public service data base database mail email name word phrase code
""".split()
RANK = {w: i + 1 for i, w in reversed(list(enumerate([*WORDS, *get_data(__package__, "words.txt").decode().split()])))}
LONGEST = max(map(len, RANK))
LEET = str.maketrans({"@": "a", "4": "a", "0": "o", "1": "l", "3": "e", "5": "s", "7": "t", "$": "s", "!": "i"})
ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm")
DATE = re.compile(r"(?:19|20)\d\d[-./_]?(?:0[1-9]|1[0-2])[-./_]?(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])[-./_]?(?:0[1-9]|1[0-2])[-./_]?(?:19|20)\d\d|(?:19|20)\d\d", re.A)

BRUTE = 1.0
DATE_COST, YEAR_COST, WALK_COST = 4.6, 2.1, 1.6
PIECE_COST = 0.1


def _near() -> set[str]:
    """Pairs of characters that follow each other on a keyboard row, in a column of keys or in the alphabet, either way."""
    pairs = {a + b for row in (*ROWS, "abcdefghijklmnopqrstuvwxyz", "0123456789") for a, b in zip(row, row[1:])}
    pairs |= {a + b for upper, lower in zip(ROWS, ROWS[1:]) for a, b in zip(upper, lower)}
    return pairs | {p[::-1] for p in pairs}


NEAR = _near()


def _words(value: str, low: str, leet: str, start: int) -> Iterator[tuple[int, float, str]]:
    """(end, cost, kind) of the words and dates that start there."""
    for end in range(start + 3, min(len(value), start + LONGEST) + 1):
        word = plain = low[start:end]
        rank = RANK.get(word)
        if rank is None:
            plain = leet[start:end]
            rank = RANK.get(plain)
        if rank:
            changed = sum(c.isupper() for c in value[start:end]) + sum(a != b for a, b in zip(plain, word))
            yield end, log10(rank + 1) + 0.3 * changed, "word"
    m = DATE.match(value, start)
    if m:
        yield m.end(), YEAR_COST if m.end() - start == 4 else DATE_COST, "date"
        if m.end() - start > 4 and value[start : start + 2] in ("19", "20"):
            yield start + 4, YEAR_COST, "date"


def _pieces(value: str) -> Iterator[tuple[int, list[tuple[int, float, str]]]]:
    """For each start, from the last character to the first: (end, cost, kind) of its pieces other than a single character.

    Ends of walks and repeats follow from those one character on, so only one of each is kept, however long the value.
    """
    low = value.lower()
    leet, n = low.translate(LEET), len(value)
    sizes = range(1, min(8, n // 2) + 1)
    walk, same = n, [0] * (len(sizes) + 1)
    for start in range(n - 1, -1, -1):
        if not (start + 1 < n and low[start : start + 2] in NEAR):
            walk = start + 1
        out = list(_words(value, low, leet, start))
        if walk - start >= 3:
            out.append((walk, WALK_COST + log10(walk - start), "walk"))
        for size in sizes:
            same[size] = same[size] + 1 if start + size < n and value[start] == value[start + size] else 0
            length = size * (1 + same[size] // size)
            if length >= max(3, 2 * size):
                out.append((start + length, BRUTE * size + log10(length / size), "repeat"))
        yield start, out


def _costs(value: str, choice: list | None = None) -> array:
    """The least guess cost of the value from each of its characters on, eight bytes each; ``choice`` takes the piece that gives it."""
    best = array("d", bytes(8 * (len(value) + 1)))
    for start, pieces in _pieces(value):
        least, taken = BRUTE + best[start + 1], (start + 1, "brute")
        for end, cost, kind in pieces:
            cost += PIECE_COST + best[end]
            if cost < least:
                least, taken = cost, (end, kind)
        best[start] = least
        if choice is not None:
            choice[start] = taken
    return best


def segments(value: str) -> tuple[float, list[tuple[int, int, str]]]:
    """The least guess cost of a value and the pieces that give it; single characters in a row are one brute-force piece."""
    choice: list = [None] * len(value)
    cost, out, start = _costs(value, choice)[0], [], 0
    while start < len(value):
        end, kind = choice[start]
        if out and kind == "brute" == out[-1][2]:
            out[-1] = (out[-1][0], end, kind)
        else:
            out.append((start, end, kind))
        start = end
    return cost, out


#: Values up to this length are kept in the caches; of longer ones only the last.
KEPT_CHARS = 1000


@lru_cache(maxsize=16)
def _kept_costs(value: str) -> array:
    return _costs(value)


@lru_cache(maxsize=1)
def _last_costs(value: str) -> array:
    return _costs(value)


def suffix_costs(value: str) -> array:
    """The guess cost of the value from each of its characters on."""
    return _kept_costs(value) if len(value) <= KEPT_CHARS else _last_costs(value)


@lru_cache(maxsize=100_000)
def _kept_cost(value: str) -> float:
    return _costs(value)[0]


def guess_cost(value: str) -> float:
    return _kept_cost(value) if len(value) <= KEPT_CHARS else suffix_costs(value)[0]


def base_spans(text: str, low: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns, leftmost and not overlapping within a kind; ``low``: the text in lower case."""
    out = []
    if any(s in low for s in _ASSIGN_SIGNS):
        out += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        out += [(*m.span(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    return out + [(*m.span(), "hex") for m in HEX.finditer(text)]


def _guessed(text: str, taken: list[tuple[int, int]]) -> Iterator[tuple[int, int, str, float]]:
    """Values in a context that cost enough and that no span of ``taken`` (in order) holds whole.

    A value that is dropped may itself hold the next context, so the search goes on at its start; a value behind a bare
    space also gives way to a context with a sign in it, if what stands before that is cheap (``login my_token=...``).
    """
    begins, reach = [a for a, _ in taken], list(accumulate((b for _, b in taken), max))
    first = stop = end = 0
    m = CONTEXT.search(text)
    while m:
        start = m.end()
        if start >= stop:
            # not within the value that was looked at last
            first, stop = start, VALUE.match(text, start).end()
            end = stop
            while end > start and text[end - 1] in ".:!?)]}":
                end -= 1
        at = bisect_right(begins, start)
        held = at > 0 and reach[at - 1] >= end
        cost = (guess_cost(text[first:end]) if start == first else suffix_costs(text[first:end])[start - first]) if end - start >= LEAST_VALUE and not held else 0.0
        following = CONTEXT.search(text, start)
        inner = following and m["bare"] and following.start() < stop and not following["bare"]
        if cost >= LEAST_COST and not (inner and guess_cost(text[start : following.start()]) < LEAST_COST):
            yield start, end, "guess", cost
            following = CONTEXT.search(text, stop)
        m = following


def find(text: str) -> list[tuple[str, int, int, float | None]]:
    """All spans, (kind, start, end, guess cost) by start, then kind; base spans have no cost. A guessed value that a base span holds whole is not given again."""
    low = text.lower()
    out = base_spans(text, low)
    if any(s in low for s in _CONTEXT_SIGNS):
        out += _guessed(text, sorted((a, b) for a, b, _ in out))
    return [(s[2], s[0], s[1], s[3] if len(s) > 3 else None) for s in sorted(out, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))]


def scan(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``spans`` (array of struct(kind, start, end, cost)), in code points, end exclusive.

    A null text is empty and has no spans; a null ``doc_id`` stays; repeated rows stay; an empty table gives no rows.
    """
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("cost", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in arrow_rows(batches, "doc_id", "text"):
            found = [[dict(zip(("kind", "start", "end", "cost"), s)) for s in find(t)] for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, kind)], ["doc_id", "spans"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:long,end:long,cost:double>>")

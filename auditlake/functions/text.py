"""Text normalisers and predicates, Column -> Column."""

from __future__ import annotations

import json
import re
import unicodedata
from functools import lru_cache, reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from auditlake import constants as K


def let(c: Column, body) -> Column:
    """Evaluate ``c`` once and hand it to ``body``: keeps long expression chains small."""
    return F.transform(F.array(c), body)[0]


def strip(c: Column) -> Column:
    """Drop leading and trailing whitespace of any kind (``trim`` drops blanks only).

    A text that starts and ends with a printable ASCII character has none and is not searched.
    """
    def bare(x: Column) -> Column:
        return F.ascii(x).between(33, 126) & F.ascii(F.right(x, F.lit(1))).between(33, 126)

    return let(c, lambda x: F.when(bare(x), x).otherwise(F.regexp_replace(x, r"(?U)^\s+|\s+$", "")))


def is_null_alias(c: Column) -> Column:
    return F.coalesce(F.lower(strip(c)).isin(K.NULL_ALIASES), F.lit(True))


def is_empty(c: Column) -> Column:
    """Empty test for a string column; a blank string is one of the aliases."""
    return is_null_alias(c)


def _bare(ch: str) -> str:
    """Compatibility decomposition of a character without combining marks."""
    return "".join(x for x in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(x))


#: Hangul syllables decompose by rule: first of these, then how many vowels and finals each leading consonant has.
HANGUL_FIRST, HANGUL_LAST, HANGUL_VOWELS, HANGUL_FINALS = 0xAC00, 0xD7A3, 21, 28


@lru_cache(maxsize=1)
def decompositions() -> tuple[str, str, dict[str, str]]:
    """All planes, by rule: characters that become one other and what they become, with the combining marks to drop at the end of the
    former, and those that become several. Hangul syllables are left out."""
    source, target, marks, wide = [], [], [], {}
    for code in range(0x80, 0x110000):
        if 0xD800 <= code <= 0xDFFF or HANGUL_FIRST <= code <= HANGUL_LAST:
            continue
        ch = chr(code)
        base = _bare(ch)
        if base == ch:
            continue
        if not base:
            marks.append(ch)
        elif len(base) == 1:
            source.append(ch)
            target.append(base)
        else:
            wide[ch] = base
    return "".join(source + marks), "".join(target), wide


#: Ranges of a character class that stand behind one test of their hull.
RANGES_TOGETHER = 24


def _ranges(chars) -> str:
    """Contents of a character class that holds just ``chars``, none of them ASCII.

    A class tries its ranges one after the other, and most characters are in none of them. Neighbouring ranges are
    therefore put behind their hull, and all behind the end of ASCII: an ASCII character costs one test.
    """
    ranges: list[list[int]] = []
    for code in sorted(map(ord, chars)):
        if ranges and code == ranges[-1][1] + 1:
            ranges[-1][1] = code
        else:
            ranges.append([code, code])
    def one(a: int, b: int) -> str:
        return f"\\x{{{a:X}}}-\\x{{{b:X}}}"

    groups = [ranges[i:i + RANGES_TOGETHER] for i in range(0, len(ranges), RANGES_TOGETHER)]
    inside = "".join(f"[{one(g[0][0], g[-1][1])}&&[{''.join(one(a, b) for a, b in g)}]]" for g in groups)
    return f"[{one(0x80, 0x10FFFF)}&&[{inside}]]"


@lru_cache(maxsize=1)
def _wide_class() -> str:
    return _ranges([*decompositions()[2], *map(chr, range(HANGUL_FIRST, HANGUL_LAST + 1))])


def _hangul(syllable: Column) -> Column:
    """Jamo of a Hangul syllable."""
    def jamo(first: int, many: int, step: int) -> Column:
        forms = [_bare(chr(HANGUL_FIRST + i * step)) for i in range(many)]
        at = (F.ascii(syllable) - HANGUL_FIRST) / F.lit(step)
        return F.element_at(F.array(*[F.lit(f[first:first + 1]) for f in forms]), (F.floor(at) % many + 1).cast("int"))

    block = HANGUL_VOWELS * HANGUL_FINALS
    return F.concat(jamo(0, (HANGUL_LAST - HANGUL_FIRST + 1) // block, block), jamo(1, HANGUL_VOWELS, HANGUL_FINALS), jamo(2, HANGUL_FINALS, 1))


@lru_cache(maxsize=1)
def _uppers() -> tuple[str, str]:
    """Characters whose upper case is several characters, and the one character that each becomes instead (itself where there is none)."""
    source = [chr(code) for code in range(0x80, 0x110000) if not 0xD800 <= code <= 0xDFFF and len(chr(code).upper()) > 1]
    return "".join(source), "".join("\u1e9e" if ch == "\u00df" else ch.title() if len(ch.title()) == 1 else ch for ch in source)


def upper(c: Column) -> Column:
    """Upper case character by character, so that lower case leads back: ``upper`` makes SS of an eszett, this its capital."""
    source, target = _uppers()
    some = _ranges(source)
    pieces = F.regexp_extract_all(c, F.lit(f"([^{some}]+|[{some}])"), 1)
    each = F.array_join(F.transform(pieces, lambda p: F.when(p.rlike(f"^[{some}]"), F.translate(p, source, target)).otherwise(F.upper(p))), "")
    return F.when(c.rlike(f"[{some}]"), each).otherwise(F.upper(c))


def strip_accents(c: Column) -> Column:
    """Compatibility decomposition without combining marks, of every character of Unicode.

    Forms of one character go through one ``translate``. Those that become
    several (ligatures, fractions, Hangul …) are cut out of texts that hold one
    and looked up; what stands between them stays in one piece.
    """
    source, target, wide = decompositions()
    # one literal, folded to a map once
    pairs = F.from_json(F.lit(json.dumps(wide)), "map<string,string>")
    some = _wide_class()
    pieces = F.regexp_extract_all(c, F.lit(f"([^{some}]+|[{some}])"), 1)
    widened = F.array_join(
        F.transform(pieces, lambda p: F.when(p.rlike(f"^[\\x{{{HANGUL_FIRST:X}}}-\\x{{{HANGUL_LAST:X}}}]$"), _hangul(p)).otherwise(F.coalesce(F.try_element_at(pairs, p), p))), ""
    )
    plain = F.octet_length(c) == F.length(c)
    return F.when(plain, c).otherwise(F.translate(F.when(c.rlike(f"[{some}]"), widened).otherwise(c), source, target))


def fold(c: Column) -> Column:
    """Accent-free lower-case text with single blanks, for quote comparison."""
    # a single blank stands for itself; afterwards blanks are the only whitespace
    return F.trim(F.regexp_replace(F.lower(strip_accents(F.coalesce(c, F.lit("")))), r"(?U) \s+|[\s&&[^ ]]\s*", " "))


def tokenise(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"([\p{L}\p{N}_]+)"), 1)


def split_words(c: Column) -> Column:
    return F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")


#: What stands between words: punctuation and whitespace of any kind, as one class that needs no tables of Unicode.
_BETWEEN_WORDS = "[" + re.sub(r"([^\w\s])", r"\\\1", K.COMPARE_PUNCTUATION) + r"\t-\r \x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]+"


def content_words(c: Column) -> Column:
    """Distinct words without punctuation, stopwords and one-letter tokens."""
    words = F.split(F.lower(F.coalesce(c, F.lit(""))), _BETWEEN_WORDS)
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 2) & ~w.isin(K.STOPWORDS)))


def contains_any(lowered: Column, keywords: list[str]) -> Column:
    """Substring test of a keyword list against text that is already lower-case."""
    return reduce(or_, [F.contains(lowered, F.lit(k.lower())) for k in keywords])


def first_group(c: Column, pattern: str, group: int = 1) -> Column:
    """First match of a group, NULL when the pattern does not occur."""
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, group))


def list_markup(c: Column) -> Column:
    """List text to array: item tags, else bulleted lines, else the whole text."""
    items = F.regexp_extract_all(c, F.lit(r"(?s)<item>\s*(.*?)\s*</item>"), 1)
    tagged = F.filter(F.transform(items, strip), lambda x: x != "")
    lines = F.filter(F.transform(F.split(c, "\n"), strip), lambda x: x != "")
    bare = F.filter(
        F.transform(
            lines,
            lambda x: F.regexp_replace(
                F.regexp_replace(x, r"(?U)^[\-*•]\s+", ""), r"(?U)^\d+[.)]\s+", ""
            ),
        ),
        lambda x: x != "",
    )
    return (
        F.when(c.isNull(), F.array().cast("array<string>"))
        .when(F.size(items) > 0, tagged)
        .when(F.size(lines) > 1, bare)
        .otherwise(lines)
    )


def list_markup_array(c: Column) -> Column:
    """Array form of the same: trimmed, NULL and blank entries dropped."""
    return F.filter(F.transform(c, strip), lambda x: x.isNotNull() & (x != ""))

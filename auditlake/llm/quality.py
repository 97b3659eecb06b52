"""Quality rules as weak supervision. DataFrame functions only.

Each rule votes for a text (1), against it (-1) or abstains (0). The votes' patterns are counted over all documents;
there are at most 3^9 patterns however many documents there are, so this table is what expectation-maximisation runs
on. It estimates how often each rule is right and how common good texts are; the posterior probability of a good text
replaces the demand that every rule be passed. Two base rules reject a text whatever the others say.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.llm.common import packed, unpacked
from auditlake.session import materialise

WINDOW = 8
LEAST_WORDS = 20
MOST_REPEATED_PERCENT = 30
ROUNDS = 50
#: Where the estimates start, how far the share of good texts may go, and what is added to each count of votes.
START_ACCURACY, START_GOOD = 0.8, 0.8
LEAST_GOOD, MOST_GOOD = 0.05, 0.95
SMOOTHING = 1.0

RULES = ["length", "word_length", "symbols", "marks", "lines", "repeats", "letters", "stops", "variety"]
_SPACE = " \t\n\x0b\x0c\r"


def features(docs: DataFrame) -> DataFrame:
    """``docs`` with one more column, ``_f``: a struct of counts. A null text is empty; all counts of it are 0.

    ``_f`` and, as helpers, ``_w``, ``_k``, ``_o`` and ``_l`` are names of its own: give rows with columns of any name as
    ``packed`` makes them.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    bare = F.btrim(text, F.lit(_SPACE))
    # one row per document stays one row throughout; helper columns are in a struct of a name of their own
    step = docs.withColumn("_w", F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, "[\\x20\\x09-\\x0D]+")))
    word = F.col("_w")
    n = F.size(word)
    keys = F.when(n < WINDOW, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.get(word, i + k) for k in range(WINDOW)])))
    step = step.withColumn("_k", keys)
    key = F.col("_k")
    empty = F.array().cast("array<struct<k:bigint,i:int>>")
    ordered = F.when(F.size(key) == F.size(F.array_distinct(key)), empty).otherwise(F.sort_array(F.transform(key, lambda k, i: F.struct(k.alias("k"), i.alias("i")))))
    step = step.withColumn("_o", ordered)
    o = F.col("_o")
    twice = F.filter(o, lambda s, j: (s["k"] == F.get(o, j - 1)["k"]).eqNullSafe(True) | (s["k"] == F.get(o, j + 1)["k"]).eqNullSafe(True))
    begin = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    covered = F.aggregate(
        F.sort_array(F.transform(twice, lambda s: s["i"])), begin, lambda a, i: F.struct((a["n"] + i + WINDOW - F.greatest(a["end"], i)).alias("n"), (i + WINDOW).alias("end"))
    )["n"]
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(_SPACE)) != "")
    step = step.withColumn("_l", lines)
    line = F.col("_l")
    counts = {
        "n_words": n,
        "word_chars": F.char_length(F.array_join(word, "")),
        "n_symbols": F.regexp_count(text, F.lit("[#*$%&|<>]")),
        "n_dup_lines": F.size(line) - F.size(F.array_distinct(line)),
        "n_repeat_words": covered,
        "n_lines": F.size(line),
        "n_letters": F.regexp_count(text, F.lit("\\p{L}+")),
        "n_stops": F.regexp_count(text, F.lit("[.!?]")),
        "n_distinct": F.size(F.array_distinct(word)),
    }
    # exploded from an array of one, so that what reads the counts does not make them anew for each use
    one = F.explode(F.array(F.struct(*[c.cast("long").alias(k) for k, c in counts.items()])))
    return step.withColumn("_f", one).drop("_w", "_k", "_o", "_l")


def rules(f: Column) -> dict[str, Column]:
    """The rules' votes on a struct of counts: name to 1, -1 or 0. A text without words gets no vote but that on its length."""
    n = f["n_words"]
    vote = lambda good, bad: F.when(n == 0, 0).when(bad, -1).when(good, 1).otherwise(0)
    return {
        "length": F.when(n < LEAST_WORDS, -1).when(n >= 50, 1).otherwise(0),
        "word_length": vote((f["word_chars"] >= 3 * n) & (f["word_chars"] <= 9 * n), (f["word_chars"] < 2 * n) | (f["word_chars"] > 12 * n)),
        "symbols": vote(50 * f["n_symbols"] <= n, 10 * f["n_symbols"] > n),
        "marks": vote(100 * f["n_symbols"] <= f["word_chars"], 25 * f["n_symbols"] > f["word_chars"]),
        "lines": vote(f["n_dup_lines"] == 0, 10 * f["n_dup_lines"] > 3 * f["n_lines"]),
        "repeats": vote(20 * f["n_repeat_words"] <= n, 5 * f["n_repeat_words"] > n),
        "letters": vote(10 * f["n_letters"] >= 8 * n, 10 * f["n_letters"] < 5 * n),
        "stops": vote((60 * f["n_stops"] >= n) & (3 * f["n_stops"] <= n), (n >= 50) & ((f["n_stops"] == 0) | (2 * f["n_stops"] > n))),
        "variety": vote(10 * f["n_distinct"] >= 3 * n, (n >= 50) & (5 * f["n_distinct"] < n)),
    }


def votes(f: Column) -> Column:
    """The votes as one array, in the order of ``rules``."""
    return F.array(*[v.cast("int") for v in rules(f).values()])


def estimate(patterns: list[tuple[tuple[int, ...], int]], rounds: int = ROUNDS) -> tuple[float, list[dict[int, float]], list[dict[int, float]]]:
    """Expectation-maximisation over (votes, count): share of good texts and, for good and for bad texts, how likely each rule is to give each vote.

    A rule's accuracy is thus estimated apart for good and for bad texts: one that votes for most bad texts too says
    little when it votes for one and much when it votes against it. No pattern leaves the starting values. A rule never
    comes to mean its contrary: a vote for a text is not likelier in bad texts, nor one against it in good ones.
    """
    width = len(patterns[0][0]) if patterns else len(RULES)
    wrong = (1 - START_ACCURACY) / 2
    good, on_good, on_bad = START_GOOD, [{1: START_ACCURACY, 0: wrong, -1: wrong} for _ in range(width)], [{1: wrong, 0: wrong, -1: START_ACCURACY} for _ in range(width)]
    for _ in range(rounds if patterns else 0):
        sums = [[{v: SMOOTHING for v in (1, 0, -1)} for _ in range(width)] for _ in range(2)]
        sure, total = 0.0, 0
        for pattern, many in sorted(patterns):
            p = 1 / (1 + math.exp(-score(pattern, good, on_good, on_bad)))
            sure += many * p
            total += many
            for j, v in enumerate(pattern):
                sums[0][j][v] += many * p
                sums[1][j][v] += many * (1 - p)
        good = min(MOST_GOOD, max(LEAST_GOOD, sure / total))
        on_good, on_bad = ([{v: s / sum(x.values()) for v, s in x.items()} for x in side] for side in sums)
    return good, on_good, on_bad


def weights(good: list[dict[int, float]], bad: list[dict[int, float]]) -> list[dict[int, float]]:
    """What each vote of each rule adds to the log odds; abstaining adds nothing."""
    out = []
    for g, b in zip(good, bad):
        out.append({1: max(0.0, math.log(g[1] / b[1])), 0: 0.0, -1: min(0.0, math.log(g[-1] / b[-1]))})
    return out


def score(pattern: tuple[int, ...], good: float, on_good: list[dict[int, float]], on_bad: list[dict[int, float]]) -> float:
    """Log odds that a text with these votes is good."""
    return math.log(good / (1 - good)) + sum(w[v] for w, v in zip(weights(on_good, on_bad), pattern))


def _base_failed(f: Column) -> Column:
    return (f["n_words"] < LEAST_WORDS) | (100 * f["n_repeat_words"] > MOST_REPEATED_PERCENT * f["n_words"])


def fit(judged: DataFrame) -> tuple[float, list[dict[int, float]], list[dict[int, float]]]:
    """The estimates for all rows of a table with ``_f`` that pass the base rules (the others are decided already); what comes to the driver is one row for each pattern of votes, 3^9 at most."""
    counts = judged.where(~_base_failed(F.col("_f"))).groupBy(votes(F.col("_f")).alias("votes")).count().collect()
    return estimate([(tuple(r["votes"]), r["count"]) for r in counts])


def verdicts(judged: DataFrame, model: tuple[float, list[dict[int, float]], list[dict[int, float]]]) -> DataFrame:
    """A table with ``_f`` and three more columns: ``_base_failed``, ``_quality`` (posterior) and ``_kept``."""
    good, on_good, on_bad = model
    f = F.col("_f")
    odds = F.lit(math.log(good / (1 - good)))
    for vote, w in zip(rules(f).values(), weights(on_good, on_bad)):
        odds = odds + F.when(vote > 0, w[1]).when(vote < 0, w[-1]).otherwise(0.0)
    return judged.withColumn("_base_failed", _base_failed(f)).withColumn("_quality", 1 / (1 + F.exp(-odds))).withColumn("_kept", ~F.col("_base_failed") & (F.col("_quality") >= 0.5))


def filter_docs(docs: DataFrame) -> DataFrame:
    """``docs`` without the texts that the verdict rejects; columns as before, whatever their names. The estimates are made from all rows first.

    The counts are written beside the rows, so that they are made once for the estimates and for the verdicts.
    """
    counted = materialise(features(packed(docs).select("row", "text")).drop("text"), "counted")
    return unpacked(verdicts(counted, fit(counted)).where("_kept"), docs.columns)

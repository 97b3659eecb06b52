"""Name joins that never compare all pairs.

Substring containment: if one string contains the other, it holds every
fragment of it.  Each short name is therefore looked up by one fragment only,
the one that the fewest names on the other side hold, and only those
candidates are verified.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from auditlake.session import materialise

FRAGMENT = 4
#: Of the words that two sets must share, one in so many is counted among the rare ones before the sets are compared.
RARE_SHARE = 3


def fragments(c: Column, size: int = FRAGMENT) -> Column:
    """Distinct substrings of ``size`` characters; a shorter text is its own fragment."""
    return F.array_distinct(
        F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - (size - 1), F.lit(1))), lambda i: c.substr(i, F.lit(size)))
    )


def _short_pieces(c: Column, size: int, lengths: Column) -> Column:
    """All pieces shorter than a fragment, of the lengths that very short names have."""
    return F.flatten(F.array(*[F.when(F.array_contains(lengths, n), fragments(c, n)).otherwise(F.array().cast("array<string>")) for n in range(1, size)]))


def _contained_in(needles: DataFrame, hay: DataFrame, needle: str, straw: str, scope: list[str], size: int) -> DataFrame:
    """(scope, needle, straw) where the needle is a substring of the straw.

    Straws are cut into fragments, and into shorter pieces only of lengths that some needle has. Of all pieces only those
    that a needle holds are kept, before they are counted or joined.
    """
    asked = needles.select(*scope, needle, F.explode(fragments(F.col(needle), size)).alias("_piece"))
    wanted = asked.select(*scope, "_piece").distinct()
    # at most ``size`` - 1 lengths; null where no needle is short
    lengths = needles.filter(F.length(needle) < size).agg(F.collect_set(F.length(needle))).scalar()
    pieces = F.concat(fragments(F.col(straw), size), _short_pieces(F.col(straw), size, lengths))
    postings = hay.select(*scope, straw, F.explode(F.array_distinct(pieces)).alias("_piece")).join(wanted, scope + ["_piece"], "left_semi")
    freq = postings.groupBy(*scope, "_piece").agg(F.count(F.lit(1)).alias("_n"))
    # a needle holding a piece that no straw holds is in none; else the rarest piece leads to all that may hold it
    probe = asked.join(freq, scope + ["_piece"], "left").groupBy(*scope, needle).agg(
        F.min(F.coalesce(F.col("_n"), F.lit(0))).alias("_least"),
        F.min_by("_piece", F.struct(F.coalesce(F.col("_n"), F.lit(0)), F.col("_piece"))).alias("_piece"),
    ).filter(F.col("_least") > 0).drop("_least")
    return (
        probe.join(postings, scope + ["_piece"])
        .filter(F.contains(F.col(straw), F.col(needle)))
        .select(*scope, needle, straw)
    )


def substring_lookup(needles: DataFrame, hay: DataFrame, needle: str, straw: str, scope: list[str] | None = None, size: int = FRAGMENT) -> DataFrame:
    """Distinct (scope, needle, straw) where the needle occurs in the straw; one direction only."""
    return _contained_in(needles.filter(F.col(needle) != ""), hay.filter(F.col(straw) != ""), needle, straw, scope or [], size).distinct()


def contains_join(left: DataFrame, right: DataFrame, a: str, b: str, scope: list[str] | None = None, size: int = FRAGMENT) -> DataFrame:
    """Distinct (scope, a, b) where one name contains the other.  Inputs must be distinct, non-empty names."""
    scope = scope or []
    left = left.select(*scope, a).filter(F.col(a) != "")
    right = right.select(*scope, b).filter(F.col(b) != "")
    forward = _contained_in(left, right, a, b, scope, size)
    backward = _contained_in(right, left, b, a, scope, size)
    return forward.unionByName(backward).distinct()


def share_at_least(left: DataFrame, right: DataFrame, a: str, b: str, ratio: float, scope: list[str] | None = None,
                   of_larger: bool = False) -> DataFrame:
    """(scope, id of a, id of b, n_shared) whose token sets overlap by ``ratio``.

    ``left`` and ``right`` hold (scope, id column, ``tokens`` array of distinct
    words).  The overlap counts against the left set, or against the larger set.
    A set that must share ``m`` of its ``n`` tokens shares at least one of any
    ``n - m + 1``; taking the rarest ones keeps the candidate join small.
    """
    scope = scope or []
    lt = left.select(*scope, a, F.size("tokens").alias("_na"), F.explode("tokens").alias("_w"))
    rt = right.select(*scope, b, F.size("tokens").alias("_nb"), F.explode("tokens").alias("_w"))
    freq = rt.groupBy(*scope, "_w").agg(F.count(F.lit(1)).alias("_f"))
    ranked = lt.join(freq, scope + ["_w"], "left").withColumn(
        "_rank", F.row_number().over(Window.partitionBy(*scope, a).orderBy(F.coalesce(F.col("_f"), F.lit(0)), "_w"))
    )
    need = F.ceil(F.col("_na") * F.lit(ratio) - F.lit(1e-9))
    prefix = ranked.filter((F.col("_rank") <= F.col("_na") - need + 1) & F.col("_f").isNotNull()).select(*scope, a, "_na", "_w")
    size_ok = (F.col("_nb") >= F.col("_na") * F.lit(ratio) - F.lit(1e-9)) & (
        (F.col("_na") >= F.col("_nb") * F.lit(ratio) - F.lit(1e-9)) if of_larger else F.lit(True))
    pairs = prefix.join(rt, scope + ["_w"]).filter(size_ok).select(*scope, a, b, "_na", "_nb").distinct()
    overlap = (
        pairs.join(lt.select(*scope, a, "_w"), scope + [a])
        .join(rt.select(*scope, b, "_w"), scope + [b, "_w"])
        .groupBy(*scope, a, b, "_na", "_nb").agg(F.count(F.lit(1)).alias("n_shared"))
    )
    base = F.greatest(F.col("_na"), F.col("_nb")) if of_larger else F.col("_na")
    return overlap.filter(F.col("n_shared") / base >= ratio).select(*scope, a, b, "n_shared", F.col("_na").alias("n_left"), F.col("_nb").alias("n_right"))


def covered_at_least(left: DataFrame, right: DataFrame, a: str, b: str, ratio: float, scope: list[str] | None = None) -> DataFrame:
    """Distinct (scope, id of a) of the ``left`` sets that have ``ratio`` of their words in one set of ``right``.

    Inputs as for ``share_at_least``. Of the rarest ``n - m + k`` of its ``n``
    words a set that must share ``m`` shares ``k``: these are counted, the more
    frequent ones only looked at in the pairs that are left. Rare words and
    pairs are written, so that few of them are broadcast and ``right`` is not shuffled.
    """
    scope = scope or []
    lt = left.select(*scope, a, F.size("tokens").alias("_na"), F.explode("tokens").alias("_w"))
    wanted = lt.select(*scope, "_w").distinct()
    freq = right.select(*scope, F.explode("tokens").alias("_w")).join(wanted, scope + ["_w"], "left_semi").groupBy(*scope, "_w").agg(F.count(F.lit(1)).alias("_f"))
    ranked = lt.join(freq, scope + ["_w"], "left").withColumn(
        "_rank", F.row_number().over(Window.partitionBy(*scope, a).orderBy(F.coalesce(F.col("_f"), F.lit(0)), "_w")))
    need = F.ceil(F.col("_na") * F.lit(ratio) - F.lit(1e-9))
    least = F.ceil(need / RARE_SHARE)
    rare = ranked.select(*scope, a, "_w", "_f", "_rank", "_na", need.alias("_need"), least.alias("_least")).filter(
        (F.col("_rank") <= F.col("_na") - F.col("_need") + F.col("_least")) & F.col("_f").isNotNull()).select(*scope, a, "_w", "_need", "_least")
    rare = materialise(rare, "rare-words")
    counted = right.select(*scope, b, F.size("tokens").alias("_nb"), F.explode("tokens").alias("_w")).join(rare, scope + ["_w"]).filter(F.col("_nb") >= F.col("_need"))
    pairs = counted.groupBy(*scope, a, b, "_least").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= F.col("_least")).select(*scope, a, b)
    pairs = materialise(pairs, "pairs")
    both = right.select(*scope, b, "tokens").join(pairs, scope + [b]).join(left.select(*scope, a, F.col("tokens").alias("_mine")), scope + [a])
    return both.filter(F.size(F.array_intersect("_mine", "tokens")) / F.size("_mine") >= ratio).select(*scope, a).distinct()

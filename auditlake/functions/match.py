"""Name and identifier matching predicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from auditlake import constants as K
from auditlake.functions.text import split_words


def tax_id_valid(c: Column) -> Column:
    """TRUE / FALSE for an 11-digit tax id by its check digit, NULL for other shapes."""
    digits = F.translate(c, "- ", "")
    total = sum(
        (F.substring(digits, i + 1, 1).cast("int") * w for i, w in enumerate(K.TAX_ID_WEIGHTS)), F.lit(0)
    )
    return F.when(
        digits.rlike(r"^\d{11}$"), (10 - total % 10) % 10 == F.substring(digits, 8, 1).cast("int")
    )


def name_contains(a: Column, b: Column) -> Column:
    """Case-insensitive substring either way; an empty or missing name never matches."""
    la, lb = F.lower(a), F.lower(b)
    return F.coalesce((a != "") & (b != "") & (F.contains(la, lb) | F.contains(lb, la)), F.lit(False))


def words_alike(wa: Column, wb: Column, overlap: float = 0.8) -> Column:
    """Enough shared words and no digit in any word that differs; both sides hold distinct words."""
    shared = F.size(F.array_intersect(wa, wb))
    different = F.concat(F.array_except(wa, wb), F.array_except(wb, wa))
    return (
        (F.size(wa) > 0)
        & (F.size(wb) > 0)
        & (shared / F.greatest(F.size(wa), F.size(wb)) >= overlap)
        & ~F.exists(different, lambda w: w.rlike(r"\p{Nd}"))
    )


def names_alike(a: Column, b: Column, overlap: float = 0.8) -> Column:
    """Equal, or enough shared words and no digit in any word that differs."""
    similar = words_alike(F.array_distinct(split_words(a)), F.array_distinct(split_words(b)), overlap)
    return F.coalesce((a != "") & (b != "") & ((a == b) | similar), F.lit(False))

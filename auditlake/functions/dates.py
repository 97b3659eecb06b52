"""Date normalisers; dates stay ISO strings unless day arithmetic is needed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from auditlake.functions.text import is_null_alias, let, strip

_YEAR_FIRST = r"^(\d{4})(-|/|\.)(\d{1,2})\2(\d{1,2})\.?$"
_DAY_FIRST = r"^(\d{1,2})(/|\.)(\d{1,2})\2(\d{4})\.?$"


def parse_date(c: Column) -> Column:
    """Calendar date of a ten-character prefix in one of seven layouts, else NULL.

    A closing dot is allowed only where dots separate the parts.
    """

    def to_iso(s: Column) -> Column:
        def part(pattern: str, i: int) -> Column:
            return F.regexp_extract(s, pattern, i)

        def fits(pattern: str) -> Column:
            return s.rlike(pattern) & ~(s.endswith(".") & (part(pattern, 2) != "."))

        return F.when(
            fits(_YEAR_FIRST),
            F.concat_ws("-", part(_YEAR_FIRST, 1), part(_YEAR_FIRST, 3), part(_YEAR_FIRST, 4)),
        ).when(
            fits(_DAY_FIRST),
            F.concat_ws("-", part(_DAY_FIRST, 4), part(_DAY_FIRST, 3), part(_DAY_FIRST, 1)),
        )

    return F.when(~is_null_alias(c), let(F.substring(strip(c), 1, 10), to_iso).try_cast("date"))


def iso_prefix_date(c: Column) -> Column:
    """Strict form: at least ten characters, the first ten an ISO date."""
    head = F.substring(c, 1, 10)
    return F.when(head.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$") & (F.length(c) >= 10), head.try_cast("date"))


def iso_lenient_date(c: Column) -> Column:
    """The first ten characters as an ISO date, whose month and day may have one digit."""
    head = F.substring(c, 1, 10)
    return F.when(head.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), head.try_cast("date"))


def iso_parts(year: Column, month: Column, day: Column) -> Column:
    """Zero-padded ISO text without a calendar check (29 February stays)."""
    return F.concat_ws("-", F.lpad(year, 4, "0"), F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))


def expiring_soon(c: Column, asof: Column, months: int = 12) -> Column:
    """Calendar-month distance from ``asof`` within [0, months]; the day is ignored."""
    d = parse_date(c)
    gap = (F.year(d) - F.year(asof)) * 12 + F.month(d) - F.month(asof)
    return F.coalesce(gap.between(0, months), F.lit(False))

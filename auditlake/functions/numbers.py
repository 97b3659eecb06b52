"""Number normalisers and amount predicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from auditlake import constants as K
from auditlake.functions.text import is_null_alias, let, strip

_PLAIN = r"^\d+(\.\d+)?\z"
_FLOAT = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def _to_double(s: Column) -> Column:
    """Cast guarded by shape: ``12d`` is no number, ``inf`` and ``nan`` are."""
    return (
        F.when(s.rlike(_FLOAT), s.try_cast("double"))
        .when(s.rlike(r"(?i)^\+?inf(inity)?$"), F.lit(float("inf")))
        .when(s.rlike(r"(?i)^-inf(inity)?$"), F.lit(float("-inf")))
        .when(s.rlike(r"(?i)^[+-]?nan$"), F.lit(float("nan")))
    )


def _separators(s: Column) -> Column:
    """Rewrite thousands and decimal separators to plain decimal notation."""
    has_dot, has_comma = F.contains(s, F.lit(".")), F.contains(s, F.lit(","))
    dot_last = F.regexp_extract(s, r"([.,])[^.,]*$", 1) == "."
    keep_last_dot = F.regexp_replace(s, r"\.(?=.*\.)", "")
    keep_last_comma = F.replace(F.regexp_replace(s, r",(?=.*,)", ""), F.lit(","), F.lit("."))
    no_commas = F.replace(s, F.lit(","), F.lit(""))
    european = F.replace(F.replace(s, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    return (
        F.when(has_dot & has_comma, F.when(dot_last, no_commas).otherwise(european))
        .when(has_comma, F.when(s.rlike(r",[^,]{1,2}$"), keep_last_comma).otherwise(no_commas))
        .otherwise(keep_last_dot)
    )


def coerce_number(c: Column) -> Column:
    """Tolerant text-to-number with currency marks, parentheses and separators; plain decimals are read as they are."""
    return let(c, lambda x: F.when(x.rlike(_PLAIN), x.try_cast("double")).otherwise(_tolerant(x)))


def _tolerant(c: Column) -> Column:
    bare = strip(F.regexp_replace(strip(F.regexp_replace(c, K.CURRENCY_SUFFIX, "")), K.CURRENCY_PREFIX, ""))
    signed = let(
        bare,
        lambda b: F.when(
            b.rlike(r"(?s)^\(.*\)$|^\($"), F.concat(F.lit("-"), F.regexp_replace(b, r"^\(|\)$", ""))
        ).otherwise(b),
    )
    return F.when(~is_null_alias(c), _decimal(F.regexp_replace(signed, r" |(?<=\d)_(?=\d)", "")))


def parse_money(c: Column) -> Column:
    """Separator rules only: no currency, parentheses or null aliases."""
    return _decimal(F.regexp_replace(strip(c), r" |(?<=\d)_(?=\d)", ""))


def _decimal(compact: Column) -> Column:
    return let(let(compact, _separators), _to_double)


def is_round(x: Column, above: float = K.ROUNDED_MIN_AMOUNT, step: float = K.ROUNDED_STEP) -> Column:
    return (F.abs(x) > above) & (F.abs(x) % F.lit(float(step)) == 0)


def money(x: Column) -> Column:
    """Exact type for sums, so that totals do not depend on row order."""
    return x.cast("decimal(18,2)")


def whole(x: Column) -> Column:
    """Thousands-separated whole number, half to even."""
    return F.format_number(x, 0)


def plain_whole(x: Column) -> Column:
    return F.replace(F.format_number(x, 0), F.lit(","), F.lit(""))


def general(x: Column) -> Column:
    """Shortest plain form of a number (``5`` for 5.0), six significant digits."""
    rounded = F.round(x, 6)
    return F.when((x == F.floor(x)) & (F.abs(x) < 1e6), x.cast("bigint").cast("string")).when(
        (rounded == F.floor(rounded)) & (F.abs(rounded) < 1e6), rounded.cast("bigint").cast("string")
    ).otherwise(F.regexp_replace(F.format_string("%.6g", x), r"(\.\d*?)0+$|\.$", "$1"))


def amount_tier(a: Column, b: Column, tolerance_pct: float = 0.01) -> Column:
    """ok / warning / critical for two amounts; NULL where no comparison applies."""
    diff = F.abs(a - b)
    pct = diff / F.greatest(F.abs(a), F.abs(b)) * 100
    return F.when(
        a.isNotNull() & b.isNotNull() & ~((a == 0) & (b == 0)),
        F.when(diff <= 1, F.lit("ok"))
        .when(pct <= tolerance_pct * 100, F.lit("ok"))
        .when(pct <= 5, F.lit("warning"))
        .otherwise(F.lit("critical")),
    )

"""Lookups of fixed labels, scores and severities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from auditlake import constants as K


def lookup(table: dict, key: Column, default) -> Column:
    """Small fixed table as a literal map."""
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, key), default if isinstance(default, Column) else F.lit(default))


def severity(c: Column) -> Column:
    return lookup(K.SEVERITY_MAP, F.lower(c), c)


def severity_bucket(c: Column) -> Column:
    """high / medium / low / info; anything else counts as low."""
    s = F.lower(c)
    return F.when(s.isin("high", "medium", "low", "info"), s).otherwise(F.lit("low"))


def evidence_score(doc_type: Column) -> Column:
    return lookup(K.EVIDENCE_SCORES, doc_type, 3)


def manual_minutes(doc_type: Column) -> Column:
    return lookup(K.MANUAL_MINUTES, doc_type, 15)


def doc_label(doc_type: Column) -> Column:
    return lookup(K.DOC_LABELS, doc_type, "Other")


def display_label(label: Column, doc_type: Column) -> Column:
    """A known label stays; an unknown one becomes the label of the type."""
    return F.when(label.isin(list(K.DOC_LABELS.values())), label).otherwise(doc_label(doc_type))


def known_type(doc_type: Column) -> Column:
    return F.when(doc_type.isin(list(K.DOC_LABELS)), doc_type).otherwise(F.lit("other"))


def confidence_label(c: Column) -> Column:
    return F.when(c > 0.8, F.lit("confident")).otherwise(F.lit("uncertain"))


def confidence_fields(confidence: Column, level: str) -> Column:
    """Field names whose confidence is ``level``, sorted."""
    return F.array_sort(F.map_keys(F.map_filter(confidence, lambda _, v: v == level)))

"""Severity and confidence: parsing, order, and the grade of an advisory."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from scanloom.functions.lam import let, lookup
from scanloom.schema import CONFIDENCES, SEVERITIES

# Accepted spellings.
SEVERITY_ALIASES = {**{s: s for s in SEVERITIES}, "med": "medium", "crit": "critical"}
CONFIDENCE_ALIASES = {**{c: c for c in CONFIDENCES}, "med": "medium"}


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def severity_name(text: str) -> str | None:
    """Driver-side parse used by validation."""
    return SEVERITY_ALIASES.get(text.strip().lower())


def confidence_name(text: str) -> str | None:
    return CONFIDENCE_ALIASES.get(text.strip().lower())


def parse_severity(value) -> Column:
    return lookup(SEVERITY_ALIASES, F.lower(F.trim(_col(value))))


def parse_confidence(value) -> Column:
    return lookup(CONFIDENCE_ALIASES, F.lower(F.trim(_col(value))))


def severity_ord(value) -> Column:
    """0 (info) to 4 (critical); null for an unknown name."""
    return lookup({s: i for i, s in enumerate(SEVERITIES)}, _col(value), "int")


def confidence_ord(value) -> Column:
    return lookup({c: i for i, c in enumerate(CONFIDENCES)}, _col(value), "int")


def document_level(severity) -> Column:
    """Level of a result document: error, warning or note."""
    s = _col(severity)
    return F.when(s.isin("critical", "high"), "error").when(s == "medium", "warning").otherwise("note")


def annotation_level(severity) -> Column:
    s = _col(severity)
    return F.when(s.isin("critical", "high"), "error").when(s == "medium", "warning").otherwise("notice")


def cvss_score(vector) -> Column:
    """Base score: the first ``BS:`` part if it is a number, else the whole text if it is."""
    v = _col(vector)
    part = F.get(F.filter(F.split(v, "/"), lambda s: F.startswith(s, F.lit("BS:"))), F.lit(0))
    return F.coalesce(
        F.substring(part, 4, 1 << 30).try_cast("double"),
        v.try_cast("double"),
    )


def advisory_severity(entries, rating) -> Column:
    """Grade of an advisory: first CVSS v3/v4 entry, else its textual rating, else medium."""
    first = F.get(F.filter(_col(entries), lambda e: F.upper(e["type"]).isin("CVSS_V3", "CVSS_V4")), F.lit(0))
    return let(
        F.struct(cvss_score(first["score"]).alias("score"), F.upper(_col(rating)).alias("rating")),
        lambda x: F.when(x["score"] >= 9.0, "critical").when(x["score"] >= 7.0, "high")
        .when(x["score"] >= 4.0, "medium").when(x["score"].isNotNull(), "low")
        .when(x["rating"] == "CRITICAL", "critical").when(x["rating"] == "HIGH", "high")
        .when(x["rating"] == "LOW", "low").otherwise("medium"),
    )

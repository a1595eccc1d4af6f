"""Text columns: entropy, binary test, message building, escapes, quoted strings, tags."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from scanloom.functions.lam import let


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def char_count(text, ch: str) -> Column:
    """Occurrences of a one-byte character."""
    t = _col(text)
    return F.octet_length(t) - F.octet_length(F.replace(t, F.lit(ch), F.lit("")))


def shannon_entropy(text) -> Column:
    """Bits per character; 0 for the empty string, null for null."""
    t = _col(text)
    n = F.char_length(t).cast("double")

    def term(ch: Column) -> Column:
        # Characters are counted by length difference, so one pass per distinct one.
        share = (F.char_length(t) - F.char_length(F.replace(t, ch, F.lit("")))) / n
        return -share * F.log2(share)

    return F.when(t.isNull(), F.lit(None).cast("double")).when(F.char_length(t) == 0, F.lit(0.0)).otherwise(
        F.aggregate(F.array_distinct(F.split(t, "")), F.lit(0.0), lambda acc, ch: acc + F.when(ch == "", F.lit(0.0)).otherwise(term(ch)))
    )


def is_binary(content) -> Column:
    """More than one NUL per hundred bytes (integer arithmetic)."""
    size = F.octet_length(_col(content))
    # Read as text the bytes stay as they are, and a NUL is never part of another character.
    nul = char_count(_col(content).cast("string"), "\0").cast("long")
    return F.when(size == 0, F.lit(False)).otherwise(F.floor(nul * 100 / size) > 1)


def call_site(match) -> Column:
    """Readable call site: trailing separators and one parenthesis go, balance is restored."""
    cut = F.regexp_replace(F.regexp_replace(_col(match), r"[, \t]+$", ""), r"\)$", "")
    return let(cut, lambda c: F.concat(
        c, F.repeat(F.lit(")"), F.greatest(char_count(c, "(") - char_count(c, ")"), F.lit(0)))
    ))


def trimmed(match) -> Column:
    return F.regexp_replace(_col(match), r"^\s+|\s+$", "")


def clipped(match, width: int = 80) -> Column:
    """Trimmed match, cut to ``width`` with an ellipsis; for display only."""
    t = trimmed(match)
    return F.when(F.char_length(t) > width, F.concat(F.substring(t, 1, width), F.lit("..."))).otherwise(t)


def display_snippet(match, width: int = 120) -> Column:
    """First line of a match for display; longer than ``width`` characters it ends in an ellipsis."""
    t = F.regexp_extract(_col(match), r"^([^\r\n]*)", 1)
    return F.when(
        F.char_length(t) > width, F.concat(F.substring(t, 1, width - 3), F.lit("..."))
    ).otherwise(t)


def _escape(value, pairs) -> Column:
    out = _col(value)
    for raw, code in pairs:
        out = F.replace(out, F.lit(raw), F.lit(code))
    return out


# Escapes of workflow-command data and properties.
_DATA = (("%", "%25"), ("\r", "%0D"), ("\n", "%0A"))
_PROPERTY = _DATA + ((":", "%3A"), (",", "%2C"))


def annotation_data(value) -> Column:
    return _escape(value, _DATA)


def annotation_property(value) -> Column:
    return _escape(value, _PROPERTY)


def quoted_strings(line) -> Column:
    """Double-quoted strings of a line in order, backslash escapes resolved.

    The two quantifiers are possessive: neither can match what the other does,
    so nothing is lost and the matcher never recurses.
    """
    raw = F.regexp_extract_all(_col(line), F.lit(r'(?s)"([^"\\]*+(?:\\.[^"\\]*+)*+)"'), F.lit(1))
    return F.transform(raw, lambda s: F.regexp_replace(s, r"(?s)\\(.)", "$1"))


def strip_xml_comments(text) -> Column:
    """Drop comments; an unclosed one runs to the end."""
    closed = F.regexp_replace(_col(text), r"(?s)<!--.*?-->", "")
    return F.regexp_replace(closed, r"(?s)<!--.*$", "")


def tag_text(block, tag: str) -> Column:
    """Trimmed text of the first ``<tag>``; null when missing or blank."""
    text = F.regexp_extract(_col(block), rf"(?s)<{tag}>(.*?)</{tag}>", 1)
    return F.nullif(F.regexp_replace(text, r"^\s+|\s+$", ""), F.lit(""))

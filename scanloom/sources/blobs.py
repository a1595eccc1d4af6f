"""Secrets in containers: members of archives and image layers, given as a table."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

from scanloom.functions.text import is_binary
from scanloom.operators.scan import scan_texts
from scanloom.rules import Rule
from scanloom.rules.catalogue import secret_rules
from scanloom.schema import FINDING_COLUMNS

# Names of nested archives; their members are rows of their own.
INNER_ARCHIVE = r"(?:/layer\.tar|\.tar|\.tar\.gz|\.tgz)$"


def _is_archive(entry: Column) -> Column:
    return F.rlike(F.lower(entry), F.lit(INNER_ARCHIVE))


def _status(max_bytes: int | None, max_depth: int | None) -> Column:
    """What happens to an entry; later tests assume the earlier ones passed. Bounds only where asked for."""
    never = F.lit(False)
    return (
        F.when(never if max_depth is None else F.col("depth") > max_depth, "too_deep")
        .when(_is_archive(F.col("entry")), "archive")
        .when(never if max_bytes is None else F.col("size") > max_bytes, "too_large")
        .when(is_binary("bytes"), "binary")
        .when(~F.is_valid_utf8(F.col("bytes").cast("string")), "binary")
        .otherwise("scanned")
    )


def scan_blobs(blobs: DataFrame, rules: Iterable[Rule] | None = None, max_bytes: int | None = None,
               max_depth: int | None = None) -> DataFrame:
    """Findings at ``container::entry`` with the entry named in the message."""
    rules = list(rules) if rules is not None else secret_rules(kinds=("other",))
    texts = blobs.filter(_status(max_bytes, max_depth) == "scanned")
    named = texts.select(
        "entry", F.concat("container", F.lit("::"), "entry").alias("path"), F.col("bytes").cast("string").alias("content"))
    found = scan_texts(named, rules, carry=("entry",))
    message = F.concat("message", F.lit(" (in image layer "), "entry", F.lit(")"))
    return found.withColumn("message", message).select(*FINDING_COLUMNS)


def blob_stats(blobs: DataFrame, max_bytes: int | None = None, max_depth: int | None = None) -> DataFrame:
    """One row: archives with nested archives, members scanned, members skipped by reason."""
    marked = blobs.select("container", _status(max_bytes, max_depth).alias("status"))
    counts = marked.agg(
        F.count_if(F.col("status") == "scanned").alias("files_scanned"),
        F.count_if(F.col("status") == "too_large").alias("files_skipped_too_large"),
        F.count_if(F.col("status") == "binary").alias("files_skipped_binary"),
        F.count_distinct(F.when(F.col("status") == "archive", F.col("container"))).alias("layers_scanned"),
    )
    return counts.select("layers_scanned", "files_scanned", "files_skipped_too_large", "files_skipped_binary")

"""Inline directives: parse them from file text and apply them to findings."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from scanloom.functions.lam import let
from scanloom.rules.catalogue import known_prefixes

DIRECTIVE = "scan-ignore"
MIN_TOKEN = 7


def directives_of(content: Column, name: str = DIRECTIVE, prefixes=None) -> Column:
    """Array of (line, code) of one text; null line for the whole file, empty for most texts."""
    prefixes = known_prefixes() if prefixes is None else tuple(prefixes)
    pattern = F.lit(rf"(?d){name}(?:-(line|file))?\s*:\s*([^/\n]*)")

    token = F.lit(rf"^(?:{'|'.join(map(re.escape, prefixes))})[A-Z0-9_-]*$")

    def valid(code: Column) -> Column:
        return (code == "*") | ((F.char_length(code) >= MIN_TOKEN) & F.rlike(code, token))

    def of_line(text: Column, index: Column) -> Column:
        def marks(suffix: Column, codes: Column) -> Column:
            line = F.when(suffix == "line", index + 1).when(suffix == "", index + 2)
            return F.transform(
                F.filter(F.split(codes, r"[,\s]+"), valid),
                lambda code: F.struct(line.cast("int").alias("line"), code.alias("code")))

        found = F.zip_with(
            F.regexp_extract_all(text, pattern, F.lit(1)), F.regexp_extract_all(text, pattern, F.lit(2)), marks)
        return F.when(F.contains(text, F.lit(name)), F.flatten(found))

    # Texts without the word are not cut into lines.
    return F.when(
        F.contains(content, F.lit(name)),
        F.flatten(F.filter(F.transform(F.split(content, "\n"), of_line), lambda x: x.isNotNull())),
    )


def parse_directives(files: DataFrame, name: str = DIRECTIVE, prefixes=None) -> DataFrame:
    """(path, line, code); a null line covers the whole file.

    ``<name>: codes`` is for the next line, ``<name>-line`` for its own,
    ``<name>-file`` for the file. The list ends at a slash or the end of the line.
    Only built-in code families (or ``*``) count; pass ``prefixes`` to change that.
    """
    return files.filter(F.contains("content", F.lit(name))).select(
        "path", F.inline(F.array_distinct(directives_of(F.col("content"), name, prefixes))))


def unsilenced(findings: Column, content: Column, name: str = DIRECTIVE, prefixes=None) -> Column:
    """Findings of one file that no directive of the file covers; array in, array out."""
    def kept(directives: Column) -> Column:
        return F.filter(findings, lambda f: ~F.exists(
            directives,
            lambda d: (d["line"].isNull() | (d["line"] == f["location"]["line"])) & ((d["code"] == "*") | (d["code"] == f["code"])),
        ))

    return F.when(
        (F.size(findings) > 0) & F.contains(content, F.lit(name)),
        let(F.coalesce(directives_of(content, name, prefixes), F.array().cast("array<struct<line:int,code:string>>")), kept),
    ).otherwise(findings)


def directives_for(findings: DataFrame, files: DataFrame, **options) -> DataFrame:
    """Parse only files that have findings."""
    reported = findings.select(F.col("location.file").alias("path")).distinct()
    return parse_directives(files.join(reported, "path", "left_semi"), **options)


def apply_directives(findings: DataFrame, directives: DataFrame) -> DataFrame:
    """Drop findings a directive of their file or line names, or covers with ``*``.

    Two anti joins with at most one match per code on the right, so a file with
    very many findings and very many directives is never paired with itself.
    """
    codes = lambda df: (df["_code"] == "*") | (df["_code"] == findings["code"])
    whole = directives.filter("line is null").select(F.col("path").alias("_path"), F.col("code").alias("_code")).distinct()
    lines = directives.filter("line is not null").select(
        F.col("path").alias("_path"), F.col("line").alias("_line"), F.col("code").alias("_code")).distinct()
    kept = findings.join(whole, (findings["location.file"] == whole["_path"]) & codes(whole), "left_anti")
    return kept.join(
        lines,
        (findings["location.file"] == lines["_path"]) & (findings["location.line"] == lines["_line"]) & codes(lines),
        "left_anti",
    )

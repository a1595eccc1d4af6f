"""Comparable version keys and package URLs."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from scanloom.functions.lam import let, lookup

# Package URL type per ecosystem; an unknown ecosystem is its own type.
PURL_TYPES = {
    "crates.io": "cargo", "npm": "npm", "PyPI": "pypi", "Go": "golang", "RubyGems": "gem",
    "Packagist": "composer", "NuGet": "nuget", "SwiftURL": "swift", "Pub": "pub", "Hex": "hex",
    "Maven": "maven",
}


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def number(digits: Column) -> Column:
    """Sorts like the number, however long: by the count of digits, then by the digits. Words sort after all numbers."""
    bare = F.regexp_replace(digits, r"^0+(?=[0-9])", "")
    return F.struct(F.char_length(bare).alias("size"), bare.alias("text"))


def version_key(version) -> Column:
    """Struct that sorts like the version: numbers, then release above pre-release.

    Trailing zeros are dropped (1.5 equals 1.5.0), build metadata is ignored, and
    in a pre-release numbers sort below words.
    """
    v = F.regexp_replace(F.regexp_replace(F.trim(_col(version)), r"^[vV=]+", ""), r"\+.*$", "")

    def build(t: Column) -> Column:
        core = F.regexp_extract(t, r"^([0-9]+(?:\.[0-9]+)*)", 1)
        tail = F.regexp_replace(F.substring(t, F.char_length(core) + 1, F.lit(1 << 30)), r"^[-._]", "")
        numbers = F.transform(
            F.filter(F.split(F.regexp_replace(core, r"(?:\.0+)+$", ""), r"\."), lambda x: x != ""),
            number,
        )
        words = F.transform(
            F.filter(F.split(tail, r"[.\-]"), lambda x: x != ""),
            lambda x: F.when(F.rlike(x, F.lit(r"^[0-9]+$")), number(x)).otherwise(
                F.struct(F.lit(1 << 30).alias("size"), x.alias("text"))),
        )
        return F.struct(
            numbers.alias("numbers"),
            F.when(tail == "", F.lit(1)).otherwise(F.lit(0)).alias("released"),
            words.alias("pre"),
        )

    return let(v, build)


def purl(ecosystem, name, version) -> Column:
    eco, n = _col(ecosystem), _col(name)
    kind = F.coalesce(lookup(PURL_TYPES, eco), eco)
    path = F.when(eco == "Maven", F.regexp_replace(n, r"^([^:]*):", "$1/")).otherwise(n)
    return F.concat(F.lit("pkg:"), kind, F.lit("/"), path, F.lit("@"), _col(version))

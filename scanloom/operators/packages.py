"""Packages from lock files: routing, extraction, inventory."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, functions as F

from scanloom.functions import paths, text
from scanloom.functions.lam import let, lookup

# Lower-cased file name -> format, in the order formats are collected.
FORMATS = {
    "cargo.lock": "cargo",
    "package-lock.json": "npm",
    "pnpm-lock.yaml": "pnpm",
    "yarn.lock": "yarn",
    "requirements.txt": "requirements",
    "poetry.lock": "poetry",
    "pipfile.lock": "pipfile",
    "uv.lock": "uv",
    "gemfile.lock": "gemfile",
    "composer.lock": "composer",
    "packages.lock.json": "nuget",
    "package.resolved": "swift",
    "pubspec.lock": "pubspec",
    "mix.lock": "mix",
    "pom.xml": "pom",
    "gradle.lockfile": "gradle",
    "go.sum": "gosum",
}
# Ecosystem name per format.
ECOSYSTEMS = {
    "cargo": "crates.io", "npm": "npm", "pnpm": "npm", "yarn": "npm", "requirements": "PyPI", "poetry": "PyPI",
    "pipfile": "PyPI", "uv": "PyPI", "gemfile": "RubyGems", "composer": "Packagist", "nuget": "NuGet",
    "swift": "SwiftURL", "pubspec": "Pub", "mix": "Hex", "pom": "Maven", "gradle": "Maven", "gosum": "Go",
}
PAIR = "struct<name:string,version:string>"
_SPACE = r"^\s+|\s+$"


def format_of(path) -> Column:
    name = F.lower(paths.base_name(path))
    return lookup(FORMATS, name)


def format_order(fmt: Column) -> Column:
    return lookup({f: i for i, f in enumerate(FORMATS.values())}, fmt, "int")


def with_format(files: DataFrame) -> DataFrame:
    return files.withColumn("format", format_of("path"))


# --- helpers ----------------------------------------------------------------

def _trim(c: Column) -> Column:
    return F.regexp_replace(c, _SPACE, "")


def _lines(c: Column) -> Column:
    return F.split(c, r"\r?\n")


def _unquote(c: Column, quote: str = "\"'") -> Column:
    """Strip all leading and trailing quotes of the given kinds, outer kind first."""
    out = c
    for q in quote:
        out = F.regexp_replace(out, f"^{q}+|{q}+$", "")
    return out


def _pair(name: Column, version: Column) -> Column:
    return F.struct(name.alias("name"), version.alias("version"))


def _complete(pairs: Column) -> Column:
    return F.filter(pairs, lambda p: p["name"].isNotNull() & p["version"].isNotNull()
                    & (p["name"] != "") & (p["version"] != ""))


def _distinct(pairs: Column) -> Column:
    """Distinct pairs of one file; as text, so the engine can hash them."""
    keys = F.array_distinct(F.transform(pairs, lambda p: F.concat(p["name"], F.lit("\0"), p["version"])))
    return F.transform(keys, lambda k: _pair(F.substring_index(k, "\0", 1), F.substring_index(k, "\0", -1)))


def _blocks(content: Column) -> Column:
    """A block is an unindented line with the indented or blank lines under it."""
    return F.split(content, r"\n(?=[^\s])")


def _map_pairs(entries: Column, name, version) -> Column:
    return F.transform(F.map_entries(entries), lambda e: _pair(name(e), version(e)))


def _or_empty(pairs: Column) -> Column:
    return F.coalesce(pairs, F.array().cast(f"array<{PAIR}>"))


# --- JSON formats -----------------------------------------------------------

def _npm(content: Column) -> Column:
    lock = F.from_json(
        content,
        "packages map<string,struct<name:string,version:string,link:boolean>>, dependencies map<string,struct<version:string>>",
    )

    def pairs(x: Column) -> Column:
        entries = F.filter(
            F.map_entries(x["packages"]), lambda e: (e["key"] != "") & ~F.coalesce(e["value"]["link"], F.lit(False)))
        current = _complete(F.transform(entries, lambda e: _pair(
            F.coalesce(e["value"]["name"], F.substring_index(e["key"], "node_modules/", -1)), e["value"]["version"])))
        older = _complete(_map_pairs(x["dependencies"], lambda e: e["key"], lambda e: e["value"]["version"]))
        return let(_or_empty(current), lambda c: F.when(F.size(c) > 0, c).otherwise(_or_empty(older)))

    return let(lock, pairs)


def _pipfile(content: Column) -> Column:
    entry = "map<string,struct<version:string>>"
    lock = F.from_json(content, f"default {entry}, develop {entry}")
    pairs = lambda m: _or_empty(_map_pairs(
        m, lambda e: e["key"], lambda e: _trim(F.regexp_replace(_trim(e["value"]["version"]), r"^(?:==)+", ""))))
    return let(lock, lambda x: _complete(F.concat(pairs(x["default"]), pairs(x["develop"]))))


def _composer(content: Column) -> Column:
    lock = F.from_json(content, f"packages array<{PAIR}>, `packages-dev` array<{PAIR}>")
    clean = lambda a: _or_empty(F.transform(a, lambda e: _pair(
        _trim(e["name"]), F.regexp_replace(_trim(e["version"]), "^v", ""))))
    return let(lock, lambda x: _complete(F.concat(clean(x["packages"]), clean(x["packages-dev"]))))


def _nuget(content: Column) -> Column:
    lock = F.from_json(content, "dependencies map<string,map<string,struct<resolved:string>>>")
    per_target = F.transform(F.map_values(lock["dependencies"]), lambda m: _or_empty(
        _map_pairs(m, lambda e: e["key"], lambda e: _trim(e["value"]["resolved"]))))
    return _distinct(_complete(F.flatten(per_target)))


def _swift(content: Column) -> Column:
    pin = "array<struct<location:string,repositoryURL:string,state:struct<version:string>>>"
    lock = F.from_json(content, f"pins {pin}, object struct<pins:{pin}>")

    def url(c: Column) -> Column:
        out = F.regexp_replace(F.regexp_replace(_trim(c), r"/+$", ""), r"(?:\.git)+$", "")
        for prefix in ("https://", "http://", "git@"):
            out = F.regexp_replace(out, f"^(?:{prefix})+", "")
        return F.lower(F.replace(out, F.lit(":"), F.lit("/")))

    return let(lock, lambda x: _complete(F.transform(
        F.coalesce(x["pins"], x["object"]["pins"]),
        lambda p: _pair(url(F.coalesce(p["location"], p["repositoryURL"])), _trim(p["state"]["version"])))))


# --- line formats -----------------------------------------------------------

def _pnpm(content: Column) -> Column:
    section = F.filter(_blocks(content), lambda b: F.startswith(b, F.lit("packages:")))
    keys = F.filter(F.flatten(F.transform(section, _lines)), lambda t: F.rlike(t, F.lit(r"^\s\s\S.*:$")))

    def pair(t: Column) -> Column:
        key = F.regexp_replace(F.regexp_replace(t, r"^\s+|:$", ""), r"""^'(.*)'$|^"(.*)"$""", "$1$2")
        spec = F.regexp_extract(F.regexp_replace(key, "^/", ""), r"^([^(_]*)", 1)
        # The name may start with @, so the last @ separates the version.
        return _pair(F.regexp_extract(spec, r"^(.+)@([0-9][^@]*)$", 1), F.regexp_extract(spec, r"^(.+)@([0-9][^@]*)$", 2))

    return _distinct(_complete(F.transform(keys, pair)))


def _yarn(content: Column) -> Column:
    entries = F.filter(_blocks(content), lambda b: F.rlike(b, F.lit(r"^(?!#|__metadata)[^\n]*:\s*(?:\n|$)")))

    def pairs(block: Column) -> Column:
        head = _trim(F.regexp_replace(F.regexp_extract(block, r"^([^\n]*)", 1), r":+\s*$", ""))
        first = F.regexp_replace(_trim(F.substring_index(head, ",", 1)), r'^"(.*)"$', "$1")
        name = F.regexp_extract(F.regexp_replace(first, "^npm:", ""), r"^(.+)@[^@]*$", 1)
        versions = F.filter(F.transform(_lines(block), _trim), lambda t: F.startswith(t, F.lit("version")))
        value = lambda t: F.regexp_replace(_trim(F.regexp_replace(t, r"^version[ :]*", "")), r'^"(.*)"$', "$1")
        return F.transform(versions, lambda t: _pair(name, value(t)))

    return _distinct(_complete(F.flatten(F.transform(entries, pairs))))


def _requirements(content: Column) -> Column:
    lines = F.transform(_lines(content), lambda t: _trim(F.substring_index(t, "#", 1)))
    pinned = F.filter(lines, lambda t: F.contains(t, F.lit("==")) & ~F.rlike(t, F.lit(r"^(?:-|@|git\+|http)")))

    def pair(t: Column) -> Column:
        left = F.substring_index(t, "==", 1)
        right = F.substring(t, F.char_length(left) + 3, F.lit(1 << 30))
        return _pair(
            _trim(F.regexp_extract(left, r"^([^\[ \t]*)", 1)),
            _unquote(_trim(F.regexp_extract(right, r"^([^; \t#]*)", 1))),
        )

    return _complete(F.transform(pinned, pair))


def _gemfile(content: Column) -> Column:
    # A blank line ends the list as well, so it starts a block of its own.
    blocks = F.split(content, r"\n(?=[^\s]|[ \t\r]*(?:\n|$))")

    def pairs(block: Column) -> Column:
        def below(lines: Column) -> Column:
            start = F.array_position(F.transform(lines, lambda t: F.regexp_replace(t, r"^\s+", "")), "specs:").cast("int")
            specs = F.when(start > 0, F.slice(lines, start + 1, F.size(lines))).otherwise(F.array().cast("array<string>"))
            return F.transform(
                F.filter(specs, lambda t: F.rlike(t, F.lit(r"^ {4}[^ ].* \(.+\)"))),
                lambda t: _pair(_trim(F.regexp_extract(t, r"^ {4}(.*?) \((.+)\)[^)]*$", 1)),
                                _trim(F.regexp_extract(t, r"^ {4}(.*?) \((.+)\)[^)]*$", 2))),
            )

        return let(_lines(block), below)

    return _complete(F.flatten(F.transform(blocks, pairs)))


def _pubspec(content: Column) -> Column:
    clean = F.array_join(F.filter(_lines(content), lambda t: ~F.rlike(t, F.lit(r"^\s*(?:#|$)"))), "\n")
    section = F.filter(_blocks(clean), lambda b: F.startswith(b, F.lit("packages:")))
    entries = F.flatten(F.transform(section, lambda b: F.split(b, r"\n(?= {2}[^ ])")))

    def pairs(entry: Column) -> Column:
        name = _trim(_unquote(F.regexp_extract(entry, r"^ {2}([^\n]*):(?:\n|$)", 1)))
        versions = F.filter(_lines(entry), lambda t: F.rlike(t, F.lit(r"^ {4}version:")))
        return F.transform(versions, lambda t: _pair(name, _trim(_unquote(_trim(F.regexp_replace(t, r"^ {4}version:", ""))))))

    return _complete(F.flatten(F.transform(entries, pairs)))


def _mix(content: Column) -> Column:
    lines = F.filter(_lines(content), lambda t: F.contains(t, F.lit("{:hex,")))
    return _complete(F.transform(F.transform(lines, text.quoted_strings), lambda q: _pair(F.get(q, F.lit(0)), F.get(q, F.lit(1)))))


def _gradle(content: Column) -> Column:
    lines = F.filter(F.transform(_lines(content), _trim), lambda t: ~F.rlike(t, F.lit(r"^(?:#|empty=)")) & F.contains(t, F.lit("=")))

    def pair(t: Column) -> Column:
        spec = F.substring_index(t, "=", 1)
        part = lambda i: _trim(F.regexp_extract(spec, r"^([^:]*):([^:]*):(.*)$", i))
        return _pair(
            F.when((part(1) != "") & (part(2) != ""), F.concat(part(1), F.lit(":"), part(2))), part(3))

    return _distinct(_complete(F.transform(lines, pair)))


def _gosum(content: Column) -> Column:
    fields = F.transform(_lines(content), lambda t: F.split(_trim(t), r"\s+"))
    rows = F.filter(fields, lambda f: (F.size(f) >= 3) & F.startswith(F.get(f, F.lit(1)), F.lit("v")))
    return _distinct(_complete(F.transform(
        rows, lambda f: _pair(F.get(f, F.lit(0)), F.regexp_replace(F.get(f, F.lit(1)), r"/go\.mod$", "")))))


# --- block formats ----------------------------------------------------------

def _tables(content: Column) -> Column:
    """Bodies of ``[[package]]`` tables, each cut at the next table of any name."""
    parts = F.split(F.concat(F.lit("\n"), content), r"\n\[\[package\]\]")
    return F.transform(F.slice(parts, F.lit(2), F.size(parts)), lambda b: F.regexp_extract(b, r"(?s)^(.*?)(?:\n\[|$)", 1))


def _key(block: Column, key: str) -> Column:
    return F.regexp_extract(block, rf'(?m)^{key}\s*=\s*"([^"]*)"', 1)


def _toml_packages(content: Column) -> Column:
    return _complete(F.transform(_tables(content), lambda b: _pair(_key(b, "name"), _key(b, "version"))))


def _cargo(content: Column) -> Column:
    registry = F.filter(_tables(content), lambda b: F.startswith(_key(b, "source"), F.lit("registry+")))
    return _complete(F.transform(registry, lambda b: _pair(_key(b, "name"), _key(b, "version"))))


def _pom(content: Column) -> Column:
    body = text.strip_xml_comments(content)
    for managed in (r"(?s)<dependencyManagement>.*?</dependencyManagement>", r"(?s)<dependencyManagement>.*$"):
        body = F.regexp_replace(body, managed, "")
    parts = F.split(body, "<dependency>")
    blocks = F.transform(
        F.filter(F.slice(parts, F.lit(2), F.size(parts)), lambda b: F.contains(b, F.lit("</dependency>"))),
        lambda b: F.substring_index(b, "</dependency>", 1))

    def pair(b: Column) -> Column:
        group, artifact, version = (text.tag_text(b, t) for t in ("groupId", "artifactId", "version"))
        plain = ~F.contains(F.concat_ws("", group, artifact, version), F.lit("${"))
        return _pair(F.when(plain, F.concat(group, F.lit(":"), artifact)), version)

    return _distinct(_complete(F.transform(blocks, pair)))


_READERS = {
    "cargo": _cargo, "npm": _npm, "pnpm": _pnpm, "yarn": _yarn, "requirements": _requirements, "poetry": _toml_packages,
    "pipfile": _pipfile, "uv": _toml_packages, "gemfile": _gemfile, "composer": _composer, "nuget": _nuget,
    "swift": _swift, "pubspec": _pubspec, "mix": _mix, "pom": _pom, "gradle": _gradle, "gosum": _gosum,
}


def extract_packages(files: DataFrame, formats=None) -> DataFrame:
    """ecosystem, name, version, source: every package of every known lock file.

    One pass: each file takes the branch of its format, so the corpus is read
    once and only for the named files.
    """
    chosen = tuple(f for f in FORMATS.values() if formats is None or f in formats)
    names = [n for n, f in FORMATS.items() if f in chosen]
    named = files.filter(F.lower(paths.base_name("path")).isin(*names))
    return named.select(
        lookup(ECOSYSTEMS, format_of("path")).alias("ecosystem"), F.col("path").alias("source"),
        F.inline(_packages_of(chosen, files.sparkSession.sparkContext.applicationId)),
    ).select("ecosystem", "name", "version", "source")


@lru_cache(maxsize=32)
def _packages_of(formats: tuple[str, ...], _gateway: int) -> Column:
    """Packages of one file as an expression over ``path, content``; built once per choice of formats."""
    fmt = format_of("path")
    found = None
    for f in formats:
        value = _READERS[f](F.col("content"))
        found = F.when(fmt == f, value) if found is None else found.when(fmt == f, value)
    return found


def inventory(packages: DataFrame) -> DataFrame:
    """Distinct (ecosystem, name, version), each with its first source, in order."""
    first = F.min(F.struct(format_order(format_of("source")).alias("format"), "source"))["source"]
    return packages.groupBy("ecosystem", "name", "version").agg(first.alias("source")).orderBy("ecosystem", "name", "version")

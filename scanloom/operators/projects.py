"""Projects: detection from manifests, scan-level sets, path assignment, framework gates."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

from scanloom.functions import paths
from scanloom.functions.lam import lookup
from scanloom.operators.classify import with_kind
from scanloom.operators.order import carried, seated
from scanloom.rules import Rule, unix_lines

# Manifest name -> language, ecosystem.
MANIFESTS = {
    "cargo.toml": ("rust", "cargo"),
    "package.json": ("javascript", "npm"),
    "pyproject.toml": ("python", "pypi"),
    "requirements.txt": ("python", "pypi"),
    "pipfile": ("python", "pypi"),
    "poetry.lock": ("python", "pypi"),
    "uv.lock": ("python", "pypi"),
    "go.mod": ("go", "gomod"),
    "pom.xml": ("java", "maven"),
    "build.gradle": ("java", "gradle"),
    "build.gradle.kts": ("kotlin", "gradle"),
    "composer.json": ("php", "composer"),
    "gemfile": ("ruby", "bundler"),
    "gemfile.lock": ("ruby", "bundler"),
    "package.resolved": ("swift", "swiftpm"),
    "pubspec.lock": ("dart", "pub"),
    "mix.lock": ("elixir", "hex"),
    "packages.lock.json": ("csharp", "nuget"),
}
# Per language, framework -> any of these texts (lower-cased text where noted).
FRAMEWORK_TEXTS = {
    ("rust", True): {
        "actix": ("\nactix-web", '"actix-web"'),
        "axum": ("\naxum", '"axum"'),
        "rocket": ("\nrocket", '"rocket"'),
    },
    ("javascript", False): {
        "nextjs": ('"next"',),
        "nestjs": ('"@nestjs/core"', '"@nestjs/common"'),
        "express": ('"express"',),
        "react": ('"react"',),
        "vue": ('"vue"',),
        "svelte": ('"svelte"',),
    },
    ("python", True): {"fastapi": ("fastapi",), "django": ("django",), "flask": ("flask",)},
    ("go", False): {"gin": ("github.com/gin-gonic/gin",)},
    ("java", False): {"spring-boot": ("spring-boot-starter", "org.springframework.boot")},
    ("php", False): {
        "laravel": ('"laravel/framework"',),
        "symfony": ('"symfony/framework-bundle"', '"symfony/symfony"'),
    },
    ("ruby", True): {"rails": ('"rails"', "'rails'", "\n  rails ")},
}
TYPED_JS = ('"typescript"', '"@types/node"')


def _any_of(text: Column, needles) -> Column:
    out = F.lit(False)
    for n in needles:
        out = out | F.contains(text, F.lit(n))
    return out


def fingerprint(files: DataFrame) -> DataFrame:
    """One row per recognised manifest: root, manifest, language, ecosystem, frameworks."""
    if "kind" not in files.columns:
        files = with_kind(files)
    name = F.lower(paths.base_name("path"))
    rows = files.filter((F.col("kind") == "manifest") & name.isin(*MANIFESTS) & F.col("content").isNotNull())
    content = F.col("content")

    base = lookup({m: language for m, (language, _) in MANIFESTS.items()}, name)
    lowered = F.lower(content)
    frameworks = None
    for (language, fold), table in FRAMEWORK_TEXTS.items():
        text = lowered if fold else content
        found = F.array_compact(F.array(*[F.when(_any_of(text, ns), F.lit(fw)) for fw, ns in table.items()]))
        # Kotlin build scripts use the texts of the Java family.
        applies = base.isin("java", "kotlin") if language == "java" else base == language
        frameworks = F.when(applies, found) if frameworks is None else frameworks.when(applies, found)
    return rows.select(
        paths.parent("path").alias("root"),
        F.col("path").alias("manifest"),
        F.when((base == "javascript") & _any_of(content, TYPED_JS), F.lit("typescript")).otherwise(base).alias("language"),
        lookup({m: ecosystem for m, (_, ecosystem) in MANIFESTS.items()}, name).alias("ecosystem"),
        frameworks.otherwise(F.array().cast("array<string>")).alias("frameworks"),
    )


def fingerprint_summary(projects: DataFrame) -> DataFrame:
    """One row: the sets of languages, ecosystems and frameworks (each at most a few dozen names)."""
    return projects.agg(
        F.array_sort(F.collect_set("language")).alias("languages"),
        F.array_sort(F.collect_set("ecosystem")).alias("ecosystems"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("frameworks")))).alias("frameworks"),
    )


def place(path: Column) -> Column:
    """Sorts a directory right before all that lies below it: its parts, each closed by a zero byte."""
    escaped = F.replace(F.replace(path, F.lit("\x01"), F.lit("\x01\x02")), F.lit("\x00"), F.lit("\x01\x01"))
    return F.encode(F.when(path == "", F.lit("")).otherwise(F.concat(F.replace(escaped, F.lit("/"), F.lit("\x00")), F.lit("\x00"))), "UTF-8")


def first_roots(directories: DataFrame, roots: DataFrame, group: str | None = None) -> DataFrame:
    """(directory, [group,] root): the topmost root at or above every directory; directories without one are left out.

    A root covers all places from its own up to the same followed by a byte that no UTF-8 text holds. Roots and
    directories are sorted together by ranges, and the root that reaches furthest is carried along: if it reaches a
    directory it is above it, and of several it is the topmost. So a directory is one row however deep it lies, no key
    stands for the root of everything, and an empty root is a range like any other. With ``group`` roots hold for
    directories of the same group only. Null roots and directories are left out.
    """
    keys = [group] if group else []
    nothing = F.lit(None).cast("string")
    starts = roots.filter("root is not null").select(*keys, "root").distinct().select(
        *keys, place(F.col("root")).alias("_place"), F.lit(0).alias("_kind"), "root", nothing.alias("directory"))
    asked = directories.filter("directory is not null").select(*keys, "directory").distinct().select(
        *keys, place(F.col("directory")).alias("_place"), F.lit(1).alias("_kind"), nothing.alias("root"), "directory")
    reach = F.when(F.col("root").isNotNull(), F.struct(F.concat("_place", F.unhex(F.lit("FF"))).alias("end"), F.col("root").alias("root")))
    run = carried(seated(starts.unionByName(asked), keys, ["_place", "_kind"]), keys, F.max, reach, F.greatest, "_reach")
    return run.filter(F.col("directory").isNotNull() & (F.col("_reach.end") >= F.col("_place"))).select(
        "directory", *keys, F.col("_reach.root").alias("root"))


def assign_projects(files: DataFrame, projects: DataFrame) -> DataFrame:
    """(path, root): the first root in sorted order, which among prefixes is the shortest.

    Roots are found for distinct directories, not for files.
    """
    located = files.select("path", paths.parent("path").alias("directory"))
    return located.join(first_roots(located.select("directory"), projects), "directory").select("path", "root")


def gate_by_framework(findings: DataFrame, rules: Iterable[Rule], projects: DataFrame) -> DataFrame:
    """Keep framework findings where the framework is.

    Project-scoped codes need a project with the framework above the file;
    scan-scoped codes need it anywhere in the scan. Other codes pass untouched.
    """
    rules = list(rules)
    scoped = {r.code: r.framework for r in rules if r.framework}
    anywhere = {r.code: r.scan_framework for r in rules if r.scan_framework}
    if not scoped and not anywhere:
        return findings
    columns = findings.columns
    used = projects.select("root", F.explode("frameworks").alias("framework")).distinct()
    out = findings
    if anywhere:
        wanted = lookup(anywhere, F.col("code"))
        # At most a few dozen names, so one scalar says what the scan holds.
        present = used.agg(F.collect_set("framework")).scalar()
        out = out.filter(wanted.isNull() | F.array_contains(present, wanted))
    if scoped:
        wanted = lookup(scoped, F.col("code"))
        # Only directories that hold a gated finding meet the project table, each with the frameworks it asks for.
        asked = out.filter(wanted.isNotNull()).select(paths.parent("location.file").alias("directory"), wanted.alias("framework"))
        granted = first_roots(asked, used, "framework").select(
            F.col("directory").alias("_directory"), F.col("framework").alias("_framework"), F.lit(True).alias("_granted"))
        out = (
            out.withColumns({
                "_framework": F.coalesce(wanted, F.lit("")),
                "_directory": F.when(wanted.isNotNull(), paths.parent("location.file")).otherwise(_nowhere()),
            })
            .join(granted, ["_directory", "_framework"], "left")
            .filter((F.col("_framework") == "") | F.col("_granted"))
            .select(*columns)
        )
    return out


def _nowhere() -> Column:
    """Join key for findings a join does not concern: matches nothing and spreads them evenly.

    A null key would send all of them to one task.
    """
    return F.concat(F.lit("\0"), F.xxhash64("code", "message", "location").cast("string"))


def exempt_roots(files: DataFrame, projects: DataFrame, marker: str, framework: str) -> DataFrame:
    """Roots of projects in which some module file mentions the marker."""
    if "kind" not in files.columns:
        files = with_kind(files)
    modules = files.filter(
        (F.col("kind") == "source") & paths.is_module_file("path") & F.rlike("content", F.lit(unix_lines(marker)))
    ).select("path")
    scoped = projects.filter(F.array_contains("frameworks", framework)).select("root")
    return assign_projects(modules, scoped).select("root").distinct()


def exempt_projects(findings: DataFrame, roots: DataFrame, code: str) -> DataFrame:
    """Drop findings of one code below an exempt root."""
    is_code = F.col("code") == code
    directories = findings.filter(is_code).select(paths.parent("location.file").alias("directory"))
    exempt = first_roots(directories, roots).select(F.col("directory").alias("_directory"))
    key = F.when(is_code, paths.parent(F.col("location.file"))).otherwise(_nowhere())
    return findings.withColumn("_directory", F.coalesce(key, _nowhere())).join(exempt, "_directory", "left_anti").select(*findings.columns)

"""File kind, rule family and minified text: narrow projections over ``files``."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

from scanloom.functions import paths
from scanloom.functions.lam import let
from scanloom.functions.text import char_count, is_binary

# The name lists behind the kinds.
MANIFEST_NAMES = (
    "cargo.toml", "cargo.lock", "package.json", "package-lock.json", "yarn.lock", "pnpm-lock.yaml",
    "requirements.txt", "pipfile", "pipfile.lock", "poetry.lock", "uv.lock", "pyproject.toml", "go.mod",
    "go.sum", "gemfile", "gemfile.lock", "composer.json", "composer.lock", "packages.lock.json", "pom.xml",
    "build.gradle", "build.gradle.kts", "gradle.lockfile", "package.resolved", "pubspec.lock", "mix.lock",
)
TEST_DIRECTORIES = (
    "tests", "test", "__tests__", "__test__", "benches", "bench", "spec", "specs", "cypress", "e2e",
)
TEST_NAMES = ("conftest.py", "tests.rs")
TEST_PREFIXES = ("test_",)
TEST_PREFIX_EXTENSIONS = ("py", "rs")
TEST_SUFFIXES = (
    "_test.go", "_test.py", "_test.rb", "_test.rs", "_tests.rs", "_spec.rb", ".test.js", ".test.jsx", ".test.ts", ".test.tsx", ".test.cjs",
    ".test.mjs", ".spec.js", ".spec.jsx", ".spec.ts", ".spec.tsx", ".spec.cjs", ".spec.mjs",
)
SOURCE_EXTENSIONS = (
    "rs", "ts", "tsx", "js", "jsx", "mjs", "cjs", "py", "go", "java", "kt", "kts", "rb", "php", "cs", "cpp",
    "cc", "cxx", "c", "h", "hpp", "swift", "scala", "sh", "bash",
)
CONFIG_EXTENSIONS = (
    "toml", "yaml", "yml", "json", "ini", "env", "conf", "cfg", "properties", "xml", "tf", "tfvars",
)
MINIFIED_PIECES = (
    ".min.js", ".min.mjs", ".min.cjs", ".min.css", ".bundle.js", ".bundle.mjs", ".bundle.css", "-min.js", "-min.css",
)
MINIFIED_EXTENSIONS = ("js", "mjs", "cjs", "jsx", "ts", "tsx", "css")
MINIFIED_FLOOR = 256
MINIFIED_LINE = 500


def _any(tests: Iterable[Column]) -> Column:
    return reduce(or_, tests)


def is_test_name(name: Column, ext: Column) -> Column:
    """A lower-case file name that test runners look for."""
    return (
        name.isin(*TEST_NAMES)
        | (_any(F.startswith(name, F.lit(x)) for x in TEST_PREFIXES) & ext.isin(*TEST_PREFIX_EXTENSIONS))
        | _any(F.endswith(name, F.lit(x)) for x in TEST_SUFFIXES)
    )


def kind_of(path) -> Column:
    """manifest, then test, then dotenv, then source, then config, else other."""
    p = F.col(path) if isinstance(path, str) else path
    lowered = F.lower(paths.normalize(p))
    return let(
        F.struct(
            paths.base_name(lowered).alias("name"),
            paths.segments(lowered).alias("parts"),
            paths.extension(lowered).alias("ext"),
        ),
        lambda f: F.when(f["name"].isin(*MANIFEST_NAMES), "manifest")
        .when(
            is_test_name(f["name"], f["ext"])
            | F.arrays_overlap(f["parts"], F.array(*[F.lit(d) for d in TEST_DIRECTORIES])),
            "test",
        )
        .when((f["name"] == ".env") | (f["name"] == ".envrc") | F.startswith(f["name"], F.lit(".env.")), "config")
        .when(f["ext"].isin(*SOURCE_EXTENSIONS), "source")
        .when(f["ext"].isin(*CONFIG_EXTENSIONS), "config")
        .otherwise("other"),
    )


def with_kind(files: DataFrame) -> DataFrame:
    """Add ``kind`` and ``ext``. Store both with the corpus: scans prune on them."""
    return files.withColumns({"kind": kind_of("path"), "ext": F.coalesce(paths.extension("path"), F.lit(""))})


def is_minified(path, content) -> Column:
    """By name, or a web text whose lines average 500 bytes or more; the whole text counts."""
    p = F.col(path) if isinstance(path, str) else path
    c = F.col(content) if isinstance(content, str) else content
    named = _any(F.contains(F.lower(paths.base_name(p)), F.lit(x)) for x in MINIFIED_PIECES)

    def dense(t: Column) -> Column:
        return (
            (F.octet_length(t) >= MINIFIED_FLOOR)
            & F.is_valid_utf8(t)
            & ~F.contains(t, F.lit("\0"))
            & (F.floor(F.octet_length(t) / (char_count(t, "\n") + 1)) >= MINIFIED_LINE)
        )

    return F.coalesce(
        named | (F.coalesce(paths.extension(p), F.lit("")).isin(*MINIFIED_EXTENSIONS) & dense(c)), F.lit(False)
    )


def drop_minified(files: DataFrame) -> DataFrame:
    return files.filter(~is_minified("path", "content"))


def drop_binary(files: DataFrame) -> DataFrame:
    return files.filter(~is_binary("content"))


def family_of(path, content) -> Column:
    """Which infrastructure rule set a file takes: the first class that fits, else null."""
    return (
        F.when(paths.is_dockerfile(path), "dockerfile")
        .when(paths.is_terraform(path), "terraform")
        .when(paths.is_k8s(path, content), "kubernetes")
    )


def route_family(files: DataFrame) -> DataFrame:
    """Add ``family`` and ``workflow`` (a workflow file must also be of kind config)."""
    return files.withColumns({
        "family": family_of("path", "content"),
        "workflow": (F.col("kind") == "config") & paths.is_workflow("path"),
    })


def route_keys(kind: Column, ext: Column, path: Column, content: Column) -> Column:
    """Lookup keys of the rules a file may meet (see ``rules_of``)."""
    return F.array(
        F.concat(kind, F.lit(":"), ext),
        F.concat(kind, F.lit(":*")),
        F.concat(F.lit("family:"), family_of(path, content)),
        F.when((kind == "config") & paths.is_workflow(path), F.lit("family:workflow")),
    )

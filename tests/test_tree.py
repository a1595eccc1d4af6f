"""Ignore files of a tree, and listing in rounds."""

import os
import random

import pytest
import scanloom as sl
from pyspark.sql import functions as F
from scanloom.functions import globs
from scanloom.sources.corpus import list_tree
from scanloom.sources.ignores import IGNORE_FILES, ignored_paths


def brute(files, lines):
    """Every entry on the way to a file, decided by all lines of all directories above it."""
    import re

    def decided(entry, is_dir):
        best = None
        for path, text in lines:
            directory, _, name = path.rpartition("/")
            if name in IGNORE_FILES and text is not None and (directory == "" or entry.startswith(directory + "/")):
                below = entry[len(directory) + 1:] if directory else entry
                for no, line in enumerate(text.splitlines()):
                    g = globs.parse_glob(line)
                    if g and (is_dir or not g.directory_only) and re.fullmatch(g.regex, below, re.DOTALL):
                        key = (IGNORE_FILES.index(name), directory.count("/") + bool(directory), no)
                        if best is None or key > best[0]:
                            best = key, not g.negated
        return best is not None and best[1]

    def skipped(path):
        parts = path.split("/")
        return any(decided("/".join(parts[:i]), True) for i in range(1, len(parts))) or decided(path, False)

    return sorted(p for p in set(files) if p is not None and skipped(p))


FILES = "path string, content string"


@pytest.mark.parametrize("lines, path, skipped", [
    ([(".gitignore", "*.log")], "a/b/x.log", True),
    ([("a/.gitignore", "*.log")], "x.log", False),
    ([("a/.gitignore", "/x.log")], "a/b/x.log", False),
    ([("a/.gitignore", "/x.log")], "a/x.log", True),
    ([(".gitignore", "*.log"), ("a/.gitignore", "!x.log")], "a/x.log", False),
    ([(".gitignore", "a/"), ("a/.gitignore", "!x.log")], "a/x.log", True),
    ([(".gitignore", "!x.log"), (".ignore", "*.log")], "x.log", True),
    ([("a/.gitignore", "x.log"), (".ignore", "!x.log")], "a/x.log", False),
    ([(".gitignore", "x/\n!x/keep")], "x/keep", True),
    ([(".gitignore", "x/*\n!x/keep")], "x/keep", False),
    ([("a/b/.gitignore", "*")], "a/c/x", False),
    ([("ab/.gitignore", "*")], "a/x", False),
    ([("a/.gitignore", None)], "a/x", False),
    ([("a/notes.txt", "*")], "a/x", False),
])
def test_one_file(spark, lines, path, skipped):
    files = spark.createDataFrame([(path, "x"), *lines], FILES)
    kept = {r.path for r in sl.honour_ignore_files(files).collect()}
    assert (path not in kept) is skipped


def test_random_trees(spark):
    rng = random.Random(7)
    names = ["a", "b", "ab", "a-b", "x.log", "y.py", "é", "build"]
    globs_ = ["a", "b/", "*.log", "!x.log", "/a/b", "a/**", "**/b", "build/", "!build", "# a", "", "*", "!*.py", "?", "[ab]", "a*/x.log", "!a/"]
    files = ["/".join(rng.choice(names) for _ in range(rng.randrange(1, 6))) for _ in range(1500)]
    lines = {}
    for _ in range(60):
        directory = "/".join(rng.choice(names) for _ in range(rng.randrange(0, 4)))
        lines[(directory + "/" if directory else "") + rng.choice(IGNORE_FILES)] = "\n".join(rng.choices(globs_, k=rng.randrange(1, 5)))
    lines.pop(".gitignore", None), lines.pop(".ignore", None)
    lines[".gitignore"] = "*.log\n!a/x.log"
    df = spark.createDataFrame([(f,) for f in [*files, None]], "path string")
    rows = spark.createDataFrame(list(lines.items()), FILES)
    expected = brute(files, lines.items())
    assert 100 < len(expected) < len(set(files)) - 100
    for partitions in (1, 3, 23):
        assert sorted(r.path for r in ignored_paths(df, rows, partitions).collect()) == expected
    assert ignored_paths(df, rows.limit(0)).count() == 0 and ignored_paths(df.limit(0), rows).count() == 0


def test_texts_do_not_move(spark):
    files = spark.createDataFrame([("a/x.py", "x" * 100), (".gitignore", "*.log")], FILES)
    plan = sl.honour_ignore_files(files)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan or "SortMergeJoin" in plan
    assert {r.path for r in sl.honour_ignore_files(files).collect()} == {"a/x.py", ".gitignore"}


def test_read_corpus_follows_ignore_files(spark, tmp_path):
    for name, text in {".gitignore": "*.log\nout/\n", "a.py": "x", "b.log": "x", "out/c.py": "x", "src/.ignore": "!d.log\ne.py", "src/d.log": "x",
                       "src/e.py": "x", "src/f.py": "x"}.items():
        os.makedirs((tmp_path / name).parent, exist_ok=True)
        (tmp_path / name).write_text(text)
    assert {r.path for r in sl.read_corpus(spark, str(tmp_path)).collect()} == {"a.py", "src/d.log", "src/f.py"}
    every = {r.path for r in sl.read_corpus(spark, str(tmp_path), ignore_files=False).collect()}
    assert every == {"a.py", "b.log", "out/c.py", "src/d.log", "src/e.py", "src/f.py"}
    assert {".gitignore", "src/.ignore"} <= {r.path for r in sl.read_corpus(spark, str(tmp_path), hidden=True).collect()}


def test_a_flat_directory_and_a_deep_chain(spark, tmp_path):
    flat = tmp_path / "flat"
    flat.mkdir()
    for i in range(100_000):
        (flat / f"f{i}").touch()
    deep = tmp_path.joinpath(*[f"d{i}" for i in range(50)])
    deep.mkdir(parents=True)
    (deep / "end.py").write_text("x")
    listed = list_tree(spark, str(tmp_path))
    assert listed.count() == 100_001 and listed.select("path").distinct().count() == 100_001
    # A budget of nothing but the next directory: one round a level, the same result.
    for i in range(6):
        wide = tmp_path / "wide" / f"w{i}"
        wide.mkdir(parents=True)
        (wide / "x").touch()
    few = list_tree(spark, str(tmp_path / "wide"), budget=1)
    assert sorted(r.path for r in few.collect()) == [f"w{i}/x" for i in range(6)]
    assert list_tree(spark, str(tmp_path), max_depth=2).filter("path like 'd0/%'").count() == 0


def test_errors_are_kept(spark, tmp_path):
    (tmp_path / "ok.py").write_text("x")
    shut = tmp_path / "shut"
    shut.mkdir()
    (shut / "in.py").write_text("x")
    shut.chmod(0)
    (tmp_path / "unread.py").write_text("x")
    (tmp_path / "unread.py").chmod(0)
    try:
        if os.access(shut, os.R_OK):
            pytest.skip("this user may read everything")
        crawl = sl.crawl(spark, str(tmp_path))
        assert [(r.path, "ermission" in r.error) for r in crawl.errors.collect()] == [("shut", True)]
        rows = {r.path: r for r in crawl.files.collect()}
        assert rows["ok.py"].error is None and "ermission" in rows["unread.py"].error and rows["unread.py"].content is None
    finally:
        shut.chmod(0o700)


def test_a_directory_that_goes_away_is_an_error(spark, tmp_path, monkeypatch):
    """As seen by a task whose directory was removed after it had been handed out."""
    from scanloom.sources import corpus

    (tmp_path / "a").mkdir()
    fs, base = corpus.connect(str(tmp_path))
    with pytest.raises(OSError):
        list(corpus.entries(fs, f"{base}/gone"))
    assert list(corpus.entries(fs, base)) == [("a", "d", None)]
    assert sl.crawl(spark, str(tmp_path)).errors.agg(F.count("*")).first()[0] == 0

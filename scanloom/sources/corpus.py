"""Corpora: directory trees, table columns, ignore globs, changed files."""

from __future__ import annotations

import os
from dataclasses import dataclass
from functools import reduce

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from scanloom.functions import globs, paths
from scanloom.sources.ignores import IGNORE_FILES, honour_ignore_files
from scanloom.sources.shared import save, workers_import

# Directories never worth scanning.
NOISE_DIRECTORIES = (".git", "node_modules", "target", "dist", "build", ".venv", "venv", "__pycache__")
LIST_BATCH = 10_000
READ_BATCH = 32 << 20
#: Entries after which a task hands on the directories it has not listed.
LIST_BUDGET = 20_000
# Change kinds that leave a file behind.
KEPT_CHANGES = ("A", "M", "R", "T")


def _inside(path: Column, max_depth, hidden: bool, noise: bool) -> Column:
    parts = paths.segments(path)
    keep = F.lit(True)
    if noise:
        above = F.slice(parts, F.lit(1), F.size(parts) - 1)
        keep = keep & ~F.arrays_overlap(above, F.array(*[F.lit(d) for d in NOISE_DIRECTORIES]))
    if not hidden:
        keep = keep & ~F.exists(parts, lambda p: F.startswith(p, F.lit(".")))
    if max_depth is not None:
        keep = keep & (F.size(parts) <= max_depth)
    return keep


def walk_filter(files: DataFrame, max_depth: int | None = None, hidden: bool = False, noise: bool = True) -> DataFrame:
    """Path rules of a walk on an existing corpus: noise directories, hidden names, depth."""
    return files.filter(_inside(F.col("path"), max_depth, hidden, noise))


def decode(raw: Column) -> Column:
    """Text of valid UTF-8 bytes, else null: such files are counted but not scanned."""
    return F.when(F.is_valid_utf8(raw.cast("string")), raw.cast("string"))


def is_link(fs, path: str) -> bool:
    """Whether a local path is a symbolic link: links can leave the tree or lead back into it."""
    return isinstance(fs, pafs.LocalFileSystem) and os.path.islink(path)


def connect(root: str):
    """(file system, folder) of a root."""
    fs, base = pafs.FileSystem.from_uri(root) if "://" in root else (pafs.LocalFileSystem(), root)
    return fs, base.rstrip("/")


def entries(fs, folder: str):
    """(name, kind, size) of a folder, without a list of all of them where the file system allows."""
    if isinstance(fs, pafs.LocalFileSystem):
        with os.scandir(folder or "/") as found:
            for e in found:
                if e.is_dir():
                    yield e.name, "d", None
                elif e.is_file():
                    yield e.name, "f", e.stat().st_size
    else:
        for info in fs.get_file_info(pafs.FileSelector(folder)):
            if info.type in (pafs.FileType.Directory, pafs.FileType.File):
                yield info.base_name, "d" if info.type == pafs.FileType.Directory else "f", info.size


def list_tree(spark: SparkSession, root: str, max_depth: int | None = None, hidden: bool = False,
              noise: bool = True, follow_links: bool = False, also: tuple[str, ...] = (), budget: int = LIST_BUDGET) -> DataFrame:
    """(path, size, error) of a tree, ``path`` relative to ``root``.

    The driver lists nothing. Directories still to be listed are a table; tasks take them, go down while their
    budget of entries lasts, and hand on what is left as the next table. Every round is written to the shared folder, so there are about as
    many rounds as a task's budget is passed, not as the tree is deep, and a lost executor costs its part of a round.
    A directory's names are read as a stream; one directory is one task's work. Noise and hidden directories are not
    entered; names in ``also`` are given although hidden. A directory that cannot be listed becomes a row with an error.

    Spark's own file listing leaves out names that start with a dot or an
    underscore (``__init__.py``), so the tree is listed here.
    """
    fs, base = connect(root)
    if fs.get_file_info(base or "/").type != pafs.FileType.Directory:
        raise FileNotFoundError(f"no directory: {root}")

    def wanted(name: str, kind: str) -> bool:
        if kind == "d":
            return not (noise and name in NOISE_DIRECTORIES) and (hidden or not name.startswith("."))
        return hidden or not name.startswith(".") or name in also

    def deep(path: str) -> bool:
        return max_depth is not None and path.count("/") + 1 >= max_depth

    def walk(batches):
        fs, base = connect(root)
        left = budget
        for batch in batches:
            stack, rows = list(batch["path"]), []
            while stack:
                current = stack.pop()
                if left <= 0:
                    rows.append((current, None, None, True))
                    continue
                try:
                    for name, kind, size in entries(fs, f"{base}/{current}" if current else base):
                        left -= 1
                        path = f"{current}/{name}" if current else name
                        if not wanted(name, kind) or not follow_links and is_link(fs, f"{base}/{path}"):
                            continue
                        if kind == "f":
                            rows.append((path, size, None, False))
                        elif not deep(path):
                            stack.append(path)
                        if len(rows) >= LIST_BATCH:
                            yield pd.DataFrame(rows, columns=["path", "size", "error", "open"])
                            rows = []
                except OSError as err:
                    rows.append((current, None, str(err), False))
            yield pd.DataFrame(rows, columns=["path", "size", "error", "open"])

    workers_import(spark)
    width = spark.sparkContext.defaultParallelism * 4
    front, rounds, n = spark.createDataFrame([("",)], "path string"), [], 1
    while n:
        # Neighbours in a list lie near each other in the tree; dealing them out at random spreads a deep part over tasks.
        dealt = front.repartition(min(n, width), F.xxhash64("path"))
        done = save(dealt.mapInPandas(walk, "path string, size long, error string, open boolean"), "listing")
        rounds.append(done.filter(~F.col("open")).select("path", "size", "error"))
        front = done.filter("open").select("path")
        n = front.count()
    return reduce(DataFrame.unionAll, rounds)


@dataclass
class Crawl:
    """The files of a tree, and what could not be listed: (path, error)."""

    files: DataFrame
    errors: DataFrame


def crawl(spark: SparkSession, root: str, max_depth: int | None = None, hidden: bool = False, noise: bool = True,
          globs_: list[str] | None = None, follow_links: bool = False, ignore_files: bool = True) -> Crawl:
    """Files (path, content, size, error) of a tree, and errors (path, error) of its directories.

    ``path`` is relative to ``root``. The ignore files of the tree hold unless told otherwise. Bytes are only read for files that pass the
    path rules, in tasks of about one split of bytes each. Content is null for a file that is not text or cannot be read: it counts, but
    it is not scanned; one that cannot be read says why in ``error``.
    """
    listed = save(list_tree(spark, root, max_depth, hidden, noise, follow_links, IGNORE_FILES if ignore_files else ()), "tree")
    files = listed.filter("error IS NULL").select("path", "size")
    if globs_:
        files = files.filter(~globs.excluded(F.col("path"), globs_))

    def read(batches):
        fs, base = connect(root)
        for batch in batches:
            rows, held = [], 0
            for path, size in zip(batch["path"], batch["size"]):
                data = error = None
                try:
                    with fs.open_input_stream(f"{base}/{path}") as stream:
                        data = stream.read()
                except OSError as err:
                    error = str(err)
                rows.append((path, size, data, error))
                held += len(data or b"")
                if held >= READ_BATCH:
                    yield pd.DataFrame(rows, columns=["path", "size", "raw", "error"])
                    rows, held = [], 0
            yield pd.DataFrame(rows, columns=["path", "size", "raw", "error"])

    def texts(listing: DataFrame) -> DataFrame:
        # The listing is small next to the bytes; its sum decides how many read tasks there are.
        split = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
        total = listing.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
        tasks = max(spark.sparkContext.defaultParallelism, -(-total // split))
        raw = listing.repartition(int(tasks), F.xxhash64("path")).mapInPandas(read, "path string, size long, raw binary, error string")
        return raw.select("path", decode(F.col("raw")).alias("content"), "size", "error")

    if ignore_files:
        name = paths.base_name("path")
        files = save(honour_ignore_files(files, texts(files.filter(name.isin(*IGNORE_FILES)))), "visited")
        if not hidden:
            files = files.filter(~F.startswith(name, F.lit(".")))
    return Crawl(texts(files), listed.filter("error IS NOT NULL").select("path", "error"))


def read_corpus(spark: SparkSession, root: str, max_depth: int | None = None, hidden: bool = False,
                noise: bool = True, globs_: list[str] | None = None, follow_links: bool = False, ignore_files: bool = True) -> DataFrame:
    """(path, content, size) of a tree: the files of ``crawl``."""
    return crawl(spark, root, max_depth, hidden, noise, globs_, follow_links, ignore_files).files.select("path", "content", "size")


def to_corpus(df: DataFrame, path: Column, text: Column) -> DataFrame:
    """Any text column as a corpus under a synthetic path."""
    return df.select(path.alias("path"), text.alias("content"), F.octet_length(text).cast("long").alias("size"))


def ignore_paths(files: DataFrame, patterns, root: str = "") -> DataFrame:
    """Drop files a walk with these ignore lines would skip (last match wins)."""
    path = F.col("path")
    if root:
        path = F.regexp_replace(path, "^\\Q" + root.rstrip("/") + "\\E/+", "")
    return files.filter(~globs.excluded(paths.normalize(path), patterns))


def changed_only(files: DataFrame, changes: DataFrame) -> DataFrame:
    """Keep files in the change set; deletions do not count."""
    kept = changes.filter(F.col("kind").isin(*KEPT_CHANGES)).select("path").distinct()
    return files.join(kept, "path", "left_semi")

"""Ignore files that lie in a tree: every directory may hold some, their lines hold below it.

A walk decides an entry by the last line that matches it: lines of ``.ignore`` files count after those
of ``.gitignore`` files, deeper files after higher ones, later lines after earlier ones. An ignored directory is
closed: nothing below it comes back. Here the same is one pass over paths in order: all that lies below a
directory stands right behind its ignore files, so a task keeps the files of the directories
above its current path and decides every directory once. What holds at the start of a range is looked up for the
first path of the range only.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from scanloom.functions import globs, paths
from scanloom.operators.order import seated
from scanloom.operators.projects import place
from scanloom.sources.shared import workers_import

#: Names of ignore files; lines of a later one win.
IGNORE_FILES = (".gitignore", ".ignore")


class Walk:
    """The directories above the current path, with their lines and whether they are closed."""

    def __init__(self):
        self.open: list[tuple[str, bool]] = [("", False)]
        self.lines: dict[tuple[str, int], list[tuple[re.Pattern, bool, bool]]] = {}

    def enter(self, directory: str) -> bool:
        """Go to a directory; is it closed?"""
        while self.open[-1][0] and not (directory == self.open[-1][0] or directory.startswith(self.open[-1][0] + "/")):
            left = self.open.pop()[0]
            for rank in range(len(IGNORE_FILES)):
                self.lines.pop((left, rank), None)
        while self.open[-1][0] != directory:
            above, closed = self.open[-1]
            rest = directory[len(above) + 1:] if above else directory
            below = (above + "/" if above else "") + rest.split("/", 1)[0]
            self.open.append((below, closed or self.ignored(below, True)))
        return self.open[-1][1]

    def read(self, directory: str, rank: int, text: str) -> None:
        self.enter(directory)
        self.lines[directory, rank] = [(re.compile(g.regex, re.DOTALL), g.negated, g.directory_only)
                                       for g in globs.parse_globs((text or "").splitlines())]

    def ignored(self, path: str, is_directory: bool) -> bool:
        """What the last matching line says; called while the directories above the path are open."""
        for rank in reversed(range(len(IGNORE_FILES))):
            for directory, _ in reversed(self.open):
                lines = self.lines.get((directory, rank))
                if lines:
                    below = path[len(directory) + 1:] if directory else path
                    for pattern, negated, directory_only in reversed(lines):
                        if (is_directory or not directory_only) and pattern.fullmatch(below):
                            return not negated
        return False

    def skips(self, path: str) -> bool:
        return self.enter(path.rpartition("/")[0]) or self.ignored(path, False)


def ignored_paths(files: DataFrame, lines: DataFrame, partitions: int | None = None) -> DataFrame:
    """(path): those of ``files`` that a walk with these ignore files would skip.

    ``lines`` has (path, content) of ignore files; its other rows, and those without text, say nothing. Null paths are left out, a path that
    occurs several times is given once. Paths move, texts of files do not.
    """
    name = paths.base_name("path")
    rank = F.array_position(F.array(*[F.lit(n) for n in IGNORE_FILES]), name).cast("int") - 1
    rules = lines.filter(name.isin(*IGNORE_FILES) & F.col("content").isNotNull()).select(
        paths.parent("path").alias("directory"), rank.alias("rank"), "content")
    held = rules.groupBy("directory", "rank").agg(F.max("content").alias("content"))
    none = F.lit(None)
    # In a table a file may have the name of a directory; it comes before what lies in there.
    rows = held.select(place(F.col("directory")).alias("_place"), "rank", F.col("directory").alias("path"), "content").unionByName(
        files.filter("path is not null").select("path").distinct().select(
            place(F.col("path")).alias("_place"), F.lit(-1).alias("rank"), "path", none.cast("string").alias("content")))
    ranges = seated(rows, [], ["_place", "rank"], partitions)
    # A range starts below the directories of its first path: a few rows per range.
    starts = ranges.groupBy("_range").agg(F.min_by(F.struct("path", "rank"), "_seat").alias("s"))
    above = starts.select("_range", F.explode(paths.ancestors(
        F.when(F.col("s.rank") >= 0, F.concat(F.col("s.path"), F.lit("/x"))).otherwise(F.col("s.path")))).alias("directory"))
    carry = held.join(above, "directory").select("_range", F.lit(-1).cast("long").alias("_seat"), "rank", F.col("directory").alias("path"), "content")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, current = Walk(), None
        for batch in batches:
            out = []
            for number, _, rank, path, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if number != current:
                    state, current = Walk(), number
                if rank >= 0:
                    state.read(path, rank, content)
                elif state.skips(path):
                    out.append(path)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["path"])

    workers_import(files.sparkSession)
    every = ranges.select("_range", "_seat", "rank", "path", "content").unionByName(carry.select("_range", "_seat", "rank", "path", "content"))
    return every.repartition(F.col("_range")).sortWithinPartitions("_range", "_seat", F.length("path"), "rank").mapInArrow(walk, "path string")


def honour_ignore_files(files: DataFrame, lines: DataFrame | None = None) -> DataFrame:
    """Files that a walk would visit: without those that ignore files of the tree take out.

    The ignore files are rows of ``files`` itself, or of ``lines`` where they are kept apart (hidden names are often left out).
    """
    return files.join(ignored_paths(files, files if lines is None else lines), "path", "left_anti").select(*files.columns)

"""Ignore globs as regular expressions.

Syntax: ``*`` and ``?`` stop at a slash, ``**`` crosses directories, classes and
``{a,b}`` alternatives work, a leading slash (or any inner one) anchors the
pattern at the root, a trailing slash restricts it to directories, ``!`` takes
paths back in, and the last matching line decides. Globs are configuration, so
they are translated on the driver; the test itself is an ordinary ``rlike``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from scanloom.functions.paths import segments


@dataclass(frozen=True)
class Glob:
    regex: str
    negated: bool
    directory_only: bool


def translate(pattern: str) -> str:
    """Anchored regular expression of one glob body."""
    out, i, n = [], 0, len(pattern)
    depth = 0
    while i < n:
        c = pattern[i]
        if pattern.startswith("**/", i) and (i == 0 or pattern[i - 1] == "/"):
            out.append("(?:.*/)?")
            i += 3
            continue
        if pattern.startswith("**", i) and i + 2 == n and (i == 0 or pattern[i - 1] == "/"):
            out.append(".*")
            i += 2
            continue
        if c == "*":
            while i < n and pattern[i] == "*":
                i += 1
            out.append("[^/]*")
            continue
        if c == "?":
            out.append("[^/]")
        elif c == "[":
            end = pattern.find("]", i + 2)
            if end < 0:
                out.append(r"\[")
            else:
                body = pattern[i + 1:end]
                head = "^" if body[:1] in "!^" else ""
                out.append("[" + head + body[len(head):].replace("\\", r"\\").replace("[", r"\[") + "]")
                i = end
        elif c == "{":
            depth += 1
            out.append("(?:")
        elif c == "}" and depth:
            depth -= 1
            out.append(")")
        elif c == "," and depth:
            out.append("|")
        elif c == "\\" and i + 1 < n:
            i += 1
            out.append(re.escape(pattern[i]))
        else:
            out.append(re.escape(c))
        i += 1
    return "^" + "".join(out) + "$"


def parse_glob(line: str) -> Glob | None:
    """One ignore line; None for a blank line or a comment."""
    text = line.rstrip() if not line.endswith("\\ ") else line
    if not text.strip() or text.startswith("#"):
        return None
    negated = text.startswith("!")
    if negated:
        text = text[1:]
    elif text[:2] in ("\\!", "\\#"):
        text = text[1:]
    anchored = text.startswith("/")
    text = text[1:] if anchored else text
    directory_only = text.endswith("/")
    text = text[:-1] if directory_only else text
    if not anchored and "/" not in text:
        text = "**/" + text
    if text.endswith("/**"):
        text += "/*"
    return Glob(translate(text), negated, directory_only)


def parse_globs(lines) -> list[Glob]:
    return [g for g in (parse_glob(x) for x in lines) if g is not None]


def _verdict(path: Column, globs: list[Glob], is_dir: bool) -> Column:
    """1 ignored, -1 taken back, 0 undecided; the last matching line wins."""
    out = None
    for g in reversed(globs):
        if g.directory_only and not is_dir:
            continue
        mark = F.lit(-1 if g.negated else 1)
        hit = F.rlike(path, F.lit(g.regex))
        out = F.when(hit, mark) if out is None else out.when(hit, mark)
    return F.lit(0) if out is None else out.otherwise(F.lit(0))


def matches(path: Column, lines) -> Column:
    """Does the path itself match? Used on findings, where only files occur."""
    return F.coalesce(_verdict(path, parse_globs(lines), is_dir=False) == 1, F.lit(False))


def excluded(path: Column, lines) -> Column:
    """Would a walk skip this file? An ignored directory hides all below it."""
    globs = parse_globs(lines)
    parts = segments(path)
    above = F.when(
        F.size(parts) > 1,
        F.exists(
            F.sequence(F.lit(1), F.size(parts) - 1),
            lambda n: _verdict(F.array_join(F.slice(parts, F.lit(1), n), "/"), globs, is_dir=True) == 1,
        ),
    ).otherwise(F.lit(False))
    return above | matches(path, lines)

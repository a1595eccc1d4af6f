"""What a text must contain before a pattern is worth running.

The literals every match of a pattern contains are read off the parsed pattern,
once, on the driver. Two shortcuts follow:

* a gate: one small regular expression per rule group finds, in a single pass
  over a text, which short pieces of these literals occur at all. Pieces start
  with a character that is rare in text, so nearly every position is dismissed
  by one class test, however many rules there are;
* the literal itself, found by a plain substring search for rules past the gate.

A pattern with no certain literal (or one that does not parse here) is always
tried.
"""

from __future__ import annotations

import re
import re._constants as C
import re._parser as parser
import warnings
from collections.abc import Iterable
from functools import lru_cache

MAX_ALTERNATIVES = 24
PIECE = 6
# About how many of a thousand characters of prose and code are this one; others are rarer.
SHARE = {
    " ": 150, "e": 95, "t": 72, "a": 65, "o": 60, "i": 58, "n": 56, "s": 54, "r": 52, "l": 36, "h": 34, "d": 31, "c": 28,
    "u": 24, "m": 22, "p": 20, "f": 19, "g": 17, ".": 15, "y": 14, "b": 13, "w": 13, ",": 11, "v": 10, "(": 8, ")": 8,
    "k": 7, "_": 7, "'": 6, '"': 6, "=": 6, ":": 6, "-": 6, "/": 5, "x": 4, "0": 4, "1": 4, "2": 3, "j": 2, "q": 2, "z": 2,
}
RARE = 1
SURE = 3   # a piece this long is selective whatever it starts with


def _sets_within_sets(pattern: str) -> bool:
    """Whether a class holds a class or an intersection: the matcher reads those as sets, the parser here does not."""
    inside, i = -1, 0  # where the class began
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            i += 1
        elif inside < 0:
            if c == "[":
                inside = i + pattern.startswith("[^", i)
        elif c == "[" or pattern.startswith("&&", i):
            return True
        elif c == "]" and i > inside + 1:
            inside = -1
        i += 1
    return False


def _parse(pattern: str):
    if _sets_within_sets(pattern):
        return None
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("error")  # nested and intersected classes mean something else to the matcher
            return parser.parse(pattern)
    except Exception:
        return None


def least_width(pattern: str) -> int | None:
    """Length of the shortest match; None for a pattern that does not parse here."""
    tree = _parse(pattern)
    return None if tree is None else tree.getwidth()[0]


def _worth(options) -> int:
    """Length of the weakest literal: what the search is sure to look for."""
    return min(map(len, options)) if options else 0


def _choices(op, arg) -> list[str] | None:
    """The characters one item can be, when they are few."""
    if op is C.LITERAL:
        return [chr(arg)]
    if op is C.IN and len(arg) <= 3 and all(o is C.LITERAL for o, _ in arg):
        return [chr(a) for _, a in arg]
    return None


def _option_sets(items) -> list[list[str]]:
    """Sets of literals; every match contains one of each set."""
    out: list[list[str]] = []
    runs = [""]
    for op, arg in [*items, (None, None)]:
        choices = _choices(op, arg)
        if choices and len(runs) * len(choices) <= MAX_ALTERNATIVES:
            runs = [r + c for r in runs for c in choices]
            continue
        if runs[0]:
            out.append(runs)
        runs = choices or [""]
        if op is C.SUBPATTERN:
            out += _option_sets(arg[3])
        elif op is C.BRANCH:
            sides = [_option_sets(side) for side in arg[1]]
            if all(sides):
                out.append(sorted({x for side in sides for x in max(side, key=_worth)}))
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT) and arg[0] >= 1:
            out += _option_sets(arg[2])
        elif op is C.ATOMIC_GROUP:
            out += _option_sets(arg)
    return [x for x in out if len(x) <= MAX_ALTERNATIVES and _worth(x) >= 2 and all(y.isascii() for y in x)]


def _folds(items, flags: int) -> bool:
    if flags & C.SRE_FLAG_IGNORECASE:
        return True
    for op, arg in items:
        if op is C.SUBPATTERN and (arg[1] & C.SRE_FLAG_IGNORECASE or _folds(arg[3], 0)):
            return True
        if op is C.BRANCH and any(_folds(side, 0) for side in arg[1]):
            return True
        if op in (C.MAX_REPEAT, C.MIN_REPEAT) and _folds(arg[2], 0):
            return True
    return False


@lru_cache(maxsize=None)
def _analysed(pattern: str) -> tuple[tuple[tuple[str, ...], ...], bool]:
    tree = _parse(pattern)
    if tree is None:
        return (), False
    folds = _folds(tree, tree.state.flags)
    return tuple(tuple(x.lower() if folds else x for x in o) for o in _option_sets(tree)), folds


def needed_literals(pattern: str) -> tuple[tuple[str, ...], bool]:
    """(any-of literals, compare lower-cased); no literals means no shortcut."""
    options, folds = _analysed(pattern)
    return max(options, key=lambda o: (_worth(o), -len(o)), default=()), folds


def _share(ch: str) -> int:
    return SHARE.get(ch, RARE)


def _pieces(literal: str) -> dict[str, str]:
    """Start character -> part of a literal, lower-cased, that is selective enough to search for."""
    text = literal.lower()
    out: dict[str, str] = {}
    for i in range(len(text)):
        # A short tail is only accepted behind a very rare character.
        if i == 0 or len(text) - i >= SURE or (len(text) - i == 2 and _share(text[i]) <= 2):
            out.setdefault(text[i], text[i:i + PIECE])
    return out


def _choose(option_sets, allowed: set[str]) -> list[str] | None:
    """Pieces of the best option whose pieces all start with allowed characters."""
    best = None
    for options in option_sets:
        parts = [
            min(((_share(c), p) for c, p in _pieces(x).items() if c in allowed), default=None) for x in options
        ]
        if all(parts):
            cost = (sum(share for share, _ in parts), -min(len(p) for _, p in parts))
            if best is None or cost < best[0]:
                best = (cost, [p for _, p in parts])
    return best and best[1]


@lru_cache(maxsize=256)
def gate_pieces(patterns: tuple[str, ...]) -> list[tuple[str, ...]]:
    """Per pattern the pieces one of which its matches contain; no piece starts another.

    Characters are struck off from the most frequent down as long as every
    pattern keeps a choice, so few positions of a text can start any piece.
    """
    option_sets = [_analysed(p)[0] for p in patterns]
    asking = [o for o in option_sets if o]
    allowed = {c for o in asking for options in o for x in options for c in _pieces(x)}
    for c in sorted(allowed, key=lambda c: (-_share(c), c)):
        if all(_choose(o, allowed - {c}) for o in asking):
            allowed.discard(c)
    chosen = [_choose(o, allowed) or [] for o in option_sets]
    # Where one piece is the beginning of another, the shorter stands for both: it is still
    # contained in every match, and at any position at most one piece is found.
    every = sorted({x for pieces in chosen for x in pieces}, key=len)
    short: dict[str, str] = {}
    for x in every:
        short[x] = next((x[:n] for n in range(1, len(x)) if short.get(x[:n]) == x[:n]), x)
    return [tuple(sorted({short[x] for x in pieces})) for pieces in chosen]


def gate_regex(pieces: Iterable[str]) -> str:
    """Pattern whose group 1 is the piece found at a position; it consumes nothing."""
    by_start: dict[str, list[str]] = {}
    for x in sorted(set(pieces)):
        by_start.setdefault(x[0], []).append(x[1:])
    starts = "".join(sorted({re.escape(c) for c in by_start} | {re.escape(c.upper()) for c in by_start}))
    tails = "|".join(f"{re.escape(c)}(?:{'|'.join(map(re.escape, rest))})" for c, rest in by_start.items())
    return f"(?=[{starts}])(?i)(?=({tails}))"

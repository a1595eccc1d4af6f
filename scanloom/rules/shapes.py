"""Words for stating what a rule looks for: calls, arguments, settings, request values.

A rule says which callee, in which argument place, meets which kind of value; the pattern follows
from that. Stretches of free text are runs of one character class, and no group with a variable body
is repeated: a matcher that recurses per repetition of a group can read a text of any length.
Patterns keep to what backtracking and automaton matchers share.
"""

from __future__ import annotations

import re

BLANK = r"\s*"


def either(*options: str) -> str:
    return options[0] if len(options) == 1 else f"(?:{'|'.join(options)})"


def plain(*texts: str) -> str:
    """One of some fixed texts."""
    return either(*(re.escape(t) for t in texts))


def word(*texts: str) -> str:
    """One of some fixed texts that stands on its own."""
    return rf"\b{plain(*texts)}\b"


def run(without: str, least: int = 0, lazy: bool = False) -> str:
    """Any characters but the given ones."""
    return f"[^{without}]{'+' if least else '*'}" + "?" * lazy


def spaced(*parts: str) -> str:
    """Parts with blanks allowed between them."""
    return BLANK.join(parts)


def call(callee: str, *inside: str) -> str:
    """A call; what follows the parenthesis may be stated."""
    return spaced(rf"\b{callee}", r"\(", *inside)


def method(callee: str, *inside: str) -> str:
    """A call on some receiver."""
    return spaced(rf"\.{callee}", r"\(", *inside)


def skip(n: int) -> str:
    """n arguments that are no calls themselves."""
    return spaced(*[rf"{run(',()', 1)},"] * n)


def somewhere(what: str, without: str = ")") -> str:
    """Something later in the same stretch."""
    return run(without, lazy=True) + what


def quoted(inner: str = "") -> str:
    return rf"""["']{inner}["']"""


def go_text(inner: str) -> str:
    """A Go literal, plain or raw."""
    return f'["`]{inner}["`]'


def setting(key: str, value: str, sign: str = ":") -> str:
    """`key: value` or `key = value`."""
    return spaced(rf"\b{key}", sign, rf"{value}\b")


def at_line(what: str) -> str:
    """At the start of a line; needs the (?m) flag in front of the pattern."""
    return r"^[ \t]*" + what


def built_text(quote: str, hole: str) -> str:
    """A literal of that quote that has a hole for a value."""
    return rf"{quote}{run(quote)}?{hole}"


NAME = r"[A-Za-z_]\w*"
PATH = r"[A-Za-z_][\w.]*"
JS_TEMPLATE = built_text("`", r"\$\{")
JS_REQUEST = rf"req\.{either('body', 'query', 'params', 'cookies', 'headers')}"
JS_VALUE = rf"{JS_REQUEST}\.[A-Za-z_][\w.]*"
GO_VALUE = rf"{NAME}\.{either('FormValue', 'PostFormValue', r'URL[.]Query[(][)][.]Get')}\({run(')')}\)"
PHP_VALUE = r"\$_" + either("GET", "POST", "REQUEST", "COOKIE") + r"\b"
#: One element of what the client sent; the arrays themselves are no text.
PHP_FIELD = r"\$_" + either("COOKIE", "GET", "POST", "REQUEST") + BLANK + r"\["
ENDS = rf"{BLANK}[,)]"


def py_value(*fields: str) -> str:
    """A field of the request, read by key or by a getter."""
    return rf"request\.{either(*fields)}[\w.]*[\[(]{run(r'\])', 1)}[\])]"

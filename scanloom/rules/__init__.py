"""Rules: the record, its validation, and the literal table a scan carries.

A rule set is configuration. It is validated on the driver and travels inside
the plan as one constant, grouped by the route (kind and extension, or file
family) its rules apply to; a file only ever looks at the rules of its route.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable
from dataclasses import asdict, dataclass, fields, replace
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from scanloom.functions.grades import confidence_name, severity_name
from scanloom.functions.lam import lookup, sql_text
from scanloom.rules.literals import gate_pieces, gate_regex, least_width, needed_literals
from scanloom.schema import CATEGORIES, KINDS

# A scan's constant must stay small next to the data it meets; more rules take several passes.
PASS_RULES = 10_000
PASS_RULE_BYTES = 8 << 20


# Detector families in registry order.
FAMILIES = {
    name: i for i, name in enumerate((
        "secrets", "crypto", "injection", "network", "workflow", "infrastructure", "deserialization",
        "path-traversal", "ssrf", "xss", "open-redirect", "ssti", "xxe", "nosqli", "web-config", "jwt",
        "orm", "ldap", "memory", "nestjs", "nextjs", "axum", "django", "flask", "spring-boot", "redos",
        "user", "dependencies", "performance",
    ))
}


class RuleError(ValueError):
    """A rule, glob or setting that cannot be used."""


@dataclass(frozen=True)
class Rule:
    code: str
    pattern: str
    message: str = ""
    # With a trailer the message quotes the match: `match` trailer.
    trailer: str = ""
    quote: str = "call"  # call | clip | line
    severity: str = "medium"
    confidence: str = "high"
    category: str = "security"
    help: str | None = None
    extensions: tuple[str, ...] = ()
    kinds: tuple[str, ...] = ("source",)
    # dockerfile, terraform, kubernetes or workflow; then extensions and kinds are not used.
    family: str = ""
    path_pattern: str = ""
    all_of: tuple[str, ...] = ()
    none_of: tuple[str, ...] = ()
    max_matches: int = 0
    line_exclude: str = ""
    allow: tuple[str, ...] = ()
    min_entropy: float = 0.0
    # Project-scoped framework, scan-scoped framework, and the marker that exempts a project.
    framework: str = ""
    scan_framework: str = ""
    exempt_marker: str = ""
    detector: str = "user"
    family_no: int = 26
    rule_no: int = 0


_TUPLES = {f.name for f in fields(Rule) if "tuple" in str(f.type)}


def _jvm_compiles(spark: SparkSession, pattern: str) -> str | None:
    """None when the pattern compiles for the engine that will run it, else the reason."""
    try:
        spark._jvm.java.util.regex.Pattern.compile(pattern)
        return None
    except Exception as err:  # py4j wraps PatternSyntaxException
        return str(getattr(err, "java_exception", err)).splitlines()[0]


def load_rules(source, spark: SparkSession | None = None, first_no: int = 0) -> list[Rule]:
    """Validate user rules given as dicts or as a small table.

    ``id``, ``pattern`` and ``message`` must be non-blank, the pattern must
    compile and the severity must parse. Defaults: medium, security, any
    extension, source and config files.
    """
    if isinstance(source, DataFrame):
        spark = spark or source.sparkSession
        source = [r.asDict(recursive=True) for r in source.collect()]  # rules are configuration
    spark = spark or SparkSession.getActiveSession()
    out = []
    for i, raw in enumerate(source):
        code = str(raw.get("id") or raw.get("code") or "")
        for key, value in (("id", code), ("pattern", raw.get("pattern")), ("message", raw.get("message"))):
            if not str(value or "").strip():
                raise RuleError(f"rule '{code}': `{key}` is empty")
        severity = severity_name(raw.get("severity") or "medium")
        if severity is None:
            raise RuleError(f"rule '{code}': unknown severity {raw['severity']!r}")
        confidence = confidence_name(raw.get("confidence") or "high")
        if confidence is None:
            raise RuleError(f"rule '{code}': unknown confidence {raw['confidence']!r}")
        category = raw.get("category") or "security"
        if category not in CATEGORIES:
            raise RuleError(f"rule '{code}': unknown category {category!r}")
        kinds = tuple(raw.get("kinds") or ("source", "config"))
        if not set(kinds) <= set(KINDS):
            raise RuleError(f"rule '{code}': unknown kind in {kinds}")
        reason = _jvm_compiles(spark, raw["pattern"]) if spark else None
        if reason:
            raise RuleError(f"rule '{code}': pattern does not compile: {reason}")
        if may_match_nothing(raw["pattern"]):
            raise RuleError(f"rule '{code}': pattern matches the empty text")
        for pattern in (raw["pattern"], *(raw.get("all_of") or ()), *(raw.get("none_of") or ())):
            if open_loop(pattern):
                raise RuleError(f"rule '{code}': a repeated group holds a choice or repetition; make its loop possessive or use a character class")
        extra = {
            k: (tuple(v) if k in _TUPLES else v)
            for k, v in raw.items()
            if k in {f.name for f in fields(Rule)} and v is not None
        }
        extra.update(
            code=code, severity=severity, confidence=confidence, category=category, kinds=kinds,
            extensions=tuple(e.lstrip(".").lower() for e in (raw.get("extensions") or ()) if e),
            rule_no=first_no + i,
        )
        extra.setdefault("family_no", FAMILIES["user"])
        out.append(Rule(**extra))
    return out


# --- the constant a scan carries -------------------------------------------

RULE_DDL = (
    "struct<code:string,pattern:string,message:string,trailer:string,quote:string,severity:string,"
    "confidence:string,category:string,help:string,path_pattern:string,all_of:array<string>,"
    "none_of:array<string>,max_matches:int,line_exclude:string,allow:array<string>,min_entropy:double,"
    "family_no:int,rule_no:int,pieces:array<string>,needles:array<string>,fold:boolean>"
)
_CARRIED = (
    "code", "message", "trailer", "quote", "severity", "confidence", "category", "help", "path_pattern",
    "max_matches", "line_exclude", "allow", "min_entropy", "family_no", "rule_no",
)


def unix_lines(pattern: str) -> str:
    """Only a line feed ends a line."""
    return "(?d)" + pattern


def _record(rule: Rule) -> dict:
    data = asdict(rule)
    out = {k: data[k] for k in _CARRIED}
    out["pattern"] = unix_lines(rule.pattern)
    out["all_of"] = [unix_lines(p) for p in rule.all_of]
    out["none_of"] = [unix_lines(p) for p in rule.none_of]
    out["needles"], out["fold"] = needed_literals(rule.pattern)
    out["line_exclude"] = rule.line_exclude and unix_lines(rule.line_exclude)
    return out


def routes(rule: Rule) -> list[str]:
    """Keys under which a file may meet this rule."""
    if rule.family:
        return [f"family:{rule.family}"]
    return [f"{k}:{e}" for k in rule.kinds for e in (rule.extensions or ("*",))]


def passes(rules: Iterable[Rule]) -> list[tuple[Rule, ...]]:
    """Rules in as many parts as their number and size ask for, in order."""
    out: list[list[Rule]] = [[]]
    held = 0
    for r in rules:
        if out[-1] and (len(out[-1]) == PASS_RULES or held + len(r.pattern) > PASS_RULE_BYTES):
            out.append([])
            held = 0
        out[-1].append(r)
        held += len(r.pattern)
    return [tuple(part) for part in out]


def open_loop(pattern: str) -> bool:
    """Whether a group with a choice or a repetition inside is itself repeated without a small bound.

    The matcher calls itself for each turn of such a loop, so a long text ends the process. A
    possessive loop (`*+`, `++`) does not.
    """
    groups, i, n, last = [False], 0, len(pattern), False  # whether each open group, and the last closed one, varies
    closed = False
    while i < n:
        c = pattern[i]
        if c == "\\":
            if pattern.startswith("\\Q", i):
                i = (pattern.find("\\E", i) + 2) if "\\E" in pattern[i:] else n
            else:
                i += 2
            closed = False
            continue
        if c == "[":
            depth = 0
            while i < n:
                if pattern[i] == "\\":
                    i += 1
                elif pattern[i] == "[":
                    depth += 1
                elif pattern[i] == "]" and pattern[i - 1] != "[":
                    depth -= 1
                i += 1
                if not depth:
                    break
            closed = False
            continue
        m = re.match(r"[*+?]|\{([0-9]+)(,?)([0-9]*)\}", pattern[i:])
        if c == "(":
            groups.append(False)
            skip = re.match(r"\(\?(?:[:=!>]|<[=!]|<\w+>|[a-zA-Z-]*:)?", pattern[i:])
            i += skip.end() if skip else 1
            closed = False
        elif c == ")":
            last = groups.pop() if len(groups) > 1 else False
            groups[-1] |= last
            closed = True
            i += 1
        elif m:
            end = i + m.end()
            most = 1 if m[0] == "?" else None if m[0] in "*+" else int(m[3]) if m[3] else None if m[2] else int(m[1])
            possessive = end < n and pattern[end] == "+"
            if closed and last and not possessive and (most is None or most > 100):
                return True
            groups[-1] |= m[1] is None or bool(m[2])
            i = end + (1 if end < n and pattern[end] in "+?" else 0)
            closed = False
        else:
            groups[-1] |= c == "|"
            closed = False
            i += 1
    return False


def may_match_nothing(pattern: str) -> bool:
    width = least_width(pattern)
    return width == 0


@dataclass(frozen=True)
class RuleTable:
    """What a scan carries: groups of rules, the gate of each group, and the way from a route to its group."""

    groups: tuple[tuple[Rule, ...], ...]
    pieces: tuple[tuple[tuple[str, ...], ...], ...]
    group_of: dict[str, int]

    def numbers(self, keys: Column) -> Column:
        """Groups of a file. The first two keys are the kind with and without the extension; the rest are families."""
        of = lambda k: lookup(self.group_of, k, "int")
        return F.array_compact(F.concat(
            F.array(F.coalesce(of(F.get(keys, 0)), of(F.get(keys, 1)))), F.transform(F.slice(keys, 3, 2), of)))

    def rules(self, numbers: str) -> Column:
        """All rules of the groups in a column; the table is one constant, each group in it once."""
        table = [
            [{**_record(r), "pieces": ps} for r, ps in zip(rules, pieces)] for rules, pieces in zip(self.groups, self.pieces)
        ]
        constant = F.from_json(F.lit(json.dumps(table)), f"array<array<{RULE_DDL}>>")
        return F.flatten(F.transform(F.col(numbers), lambda g: F.get(constant, g)))

    def found(self, numbers: str, content: str) -> Column:
        """Gate pieces that occur in a text: one branch per group, each with its constant pattern."""
        branches = "".join(
            f" WHEN {i} THEN regexp_extract_all({content}, {sql_text(gate_regex(asked))}, 1)"
            for i, pieces in enumerate(self.pieces) if (asked := {p for ps in pieces for p in ps})
        )
        none = "cast(array() AS array<string>)"
        gate = f"CASE g{branches} ELSE {none} END" if branches else none
        return F.expr(f"transform(array_distinct(flatten(transform({numbers}, g -> {gate}))), p -> lower(p))")


@lru_cache(maxsize=32)
def rule_table(rules: tuple[Rule, ...]) -> RuleTable:
    """Group rules by route. Routes with the same rules share a group, and rules for any
    extension join the group of every extension of their kind: a text passes one gate, not two."""
    by_route: dict[str, list[int]] = {}
    for i, r in enumerate(rules):
        for key in routes(r):
            by_route.setdefault(key, []).append(i)
    merged = {key: sorted({*ids, *by_route.get(key.split(":", 1)[0] + ":*", [])}) for key, ids in by_route.items()}
    numbers: dict[tuple, int] = {}
    group_of = {key: numbers.setdefault(tuple(ids), len(numbers)) for key, ids in merged.items()}
    groups = tuple(tuple(rules[i] for i in ids) for ids in numbers)
    return RuleTable(groups, tuple(tuple(gate_pieces(tuple(r.pattern for r in g))) for g in groups), group_of)


def with_numbers(rules: Iterable[Rule]) -> list[Rule]:
    return [replace(r, rule_no=i) for i, r in enumerate(rules)]

"""Scope-aware line checks: is this line inside a loop, or inside an async function?

Lines are folded once per file with a stack of open loops and functions:
indentation opens and closes them in Python, braces elsewhere. It is a line
heuristic: strings and comments that look like code count as code.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import Column, DataFrame, functions as F

from scanloom.functions.lam import let
from scanloom.functions.text import char_count
from scanloom.operators.classify import with_kind
from scanloom.operators.scan import spans
from scanloom.rules import FAMILIES
from scanloom.schema import FINDING_COLUMNS

CHUNK = 256


@dataclass(frozen=True)
class ScopeRule:
    code: str
    pattern: str
    needle: str           # literal every hit contains
    extensions: tuple[str, ...]
    language: str
    within: str           # loop | async
    message: str
    severity: str
    help: str
    lead: str = r"\s*"    # context in front of the reported token


# Headers per language. A function or a lambda starts a new scope.
INDENT = {
    "loop": r"^\s*(?:async\s+)?(?:for|while)\b.*:",
    "def": r"^\s*def\b",
    "async": r"^\s*async\s+def\b",
    "inline_loop": r"^\s*(?:async\s+)?(?:for|while)\b.*:\s*\S",
    "reset": r"\blambda\b",
}
BRACES = {
    "js": {
        "loop": r"\bfor\b[^()]*\(.*\)|\bwhile\b|\bdo\b\s*(?:\{|$)",
        "func": r"\bfunction\b|=>|^\s*(?:(?:public|private|protected|static|async|get|set)\s+)*(?!(?:if|for|while|switch|catch|with|return)\b)[\w$]+\s*\([^()]*\)\s*(?::\s*[\w<>\[\]., ]+)?\{",
    },
    "rs": {"loop": r"\b(?:for|while|loop)\b", "func": r"\bfn\b|\|[^|]*\|"},
    "go": {"loop": r"\bfor\b", "func": r"\bfunc\b"},
}
JS_EXT = ("js", "jsx", "ts", "tsx", "mjs", "cjs")
SCOPE_RULES = (
    ScopeRule("PERF-001", r"(?:\+=|\.push_str\s*\()\s*&?\s*format(?=!)", "format!", ("rs",), "rs", "loop",
              "text is formatted into a temporary on every turn", "medium", "Write into the target with write!.",
              lead=r"(?:\+=|\.push_str\s*\()\s*&?\s*"),
    ScopeRule("PERF-101", r"\bawait\b", "await", JS_EXT, "js", "loop",
              "calls are awaited one by one", "low", "Await independent calls together."),
    ScopeRule("PERF-102", r"\bnew\s+Date\s*\(", "Date", JS_EXT, "js", "loop",
              "a date object is built on every turn", "low", "Build it once, or take the timestamp."),
    ScopeRule("PERF-201",
              r"\b[A-Za-z_]\w*\s*\+=\s*\(*\s*(?:[\w.]+(?:\([^()\"']*\))?\s*[-+*/%]\s*)*[rRbBuUfF]{0,2}[\"']", "+=",
              ("py",), "py", "loop", "text grows by copies on every turn", "medium", "Collect parts and join them once."),
    ScopeRule("PERF-202", r"(?<![\w.])time\.sleep\s*\(", "time.sleep", ("py",), "py", "async",
              "a blocking sleep stops the event loop", "high", "Await an asynchronous sleep."),
    ScopeRule("PERF-301", r"^\s*defer\b|(?<=[{;])\s*defer\b", "defer", ("go",), "go", "loop",
              "deferred calls pile up until the function ends", "medium", "Move the body into a function."),
    ScopeRule("PERF-302", r"\bfmt\.Sprintf\s*\(", "fmt.Sprintf", ("go",), "go", "loop",
              "text is formatted into a new value on every turn", "low", "Write into a builder."),
)

_HITS = "array<struct<line:int,offset:bigint,top:string,func:string>>"
_STATE = (
    "struct<depth:int,offset:bigint,pending:string,stack:array<struct<depth:int,kind:string>>,"
    f"full:array<{_HITS}>,cur:{_HITS}>"
)


def _fold(lines: Column, language: str, candidate: str) -> Column:
    """Candidate lines with the innermost scope and the innermost function around them."""

    def note(acc, i, stack, is_candidate):
        hit = F.struct(
            i.alias("line"),
            acc["offset"].alias("offset"),
            F.get(stack, F.size(stack) - 1)["kind"].alias("top"),
            let(F.filter(stack, lambda e: e["kind"] != "loop"), lambda fs: F.get(fs, F.size(fs) - 1)["kind"]).alias("func"),
        )
        # Closed chunks keep appending cheap however many candidates a file has.
        kept = F.when(F.size(acc["cur"]) >= CHUNK, F.array().cast(_HITS)).otherwise(acc["cur"])
        full = F.when(
            is_candidate & (F.size(acc["cur"]) >= CHUNK), F.concat(acc["full"], F.array(acc["cur"]))
        ).otherwise(acc["full"])
        return full, F.when(is_candidate, F.concat(kept, F.array(hit))).otherwise(acc["cur"])

    def close(acc, line, depth, pending, stack, full, cur):
        return F.struct(
            depth.cast("int").alias("depth"),
            (acc["offset"] + F.octet_length(line) + 1).alias("offset"),
            pending.alias("pending"), stack.alias("stack"), full.alias("full"), cur.alias("cur"),
        ).cast(_STATE)

    def indent_line(acc: Column, item: Column) -> Column:
        line, i = item["text"], item["no"]
        header = F.when(F.rlike(line, F.lit(INDENT["async"])), "async").when(
            F.rlike(line, F.lit(INDENT["def"])), "def").when(F.rlike(line, F.lit(INDENT["loop"])), "loop")

        def body(x: Column) -> Column:
            stack = x["stack"]
            full, cur = note(acc, i, stack, F.rlike(line, F.lit(candidate)))
            pushed = F.when(x["header"].isNull(), stack).otherwise(
                F.concat(stack, F.array(F.struct(x["lead"].alias("depth"), x["header"].alias("kind")))))
            return close(acc, line, F.lit(0), F.lit(""), pushed, full, cur)

        return F.when(
            F.rlike(line, F.lit(r"^\s*(?:#|$)")),
            close(acc, line, F.lit(0), F.lit(""), acc["stack"], acc["full"], acc["cur"]),
        ).otherwise(let(
            let(
                F.struct(F.char_length(F.regexp_extract(line, r"^(\s*)", 1)).alias("lead"), header.alias("header")),
                lambda h: F.struct(
                    h["lead"].alias("lead"), h["header"].alias("header"),
                    F.filter(acc["stack"], lambda e: e["depth"] < h["lead"]).alias("stack"),
                ),
            ),
            body,
        ))

    def brace_line(acc: Column, item: Column) -> Column:
        line, i = item["text"], item["no"]

        def body(x: Column) -> Column:
            stack, after, kind = x["stack"], x["after"], x["kind"]
            full, cur = note(acc, i, stack, F.rlike(line, F.lit(candidate)))
            # A header without its brace waits for the next line that opens one.
            entry = F.when(x["opens"], F.coalesce(kind, F.when(acc["pending"] != "", acc["pending"])))
            pushed = F.when(
                entry.isNotNull() & (after > x["before"]),
                F.concat(
                    F.filter(stack, lambda e: e["depth"] <= after),
                    F.array(F.struct(after.alias("depth"), entry.alias("kind"))),
                ),
            ).otherwise(F.filter(stack, lambda e: e["depth"] <= after))
            pending = F.when(~x["opens"] & ~F.rlike(line, F.lit(r"[;}]\s*$")), F.coalesce(kind, F.lit(""))).otherwise(F.lit(""))
            return close(acc, line, after, pending, pushed, full, cur)

        def measured(before: Column) -> Column:
            return F.struct(
                before.alias("before"),
                (acc["depth"] + char_count(line, "{") - char_count(line, "}")).alias("after"),
                F.contains(line, F.lit("{")).alias("opens"),
                _last_header(line, BRACES[language]).alias("kind"),
                F.filter(acc["stack"], lambda e: e["depth"] <= before).alias("stack"),
            )

        # Blank lines and comments change nothing but the position.
        return F.when(
            F.rlike(line, F.lit(r"^\s*(?://|\*|/\*|$)")),
            close(acc, line, acc["depth"], acc["pending"], acc["stack"], acc["full"], acc["cur"]),
        ).otherwise(let(let(acc["depth"] - char_count(F.regexp_extract(line, r"^([\s})\];,]*)", 1), "}"), measured), body))

    start = F.from_json(F.lit('{"depth":0,"offset":0,"pending":"","stack":[],"full":[],"cur":[]}'), _STATE)
    numbered = F.transform(lines, lambda t, i: F.struct(t.alias("text"), i.alias("no")))
    return F.aggregate(
        numbered, start, indent_line if language == "py" else brace_line,
        lambda s: F.flatten(F.concat(s["full"], F.array(s["cur"]))),
    )


def _last_header(code: Column, words: dict) -> Column:
    """Kind of the last header on a line, null when there is none."""
    rest_loop = F.element_at(F.split(code, words["loop"], F.lit(-1)), -1)
    rest_func = F.element_at(F.split(code, words["func"], F.lit(-1)), -1)
    has_loop = F.rlike(code, F.lit(words["loop"]))
    has_func = F.rlike(code, F.lit(words["func"]))
    return (
        F.when(has_loop & has_func, F.when(F.octet_length(rest_loop) < F.octet_length(rest_func), "loop").otherwise("func"))
        .when(has_loop, "loop").when(has_func, "func")
    )


def _inside(rule: ScopeRule, before: Column, hit: Column) -> Column:
    """Does the scope hold, given the text in front of the token on its own line?"""
    if rule.language == "py":
        fresh = F.rlike(before, F.lit(INDENT["reset"]))
        if rule.within == "async":
            same = F.when(F.rlike(before, F.lit(r"^\s*async\s+def\b.*:")), True).when(
                F.rlike(before, F.lit(r"^\s*def\b.*:")), False)
            return ~fresh & F.coalesce(same, hit["func"] == "async", F.lit(False))
        return ~fresh & (F.rlike(before, F.lit(INDENT["loop"])) | F.coalesce(hit["top"] == "loop", F.lit(False)))
    words = dict(BRACES[rule.language])
    if rule.language != "js":
        # A loop on the same line only holds what follows its brace.
        words["loop"] = rf"(?:{words['loop']})[^{{]*\{{"
    return F.coalesce(_last_header(before, words), hit["top"], F.lit("")) == "loop"


def _line_findings(rule: ScopeRule, path: Column, line: Column, hit: Column, rule_no: int) -> Column:
    def emit(m: Column) -> Column:
        shift = F.char_length(F.regexp_extract(m["text"], f"^({rule.lead})", 1))

        def located(token: Column) -> Column:
            return F.struct(
                F.lit(rule.code).alias("code"), F.lit(rule.message).alias("message"),
                F.lit(rule.severity).alias("severity"), F.lit("high").alias("confidence"),
                F.lit("performance").alias("category"), F.lit(rule.help).alias("help"),
                F.struct(
                    path.alias("file"),
                    (hit["offset"] + m["byte_offset"] + m["byte_length"] - token["bytes"]).alias("byte_offset"),
                    token["bytes"].alias("byte_length"),
                    (hit["line"] + 1).cast("int").alias("line"),
                    (m["column"] + token["shift"]).cast("int").alias("column"),
                ).alias("location"),
                F.lit(FAMILIES["performance"]).alias("family_no"), F.lit(rule_no).alias("rule_no"),
            )

        return let(F.struct(
            shift.alias("shift"),
            F.octet_length(F.substring(m["text"], shift + 1, F.lit(1 << 30))).cast("long").alias("bytes"),
        ), located)

    return F.transform(
        F.filter(spans(line, F.lit(rule.pattern)),
                 lambda m: _inside(rule, F.substring(line, F.lit(1), m["column"] - 1), hit)),
        emit,
    )


def _language_findings(rules: list[tuple[int, ScopeRule]], path: Column, content: Column) -> Column:
    """One fold per file for all rules of its language, then the rules on the candidate lines."""
    candidate = "|".join(f"(?:{r.pattern})" for _, r in rules)

    def of_hit(hit: Column, lines: Column) -> Column:
        return let(
            F.get(lines, hit["line"]),
            lambda line: F.flatten(F.array_compact(F.array(*[_line_findings(r, path, line, hit, no) for no, r in rules]))),
        )

    return let(
        F.split(content, "\n"),
        lambda lines: F.flatten(F.transform(
            _fold(lines, rules[0][1].language, candidate), lambda hit: of_hit(hit, lines))),
    )


def scan_scoped(files: DataFrame, rules=SCOPE_RULES, first_no: int = 1000) -> DataFrame:
    """Findings of scope rules in source files; files without a rule's literal are not folded."""
    if "kind" not in files.columns or "ext" not in files.columns:
        files = with_kind(files)
    languages = sorted({e for r in rules for e in r.extensions})
    source = files.filter((F.col("kind") == "source") & F.col("ext").isin(*languages))
    found = _row_findings(tuple(rules), first_no, files.sparkSession.sparkContext.applicationId)
    return source.select(F.inline(found)).select(*FINDING_COLUMNS)


@lru_cache(maxsize=8)
def _row_findings(rules: tuple[ScopeRule, ...], first_no: int, _gateway: int) -> Column:
    """Findings of one file as an expression over ``path, content, ext``; built once per rule set."""
    path, content = F.col("path"), F.col("content")
    found = None
    for language in dict.fromkeys(r.language for r in rules):
        group = [(first_no + i, r) for i, r in enumerate(rules) if r.language == language]
        extensions = sorted({e for _, r in group for e in r.extensions})
        holds = F.lit(False)
        for _, r in group:
            holds = holds | F.contains(content, F.lit(r.needle))
        test = F.col("ext").isin(*extensions) & holds
        value = _language_findings(group, path, content)
        found = F.when(test, value) if found is None else found.when(test, value)
    return found

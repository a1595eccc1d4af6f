"""Pattern scan: files and rules to findings with exact spans.

One narrow pass does all pattern families. Per file, the rules of its route are
a constant array. One gate pattern finds in a single pass which pieces of their
literals occur; a rule survives when its piece, its literal, its path test and
its required and excluded patterns hold, and only then is the pattern itself
run. No row is emitted before there is a hit, so a file is never
copied once per rule and nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import lru_cache, reduce

from pyspark.sql import Column, DataFrame, functions as F

from scanloom.functions import text
from scanloom.functions.lam import let, running
from scanloom.operators.classify import route_keys, with_kind
from scanloom.operators.directives import unsilenced
from scanloom.rules import Rule, passes, routes, rule_table
from scanloom.schema import FINDING_COLUMNS


# --- spans ------------------------------------------------------------------

def spans(content: Column, pattern: Column) -> Column:
    """All non-overlapping matches, left to right, with their positions.

    The text is cut at the matches; piece k and match k-1 together are the step
    from one match to the next, and a running total of the steps (bytes, lines,
    characters since the last line break) is the position of every match.
    """

    def measure(step: Column) -> Column:
        lines = text.char_count(step, "\n")
        return F.struct(
            F.octet_length(step).cast("long").alias("bytes"),
            lines.alias("lines"),
            F.char_length(F.substring_index(step, "\n", -1)).alias("tail"),
        )

    def join(a: Column, b: Column) -> Column:
        return F.struct(
            (a["bytes"] + b["bytes"]).alias("bytes"),
            (a["lines"] + b["lines"]).alias("lines"),
            F.when(b["lines"] > 0, b["tail"]).otherwise(a["tail"] + b["tail"]).alias("tail"),
        )

    def locate(found: Column) -> Column:
        def with_pieces(pieces: Column) -> Column:
            steps = F.transform(
                found,
                lambda _, k: measure(F.concat(
                    F.when(k > 0, F.get(found, k - 1)).otherwise(F.lit("")), F.get(pieces, k)
                )),
            )
            return F.zip_with(
                found,
                let(steps, lambda s: running(s, join)),
                lambda m, at: F.struct(
                    m.alias("text"),
                    at["bytes"].alias("byte_offset"),
                    F.octet_length(m).cast("long").alias("byte_length"),
                    (at["lines"] + 1).cast("int").alias("line"),
                    (at["tail"] + 1).cast("int").alias("column"),
                ),
            )

        # The second pass over the text only happens when the first found something.
        return F.when(F.size(found) > 0, let(F.split(content, pattern, F.lit(-1)), with_pieces))

    return let(F.regexp_extract_all(content, pattern, F.lit(0)), locate)


def with_location(df: DataFrame, content: str, pattern: str) -> DataFrame:
    """One row per match of one pattern: match, byte offset and length, line, column."""
    rest = [c for c in df.columns if c != content]
    return df.select(*rest, F.inline(spans(F.col(content), F.lit("(?d)" + pattern)))).withColumnRenamed("text", "match")


# --- rules ------------------------------------------------------------------

def _worth_trying(rule: Column, content: Column, found: Column) -> Column:
    """Necessary conditions, cheapest first; see ``rules.literals``."""
    return (F.size(rule["pieces"]) == 0) | F.arrays_overlap(rule["pieces"], found) & F.when(
        rule["fold"], let(F.lower(content), lambda low: F.exists(rule["needles"], lambda n: F.contains(low, n)))
    ).otherwise(F.exists(rule["needles"], lambda n: F.contains(content, n)))


def _conditions_hold(rule: Column, content: Column) -> Column:
    return F.forall(rule["all_of"], lambda p: F.rlike(content, p)) & ~F.exists(
        rule["none_of"], lambda p: F.rlike(content, p)
    )


def message_of(rule: Column, match: Column) -> Column:
    """The fixed message, or the whole match, quoted, followed by the trailer. Fingerprints rest on it, so nothing is cut."""
    quoted = (
        F.when(rule["quote"].isin("clip", "line"), text.trimmed(match)).otherwise(text.call_site(match))
    )
    return F.when(rule["trailer"] == "", rule["message"]).otherwise(
        F.concat(F.lit("`"), quoted, F.lit("` "), rule["trailer"])
    )


def _kept(rule: Column, hits: Column, content: Column) -> Column:
    """Match-level filters: how many, which lines, which values."""

    def test(lines: Column):
        return lambda h, i: (
            ((rule["max_matches"] <= 0) | (i < rule["max_matches"]))
            & ((rule["line_exclude"] == "") | ~F.rlike(F.get(lines, h["line"] - 1), rule["line_exclude"]))
            & ~F.array_contains(rule["allow"], h["text"])
            & ((rule["min_entropy"] <= 0) | (text.shannon_entropy(h["text"]) >= rule["min_entropy"]))
        )

    # Lines are only cut for a rule that looks at them.
    return let(
        F.when(rule["line_exclude"] != "", F.split(content, "\n")),
        lambda lines: F.filter(hits, test(lines)),
    )


@lru_cache(maxsize=4)
def _findings_of(honour_directives: bool, _session: str) -> Column:
    """Findings of one text over ``path, content, _rules``; the same for every rule set, so built once."""
    path, content = F.col("path"), F.col("content")

    def findings(rule: Column) -> Column:
        return F.transform(
            _kept(rule, spans(content, rule["pattern"]), content),
            lambda h: F.struct(
                rule["code"].alias("code"),
                message_of(rule, h["text"]).alias("message"),
                rule["severity"].alias("severity"),
                rule["confidence"].alias("confidence"),
                rule["category"].alias("category"),
                rule["help"].alias("help"),
                F.struct(
                    path.alias("file"), h["byte_offset"].alias("byte_offset"), h["byte_length"].alias("byte_length"),
                    h["line"].alias("line"), h["column"].alias("column"),
                ).alias("location"),
                rule["family_no"].alias("family_no"),
                rule["rule_no"].alias("rule_no"),
            ),
        )

    found = F.flatten(F.filter(F.transform(F.col("_rules"), findings), lambda x: x.isNotNull()))
    return let(found, lambda fs: unsilenced(fs, content)) if honour_directives else found


def find(texts: DataFrame, keys: Column, rules: Iterable[Rule], carry=(), honour_directives: bool = False,
         as_rows: bool = True) -> DataFrame:
    """Findings of texts with ``path`` and ``content``, as rows or as an array per text; other columns only if carried.

    Three narrow steps: the groups of a text, the few of their rules worth
    running on it, and their findings. Rows are generated from the expression
    itself: from a column of arrays the optimizer would infer a size filter and
    compute the arrays twice.
    """
    table = rule_table(tuple(rules))
    content = F.col("content")
    grouped = texts.select(*carry, "path", "content", table.numbers(keys).alias("_groups"))
    worth = let(table.found("_groups", "content"), lambda found: F.filter(
        table.rules("_groups"),
        lambda r: ((r["path_pattern"] == "") | F.rlike(F.lower(F.col("path")), r["path_pattern"]))
        & _worth_trying(r, content, found)
        & _conditions_hold(r, content),
    ))
    chosen = grouped.select(*carry, "path", "content", worth.alias("_rules"))
    findings = _findings_of(honour_directives, texts.sparkSession.sparkContext.applicationId)
    return chosen.select(*carry, F.inline(findings) if as_rows else findings.alias("findings"))


def reachable(rules: Iterable[Rule]) -> Column | None:
    """Predicate on (kind, ext) for files some rule could apply to; null when any file could.

    It is a plain filter on stored columns, so on a classified table it is pushed
    into the scan and row groups of other kinds are never read.
    """
    kinds: dict[str, set[str]] = {}
    for r in rules:
        if r.family:
            return None
        for key in routes(r):
            kind, ext = key.split(":", 1)
            kinds.setdefault(kind, set()).add(ext)
    out = F.lit(False)
    for kind, exts in sorted(kinds.items()):
        test = F.col("kind") == kind
        out = out | (test if "*" in exts else test & F.col("ext").isin(*sorted(exts)))
    return out


def scan(files: DataFrame, rules: Iterable[Rule], honour_directives: bool = False) -> DataFrame:
    """Findings of every applicable rule in every file; matches are independent.

    With ``honour_directives`` findings that an inline directive of the same file
    silences are left out right here, while the text is at hand: no join later.
    """
    rules = list(rules)
    if len(parts := passes(rules)) > 1:
        return reduce(DataFrame.unionByName, [scan(files, part, honour_directives) for part in parts])
    if "kind" not in files.columns or "ext" not in files.columns:
        files = with_kind(files)
    wanted = reachable(rules)
    files = files if wanted is None else files.filter(wanted)
    keys = route_keys(F.col("kind"), F.col("ext"), F.col("path"), F.col("content"))
    return find(files, keys, rules, honour_directives=honour_directives).select(*FINDING_COLUMNS)


def scan_texts(texts: DataFrame, rules: Iterable[Rule], carry=()) -> DataFrame:
    """Scan texts that have no kind (history, container members): every rule sees every text."""
    every = F.array(F.lit("other:*"), F.lit("other:*"))
    return reduce(DataFrame.unionByName, [find(texts, every, part, carry) for part in passes(rules)])


def applicable(files: DataFrame, rules: Iterable[Rule]) -> DataFrame:
    """(path, code, rule_no) pairs: which rules a file meets.

    Equi-join of the file's routes with the rules' routes. The rule side is a
    local table of known size, so the planner broadcasts it by its own threshold.
    """
    spark = files.sparkSession
    rows = [(key, r.code, r.rule_no) for r in rules for key in routes(r)]
    table = spark.createDataFrame(rows, "route string, code string, rule_no int")
    if "kind" not in files.columns:
        files = with_kind(files)
    keyed = files.select("path", F.explode(route_keys(
        F.col("kind"), F.col("ext"), F.col("path"), F.col("content"))).alias("route")).filter("route IS NOT NULL")
    return keyed.join(table, "route").select("path", "code", "rule_no")


def scan_compound(files: DataFrame, anchor: str, all_of=(), none_of=(), **rule) -> DataFrame:
    """One finding per file, at the first anchor, when all parts are present and none excluded."""
    spec = Rule(**{"code": "USER-000", "message": "", **rule, "pattern": anchor, "all_of": tuple(all_of),
                   "none_of": tuple(none_of), "max_matches": 1})
    return scan(files, [spec])


def scan_secrets(files: DataFrame, threshold: float = 3.0) -> DataFrame:
    """Credential shapes above an entropy threshold; test files are left out."""
    from scanloom.rules.catalogue import secret_rules

    return scan(files, secret_rules(threshold))

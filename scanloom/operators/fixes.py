"""Fix plan: literal substitutions on the line of a finding, and the rewritten text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from scanloom.functions.lam import let
from scanloom.operators.pipeline import seq
from scanloom.rules import RuleError

# Per code, what is replaced by what, in this order.
SUBSTITUTIONS = {
    "DES-002": (("yaml.load(", "yaml.safe_load("),),
    "CRY-001": (
        ("hashlib.md5(", "hashlib.sha256("),
        ("createHash('md5')", "createHash('sha256')"),
        ('createHash("md5")', 'createHash("sha256")'),
        ('MessageDigest.getInstance("MD5"', 'MessageDigest.getInstance("SHA-256"'),
        ("md5.New()", "sha256.New()"),
        ('"crypto/md5"', '"crypto/sha256"'),
    ),
    "CRY-002": (
        ("hashlib.sha1(", "hashlib.sha256("),
        ("createHash('sha1')", "createHash('sha256')"),
        ('createHash("sha1")', 'createHash("sha256")'),
        ('MessageDigest.getInstance("SHA-1"', 'MessageDigest.getInstance("SHA-256"'),
        ('MessageDigest.getInstance("SHA1"', 'MessageDigest.getInstance("SHA-256"'),
        ("sha1.New()", "sha256.New()"),
        ('"crypto/sha1"', '"crypto/sha256"'),
    ),
}


def _check(subs: dict) -> None:
    """A code applied twice must be a no-op: its results may not contain its own sources."""
    for code, pairs in subs.items():
        for _, new in pairs:
            for old, _ in pairs:
                if old in new:
                    raise RuleError(f"{code}: replacement {new!r} contains {old!r}")


def _rewrite(line: Column, code: Column, subs: dict) -> Column:
    out = None
    for name, pairs in subs.items():
        text = line
        for old, new in pairs:
            text = F.replace(text, F.lit(old), F.lit(new))
        out = F.when(code == name, text) if out is None else out.when(code == name, text)
    return out.otherwise(line)


def _requests(findings: DataFrame, subs: dict) -> DataFrame:
    """Per (path, line, code): how many findings, and the first one's place in the order.

    Only the first finding of a code can change its line, so the rest are counted
    rather than carried: a line with a million findings stays one row.
    """
    return (
        findings.filter(F.col("location").isNotNull() & F.col("code").isin(*subs))
        .groupBy(F.col("location.file").alias("path"), F.coalesce("location.line", F.lit(0)).alias("line"), "code")
        .agg(F.count(F.lit(1)).alias("findings"), F.min(seq()).alias("first"))
    )


def _per_line(findings: DataFrame, subs: dict) -> DataFrame:
    """Per (path, line): the requests in order; at most one per fixable code."""
    return _requests(findings, subs).groupBy("path", "line").agg(
        F.array_sort(F.collect_list(F.struct("first", "code", "findings"))).alias("requests")
    )


def _steps(line: Column, requests: Column, subs: dict) -> Column:
    """Apply the requests one after another; each sees the line the previous one left."""
    start = F.struct(line.alias("text"), F.array().cast(
        "array<struct<code:string,findings:bigint,before:string,after:string>>").alias("done"))

    def step(acc: Column, r: Column) -> Column:
        return let(_rewrite(acc["text"], r["code"], subs), lambda after: F.struct(
            after.alias("text"),
            F.concat(acc["done"], F.array(F.struct(
                r["code"].alias("code"), r["findings"].alias("findings"), acc["text"].alias("before"), after.alias("after"),
            ))).alias("done"),
        ))

    return F.aggregate(requests, start, step)


def plan_fixes(findings: DataFrame, files: DataFrame, subs: dict = SUBSTITUTIONS) -> DataFrame:
    """One row per planned fix: path, line, code, ordinal, status, before, after.

    Status is applied or skipped-no-match; repeats of a code on one line find
    nothing left to replace.
    """
    _check(subs)
    asked = _per_line(findings, subs)
    joined = asked.join(files.select("path", "content"), "path")
    lines = F.split("content", "\n")
    # The text after the last line feed only is a line when it is not empty.
    line = let(lines, lambda ls: F.when(
        (F.col("line") > 0) & ~((F.col("line") == F.size(ls)) & (F.get(ls, F.col("line") - 1) == "")),
        F.get(ls, F.col("line") - 1)))
    plan = joined.select("path", "line", F.inline(let(line, lambda t: _steps(t, F.col("requests"), subs)["done"])))
    changed = F.coalesce(F.col("before") != F.col("after"), F.lit(False))
    return plan.select(
        "path", "line", "code", F.explode(F.sequence(F.lit(1), F.col("findings").cast("int"))).alias("ordinal"),
        changed.alias("changed"), "before", "after",
    ).select(
        "path", "line", "code", "ordinal",
        F.when(F.col("changed") & (F.col("ordinal") == 1), "applied").otherwise("skipped-no-match").alias("status"),
        F.when(F.col("changed") & (F.col("ordinal") == 1), F.col("before")).alias("before"),
        F.when(F.col("changed") & (F.col("ordinal") == 1), F.col("after")).alias("after"),
    )


def fix_counts(plan: DataFrame) -> DataFrame:
    return plan.agg(
        F.count(F.lit(1)).alias("planned"),
        F.count_if(F.col("status") == "applied").alias("applied"),
        F.count_if(F.col("status") == "skipped-no-match").alias("skipped_no_match"),
        F.count_if(F.col("status") == "skipped-already-fixed").alias("skipped_already_fixed"),
    )


def apply_fixes(findings: DataFrame, files: DataFrame, subs: dict = SUBSTITUTIONS) -> DataFrame:
    """(path, content) of files a fix changes.

    The text is rebuilt from slices between the fixed lines, in one pass over
    the lines however many fixes there are.
    """
    _check(subs)
    asked = _per_line(findings, subs).groupBy("path").agg(
        F.array_sort(F.collect_list(F.struct("line", "requests"))).alias("edits")
    )
    joined = files.select("path", "content").join(asked, "path")

    def rebuild(lines: Column) -> Column:
        edits = F.filter(F.col("edits"), lambda e: (e["line"] > 0) & (e["line"] <= F.size(lines)))

        def patched(es: Column) -> Column:
            def part(e: Column, i: Column) -> Column:
                previous = F.when(i > 0, F.get(es, i - 1)["line"]).otherwise(F.lit(0))
                return F.concat(
                    F.slice(lines, previous + 1, e["line"] - previous - 1),
                    F.array(_steps(F.get(lines, e["line"] - 1), e["requests"], subs)["text"]),
                )

            last = F.coalesce(F.get(es, F.size(es) - 1)["line"], F.lit(0))
            tail = F.slice(lines, last + 1, F.size(lines) - last)
            return F.array_join(F.concat(F.flatten(F.transform(es, part)), tail), "\n")

        return let(edits, patched)

    return joined.select("path", "content", let(F.split("content", "\n"), rebuild).alias("fixed")).filter(
        F.col("fixed") != F.col("content")
    ).select("path", F.col("fixed").alias("content"))

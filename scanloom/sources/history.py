"""Secrets in history: every changed text of every non-merge commit."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, functions as F

from scanloom.functions.paths import short_id
from scanloom.operators.scan import scan_texts
from scanloom.rules import Rule
from scanloom.rules.catalogue import secret_rules
from scanloom.schema import FINDING_COLUMNS

EVERY_KIND = ("other",)


def select_commits(commits: DataFrame, since=None, max_commits: int | None = None) -> DataFrame:
    """Non-merge commits, newest first; ``since`` is exclusive."""
    out = commits.filter(~F.col("is_merge"))
    if since is not None:
        out = out.filter(F.col("ts") > F.lit(since).cast("timestamp"))
    if max_commits is not None:
        out = out.orderBy(F.desc("ts"), F.desc("sha")).limit(max_commits)
    return out.select("sha", "author")


def _scannable(revisions: DataFrame) -> DataFrame:
    return revisions.filter(F.col("change").isin("A", "M") & (F.col("content") != ""))


def scan_history(commits: DataFrame, revisions: DataFrame, rules: Iterable[Rule] | None = None,
                 since=None, max_commits: int | None = None) -> DataFrame:
    """Findings at ``path@sha`` with the commit named in the message.

    Texts are scanned where they lie; only findings meet the commit table. A
    bound on the commits filters revisions first, by a semi join on the sha.
    A repeated (sha, path) is the same text, so its findings are merged.
    """
    chosen = select_commits(commits, since, max_commits)
    texts = _scannable(revisions)
    if since is not None or max_commits is not None:
        texts = texts.join(chosen.select("sha"), "sha", "left_semi")
    rules = list(rules) if rules is not None else secret_rules(kinds=EVERY_KIND)
    named = texts.select(
        "sha", F.col("path").alias("_path"), F.concat("path", F.lit("@"), short_id("sha")).alias("path"), "content")
    found = scan_texts(named, rules, carry=("sha", "_path"))
    found = found.dropDuplicates(["sha", "_path", "rule_no", "location"])
    message = F.concat(
        "message", F.lit(" (in "), "_path", F.lit(" @ "), short_id("sha"), F.lit(" by "), "author", F.lit(")"))
    return found.join(chosen, "sha").withColumn("message", message).select(*FINDING_COLUMNS)


def history_stats(commits: DataFrame, revisions: DataFrame, since=None, max_commits: int | None = None) -> DataFrame:
    """One row: commits walked, distinct texts scanned."""
    chosen = select_commits(commits, since, max_commits)
    walked = chosen.agg(F.count(F.lit(1)).alias("commits_walked"))
    texts = (
        _scannable(revisions).select("sha", "path").join(chosen.select("sha"), "sha", "left_semi")
        .distinct().agg(F.count(F.lit(1)))
    )
    return walked.select("commits_walked", texts.scalar().alias("blobs_scanned"))

"""Full audit: detectors over a corpus, then the findings pipeline in its fixed order."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from scanloom.operators import advisories as adv
from scanloom.operators import directives, packages, pipeline, projects, reports, scan, scopes
from scanloom.operators.classify import drop_minified, is_minified, with_kind
from scanloom.rules import FAMILIES, Rule, load_rules
from scanloom.rules.catalogue import builtin_rules
from scanloom.schema import FINDING_COLUMNS
from scanloom.sources.shared import save


@dataclass(frozen=True)
class Detector:
    """Plug-in: a name, which files it wants, and how files become findings."""

    name: str
    analyze: Callable[[DataFrame], DataFrame]
    wants: Callable[[], Column] | None = None


@dataclass
class AuditConfig:
    rules: dict = field(default_factory=dict)
    custom_rules: list = field(default_factory=list)
    ignore: list = field(default_factory=list)
    suppress: list = field(default_factory=list)
    fail_on: str | None = None
    min_severity: str = "low"
    min_confidence: str = "low"
    keep_noise: bool = False
    # Minified texts are left out on demand only.
    include_minified: bool = True


def materialise(df: DataFrame) -> DataFrame:
    """Cut the lineage after the expensive scan, in the shared checkpoint folder.

    Findings are tiny next to the corpus, and later steps use them more than
    once. Where no folder is named the rows are persisted with their lineage, so
    a lost executor costs a rescan of its part and nothing else.
    """
    sc = df.sparkSession.sparkContext
    folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
    if folder and sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return df.checkpoint() if sc.getCheckpointDir() else df.persist()


# Families the pattern scan covers; performance is mixed and stays with the joins.
SETTLED = tuple(sorted({r.family_no for r in builtin_rules()} - {FAMILIES["performance"]} | {FAMILIES["user"]}))


def catalogue_rules(families: Iterable[str] | None = None, custom: Iterable[Rule] = ()) -> list[Rule]:
    chosen = [r for r in builtin_rules() if families is None or r.detector in set(families)]
    return chosen + list(custom)


def note_findings(df: DataFrame, code: str, message: Column, severity: str, category: str, help_: str) -> DataFrame:
    """Findings without a location, one per row of ``df``."""
    family = F.lit(FAMILIES["secrets"] - 1)
    return df.select(
        F.lit(code).alias("code"), message.alias("message"), F.lit(severity).alias("severity"),
        F.lit("high").alias("confidence"), F.lit(category).alias("category"), F.lit(help_).alias("help"),
        F.lit(None).cast("struct<file:string,byte_offset:bigint,byte_length:bigint,line:int,column:int>").alias("location"),
        family.alias("family_no"), F.lit(0).alias("rule_no"),
    )


def default_detectors(config: AuditConfig, advisories: DataFrame | None = None) -> list[Detector]:
    """All pattern families in one pass, scope checks, and advisories when a table is given."""
    custom = load_rules(config.custom_rules, first_no=len(builtin_rules())) if config.custom_rules else []
    rules = catalogue_rules(custom=custom)

    def patterns(files: DataFrame) -> DataFrame:
        # Directives only remove findings, as every step before them does, so the scan
        # can honour them while it has the text.
        found = materialise(scan.scan(files, rules, honour_directives=True))
        known = projects.fingerprint(files)
        gated = projects.gate_by_framework(found, rules, known)
        for r in rules:
            if r.exempt_marker:
                roots = projects.exempt_roots(files, known, r.exempt_marker, r.framework)
                gated = projects.exempt_projects(gated, roots, r.code)
        return gated

    out = [Detector("patterns", patterns), Detector("performance", scopes.scan_scoped)]
    if advisories is not None:
        out.append(Detector("dependencies", lambda files: adv.advisory_findings(
            adv.match_advisories(packages.extract_packages(files), advisories))))
    return out


def run_all(files: DataFrame, detectors: Iterable[Detector], crawl_errors: DataFrame | None = None) -> DataFrame:
    """Findings of all detectors; one that fails becomes a finding and the rest go on.

    Every detector runs as a job of its own and writes its findings to its own folder in the shared place, so it may fail while it is
    planned or while it runs: in either case nothing of it counts but the finding that says so. What is returned reads those
    folders, and no later step runs a detector again.
    """
    spark = files.sparkSession
    parts, failed = [], []
    for d in detectors:
        try:
            wanted = files.filter(d.wants()) if d.wants else files
            parts.append(save(d.analyze(wanted).select(*FINDING_COLUMNS), "findings"))
        except Exception as err:
            failed.append((f"detector '{d.name}' failed: {_reason(err)}",))
    if failed:
        parts.append(note_findings(
            spark.createDataFrame(failed, "text string"), "INT-001", F.col("text"), "medium", "internal",
            "Look at the log of this run."))
    if crawl_errors is not None:
        parts.append(note_findings(
            crawl_errors, "CRAWL-001", F.concat(F.lit("crawl warning: "), F.col("error")), "info", "crawler",
            "Check permissions and run again."))
    return reduce(DataFrame.unionByName, parts) if parts else None


def _reason(err: Exception) -> str:
    """The first line that says something of what went wrong, from the innermost cause that Spark gives."""
    text = str(err).strip()
    own = [line.strip() for line in text.splitlines() if re.match(r"\s*(?:[\w.]+\.)?\w*(?:Error|Exception): ", line)]
    return (own[-1] if own and text.startswith(("Job aborted", "An exception was thrown from", "An error occurred while calling", "[")) else text.splitlines()[0] if text else type(err).__name__)


def configured(findings: DataFrame, config: AuditConfig, keep_noise: bool | None = None) -> DataFrame:
    """Noise, enabled rules, severities, ignore globs, suppress blocks: all narrow."""
    out = findings if (config.keep_noise if keep_noise is None else keep_noise) else pipeline.drop_default_noise(findings)
    out = pipeline.apply_enabled(out, config.rules)
    out = pipeline.override_severity(out, config.rules)
    if config.ignore:
        out = pipeline.ignore_findings(out, config.ignore)
    return pipeline.suppress(out, config.suppress) if config.suppress else out


def _left_out(files: DataFrame, config: AuditConfig, crawl_errors: DataFrame | None) -> DataFrame:
    """One row: errors met while reading, and files not scanned (undecodable, or minified where those are left out)."""
    minified = F.lit(False) if config.include_minified else is_minified("path", "content")
    skipped = files.agg(F.count_if(F.col("content").isNull() | minified).alias("skipped"))
    errors = crawl_errors if crawl_errors is not None else files.limit(0)
    return errors.agg(F.count(F.lit(1)).alias("crawl_errors")).crossJoin(skipped)


@dataclass
class AuditResult:
    findings: DataFrame
    baseline: DataFrame
    projects: DataFrame
    stats: DataFrame
    gate: DataFrame


def audit(files: DataFrame, config: AuditConfig | None = None, baseline: DataFrame | None = None,
          advisories: DataFrame | None = None, detectors: Iterable[Detector] = (),
          crawl_errors: DataFrame | None = None, fail_on: str | None = None) -> AuditResult:
    """Corpus to findings, baseline snapshot, projects, statistics and gate."""
    config = config or AuditConfig()
    files = files if {"kind", "ext"} <= set(files.columns) else with_kind(files)
    every = files
    files = files if config.include_minified else drop_minified(files)
    raw = run_all(files, [*default_detectors(config, advisories), *detectors], crawl_errors)
    kept = configured(raw, config)
    # What the pattern scan did not settle itself: findings of other detectors.
    others = kept.filter(~F.col("family_no").isin(*SETTLED))
    others = directives.apply_directives(others, directives.directives_for(others, files))
    kept = kept.filter(F.col("family_no").isin(*SETTLED)).unionByName(others)
    snapshot = pipeline.fingerprints(kept)
    if baseline is not None:
        kept = pipeline.new_since(kept, baseline)
    kept = pipeline.at_least(kept, config.min_severity, config.min_confidence)
    threshold = pipeline.gate_threshold(fail_on, config.fail_on, config.min_severity)
    return AuditResult(
        findings=kept, baseline=snapshot, projects=projects.fingerprint(files),
        stats=reports.coverage(files).drop("crawl_errors", "skipped").crossJoin(_left_out(every, config, crawl_errors)), gate=pipeline.gate(kept, threshold),
    )

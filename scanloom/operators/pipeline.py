"""Findings pipeline: noise, configuration, ignore globs, baseline, thresholds, gate.

Configuration arrives as Python values (it is a file a person wrote), so most
steps are predicates or constant lookups and keep findings where they are. A
table of codes can be passed instead; then the step is a join whose small side
the planner broadcasts by its own size threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from scanloom.functions import globs, paths
from scanloom.functions.grades import SEVERITY_ALIASES, confidence_ord, parse_severity, severity_name, severity_ord
from scanloom.functions.lam import lookup
from scanloom.rules import RuleError
from scanloom.schema import CONFIDENCES, SEVERITIES

# Codes that are noise in sample trees, and the names of such trees.
NOISY_CODES = ("SEC-006", "SEC-007")
SAMPLE_SEGMENTS = (
    "tests", "test", "unittests", "unittest", "spec", "specs", "__tests__", "fixtures", "fixture", "samples",
    "sample", "examples", "example", "testdata", "test-fixtures", "test_fixtures",
)


def seq(prefix: str = "") -> Column:
    """Total order of findings: detector, path, rule, offset."""
    c = lambda name: F.col(prefix + name)
    return F.struct(
        c("family_no").alias("family"), c("location.file").alias("file"),
        c("rule_no").alias("rule"), c("location.byte_offset").alias("offset"),
    )


def drop_default_noise(findings: DataFrame) -> DataFrame:
    parts = F.split(F.lower(F.col("location.file")), "/")
    sample = F.arrays_overlap(parts, F.array(*[F.lit(s) for s in SAMPLE_SEGMENTS]))
    return findings.filter(~(F.col("code").isin(*NOISY_CODES) & F.coalesce(sample, F.lit(False))))


def rule_settings(config: dict) -> dict[str, tuple[bool, str | None]]:
    """Validate ``{code: bool | {enabled, severity}}`` into (enabled, severity override)."""
    out = {}
    for code, value in config.items():
        if isinstance(value, bool):
            out[code] = (value, None)
            continue
        severity = value.get("severity")
        if severity is not None and severity_name(severity) is None:
            raise RuleError(f"{code}: unknown severity {severity!r}")
        enabled = value.get("enabled")
        out[code] = (True if enabled is None else enabled, severity and severity_name(severity))
    return out


def apply_enabled(findings: DataFrame, config) -> DataFrame:
    """Drop findings of disabled codes."""
    if isinstance(config, DataFrame):
        off = config.filter(~F.coalesce("enabled", F.lit(True))).select("code").distinct()
        return findings.join(off, "code", "left_anti").select(*findings.columns)
    off = sorted(code for code, (enabled, _) in rule_settings(config).items() if not enabled)
    return findings.filter(~F.col("code").isin(*off)) if off else findings


def override_severity(findings: DataFrame, config) -> DataFrame:
    """Replace the severity of configured codes."""
    if isinstance(config, DataFrame):
        new = config.select("code", parse_severity("severity").alias("_severity")).filter("_severity is not null")
        # One setting per code, whatever the table holds.
        new = new.groupBy("code").agg(F.max("_severity").alias("_severity"))
        return findings.join(new, "code", "left").withColumn(
            "severity", F.coalesce("_severity", "severity")).select(*findings.columns)
    new = {code: severity for code, (_, severity) in rule_settings(config).items() if severity}
    if not new:
        return findings
    return findings.withColumn("severity", F.coalesce(lookup(new, F.col("code")), F.col("severity")))


def ignore_findings(findings: DataFrame, patterns) -> DataFrame:
    """Drop findings whose path an ignore glob matches; without a location they stay."""
    file = F.col("location.file")
    return findings.filter(file.isNull() | ~globs.matches(paths.normalize(file), patterns))


def suppress(findings: DataFrame, blocks) -> DataFrame:
    """Drop findings by (path glob, codes) blocks; codes default to all."""
    hit = F.lit(False)
    for block in blocks:
        path = (block.get("path") or block.get("path_glob") or "").strip()
        if not path:
            raise RuleError("suppress block without a path")
        codes = list(block.get("rules") or ["*"])
        match = globs.matches(paths.normalize(F.col("location.file")), [path])
        hit = hit | (match if "*" in codes else match & F.col("code").isin(*codes))
    return findings.filter(F.col("location.file").isNull() | ~hit)


# --- baseline ---------------------------------------------------------------

def fingerprint_of() -> Column:
    return F.concat_ws(
        "|", F.col("code"), F.coalesce(paths.normalize("location.file"), F.lit("")),
        F.coalesce(F.col("location.line"), F.lit(0)).cast("string"), F.col("message"),
    )


def fingerprints(findings: DataFrame) -> DataFrame:
    """Distinct fingerprints, sorted."""
    return findings.select(fingerprint_of().alias("fingerprint")).distinct().orderBy("fingerprint")


def fingerprint_key(fingerprint: Column) -> Column:
    """128 bits that stand for a fingerprint in joins, however long its message is."""
    return F.unhex(F.md5(fingerprint))


def new_since(findings: DataFrame, baseline: DataFrame) -> DataFrame:
    """Findings whose fingerprint the baseline does not hold; of the baseline only keys of 16 bytes move."""
    known = baseline.select(fingerprint_key(F.col("fingerprint")).alias("_key"))
    return findings.join(known, fingerprint_key(fingerprint_of()) == F.col("_key"), "left_anti")


# --- thresholds -------------------------------------------------------------

def at_least(findings: DataFrame, severity: str = "low", confidence: str = "low") -> DataFrame:
    lowest = SEVERITIES.index(_known(severity))
    surest = CONFIDENCES.index(confidence)
    return findings.filter((severity_ord("severity") >= lowest) & (confidence_ord("confidence") >= surest))


def _known(severity: str) -> str:
    name = severity_name(severity)
    if name is None:
        raise RuleError(f"unknown severity {severity!r}; one of {sorted(set(SEVERITY_ALIASES))}")
    return name


def gate_threshold(fail_on: str | None = None, config_fail_on: str | None = None, min_severity: str = "low") -> str | None:
    """Explicit value, else the configured one, else the severity floor; ``never``/``none`` turn it off."""
    value = fail_on or config_fail_on or min_severity
    return None if value.lower() in ("never", "none") else _known(value)


def gate(findings: DataFrame, threshold: str | None) -> DataFrame:
    """One row: does any surviving finding reach the threshold?"""
    if threshold is None:
        return findings.agg(F.lit(False).alias("failed"))
    level = SEVERITIES.index(_known(threshold))
    return findings.agg(F.coalesce(F.bool_or(severity_ord("severity") >= level), F.lit(False)).alias("failed"))

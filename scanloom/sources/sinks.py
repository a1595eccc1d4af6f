"""Sinks: findings as JSON or Parquet, and the baseline of known fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from scanloom.operators.classify import with_kind
from scanloom.operators.pipeline import fingerprint_key, fingerprint_of
from scanloom.sources.shared import save

BASELINE_VERSION = 1


class BaselineError(ValueError):
    """A baseline that cannot be read."""


def write_corpus(files: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Store a classified corpus by kind, so that every later scan prunes what it does not need.

    ``kind`` is a partition and ``ext`` a column with statistics: the manifest
    and lock-file passes of an audit then read a sliver of the data.
    """
    classified = files if {"kind", "ext"} <= set(files.columns) else with_kind(files)
    classified.write.mode(mode).partitionBy("kind").parquet(path)


def write_findings(findings: DataFrame, path: str, fmt: str = "json", mode: str = "errorifexists") -> None:
    """One record per finding, written by the executors."""
    writer = findings.write.mode(mode)
    if fmt == "json":
        writer.option("ignoreNullFields", False).json(path)
    else:
        writer.format(fmt).save(path)


def report_lines(findings: DataFrame, stats: DataFrame, projects: DataFrame | None = None) -> DataFrame:
    """(section, record) JSON lines of a whole report: findings, stats and projects.

    A report is a set of records rather than one document, so it has no size limit.
    """
    out = findings.select(F.lit("finding").alias("section"), F.to_json(F.struct("*")).alias("record"))
    out = out.unionByName(stats.select(F.lit("stats").alias("section"), F.to_json(F.struct("*")).alias("record")))
    if projects is not None:
        out = out.unionByName(projects.select(F.lit("project").alias("section"), F.to_json(F.struct("*")).alias("record")))
    return out


def _run(prints: DataFrame) -> DataFrame:
    """A run of a baseline: fingerprints in the order of their keys, so a file covers a range of keys."""
    keyed = prints.withColumns({"key": fingerprint_key(F.col("fingerprint")), "version": F.lit(BASELINE_VERSION)})
    return keyed.repartitionByRange("key").sortWithinPartitions("key").select("fingerprint", "version", "key")


def write_baseline(findings: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Versioned list of distinct fingerprints, as one run."""
    _run(findings.select(fingerprint_of().alias("fingerprint")).distinct()).write.mode(mode).parquet(path)


def merge_baseline(findings: DataFrame, path: str) -> None:
    """Add what a baseline does not hold yet as a further run; earlier runs stay as they are, and a second call adds nothing."""
    known = read_baseline(findings.sparkSession, path).select(fingerprint_key(F.col("fingerprint")).alias("_key"))
    new = findings.select(fingerprint_of().alias("fingerprint")).distinct()
    # Written aside first: a run is appended whole or not at all, and never reads what it adds to.
    run = save(_run(new.join(known, fingerprint_key(F.col("fingerprint")) == F.col("_key"), "left_anti")), "baseline-run")
    if not run.isEmpty():
        run.write.mode("append").parquet(path)


def compact_baseline(spark: SparkSession, path: str, target: str) -> None:
    """All runs as one, at another place."""
    _run(read_baseline(spark, path).distinct()).write.mode("errorifexists").parquet(target)


def read_baseline(spark: SparkSession, path: str) -> DataFrame:
    """The fingerprints of all runs of a baseline; an unknown version fails when it is read."""
    raw = spark.read.schema("fingerprint string, version int").parquet(path)
    known = F.when(F.col("version") == BASELINE_VERSION, F.col("fingerprint")).otherwise(
        F.raise_error(F.concat(F.lit("unknown baseline version "), F.col("version").cast("string"))))
    return raw.select(known.alias("fingerprint"))

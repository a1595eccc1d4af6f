"""Reports: counts, shares, roll-ups, ranked excerpts, labels and annotation lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from scanloom.functions import paths, text
from scanloom.functions.grades import annotation_level
from scanloom.operators.order import with_positions
from scanloom.operators.pipeline import seq
from scanloom.schema import CATEGORIES, SEVERITIES

# How many findings of a severity an excerpt shows; None shows all.
CAPS = {"critical": None, "high": 10, "medium": 5, "low": 5, "info": 0}


def _buckets(findings: DataFrame, column: str, names) -> DataFrame:
    """Count of every named bucket, zeros included, from one partial aggregate."""
    counted = findings.agg(*[F.count_if(F.col(column) == n).alias(n) for n in names])
    rows = F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(n).alias(column), F.col(n).alias("findings")) for i, n in enumerate(names)
    ])
    return counted.select(F.inline(rows))


def severity_counts(findings: DataFrame) -> DataFrame:
    """position, severity, findings; critical first."""
    return _buckets(findings, "severity", tuple(reversed(SEVERITIES)))


def category_counts(findings: DataFrame) -> DataFrame:
    return _buckets(findings, "category", CATEGORIES)


def coverage(files: DataFrame, errors: int = 0, skipped: int = 0) -> DataFrame:
    """One row of file counts by kind and bytes; test files count in the total only."""
    kind = lambda k: F.count_if(F.col("kind") == k)
    return files.agg(
        F.count(F.lit(1)).alias("files_scanned"),
        kind("manifest").alias("manifests"), kind("source").alias("source_files"),
        kind("config").alias("config_files"), kind("other").alias("other_files"),
        F.lit(errors).cast("long").alias("crawl_errors"), F.lit(skipped).cast("long").alias("skipped"),
        F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("bytes_scanned"),
    )


def code_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("code").agg(F.count(F.lit(1)).alias("findings")).orderBy(F.desc("findings"), "code")


def with_shares(counts: DataFrame, value: str = "findings") -> DataFrame:
    """Share of the total and of the largest bucket, in percent; ``counts`` is a small table."""
    # Totals are scalar subqueries: no window over everything in one task.
    total = counts.agg(F.sum(value)).scalar()
    largest = counts.agg(F.greatest(F.max(value), F.lit(1))).scalar()
    n = F.col(value).cast("double")
    return counts.select(
        *counts.columns,
        F.when(total > 0, n / total * 100).otherwise(F.lit(0.0)).alias("share_percent"),
        (n / largest * 100).alias("bar_percent"),
    )


def top_findings(findings: DataFrame, caps: dict = CAPS) -> DataFrame:
    """The first findings of each severity with shown, total and omitted per bucket.

    Capped buckets use a row number under a constant limit, which Spark also
    applies before the shuffle; an uncapped bucket needs no ranking at all.
    """
    totals = findings.groupBy("severity").agg(F.count(F.lit(1)).alias("total"))
    capped = {s: c for s, c in caps.items() if c}
    uncapped = [s for s, c in caps.items() if c is None]
    cap = F.create_map(*[F.lit(x) for kv in capped.items() for x in kv]) if capped else None
    out = findings.filter(F.col("severity").isin(*uncapped))
    if capped:
        place = F.row_number().over(Window.partitionBy("severity").orderBy(seq()))
        ranked = (
            findings.filter(F.col("severity").isin(*capped))
            .withColumn("_place", place).filter(F.col("_place") <= max(capped.values()))
            .filter(F.col("_place") <= F.try_element_at(cap, F.col("severity"))).drop("_place")
        )
        out = out.unionByName(ranked)
    shown = F.least(F.col("total"), F.try_element_at(cap, F.col("severity")).cast("long")) if capped else F.col("total")
    return out.join(totals, "severity").select(
        *findings.columns, shown.alias("shown"), "total", (F.col("total") - shown).alias("omitted")
    )


def rule_rollup(findings: DataFrame) -> DataFrame:
    """One row per code with the fields of its first finding, sorted by code."""
    fields = F.struct("message", "severity", "category", "help")
    return (
        findings.groupBy("code").agg(F.min_by(fields, seq()).alias("first"), F.count(F.lit(1)).alias("findings"))
        .select("code", "first.*", "findings").orderBy("code")
    )


def annotation_line(tool: str = "scanloom") -> Column:
    """Workflow-command line of a finding."""
    file, line, column = F.col("location.file"), F.col("location.line"), F.col("location.column")
    params = F.concat_ws(
        ",",
        F.concat(F.lit("file="), text.annotation_property(file)),
        F.when(file.isNotNull(), F.concat(F.lit("line="), line.cast("string"))),
        F.when(file.isNotNull(), F.concat(F.lit("col="), column.cast("string"))),
        F.concat(F.lit("title="), text.annotation_property(F.concat(F.lit(tool + "::"), F.col("code")))),
    )
    return F.concat(
        F.lit("::"), annotation_level("severity"), F.lit(" "), params, F.lit("::"), text.annotation_data("message")
    )


def to_annotations(findings: DataFrame, tool: str = "scanloom") -> DataFrame:
    return findings.select(annotation_line(tool).alias("annotation"))


def project_label_rows(projects: DataFrame, by: Column | None = None) -> DataFrame:
    """(unit, position, label): distinct labels of every scan unit in order, one row each.

    A label is the first framework (or the language) and the last root part.
    """
    last = paths.base_name("root")
    label = F.concat(
        F.coalesce(F.get("frameworks", F.lit(0)), F.col("language")), F.lit(" ("),
        F.when(last == "", F.lit(".")).otherwise(last), F.lit(")"),
    )
    unit = F.lit("") if by is None else by
    return with_positions(projects.select(unit.alias("unit"), label.alias("label")).distinct(), ["label"], ["unit"]).select("unit", "position", "label")


def project_label(projects: DataFrame, by: Column | None = None) -> DataFrame:
    """The labels of a unit as one comma-joined text, for units of few projects; ``project_label_rows`` has no such bound."""
    rows = project_label_rows(projects, by)
    out = rows.groupBy("unit").agg(F.array_join(F.array_sort(F.collect_list("label")), ", ").alias("label"))
    return out.select("label") if by is None else out

"""Reports: counts, shares, ranked excerpts, roll-ups, annotation lines, documents, sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

import scanloom as sl
from scanloom.functions.text import annotation_data, annotation_property
from workload import corpora as C, oracle as O
from workload.findings import CODE, RULES, SAMPLE, code_findings, once, sample_findings
from workload.registry import query
from workload.scans import PROJECTS_CTE

_SEV = "(VALUES (0, 'critical'), (1, 'high'), (2, 'medium'), (3, 'low'), (4, 'info')) AS d(position, severity)"
_CAT = ("(VALUES (0, 'secret'), (1, 'security'), (2, 'dependency'), (3, 'performance'), (4, 'crawler'), (5, 'internal')) AS d(position, category)")


@query("severity_counts", O.with_(*SAMPLE) + f"""
SELECT d.position, d.severity, count(f.code) AS findings FROM {_SEV} LEFT JOIN findings f USING (severity) GROUP BY 1, 2""")
def severity_counts(spark, sf):
    return sl.severity_counts(sample_findings(spark, sf))


@query("category_counts", O.with_(*SAMPLE) + f"""
SELECT d.position, d.category, count(f.code) AS findings FROM {_CAT} LEFT JOIN findings f USING (category) GROUP BY 1, 2""")
def category_counts(spark, sf):
    return sl.category_counts(sample_findings(spark, sf))


@query("severity_shares", O.with_(*SAMPLE) + f"""
, c AS (SELECT d.position, d.severity, count(f.code) AS findings FROM {_SEV} LEFT JOIN findings f USING (severity) GROUP BY 1, 2)
SELECT *, round(findings / (SELECT sum(findings) FROM c) * 100, 4) AS share_percent, round(findings / (SELECT max(findings) FROM c) * 100, 4) AS bar_percent FROM c""")
def severity_shares(spark, sf):
    out = sl.with_shares(sl.severity_counts(sample_findings(spark, sf)))
    return out.withColumns({c: F.round(c, 4) for c in ("share_percent", "bar_percent")})


@query("scan_coverage", O.with_(C.CODE_CTE, f"f AS (SELECT *, {O.KIND} AS kind FROM corpus_code)") + """
SELECT count(*) AS files_scanned, count(*) FILTER (kind = 'manifest') AS manifests, count(*) FILTER (kind = 'source') AS source_files,
  count(*) FILTER (kind = 'config') AS config_files, count(*) FILTER (kind = 'other') AS other_files, 2 AS crawl_errors, 3 AS skipped,
  sum(strlen(content))::BIGINT AS bytes_scanned FROM f""")
def scan_coverage(spark, sf):
    files = sl.with_kind(C.code(spark, sf)).withColumn("size", F.octet_length("content").cast("long"))
    return sl.coverage(files, errors=2, skipped=3)


@query("top_findings", O.with_(*SAMPLE) + """
, r AS (SELECT *, row_number() OVER (PARTITION BY severity ORDER BY family_no, file, rule_no, byte_offset) AS place,
   count(*) OVER (PARTITION BY severity) AS total, CASE severity WHEN 'high' THEN 10 WHEN 'medium' THEN 5 WHEN 'low' THEN 5 WHEN 'info' THEN 0 ELSE 1000000000 END AS cap FROM findings)
SELECT severity, code, file, byte_offset, message, least(total, cap) AS shown, total, total - least(total, cap) AS omitted FROM r WHERE place <= cap""")
def top_findings(spark, sf):
    return sl.top_findings(once(sample_findings(spark, sf))).select(
        "severity", "code", "location.file", "location.byte_offset", "message", "shown", "total", "omitted")


@query("rule_rollup", O.with_(*SAMPLE) + """
, r AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY family_no, file, rule_no, byte_offset) AS n, count(*) OVER (PARTITION BY code) AS findings FROM findings)
SELECT code, message, severity, category, help, findings FROM r WHERE n = 1""")
def rule_rollup(spark, sf):
    return sl.rule_rollup(sample_findings(spark, sf))


@query("code_counts", O.with_(*SAMPLE) + "SELECT code, count(*) AS findings FROM findings GROUP BY code")
def code_counts(spark, sf):
    return sl.code_counts(sample_findings(spark, sf))


_ESC = "replace(replace(replace({x}, '%', '%25'), chr(13), '%0D'), chr(10), '%0A')"
_PROP = "replace(replace(" + _ESC + ", ':', '%3A'), ',', '%2C')"


@query("annotation_lines", O.with_(*SAMPLE) + f"""
SELECT '::' || CASE WHEN severity IN ('critical', 'high') THEN 'error' WHEN severity = 'medium' THEN 'warning' ELSE 'notice' END
  || ' file=' || {_PROP.format(x='file')} || ',line=' || line || ',col=' || "column" || ',title=scanloom%3A%3A' || code || '::' || {_ESC.format(x='message')} AS annotation
FROM findings""")
def annotation_lines(spark, sf):
    return sl.to_annotations(sample_findings(spark, sf))


@query("annotation_escapes", f"SELECT page_id, md5({_PROP.format(x='html')}) AS property, md5({_ESC.format(x='html')}) AS data FROM pages")
def annotation_escapes(spark, sf):
    return C.table(spark, sf, "pages").select(
        "page_id", F.md5(annotation_property("html")).alias("property"), F.md5(annotation_data("html")).alias("data"))


# A document is checked record by record: rules by code, results in order, and what stands around them.
@query("result_documents", O.with_(*CODE) + """
, u AS (SELECT *, regexp_extract(file, '^[^/]*') AS unit, CASE severity WHEN 'critical' THEN 'error' WHEN 'high' THEN 'error' WHEN 'medium' THEN 'warning' ELSE 'note' END AS level FROM findings)
, r AS (SELECT unit, code, arg_min(level, (family_no, file, rule_no, byte_offset)) AS level, row_number() OVER (PARTITION BY unit ORDER BY code) - 1 AS position FROM u GROUP BY unit, code)
SELECT unit, 3 AS section, row_number() OVER (PARTITION BY unit ORDER BY family_no, file, rule_no, byte_offset, code, message) - 1 AS position,
  code, level, message, file, line, "column", byte_offset, byte_length FROM u
UNION ALL SELECT unit, 1, position, code, level, NULL, NULL, NULL, NULL, NULL, NULL FROM r
UNION ALL SELECT unit, s, 0, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM (SELECT DISTINCT unit FROM u), (SELECT unnest([0, 2, 4]) AS s)""")
def result_documents(spark, sf):
    place = "physicalLocation:struct<artifactLocation:struct<uri:string>,region:struct<startLine:int,startColumn:int,charOffset:bigint,charLength:bigint>>"
    shape = f"ruleId string, id string, level string, message struct<text:string>, defaultConfiguration struct<level:string>, locations array<struct<{place}>>"
    records = sl.sarif_records(once(code_findings(spark, sf))).withColumn(
        "i", F.when(F.col("section").isin(1, 3), F.from_json(F.regexp_replace("record", "^,", ""), shape)))
    at = F.get("i.locations", F.lit(0))["physicalLocation"]
    region = at["region"]
    return records.select(
        "unit", "section", "position", F.coalesce("i.ruleId", "i.id").alias("code"), F.coalesce("i.level", "i.defaultConfiguration.level").alias("level"),
        F.col("i.message.text").alias("message"), at["artifactLocation"]["uri"].alias("file"), region["startLine"].alias("line"),
        region["startColumn"].alias("column"), region["charOffset"].alias("byte_offset"), region["charLength"].alias("byte_length"))


# Every record of the report, read back from its text.
@query("report_records", O.with_(*CODE) + """
SELECT 'finding' AS section, code, message, severity, file, line, byte_offset, NULL::BIGINT AS files, NULL::BIGINT AS bytes FROM findings
UNION ALL SELECT 'stats', NULL, NULL, NULL, NULL, NULL, NULL, count(*), sum(strlen(content))::BIGINT FROM corpus_code""")
def report_records(spark, sf):
    files = sl.with_kind(C.code(spark, sf)).withColumn("size", F.octet_length("content").cast("long"))
    lines = sl.report_lines(sl.scan(files, RULES), sl.coverage(files))
    shape = "code string, message string, severity string, location struct<file:string,line:int,byte_offset:bigint>, files_scanned bigint, bytes_scanned bigint"
    return lines.select("section", F.from_json("record", shape).alias("r")).select(
        "section", "r.code", "r.message", "r.severity", "r.location.file", "r.location.line", "r.location.byte_offset",
        F.col("r.files_scanned").alias("files"), F.col("r.bytes_scanned").alias("bytes"))


@query("audit_findings", O.with_(*SAMPLE, PROJECTS_CTE) + """
SELECT code, severity, file, line FROM findings f WHERE severity <> 'info'
  AND (code NOT IN ('SEC-006', 'SEC-007') OR NOT regexp_matches(file, '(^|/)(tests|test)/'))
  AND (code NOT IN ('INJ-008','INJ-009','INJ-010','ORM-003','ORM-005') OR (SELECT bool_or(list_contains(frameworks, 'rails')) FROM projects))
  AND (NOT regexp_matches(code, '^(NEST|NEXT|AXUM|DJANGO|FLASK|SPRING)-') OR EXISTS (
    SELECT 1 FROM projects p WHERE starts_with(f.file, p.root || '/') AND list_contains(p.frameworks,
      CASE split_part(f.code, '-', 1) WHEN 'NEST' THEN 'nestjs' WHEN 'NEXT' THEN 'nextjs' WHEN 'SPRING' THEN 'spring-boot' ELSE lower(split_part(f.code, '-', 1)) END)))""")
def audit_findings(spark, sf):
    """The whole run over samples and manifests, as a user would start it."""
    files = C.samples(spark, sf).select("path", "content").unionByName(C.manifests(spark, sf).select("path", "content"))
    files = files.withColumn("size", F.octet_length("content").cast("long"))
    result = sl.audit(files, sl.AuditConfig(include_minified=True))
    return result.findings.filter("category <> 'performance' or code = 'PERF-002'").select(
        "code", "severity", "location.file", "location.line")

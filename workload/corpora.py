"""Derived corpora, in SQL that both engines run unchanged unless noted."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from workload.samples import SAMPLES, SCOPE_SAMPLES

CORPUS_DOCS = """
SELECT concat(source,'/',lang,'/doc_',cast(doc_id AS varchar(20)),'.txt') AS path, text AS content FROM documents
"""

CORPUS_CODE = """
SELECT doc_id,
 concat(source,'/',lang,'/',
   CASE doc_id % 12 WHEN 5 THEN '.github/workflows/ci_' WHEN 6 THEN 'deploy_'
        WHEN 8 THEN 'tests/test_' ELSE 'src/f_' END,
   cast(doc_id AS varchar(20)),
   CASE doc_id % 12 WHEN 0 THEN '.py' WHEN 1 THEN '.js' WHEN 2 THEN '.java' WHEN 3 THEN '.go'
        WHEN 4 THEN '.rs' WHEN 5 THEN '.yml' WHEN 6 THEN '/Dockerfile' WHEN 7 THEN '/.env'
        WHEN 8 THEN '.py' WHEN 9 THEN '.py' WHEN 10 THEN '/requirements.txt' ELSE '.md' END) AS path,
 concat(text, chr(10), CASE doc_id % 12
   WHEN 0 THEN 'h = hashlib.md5(x)'
   WHEN 1 THEN 'const t = Math.random();'
   WHEN 2 THEN 'MessageDigest.getInstance("MD5")'
   WHEN 3 THEN 'md5.New()'
   WHEN 4 THEN 'let r = thread_rng();'
   WHEN 5 THEN 'permissions: write-all'
   WHEN 6 THEN 'FROM ubuntu:latest'
   WHEN 7 THEN concat('AWS_KEY=AKIA', upper(substring(md5(cast(doc_id AS varchar(20))),1,16)))
   WHEN 8 THEN 'h = hashlib.md5(x)'
   WHEN 9 THEN 'h = hashlib.md5(x)  # scan-ignore-line: CRY-001'
   WHEN 10 THEN concat('pkg-', cast(doc_id AS varchar(20)), '==1.', cast(doc_id % 10 AS varchar(20)), '.0')
   ELSE 'plain text' END, chr(10)) AS content
FROM documents
"""


def literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, (list, tuple)):
        return "[" + ", ".join(literal(v) for v in value) + "]::VARCHAR[]"
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    return str(value)


def values(rows) -> str:
    """VALUES list for DuckDB."""
    return "(VALUES " + ", ".join("(" + ", ".join(literal(v) for v in r) + ")" for r in rows) + ")"


SAMPLE_ROWS = [(i, code, name, text) for i, (code, name, text, _) in enumerate(SAMPLES + SCOPE_SAMPLES)]
N_SAMPLES = len(SAMPLE_ROWS)

# One sample per document, in front of the prose or behind it; needs a `samples` relation.
CORPUS_SAMPLES = f"""
SELECT d.doc_id, s.code AS sample_code, concat(d.source,'/d',cast(d.doc_id AS varchar(20)),'/',s.name) AS path,
       CASE WHEN floor(d.doc_id / {N_SAMPLES}) % 2 = 0 THEN concat(s.text, chr(10), d.text, chr(10))
            ELSE concat(d.text, chr(10), s.text, chr(10)) END AS content
FROM documents d JOIN samples s ON d.doc_id % {N_SAMPLES} = s.no
"""

# A manifest next to two of three samples of a framework, and a plain text next to the rest.
CORPUS_MANIFESTS = f"""
SELECT d.doc_id, s.code AS sample_code,
  concat(d.source,'/d',cast(d.doc_id AS varchar(20)),'/', CASE WHEN floor(d.doc_id / {N_SAMPLES}) % 3 = 1 THEN 'README.md'
    WHEN s.code LIKE 'NE_T-%' THEN 'package.json' WHEN s.code LIKE 'AXUM-%' THEN 'Cargo.toml'
    WHEN s.code LIKE 'DJANGO-%' THEN 'requirements.txt' WHEN s.code LIKE 'FLASK-%' THEN 'pyproject.toml'
    WHEN s.code LIKE 'SPRING-%' THEN 'pom.xml' WHEN s.code LIKE 'ORM-%' THEN 'Gemfile'
    WHEN s.code LIKE 'SSRF-%' THEN 'go.mod' WHEN s.code LIKE 'XXE-%' THEN 'composer.json'
    WHEN s.code LIKE 'CRY-%' THEN 'build.gradle.kts' WHEN s.code LIKE 'NET-%' THEN 'mix.lock' ELSE 'README.md' END) AS path,
  CASE WHEN s.code LIKE 'NEST-%' THEN '{{"dependencies": {{"@nestjs/core": "10", "typescript": "5"}}}}'
    WHEN s.code LIKE 'NEXT-%' THEN '{{"dependencies": {{"next": "14", "react": "18"}}}}'
    WHEN s.code LIKE 'AXUM-%' THEN concat('[dependencies]', chr(10), 'axum = "0.7"')
    WHEN s.code LIKE 'DJANGO-%' THEN 'Django==5.0' WHEN s.code LIKE 'FLASK-%' THEN 'dependencies = ["flask"]'
    WHEN s.code LIKE 'SPRING-%' THEN '<artifactId>spring-boot-starter</artifactId>'
    WHEN s.code LIKE 'ORM-%' THEN 'gem "rails"' WHEN s.code LIKE 'SSRF-%' THEN 'require github.com/gin-gonic/gin v1'
    WHEN s.code LIKE 'XXE-%' THEN '{{"require": {{"laravel/framework": "11", "symfony/symfony": "6"}}}}'
    WHEN s.code LIKE 'CRY-%' THEN 'id("org.springframework.boot")' ELSE 'text' END AS content
FROM documents d JOIN samples s ON d.doc_id % {N_SAMPLES} = s.no
"""

COMMITS = """
SELECT md5(concat('c', cast(event_id AS varchar(20)))) AS sha,
       concat('user_', cast(user_id AS varchar(20))) AS author, ts, event_id % 10 = 0 AS is_merge
FROM events
"""

REVISIONS = """
SELECT md5(concat('c', cast(e.event_id AS varchar(20)))) AS sha, c.path,
       CASE e.event_type WHEN 'signup' THEN 'A' WHEN 'click' THEN 'M' WHEN 'view' THEN 'R'
            WHEN 'purchase' THEN 'T' ELSE 'D' END AS change, c.content
FROM (SELECT *, event_id % (SELECT count(*) FROM documents) AS target FROM events) e JOIN corpus_code c ON c.doc_id = e.target
"""

ADVISORIES = """
SELECT concat(CASE s_nationkey % 3 WHEN 0 THEN 'GHSA-' WHEN 1 THEN 'RUSTSEC-' ELSE 'CVE-' END,
              cast(s_suppkey AS varchar(20))) AS id, 'PyPI' AS ecosystem,
       concat('pkg-', cast(s_suppkey * 7 AS varchar(20))) AS name,
       '0.0.0' AS introduced, '1.5.0' AS fixed,
       CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE cast((s_suppkey % 100) / 10.0 AS double) END AS score,
       CASE s_nationkey % 5 WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'HIGH' WHEN 2 THEN 'MODERATE'
            WHEN 3 THEN 'LOW' ELSE NULL END AS rating
FROM supplier
"""


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def over(spark: SparkSession, sql: str, **frames: DataFrame) -> DataFrame:
    """Run SQL with the named tables bound to DataFrames; braces in the text stay text."""
    text = sql.replace("{", "{{").replace("}", "}}")
    for name in frames:
        text = re.sub(rf"\b(FROM|JOIN) {name}\b", rf"\1 {{{name}}}", text)
    return spark.sql(text, **frames)


def docs(spark, sf):
    return over(spark, CORPUS_DOCS, documents=table(spark, sf, "documents"))


def code(spark, sf):
    return over(spark, CORPUS_CODE, documents=table(spark, sf, "documents"))


def _sample_table(spark):
    """A local relation: its size is known, so texts meet it where they lie. From rows it would be an unknown one, and all texts be
    dealt by the few numbers of samples."""
    columns = zip(*SAMPLE_ROWS, strict=True)
    kinds = (pa.int32(), pa.string(), pa.string(), pa.string())
    return spark.createDataFrame(pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["no", "code", "name", "text"]))


def samples(spark, sf):
    return over(spark, CORPUS_SAMPLES, documents=table(spark, sf, "documents"), samples=_sample_table(spark))


def manifests(spark, sf):
    return over(spark, CORPUS_MANIFESTS, documents=table(spark, sf, "documents"), samples=_sample_table(spark))


def commits(spark, sf):
    return over(spark, COMMITS, events=table(spark, sf, "events"))


def revisions(spark, sf):
    return over(spark, REVISIONS, events=table(spark, sf, "events"), documents=table(spark, sf, "documents"), corpus_code=code(spark, sf))


def advisories(spark, sf):
    return over(spark, ADVISORIES, supplier=table(spark, sf, "supplier"))


# --- DuckDB fragments --------------------------------------------------------

SAMPLES_CTE = f"samples(no, code, name, text) AS (SELECT * FROM {values(SAMPLE_ROWS)})"
CODE_CTE = f"corpus_code AS ({CORPUS_CODE})"
DOCS_CTE = f"corpus_docs AS ({CORPUS_DOCS})"

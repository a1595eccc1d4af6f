"""Findings pipeline: noise, settings, suppression, directives, baseline, thresholds, fixes, gate."""

from __future__ import annotations

from pyspark.sql import functions as F

import scanloom as sl
from scanloom.functions import paths
from scanloom.functions.grades import confidence_ord, parse_confidence, parse_severity, severity_ord
from scanloom.operators.fixes import SUBSTITUTIONS
from scanloom.operators.pipeline import fingerprint_of
from scanloom.plans.audit import AuditConfig, configured
from scanloom.rules.catalogue import builtin_rules, known_prefixes
from scanloom.sources.shared import new_path
from workload import corpora as C, oracle as O
from workload.registry import query
from workload.scans import flat

RULES = list(builtin_rules())
CODE = O.code_findings(RULES)
SAMPLE = O.sample_findings(RULES)


def code_findings(spark, sf):
    return sl.scan(C.code(spark, sf), RULES)


def sample_findings(spark, sf):
    return sl.scan(C.samples(spark, sf), RULES)


def once(findings):
    """For queries that use their findings more than once."""
    return sl.materialise(findings)


# Sample keys and tokens below fixture-like directories, next to the same ones elsewhere.
_NOISE = f"""
SELECT concat(CASE doc_id % 3 WHEN 0 THEN 'lib/Fixtures/' WHEN 1 THEN 'lib/samples/x/' ELSE 'lib/main/' END, path) AS path, content
FROM corpus"""


@query("default_noise", O.with_(
    C.SAMPLES_CTE, f"corpus AS (SELECT * FROM {O.SAMPLES_FROM})", f"placed AS ({_NOISE})", O.files_cte("placed"), O.rules_cte(RULES),
    O.findings_ctes()) + """
SELECT code, file, line FROM findings WHERE NOT (code IN ('SEC-006', 'SEC-007') AND regexp_matches(lower(file), '(^|/)(fixtures|samples)(/|$)'))""")
def default_noise(spark, sf):
    placed = C.over(spark, _NOISE, corpus=C.samples(spark, sf))
    return sl.drop_default_noise(sl.scan(placed, RULES)).select("code", "location.file", "location.line")


CONFIG = {"CRY-005": False, "CRY-001": {"severity": "crit"}, "IAC-001": {"enabled": False}, "SEC-001": {"severity": "low"},
          "CRY-007": {"enabled": True, "severity": "MED"}}


@query("enabled_rules", O.with_(*CODE) + "SELECT code, file, line FROM findings WHERE code NOT IN ('CRY-005', 'IAC-001')")
def enabled_rules(spark, sf):
    return sl.apply_enabled(code_findings(spark, sf), CONFIG).select("code", "location.file", "location.line")


@query("severity_override", O.with_(*CODE) + """
SELECT code, CASE code WHEN 'CRY-001' THEN 'critical' WHEN 'SEC-001' THEN 'low' WHEN 'CRY-007' THEN 'medium' ELSE severity END AS severity, file, line FROM findings""")
def severity_override(spark, sf):
    table = spark.createDataFrame([("CRY-001", "crit"), ("SEC-001", "low"), ("CRY-007", "MED")], "code string, severity string")
    return sl.override_severity(code_findings(spark, sf), table).select("code", "severity", "location.file", "location.line")


@query("ignored_findings", O.with_(*CODE) + """
SELECT code, file, line FROM findings WHERE NOT (regexp_matches(file, '^src3/') OR (regexp_matches(file, '(^|/)f_[^/]*\\.py$') AND NOT regexp_matches(file, '^src5/en/src/[^/]*$')))""")
def ignored_findings(spark, sf):
    out = sl.ignore_findings(code_findings(spark, sf), ["f_*.py", "!src5/en/src/*", "/src3/**"])
    return out.select("code", "location.file", "location.line")


BLOCKS = [{"path": "**/tests/**"}, {"path": "src0/**", "rules": ["CRY-001", "CRY-005"]}, {"path": "*.rs", "rules": ["*"]}]


@query("suppressed_blocks", O.with_(*CODE) + """
SELECT code, file, line FROM findings WHERE NOT (regexp_matches(file, '(^|/)tests/.+') OR (regexp_matches(file, '^src0/.+') AND code IN ('CRY-001', 'CRY-005'))
 OR regexp_matches(file, '\\.rs$'))""")
def suppressed_blocks(spark, sf):
    return sl.suppress(code_findings(spark, sf), BLOCKS).select("code", "location.file", "location.line")


# Directive lines of every form, put around the code line of the code corpus.
_DIRECTED = """
SELECT doc_id, path, concat(
  CASE doc_id % 5 WHEN 0 THEN concat('// scan-ignore-file: CRY-005, CRY-001 / why', chr(10)) WHEN 1 THEN concat('# scan-ignore-file : *', chr(10))
    WHEN 2 THEN concat('# scan-ignore: bad TEAM-001 CRY-1', chr(10)) ELSE '' END,
  replace(content, concat(chr(10), 'h = '), concat(chr(10), '# scan-ignore: CRY-001 scan-ignore-line: SEC-001', chr(10), 'h = '))) AS content FROM corpus_code"""

_DIRECTIVES = """
dl AS (SELECT path, unnest(list_zip(string_split(content, chr(10)), range(1, 1 + len(string_split(content, chr(10)))))) AS z FROM directed),
dm AS (SELECT path, z[2] AS no, unnest(list_zip(regexp_extract_all(z[1], 'scan-ignore(?:-(line|file))?\\s*:\\s*([^/\\n]*)', 1),
   regexp_extract_all(z[1], 'scan-ignore(?:-(line|file))?\\s*:\\s*([^/\\n]*)', 2))) AS d FROM dl WHERE contains(z[1], 'scan-ignore')),
dt AS (SELECT path, no, d[1] AS suffix, unnest(regexp_split_to_array(d[2], '[,\\s]+')) AS code FROM dm),
directives AS (SELECT DISTINCT path, CASE suffix WHEN 'file' THEN NULL WHEN 'line' THEN no ELSE no + 1 END AS line, code FROM dt
  WHERE code = '*' OR (length(code) >= 7 AND regexp_matches(code, '^(""" + "|".join(known_prefixes()) + """)[A-Z0-9_-]*$')))
"""


def _directed(spark, sf):
    return C.over(spark, _DIRECTED, corpus_code=C.code(spark, sf))


@query("inline_directives", O.with_(C.CODE_CTE, f"directed AS ({_DIRECTED})", _DIRECTIVES) + "SELECT path, line, code FROM directives")
def inline_directives(spark, sf):
    return sl.parse_directives(_directed(spark, sf))


@query("applied_directives", O.with_(
    C.CODE_CTE, f"directed AS ({_DIRECTED})", O.files_cte("directed"), O.rules_cte(RULES), O.findings_ctes(), _DIRECTIVES) + """
SELECT code, file, line FROM findings f WHERE NOT EXISTS (SELECT 1 FROM directives d WHERE d.path = f.file
  AND (d.line IS NULL OR d.line = f.line) AND (d.code = '*' OR d.code = f.code))""")
def applied_directives(spark, sf):
    files = _directed(spark, sf)
    found = once(sl.scan(files, RULES))
    return sl.apply_directives(found, sl.directives_for(found, files)).select("code", "location.file", "location.line")


@query("silenced_scan", O.with_(
    C.CODE_CTE, f"directed AS ({_DIRECTED})", O.files_cte("directed"), O.rules_cte(RULES), O.findings_ctes(), _DIRECTIVES) + """
SELECT code, file, line FROM findings f WHERE NOT EXISTS (SELECT 1 FROM directives d WHERE d.path = f.file
  AND (d.line IS NULL OR d.line = f.line) AND (d.code = '*' OR d.code = f.code))""")
def silenced_scan(spark, sf):
    return sl.scan(_directed(spark, sf), RULES, honour_directives=True).select("code", "location.file", "location.line")


_PRINT = "code || '|' || file || '|' || line || '|' || message"


@query("finding_fingerprints", O.with_(*CODE) + f"SELECT DISTINCT {_PRINT} AS fingerprint FROM findings")
def finding_fingerprints(spark, sf):
    return sl.fingerprints(code_findings(spark, sf))


@query("baseline_filter", O.with_(*CODE) + f"""
, base AS (SELECT DISTINCT {_PRINT} AS fp FROM findings WHERE CAST(regexp_extract(file, '([0-9]+)[^0-9]*$', 1) AS BIGINT) % 2 = 0)
SELECT code, file, line FROM findings WHERE {_PRINT} NOT IN (SELECT fp FROM base)""")
def baseline_filter(spark, sf):
    found = once(code_findings(spark, sf))
    number = F.regexp_extract("location.file", r"([0-9]+)[^0-9]*$", 1).cast("long")
    base = found.filter(number % 2 == 0).select(fingerprint_of().alias("fingerprint"))
    return sl.new_since(found, base).select("code", "location.file", "location.line")


# Written, added to, read again: the list of fingerprints, and what is new against it.
@query("baseline_round_trip", O.with_(*CODE) + f"""
, p AS (SELECT {_PRINT} AS fingerprint, CAST(regexp_extract(file, '([0-9]+)[^0-9]*$', 1) AS BIGINT) AS number FROM findings)
, base AS (SELECT DISTINCT fingerprint FROM p WHERE number % 2 = 0 OR number % 3 = 0)
SELECT 'known' AS part, fingerprint FROM base UNION ALL SELECT 'new', fingerprint FROM p WHERE fingerprint NOT IN (SELECT fingerprint FROM base)""")
def baseline_round_trip(spark, sf):
    found = once(code_findings(spark, sf))
    number = F.regexp_extract("location.file", r"([0-9]+)[^0-9]*$", 1).cast("long")
    path = new_path(spark, "baseline")
    sl.write_baseline(found.filter(number % 2 == 0), path)
    sl.merge_baseline(found.filter(number % 3 == 0), path)
    sl.merge_baseline(found.filter(number % 6 == 0), path)
    base = sl.read_baseline(spark, path)
    return base.select(F.lit("known").alias("part"), "fingerprint").unionByName(
        sl.new_since(found, base).select(F.lit("new").alias("part"), fingerprint_of().alias("fingerprint")))


@query("thresholds", O.with_(*SAMPLE) + "SELECT code, file, line FROM findings WHERE severity IN ('high', 'critical') AND confidence IN ('medium', 'high')")
def thresholds(spark, sf):
    return sl.at_least(sample_findings(spark, sf), "high", "medium").select("code", "location.file", "location.line")


@query("grade_lookup", """
SELECT event_id, lower(event_type) AS name, CASE event_id % 7 WHEN 0 THEN 4 WHEN 1 THEN 3 WHEN 2 THEN 2 WHEN 3 THEN 2 WHEN 4 THEN 1 WHEN 5 THEN 0 END AS severity_no,
  CASE event_id % 7 WHEN 1 THEN 2 WHEN 2 THEN 1 WHEN 3 THEN 1 WHEN 4 THEN 0 END AS confidence_no FROM events""")
def grade_lookup(spark, sf):
    raw = F.get(F.array(*[F.lit(x) for x in ("CRIT", "high", "Med", "medium", "Low", "info", "none")]), (F.col("event_id") % 7).cast("int"))
    return C.table(spark, sf, "events").select(
        "event_id", F.lower("event_type").alias("name"), severity_ord(parse_severity(raw)).alias("severity_no"),
        confidence_ord(parse_confidence(raw)).alias("confidence_no"))


@query("configured_findings", O.with_(*CODE) + """
SELECT code, CASE code WHEN 'CRY-001' THEN 'critical' WHEN 'SEC-001' THEN 'low' WHEN 'CRY-007' THEN 'medium' ELSE severity END AS severity, file, line FROM findings
WHERE code NOT IN ('CRY-005', 'IAC-001') AND NOT regexp_matches(file, '^src3/') AND NOT (regexp_matches(file, '(^|/)tests/.+')
  OR (regexp_matches(file, '^src0/.+') AND code IN ('CRY-001', 'CRY-005')) OR regexp_matches(file, '\\.rs$'))""")
def configured_findings(spark, sf):
    config = AuditConfig(rules=CONFIG, ignore=["/src3/**"], suppress=BLOCKS)
    return configured(code_findings(spark, sf), config).select("code", "severity", "location.file", "location.line")


@query("gate", O.with_(*CODE) + "SELECT coalesce(bool_or(severity = 'critical'), false) AS failed FROM findings WHERE code <> 'SEC-001'")
def gate(spark, sf):
    return sl.gate(code_findings(spark, sf).filter("code <> 'SEC-001'"), sl.gate_threshold("critical"))


# --- fixes -------------------------------------------------------------------

_FIX_CODES = "('CRY-001', 'CRY-002', 'DES-002')"


def _fix_sql(line: str, code: str) -> str:
    out = []
    for name, pairs in SUBSTITUTIONS.items():
        text = line
        for old, new in pairs:
            text = f"replace({text}, {C.literal(old)}, {C.literal(new)})"
        out.append(f"WHEN '{name}' THEN {text}")
    return f"CASE {code} {' '.join(out)} END"


_PLAN = f"""
, ask AS (SELECT code, file, line, row_number() OVER (PARTITION BY file, line, code ORDER BY byte_offset) AS ordinal FROM findings WHERE code IN {_FIX_CODES}),
txt AS (SELECT a.*, string_split(f.content, chr(10))[a.line] AS before FROM ask a JOIN files f ON f.path = a.file),
plan AS (SELECT *, {_fix_sql('before', 'code')} AS after FROM txt)"""


@query("fix_plan", O.with_(*SAMPLE) + _PLAN + """
SELECT file AS path, line, code, ordinal, CASE WHEN ordinal = 1 AND after <> before THEN 'applied' ELSE 'skipped-no-match' END AS status,
  CASE WHEN ordinal = 1 AND after <> before THEN before END AS before, CASE WHEN ordinal = 1 AND after <> before THEN after END AS after FROM plan""")
def fix_plan(spark, sf):
    return sl.plan_fixes(sample_findings(spark, sf), C.samples(spark, sf))


@query("fix_counts", O.with_(*SAMPLE) + _PLAN + """
SELECT count(*) AS planned, count(*) FILTER (ordinal = 1 AND after <> before) AS applied,
  count(*) FILTER (NOT (ordinal = 1 AND after <> before)) AS skipped_no_match, 0 AS skipped_already_fixed FROM plan""")
def fix_counts(spark, sf):
    return sl.fix_counts(sl.plan_fixes(sample_findings(spark, sf), C.samples(spark, sf)))


@query("fixed_texts", O.with_(*SAMPLE) + _PLAN + """
, edits AS (SELECT file, line, min(after) AS after FROM plan WHERE after <> before GROUP BY file, line),
ln AS (SELECT path, unnest(string_split(content, chr(10))) AS text, unnest(range(1, 1 + len(string_split(content, chr(10))))) AS no FROM files
  WHERE path IN (SELECT file FROM edits))
SELECT path, md5(string_agg(coalesce(e.after, ln.text), chr(10) ORDER BY no)) AS digest FROM ln LEFT JOIN edits e ON e.file = ln.path AND e.line = ln.no GROUP BY path""")
def fixed_texts(spark, sf):
    return sl.apply_fixes(sample_findings(spark, sf), C.samples(spark, sf)).select("path", F.md5("content").alias("digest"))


@query("location_texts", O.with_(*CODE) + """
SELECT code, file || ':' || line || ':' || "column" AS place, regexp_extract(file, '([^/]*)$', 1) AS name FROM findings""")
def location_texts(spark, sf):
    return code_findings(spark, sf).select(
        "code", paths.location_text("location.file", "location.line", "location.column").alias("place"),
        paths.base_name("location.file").alias("name"))

"""Detection: rules, spans, messages, entropy, gates."""

from __future__ import annotations

from pyspark.sql import functions as F

import scanloom as sl
from scanloom.functions import text
from scanloom.plans.audit import Detector
from scanloom.rules import Rule, with_numbers
from scanloom.rules.catalogue import builtin_rules, secret_rules
from workload import corpora as C, oracle as O
from workload.registry import query
from workload.scans import PROJECTS_CTE, flat

ANY_KIND = ("manifest", "source", "config", "test", "other")
SPAN_PATTERN = r'\bhashlib\.md5\s*\(|AKIA[0-9A-Z]{16}|token = "[0-9a-f]{40}"'
SPAN_RULES = [Rule(code="USER-001", pattern=SPAN_PATTERN, message="watched text", kinds=ANY_KIND, severity="high")]
TEXT_RULES = with_numbers([
    Rule(code="USER-101", pattern=r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b", message="address in text", kinds=ANY_KIND),
    Rule(code="USER-102", pattern=r"\b[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}\b", message="card-like number", kinds=ANY_KIND),
    Rule(code="USER-103", pattern=r"(?i)\b(?:licensed under|released under)\b[^\n]*", trailer="names a licence", kinds=ANY_KIND, severity="info"),
    Rule(code="USER-104", pattern=r"[a-z0-9]+@mail[0-9]+\.example\.com", message="mail address", kinds=ANY_KIND, severity="low"),
])


@query("pattern_spans", O.with_(C.CODE_CTE, O.files_cte("corpus_code"), O.rules_cte(SPAN_RULES), O.findings_ctes())
       + f"SELECT {O.SHOWN} FROM findings")
def pattern_spans(spark, sf):
    return flat(sl.scan(C.code(spark, sf), SPAN_RULES))


@query("match_locations", f"""
WITH {C.CODE_CTE}, m AS (SELECT path, content, regexp_extract_all(content, '[a-z]+[0-9]+') AS m,
   regexp_split_to_array(content, '[a-z]+[0-9]+') AS p FROM corpus_code),
e AS (SELECT path, m, p, unnest(range(len(m))) AS k FROM m),
x AS (SELECT path, m[k+1] AS hit, array_to_string(list_concat(list_transform(range(k), lambda i: p[i+1] || m[i+1]), [p[k+1]]), '') AS prefix FROM e)
SELECT path, hit AS "match", strlen(prefix) AS byte_offset, strlen(hit) AS byte_length,
  1 + length(prefix) - length(replace(prefix, chr(10), '')) AS line, 1 + length(regexp_extract(prefix, '([^\\n]*)$', 1)) AS "column" FROM x""")
def match_locations(spark, sf):
    return sl.with_location(C.code(spark, sf).select("path", "content"), "content", "[a-z]+[0-9]+")


@query("user_text_rules", O.with_(C.DOCS_CTE, O.files_cte("corpus_docs"), O.rules_cte(TEXT_RULES), O.findings_ctes())
       + f"SELECT {O.SHOWN} FROM findings")
def user_text_rules(spark, sf):
    rules = sl.load_rules([
        {"id": r.code, "pattern": r.pattern, "message": r.message or "-", "severity": r.severity, "kinds": ANY_KIND,
         "trailer": r.trailer} for r in TEXT_RULES], spark)
    return flat(sl.scan(C.docs(spark, sf), rules))


@query("applicable_rules", O.with_(C.SAMPLES_CTE, O.files_cte(O.SAMPLES_FROM), O.rules_cte(list(builtin_rules()))) + f"""
SELECT f.path, r.code, r.rule_no FROM files f JOIN rules r ON {O.applies()}""")
def applicable_rules(spark, sf):
    return sl.applicable(C.samples(spark, sf), builtin_rules())


@query("catalogue_scan", O.with_(*O.sample_findings(list(builtin_rules()))) + f"SELECT {O.SHOWN} FROM findings")
def catalogue_scan(spark, sf):
    return flat(sl.scan(C.samples(spark, sf), builtin_rules()))


@query("catalogue_scan_code", O.with_(*O.code_findings(list(builtin_rules()))) + f"SELECT {O.SHOWN} FROM findings")
def catalogue_scan_code(spark, sf):
    return flat(sl.scan(C.code(spark, sf), builtin_rules()))


def _subset(test):
    return [r for r in builtin_rules() if test(r)]


def _register_subset(name: str, rules: list[Rule]):
    @query(name, O.with_(*O.sample_findings(rules)) + f"SELECT {O.SHOWN} FROM findings")
    def run(spark, sf):
        return flat(sl.scan(C.samples(spark, sf), rules))


_register_subset("call_site_messages", _subset(lambda r: r.trailer and r.quote in ("call", "clip")))
_register_subset("secret_shapes", secret_rules())
_register_subset("compound_rules", _subset(lambda r: r.code in ("NEST-002", "NEXT-002", "NEXT-003", "AXUM-001")))
_register_subset("content_gated_rules", _subset(lambda r: r.detector in ("flask", "spring-boot", "django")))
_register_subset("first_match_rules", _subset(lambda r: r.max_matches == 1))
_register_subset("line_exclusion", _subset(lambda r: r.line_exclude))
_register_subset("dom_sinks", _subset(lambda r: r.code == "XSS-002"))
_register_subset("family_routed_rules", _subset(lambda r: r.family))


@query("token_entropy", f"""
WITH {C.CODE_CTE}, t AS (SELECT path, regexp_extract(content, 'AKIA[0-9A-Z]{{16}}') AS token FROM corpus_code
  UNION ALL SELECT url AS path, url AS token FROM pages)
SELECT path, token, round({O.ENTROPY_LIST.format(t='token')}, 6) AS entropy FROM t WHERE token <> ''""")
def token_entropy(spark, sf):
    tokens = C.code(spark, sf).select("path", F.regexp_extract("content", "AKIA[0-9A-Z]{16}", 0).alias("token")).unionByName(
        C.table(spark, sf, "pages").select(F.col("url").alias("path"), F.col("url").alias("token")))
    return tokens.filter("token <> ''").withColumn("entropy", F.round(text.shannon_entropy("token"), 6))


# Directories of findings meet the projects above them by equality, one row per directory above.
_GATE = """
, found AS MATERIALIZED (SELECT *, regexp_replace(file, '/[^/]*$', '') AS dir, CASE
   WHEN code LIKE 'NEST-%' THEN 'nestjs' WHEN code LIKE 'NEXT-%' THEN 'nextjs' WHEN code LIKE 'AXUM-%' THEN 'axum'
   WHEN code LIKE 'DJANGO-%' THEN 'django' WHEN code LIKE 'FLASK-%' THEN 'flask' WHEN code LIKE 'SPRING-%' THEN 'spring-boot' END AS wanted FROM findings)
, known AS MATERIALIZED (SELECT root, unnest(frameworks) AS framework FROM projects)
, above AS (SELECT dir, unnest(list_transform(range(1, len(string_split(dir, '/')) + 1), lambda i: array_to_string(string_split(dir, '/')[1:i], '/'))) AS root
   FROM (SELECT DISTINCT dir FROM found WHERE wanted IS NOT NULL))
, held AS MATERIALIZED (SELECT DISTINCT dir, framework FROM above JOIN known USING (root))
, railed AS (SELECT found.* FROM found LEFT JOIN held ON held.dir = found.dir AND held.framework = wanted WHERE (wanted IS NULL OR held.dir IS NOT NULL)
   AND (code NOT IN ('INJ-008','INJ-009','INJ-010','ORM-003','ORM-005') OR (SELECT count(*) > 0 FROM known WHERE framework = 'rails')))
"""


@query("framework_gate", O.with_(*O.sample_findings(list(builtin_rules())), PROJECTS_CTE) + _GATE + f"SELECT {O.SHOWN} FROM railed")
def framework_gate(spark, sf):
    found = sl.materialise(sl.scan(C.samples(spark, sf), builtin_rules()))
    return flat(sl.gate_by_framework(found, builtin_rules(), sl.fingerprint(C.manifests(spark, sf))))


# Half of the controller projects get a module file with the global guard.
_MODULES = """
SELECT concat(source,'/d',cast(doc_id AS varchar(20)),'/app.module.ts') AS path,
  concat('providers: [{ provide: ', CASE WHEN doc_id % 2 = 0 THEN 'APP_GUARD' ELSE 'OTHER' END, ' }]') AS content FROM documents"""
_CONTROLLER = _subset(lambda r: r.code == "NEST-002")


@query("project_exemption", O.with_(
    C.SAMPLES_CTE, f"corpus AS (SELECT path, content FROM {O.SAMPLES_FROM} UNION ALL {_MODULES})", O.files_cte("corpus"),
    O.rules_cte(_CONTROLLER), O.findings_ctes(), PROJECTS_CTE) + """
SELECT f.code, f.file FROM findings f WHERE NOT EXISTS (
  SELECT 1 FROM projects p JOIN corpus m ON starts_with(m.path, p.root || '/') WHERE list_contains(p.frameworks, 'nestjs')
   AND m.path LIKE '%.module.ts' AND contains(m.content, 'APP_GUARD') AND starts_with(f.file, p.root || '/'))""")
def project_exemption(spark, sf):
    modules = C.over(spark, _MODULES, documents=C.table(spark, sf, "documents"))
    files = C.samples(spark, sf).select("path", "content").unionByName(modules)
    known = sl.fingerprint(C.manifests(spark, sf))
    roots = sl.exempt_roots(files, known, _CONTROLLER[0].exempt_marker, "nestjs")
    return sl.exempt_projects(sl.materialise(sl.scan(files, _CONTROLLER)), roots, "NEST-002").select("code", "location.file")


# Code of four languages with a loop around one call; the loop is open for even documents only.
_SCOPED = """
SELECT doc_id, concat('s/f', cast(doc_id AS varchar(20)), CASE doc_id % 4 WHEN 0 THEN '.py' WHEN 1 THEN '.js' WHEN 2 THEN '.go' ELSE '.rs' END) AS path,
  CASE doc_id % 4
   WHEN 0 THEN concat('def f(xs):', chr(10), '    s = ""', chr(10), CASE WHEN doc_id % 8 = 0 THEN '    for x in xs:' ELSE '    if xs:' END, chr(10), '        s += "a"', chr(10))
   WHEN 1 THEN concat('async function f(xs) {', chr(10), CASE WHEN doc_id % 8 = 1 THEN '  for (const x of xs) {' ELSE '  if (xs) {' END, chr(10), '    await g(x);', chr(10), '  }', chr(10), '}', chr(10))
   WHEN 2 THEN concat('func f() {', chr(10), CASE WHEN doc_id % 8 = 2 THEN '  for _, x := range xs {' ELSE '  if ok {' END, chr(10), '    defer x.Close()', chr(10), '  }', chr(10), '}', chr(10))
   ELSE concat('fn f() {', chr(10), CASE WHEN doc_id % 8 = 3 THEN '  for x in xs {' ELSE '  if ok {' END, chr(10), '    s += &format!("{}", x);', chr(10), '  }', chr(10), '}', chr(10)) END AS code,
  text FROM documents"""


@query("scoped_lines", f"""
SELECT CASE doc_id % 4 WHEN 0 THEN 'PERF-201' WHEN 1 THEN 'PERF-101' WHEN 2 THEN 'PERF-301' ELSE 'PERF-001' END AS code, path AS file,
  CASE doc_id % 4 WHEN 0 THEN 4 ELSE 3 END AS line, CASE doc_id % 4 WHEN 0 THEN 9 WHEN 3 THEN 11 ELSE 5 END AS "column"
FROM ({_SCOPED}) WHERE doc_id % 8 < 4""")
def scoped_lines(spark, sf):
    d = C.table(spark, sf, "documents")
    files = C.over(spark, _SCOPED, documents=d)
    # The prose goes into a comment, so every text is read whole and none of it is code.
    mark = F.when(F.col("doc_id") % 4 == 0, "# ").otherwise("// ")
    prose = F.concat(mark, F.regexp_replace("text", r"[\r\n]+", " "))
    return sl.scan_scoped(files.select("path", F.concat("code", prose).alias("content"))).select(
        "code", "location.file", "location.line", "location.column")


@query("scoped_code", None)
def scoped_code(spark, sf):
    return flat(sl.scan_scoped(C.samples(spark, sf)))


_ALL = [r for r in builtin_rules() if not r.framework and not r.scan_framework]


@query("all_detectors", O.with_(*O.code_findings(_ALL)) + f"""
SELECT code, message, severity, category, file, line FROM findings
UNION ALL SELECT 'PLUG-001', 'long text', 'low', 'security', path, NULL FROM corpus_code WHERE strlen(content) > 20000
UNION ALL SELECT 'CRAWL-001', 'crawl warning: unreadable ' || url, 'info', 'crawler', NULL, NULL FROM pages WHERE url LIKE 'http:%'
UNION ALL SELECT 'INT-001', 'detector ''broken'' failed: no such detector', 'medium', 'internal', NULL, NULL""")
def all_detectors(spark, sf):
    files = sl.with_kind(C.code(spark, sf))

    def long_texts(df):
        none = F.lit(None)
        return df.select(
            F.lit("PLUG-001").alias("code"), F.lit("long text").alias("message"), F.lit("low").alias("severity"),
            F.lit("high").alias("confidence"), F.lit("security").alias("category"), none.cast("string").alias("help"),
            F.struct(F.col("path").alias("file"), none.cast("long").alias("byte_offset"), none.cast("long").alias("byte_length"),
                     none.cast("int").alias("line"), none.cast("int").alias("column")).alias("location"),
            F.lit(90).alias("family_no"), F.lit(0).alias("rule_no"))

    def broken(df):
        raise RuntimeError("no such detector")

    errors = C.table(spark, sf, "pages").filter("url LIKE 'http:%'").select(F.concat(F.lit("unreadable "), "url").alias("error"))
    out = sl.run_all(files, [
        Detector("patterns", lambda df: sl.scan(df, _ALL)),
        Detector("long-text", long_texts, wants=lambda: F.octet_length("content") > 20000),
        Detector("broken", broken),
    ], errors)
    return out.select("code", "message", "severity", "category", "location.file", "location.line")

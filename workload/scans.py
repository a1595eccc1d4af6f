"""Sources, classification and projects."""

from __future__ import annotations

from pyspark.sql import functions as F

import scanloom as sl
from scanloom.functions import paths, text
from scanloom.operators import classify
from scanloom.rules.catalogue import secret_rules
from scanloom.sources import blobs as blob_ops
from workload import corpora as C, oracle as O
from workload.registry import query

FLAT = ["code", "message", "severity", "confidence", "category", "help", "location.file", "location.byte_offset",
        "location.byte_length", "location.line", "location.column"]


def flat(findings):
    return findings.select(*FLAT)


@query("corpus_from_table", f"WITH {C.DOCS_CTE} SELECT path, content, strlen(content) AS size FROM corpus_docs")
def corpus_from_table(spark, sf):
    d = C.table(spark, sf, "documents")
    path = F.concat("source", F.lit("/"), "lang", F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return sl.to_corpus(d, path, F.col("text"))


IGNORES = ["*.md", "src1/**", "/src2/en/", "deploy_*", "tests/", "!src1/**/f_*.py", ".git*"]


@query("ignore_globs", O.with_(C.CODE_CTE) + """
SELECT path FROM corpus_code WHERE NOT (
  regexp_matches(path, '^src2/en/') OR regexp_matches(path, '(^|/)tests/') OR regexp_matches(path, '(^|/)deploy_[^/]*/')
  OR regexp_matches(path, '(^|/)\\.git[^/]*/')
  OR (regexp_matches(path, '^src1/[^/]+/')
      AND (regexp_matches(path, '^src1/[^/]+/.+/')))
  OR CASE WHEN regexp_matches(path, '(^|/)\\.git[^/]*$') THEN true
          WHEN regexp_matches(path, '^src1/(.*/)?f_[^/]*\\.py$') THEN false
          WHEN regexp_matches(path, '(^|/)deploy_[^/]*$') THEN true
          WHEN regexp_matches(path, '^src1/.+') THEN true
          WHEN regexp_matches(path, '\\.md$') THEN true ELSE false END
  OR regexp_matches(path, '^src1/[^/]+/'))""")
def ignore_globs(spark, sf):
    return sl.ignore_paths(C.code(spark, sf), IGNORES).select("path")


# A tree of documents; every repository and language has ignore files of its own, some with lines that differ by repository.
_TREE = """
SELECT concat('r', cast(doc_id % 5 AS varchar(20)), '/', lang, '/', CASE doc_id % 4 WHEN 0 THEN 'build/out' WHEN 1 THEN 'src' WHEN 2 THEN 'src/gen' ELSE 'logs' END, '/',
  CASE doc_id % 3 WHEN 0 THEN 'f' WHEN 1 THEN 'keep' ELSE 'g' END, cast(doc_id AS varchar(20)),
  CASE doc_id % 7 WHEN 0 THEN '.log' WHEN 1 THEN '.txt' WHEN 2 THEN '.tmp' WHEN 3 THEN '.log' ELSE '.py' END) AS path, text AS content FROM documents"""
_IGNORES = """
SELECT DISTINCT concat('r', cast(doc_id % 5 AS varchar(20)), '/.gitignore') AS path, concat('*.log', chr(10), '!keep*.log', chr(10), '# none', chr(10),
  '/en/logs/', chr(10), CASE WHEN doc_id % 5 = 3 THEN '' ELSE 'build/' END) AS content FROM documents
UNION ALL SELECT DISTINCT concat('r', cast(doc_id % 5 AS varchar(20)), '/', lang, '/.gitignore'), concat(CASE WHEN lang = 'de' THEN '!build/' ELSE 'build' END, chr(10),
  'src/**/f*.py', chr(10), '*.t?t', chr(10)) FROM documents
UNION ALL SELECT DISTINCT concat('r', cast(doc_id % 5 AS varchar(20)), '/', lang, '/src/.ignore'), concat('!*.txt', chr(10), 'gen/*1?.log', chr(10), '[a-f]*.tmp') FROM documents"""


# The SQL side knows the lines as patterns written by hand, with the level of their file, and decides every entry by the last that matches.
@query("tree_ignore_files", f"""
WITH files AS ({_TREE}),
entries AS (SELECT path, parts[:i] AS p, i < len(parts) AS is_dir FROM (SELECT path, string_split(path, '/') AS parts, unnest(range(1, len(string_split(path, '/')) + 1)) AS i FROM files)),
rules(rank, depth, line, pattern, negated, dir_only, lang, except_r) AS (VALUES
  (0, 1, 1, '(.*/)?[^/]*\\.log', false, false, NULL, NULL), (0, 1, 2, '(.*/)?keep[^/]*\\.log', true, false, NULL, NULL), (0, 1, 4, 'en/logs', false, true, NULL, NULL),
  (0, 1, 5, '(.*/)?build', false, true, NULL, 'r3'), (0, 2, 1, '(.*/)?build', true, true, 'de', NULL), (0, 2, 1, '(.*/)?build', false, false, 'other', NULL),
  (0, 2, 2, 'src/(.*/)?f[^/]*\\.py', false, false, NULL, NULL), (0, 2, 3, '(.*/)?[^/]*\\.t[^/]t', false, false, NULL, NULL),
  (1, 3, 1, '(.*/)?[^/]*\\.txt', true, false, NULL, NULL), (1, 3, 2, 'gen/[^/]*1[^/]\\.log', false, false, NULL, NULL), (1, 3, 3, '(.*/)?[a-f][^/]*\\.tmp', false, false, NULL, NULL)),
hits AS (SELECT e.path, e.p, r.negated, r.rank, r.depth, r.line FROM entries e JOIN rules r ON len(e.p) > r.depth AND (e.is_dir OR NOT r.dir_only)
  AND (r.depth < 3 OR e.p[3] = 'src') AND (r.lang IS NULL OR (r.lang = 'de') = (e.p[2] = 'de')) AND (r.except_r IS NULL OR r.except_r <> e.p[1])
  AND regexp_full_match(array_to_string(e.p[r.depth + 1:], '/'), r.pattern)),
said AS (SELECT path, p, arg_max(negated, (rank, depth, line)) AS negated FROM hits GROUP BY path, p)
SELECT path FROM files WHERE path NOT IN (SELECT path FROM said WHERE NOT negated)""")
def tree_ignore_files(spark, sf):
    d = C.table(spark, sf, "documents")
    return sl.honour_ignore_files(C.over(spark, _TREE, documents=d), C.over(spark, _IGNORES, documents=d)).select("path")


@query("walk_rules", O.with_(C.CODE_CTE) + """
SELECT path FROM corpus_code WHERE len(string_split(path, '/')) <= 4
 AND NOT regexp_matches(path, '(^|/)\\.') AND NOT regexp_matches(path, '(^|/)(target|dist|build|node_modules|venv)/')""")
def walk_rules(spark, sf):
    return sl.walk_filter(C.code(spark, sf), max_depth=4).select("path")


@query("changed_files", O.with_(C.CODE_CTE) + """
, ch AS (SELECT c.path, CASE e.event_type WHEN 'signup' THEN 'A' WHEN 'click' THEN 'M' WHEN 'view' THEN 'R'
            WHEN 'purchase' THEN 'T' ELSE 'D' END AS kind
   FROM (SELECT *, event_id % (SELECT count(*) FROM documents) AS target FROM events) e JOIN corpus_code c ON c.doc_id = e.target)
SELECT path, strlen(content) AS size FROM corpus_code WHERE path IN (SELECT path FROM ch WHERE kind IN ('A','M','R','T'))""")
def changed_files(spark, sf):
    changes = C.revisions(spark, sf).select("path", F.col("change").alias("kind"))
    return sl.changed_only(C.code(spark, sf), changes).select("path", F.octet_length("content").cast("long").alias("size"))


def _history_sql(tail: str, commits_where: str = "", order: str = "") -> str:
    return O.with_(
        C.CODE_CTE, f"commits AS ({C.COMMITS})", f"revisions AS ({C.REVISIONS})",
        f"chosen AS (SELECT sha, author FROM commits WHERE NOT is_merge {commits_where} {order})",
        O.rules_cte(secret_rules(kinds=("other",))),
        """files AS (SELECT DISTINCT r.sha, r.path || '@' || substr(r.sha, 1, 7) AS path, r.content,
             ' (in ' || r.path || ' @ ' || substr(r.sha, 1, 7) || ' by ' || c.author || ')' AS note
           FROM revisions r JOIN chosen c USING (sha) WHERE r.change IN ('A', 'M') AND r.content <> '')""",
        O.findings_ctes(every_text=True, carry="f.note,"),
    ) + tail


_HISTORY = 'SELECT code, message || note AS message, severity, file, byte_offset, line, "column" FROM findings'


def _history(found):
    return found.select("code", "message", "severity", "location.file", "location.byte_offset", "location.line", "location.column")


@query("history_secrets", _history_sql(_HISTORY))
def history_secrets(spark, sf):
    return _history(sl.scan_history(C.commits(spark, sf), C.revisions(spark, sf)))


@query("history_newest_commits", _history_sql(_HISTORY, order="ORDER BY ts DESC, sha DESC LIMIT 500"))
def history_newest_commits(spark, sf):
    return _history(sl.scan_history(C.commits(spark, sf), C.revisions(spark, sf), max_commits=500))


@query("history_stats", O.with_(C.CODE_CTE, f"commits AS ({C.COMMITS})", f"revisions AS ({C.REVISIONS})") + """
SELECT (SELECT count(*) FROM commits WHERE NOT is_merge) AS commits_walked,
  (SELECT count(*) FROM (SELECT DISTINCT sha, path FROM revisions WHERE change IN ('A','M') AND content <> ''
     AND sha IN (SELECT sha FROM commits WHERE NOT is_merge))) AS blobs_scanned""")
def history_stats(spark, sf):
    return sl.history_stats(C.commits(spark, sf), C.revisions(spark, sf))


# Members of containers: every twelfth one is an inner archive, some carry NUL bytes or sit too deep.
_BLOBS = """
SELECT concat('image_', cast(doc_id % 7 AS varchar(20))) AS container,
  CASE WHEN doc_id % 12 = 11 THEN concat('blobs/', cast(doc_id AS varchar(20)), '/layer.tar')
       ELSE concat('layer', cast(doc_id % 3 AS varchar(20)), '/', path) END AS entry,
  cast(doc_id % 6 AS int) AS depth, content, doc_id FROM corpus_code"""


def _blobs(spark, sf):
    base = C.over(spark, _BLOBS, corpus_code=C.code(spark, sf))
    raw = F.col("content").cast("binary")
    padded = F.when(F.col("doc_id") % 10 == 3, F.concat(F.unhex(F.repeat(F.lit("00"), F.octet_length(raw))), raw)).otherwise(raw)
    return base.select("container", "entry", "depth", padded.alias("bytes")).withColumn(
        "size", F.octet_length("bytes").cast("long"))


# A text behind as many NUL bytes as it has itself is binary.
_BLOB_STATUS = f"""
SELECT *, CASE WHEN entry LIKE '%/layer.tar' THEN 'archive'
  WHEN doc_id % 10 = 3 THEN 'binary' ELSE 'scanned' END AS status FROM ({_BLOBS})"""


@query("container_secrets", O.with_(
    C.CODE_CTE, O.rules_cte(secret_rules(kinds=("other",))),
    f"files AS (SELECT container || '::' || entry AS path, content, ' (in image layer ' || entry || ')' AS note FROM ({_BLOB_STATUS}) WHERE status = 'scanned')",
    O.findings_ctes(every_text=True, carry="f.note,")) + _HISTORY)
def container_secrets(spark, sf):
    return _history(sl.scan_blobs(_blobs(spark, sf)))


@query("container_stats", O.with_(C.CODE_CTE, f"st AS ({_BLOB_STATUS})") + """
SELECT count(DISTINCT container) FILTER (status = 'archive') AS layers_scanned, count(*) FILTER (status = 'scanned') AS files_scanned,
  count(*) FILTER (status = 'too_large') AS files_skipped_too_large, count(*) FILTER (status = 'binary') AS files_skipped_binary FROM st""")
def container_stats(spark, sf):
    return blob_ops.blob_stats(_blobs(spark, sf))


@query("binary_members", O.with_(C.CODE_CTE) + f"""
SELECT container, entry, doc_id % 10 = 3 AS binary_text FROM ({_BLOBS})""")
def binary_members(spark, sf):
    return _blobs(spark, sf).select("container", "entry", text.is_binary("bytes").alias("binary_text"))


# --- classification ----------------------------------------------------------

@query("file_kinds", O.with_(C.SAMPLES_CTE, C.CODE_CTE,
       f"paths AS (SELECT path FROM corpus_code UNION ALL SELECT path FROM {O.SAMPLES_FROM} UNION ALL SELECT path FROM {O.MANIFESTS_FROM})")
       + f"SELECT path, {O.KIND} AS kind, {O.EXT} AS ext FROM paths")
def file_kinds(spark, sf):
    every = C.code(spark, sf).select("path").unionByName(C.samples(spark, sf).select("path")).unionByName(
        C.manifests(spark, sf).select("path"))
    return sl.with_kind(every)


# Web texts in three shapes: as they are, on one line, and under a minified name.
_WEB = """
SELECT concat('w/', cast(page_id AS varchar(20)), CASE page_id % 4 WHEN 0 THEN '.js' WHEN 1 THEN '.css' WHEN 2 THEN '.min.js' ELSE '.html' END) AS path,
  CASE WHEN page_id % 8 < 4 THEN replace(html, chr(10), ' ') ELSE html END AS content FROM pages"""


@query("minified_filter", f"""
WITH head AS (SELECT path, content, content AS t FROM ({_WEB}))
SELECT path, strlen(content) AS size FROM head WHERE NOT (
  regexp_matches(path, '\\.min\\.js$') OR (regexp_matches(path, '\\.(js|css)$') AND t IS NOT NULL AND strlen(t) >= 256
  AND strlen(t) // (1 + length(t) - length(replace(t, chr(10), ''))) >= 500))""")
def minified_filter(spark, sf):
    web = C.over(spark, _WEB, pages=C.table(spark, sf, "pages"))
    return sl.drop_minified(web).select("path", F.octet_length("content").cast("long").alias("size"))


@query("file_families", O.with_(C.SAMPLES_CTE, O.files_cte(O.SAMPLES_FROM)) + "SELECT path, fam AS family, wf AS workflow FROM files")
def file_families(spark, sf):
    return sl.route_family(sl.with_kind(C.samples(spark, sf))).select("path", "family", "workflow")


@query("special_files", O.with_(C.SAMPLES_CTE, f"f AS (SELECT * FROM {O.SAMPLES_FROM})") + f"""
SELECT path, coalesce({O.FAMILY} = 'dockerfile', false) AS dockerfile, {O.EXT} IN ('tf', 'tfvars') AS terraform,
  {O.EXT} IN ('yaml', 'yml') AND coalesce({O.FAMILY} = 'kubernetes', false) AS kubernetes,
  regexp_matches(path, '(^|/)\\.github/workflows/[^/]*\\.ya?ml$') AS workflow,
  regexp_matches(path, '(/settings/|/(settings|base|production|prod)\\.py$)') AND regexp_matches(content, '(?m)^\\s*(INSTALLED_APPS|MIDDLEWARE)\\s*=') AS settings,
  regexp_matches(path, '/app/(.*/)?route\\.(ts|tsx|js|jsx|mts|cts)$') AS route, regexp_matches(path, '\\.module\\.(ts|tsx|js|jsx|mts|cts)$') AS module_file
FROM f""")
def special_files(spark, sf):
    return C.samples(spark, sf).select(
        "path", paths.is_dockerfile("path").alias("dockerfile"), paths.is_terraform("path").alias("terraform"),
        paths.is_k8s("path", "content").alias("kubernetes"), paths.is_workflow("path").alias("workflow"),
        paths.is_settings("path", "content").alias("settings"), paths.is_route("path").alias("route"),
        paths.is_module_file("path").alias("module_file"))


# --- projects ----------------------------------------------------------------

PARENT = "regexp_replace({p}, '/?[^/]*$', '')"
PROJECTS_CTE = f"""projects AS (SELECT regexp_replace(path, '/?[^/]*$', '') AS root, path AS manifest,
  CASE {O.BASE} WHEN 'package.json' THEN CASE WHEN content LIKE '%"typescript"%' THEN 'typescript' ELSE 'javascript' END
    WHEN 'Cargo.toml' THEN 'rust' WHEN 'requirements.txt' THEN 'python' WHEN 'pyproject.toml' THEN 'python' WHEN 'pom.xml' THEN 'java'
    WHEN 'Gemfile' THEN 'ruby' WHEN 'go.mod' THEN 'go' WHEN 'composer.json' THEN 'php' WHEN 'build.gradle.kts' THEN 'kotlin'
    WHEN 'mix.lock' THEN 'elixir' END AS language,
  CASE {O.BASE} WHEN 'package.json' THEN 'npm' WHEN 'Cargo.toml' THEN 'cargo' WHEN 'requirements.txt' THEN 'pypi'
    WHEN 'pyproject.toml' THEN 'pypi' WHEN 'pom.xml' THEN 'maven' WHEN 'Gemfile' THEN 'bundler' WHEN 'go.mod' THEN 'gomod'
    WHEN 'composer.json' THEN 'composer' WHEN 'build.gradle.kts' THEN 'gradle' WHEN 'mix.lock' THEN 'hex' END AS ecosystem,
  list_filter([
    CASE WHEN content LIKE '%"next"%' THEN 'nextjs' END, CASE WHEN content LIKE '%"@nestjs/core"%' THEN 'nestjs' END,
    CASE WHEN content LIKE '%"react"%' THEN 'react' END,
    CASE WHEN contains(content, chr(10) || 'axum') THEN 'axum' END, CASE WHEN lower(content) LIKE '%django%' THEN 'django' END,
    CASE WHEN lower(content) LIKE '%flask%' THEN 'flask' END, CASE WHEN content LIKE '%gin-gonic/gin%' THEN 'gin' END,
    CASE WHEN content LIKE '%spring-boot-starter%' OR content LIKE '%org.springframework.boot%' THEN 'spring-boot' END,
    CASE WHEN content LIKE '%"laravel/framework"%' THEN 'laravel' END, CASE WHEN content LIKE '%"symfony/symfony"%' THEN 'symfony' END,
    CASE WHEN content LIKE '%"rails"%' THEN 'rails' END], lambda x: x IS NOT NULL) AS frameworks
 FROM {O.MANIFESTS_FROM} WHERE path NOT LIKE '%README.md')"""


@query("project_fingerprint", O.with_(C.SAMPLES_CTE, PROJECTS_CTE)
       + "SELECT root, manifest, language, ecosystem, array_to_string(frameworks, ',') AS frameworks FROM projects")
def project_fingerprint(spark, sf):
    return sl.fingerprint(C.manifests(spark, sf)).withColumn("frameworks", F.array_join("frameworks", ","))


@query("fingerprint_sets", O.with_(C.SAMPLES_CTE, PROJECTS_CTE) + """
SELECT array_to_string(list_sort(list(DISTINCT language)), ',') AS languages, array_to_string(list_sort(list(DISTINCT ecosystem)), ',') AS ecosystems,
  (SELECT array_to_string(list_sort(list(DISTINCT x)), ',') FROM (SELECT unnest(frameworks) AS x FROM projects)) AS frameworks FROM projects""")
def fingerprint_sets(spark, sf):
    sets = sl.fingerprint_summary(sl.fingerprint(C.manifests(spark, sf)))
    return sets.select(*[F.array_join(c, ",").alias(c) for c in sets.columns])


@query("project_assignment", O.with_(C.SAMPLES_CTE, PROJECTS_CTE, f"files AS (SELECT path FROM {O.SAMPLES_FROM})") + """
SELECT f.path, min(p.root) AS root FROM files f JOIN projects p ON starts_with(f.path, p.root || '/') GROUP BY f.path""")
def project_assignment(spark, sf):
    return sl.assign_projects(C.samples(spark, sf), sl.fingerprint(C.manifests(spark, sf)))


@query("project_labels", O.with_(C.SAMPLES_CTE, PROJECTS_CTE) + """
, l AS (SELECT DISTINCT regexp_extract(root, '^[^/]*') AS unit,
   coalesce(frameworks[1], language) || ' (' || regexp_extract(root, '([^/]*)$', 1) || ')' AS label FROM projects)
SELECT unit, label, row_number() OVER (PARTITION BY unit ORDER BY label) - 1 AS position FROM l""")
def project_labels(spark, sf):
    return sl.project_label_rows(sl.fingerprint(C.manifests(spark, sf)), by=F.substring_index("root", "/", 1))

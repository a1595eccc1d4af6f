"""Building blocks of the SQL side: classification, rule matching and positions, written independently."""

from __future__ import annotations

from scanloom.operators import classify
from scanloom.rules import Rule
from workload.corpora import CODE_CTE, CORPUS_MANIFESTS, CORPUS_SAMPLES, SAMPLES_CTE, literal, values

BASE = "regexp_extract(path, '([^/]*)$', 1)"
EXT = f"CASE WHEN instr(substr({BASE}, 2), '.') > 0 THEN lower(regexp_extract({BASE}, '\\.([^.]*)$', 1)) ELSE '' END"


def names(items) -> str:
    return "(" + ", ".join(literal(x) for x in items) + ")"


KIND = f"""CASE WHEN lower({BASE}) IN {names(classify.MANIFEST_NAMES)} THEN 'manifest'
 WHEN lower({BASE}) IN ('conftest.py', 'tests.rs') OR regexp_matches(lower({BASE}), '^test_.*[.](py|rs)$')
   OR regexp_matches(lower({BASE}), '(_test[.](go|py|rb|rs)|_tests[.]rs|_spec[.]rb|[.](spec|test)[.]([cm]js|[jt]sx?))$')
   OR list_has_any(string_split(lower(path), '/'), {literal(list(classify.TEST_DIRECTORIES))}) THEN 'test'
 WHEN lower({BASE}) IN ('.env', '.envrc') OR starts_with(lower({BASE}), '.env.') THEN 'config'
 WHEN {EXT} IN {names(classify.SOURCE_EXTENSIONS)} THEN 'source'
 WHEN {EXT} IN {names(classify.CONFIG_EXTENSIONS)} THEN 'config' ELSE 'other' END"""

FAMILY = f"""CASE WHEN regexp_matches(lower({BASE}), '^(dockerfile|containerfile|dockerfile\\..*|.*\\.dockerfile)$') THEN 'dockerfile'
 WHEN {EXT} IN ('tf', 'tfvars') THEN 'terraform'
 WHEN {EXT} IN ('yaml', 'yml') AND regexp_matches(content,
   '(?m)^\\s*apiVersion:\\s*\\S[\\s\\S]*?^\\s*kind:\\s*(Pod|Deployment|StatefulSet|DaemonSet|Job|CronJob|ReplicaSet|ReplicationController)\\b')
 THEN 'kubernetes' END"""
WORKFLOW = f"""({KIND} = 'config' AND regexp_matches(lower(path), '(^|/)\\.github/workflows/.*\\.ya?ml$'))"""

_RULES = ("rule_no, family_no, code, pattern, message, trailer, quote, severity, confidence, category, help, exts, kinds, "
          "family, path_pattern, all_of, none_of, max_matches, line_exclude, allow, min_entropy")


def rules_cte(rules: list[Rule], name: str = "rules") -> str:
    rows = [
        (r.rule_no, r.family_no, r.code, r.pattern, r.message, r.trailer, r.quote, r.severity, r.confidence, r.category,
         r.help, list(r.extensions), list(r.kinds), r.family, r.path_pattern, list(r.all_of), list(r.none_of),
         r.max_matches, r.line_exclude, list(r.allow), r.min_entropy)
        for r in rules
    ]
    return f"{name}({_RULES}) AS (SELECT * FROM {values(rows)})"


def files_cte(source: str, name: str = "files") -> str:
    return (f"{name} AS MATERIALIZED (SELECT *, {KIND} AS kind, {EXT} AS ext, {FAMILY} AS fam, {WORKFLOW} AS wf FROM {source})")


ENTROPY = """(SELECT -sum(share * log2(share)) FROM (SELECT (length({t}) - length(replace({t}, ch, ''))) / length({t}) AS share
 FROM (SELECT unnest(list_distinct(string_split({t}, ''))) AS ch) WHERE ch <> ''))"""

ENTROPY_LIST = """list_sum(list_transform(list_filter(list_distinct(string_split({t}, '')), lambda ch: ch <> ''),
 lambda ch: -((length({t}) - length(replace({t}, ch, ''))) / length({t})) * log2((length({t}) - length(replace({t}, ch, ''))) / length({t}))))"""

CALL = "regexp_replace(regexp_replace(hit, '[, \\t]+$', ''), '\\)$', '')"
MESSAGE = f"""CASE WHEN trailer = '' THEN message ELSE '`' || CASE quote
  WHEN 'clip' THEN regexp_replace(hit, '^\\s+|\\s+$', '', 'g') WHEN 'line' THEN regexp_replace(hit, '^\\s+|\\s+$', '', 'g')
  ELSE {CALL} || repeat(')', greatest(
     (length({CALL}) - length(replace({CALL}, '(', ''))) - (length({CALL}) - length(replace({CALL}, ')', ''))), 0)::BIGINT) END
  || '` ' || trailer END"""


def applies() -> str:
    return """((r.family <> '' AND (r.family = f.fam OR (r.family = 'workflow' AND f.wf)))
  OR (r.family = '' AND list_contains(r.kinds, f.kind) AND (len(r.exts) = 0 OR list_contains(r.exts, f.ext))))"""


def findings_ctes(files: str = "files", rules: str = "rules", every_text: bool = False, out: str = "findings",
                  carry: str = "") -> str:
    """CTEs from files and rules to findings with positions; prefixes are simply pasted together."""
    where = "true" if every_text else applies()
    return f"""
cand AS (SELECT f.path, f.content, {carry} r.* FROM {files} f JOIN {rules} r ON {where}
  WHERE (r.path_pattern = '' OR regexp_matches(lower(f.path), r.path_pattern)) AND regexp_matches(f.content, r.pattern)
    AND len(list_filter(r.all_of, lambda p: NOT regexp_matches(f.content, p))) = 0
    AND len(list_filter(r.none_of, lambda p: regexp_matches(f.content, p))) = 0),
cut AS (SELECT *, regexp_extract_all(content, pattern) AS m, regexp_split_to_array(content, pattern) AS p FROM cand),
each AS (SELECT *, unnest(range(len(m))) AS k FROM cut),
pos AS (SELECT * EXCLUDE (m, p), m[k + 1] AS hit,
   array_to_string(list_concat(list_transform(range(k), lambda i: p[i + 1] || m[i + 1]), [p[k + 1]]), '') AS prefix FROM each
   WHERE max_matches = 0 OR k < max_matches),
{out} AS (SELECT {carry.replace('f.', '')} code, {MESSAGE} AS message, severity, confidence, category, help, path AS file, strlen(prefix) AS byte_offset,
   strlen(hit) AS byte_length, 1 + length(prefix) - length(replace(prefix, chr(10), '')) AS line,
   1 + length(regexp_extract(prefix, '([^\\n]*)$', 1)) AS "column", family_no, rule_no
  FROM pos WHERE NOT list_contains(allow, hit)
    AND (min_entropy = 0 OR {ENTROPY_LIST.format(t='hit')} >= min_entropy)
    AND (line_exclude = '' OR NOT regexp_matches(
       string_split(content, chr(10))[1 + length(prefix) - length(replace(prefix, chr(10), ''))], line_exclude)))
"""


SHOWN = 'code, message, severity, confidence, category, help, file, byte_offset, byte_length, line, "column"'
SAMPLES_FROM = f"({CORPUS_SAMPLES})"
MANIFESTS_FROM = f"({CORPUS_MANIFESTS})"


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n"


def code_findings(rules: list[Rule]) -> list[str]:
    """CTEs for findings over the code corpus."""
    return [CODE_CTE, files_cte("corpus_code"), rules_cte(rules), findings_ctes()]


def sample_findings(rules: list[Rule]) -> list[str]:
    return [SAMPLES_CTE, files_cte(SAMPLES_FROM), rules_cte(rules), findings_ctes()]

"""Packages and advisories. Lock files of all formats are generated from `part`, so the SQL side knows what they hold."""

from __future__ import annotations

from pyspark.sql import functions as F

import scanloom as sl
from scanloom.functions.grades import advisory_severity
from scanloom.functions.versions import purl, version_key
from scanloom.operators.packages import ECOSYSTEMS, FORMATS
from workload import corpora as C
from workload.registry import query

N = "concat('pkg-', cast(p_partkey AS varchar(20)))"
V = "concat(cast(p_size % 3 AS varchar(20)), '.', cast(p_size % 10 AS varchar(20)), '.', cast(p_partkey % 10 AS varchar(20)))"
NL = "chr(10)"

# format -> (header, block per part, separator, footer, expected name, expected version, which parts count)
LOCKS = {
    "cargo": ("'version = 3'", f"""concat('[[package]]', {NL}, 'name = "', {N}, '"', {NL}, 'version = "', {V}, '"', {NL},
        CASE WHEN p_partkey % 5 = 0 THEN '' ELSE concat('source = "registry+https://x"', {NL}) END, 'dependencies = [', {NL}, ' "y",', {NL}, ']', {NL})""",
              NL, f"concat({NL}, '[metadata]', {NL}, 'name = \"z\"')", N, V, "p_partkey % 5 <> 0"),
    "npm": ("""'{"packages": {"": {"name": "root", "version": "1"},'""", f"""concat('"node_modules/x/node_modules/', {N}, '": {{"version": "', {V}, '"',
        CASE WHEN p_partkey % 5 = 0 THEN ', "link": true' ELSE '' END, '}}')""", "','", "'}}'", N, V, "p_partkey % 5 <> 0"),
    "pnpm": (f"concat('lockfileVersion: 6', {NL}, 'importers:', {NL}, '  skip@1.0.0:', {NL}, {NL}, 'packages:', {NL})",
             f"""CASE WHEN p_partkey % 5 = 0 THEN concat('  ''@s/', {N}, '@', {V}, '(peer@2.0.0)'':', {NL}, '    resolution: x')
                 ELSE concat('  /', {N}, '@', {V}, ':', {NL}, '    resolution: x') END""", NL,
             f"concat({NL}, 'snapshots:', {NL}, '  tail@9.9.9:')", f"CASE WHEN p_partkey % 5 = 0 THEN concat('@s/', {N}) ELSE {N} END", V, "true"),
    "yarn": (f"concat('# yarn', {NL}, '__metadata:', {NL}, '  version: 6', {NL})",
             f"""CASE WHEN p_partkey % 5 = 0 THEN concat('"', {N}, '@npm:^1.0.0":', {NL}, '  version: ', {V}, {NL})
                 ELSE concat({N}, '@^1.0.0, ', {N}, '@^1.1.0:', {NL}, '  version "', {V}, '"', {NL}, '  resolved "u"', {NL}) END""",
             NL, "''", N, V, "true"),
    "requirements": ("'# pins'", f"""CASE p_partkey % 5 WHEN 0 THEN concat({N}, '[extra]==', {V}, ' ; python_version > "3" # c') WHEN 1 THEN concat({N}, '>=', {V})
        WHEN 2 THEN concat('-r ', {N}, '==', {V}) ELSE concat({N}, '==', {V}) END""", NL, "''", N, V, "p_partkey % 5 NOT IN (1, 2)"),
    "poetry": ("'# lock'", f"""concat('[[package]]', {NL}, 'name = "', {N}, '"', {NL}, 'version = "', {V}, '"', {NL}, {NL}, '[package.extras]', {NL}, 'name = "no"', {NL})""",
               NL, "''", N, V, "true"),
    "pipfile": ("""'{"default": {'""", f"""concat('"', {N}, '": {{', CASE WHEN p_partkey % 5 = 0 THEN '"git": "u"' ELSE concat('"version": "==', {V}, '"') END, '}}')""",
                "','", "'}, \"develop\": {}}'", N, V, "p_partkey % 5 <> 0"),
    "uv": ("'version = 1'", f"""concat('[[package]]', {NL}, 'name = "', {N}, '"', {NL}, 'version = "', {V}, '"', {NL}, 'dependencies = [', {NL}, '    {{ name = "no" }},', {NL}, ']', {NL})""",
           NL, "''", N, V, "true"),
    "gemfile": (f"concat('GEM', {NL}, '  remote: https://x', {NL}, '  specs:', {NL})",
                f"concat('    ', {N}, ' (', {V}, ')', {NL}, '      dep (>= 1.0)')", NL, f"concat({NL}, {NL}, 'PLATFORMS', {NL}, '    ruby (9)')", N, V, "true"),
    "composer": ("""'{"packages": ['""", f"""concat('{{"name": "v/', {N}, '", "version": "v', {V}, '"}}')""", "','", "'], \"packages-dev\": []}'", f"concat('v/', {N})", V, "true"),
    "nuget": ("""'{"dependencies": {"net8.0": {"Twice": {"resolved": "1.0.0"}},"net6.0": {"Twice": {"resolved": "1.0.0"},'""",
              f"""concat('"', {N}, '": {{"resolved": "', {V}, '"}}')""", "','", "'}}}'", N, V, "true"),
    "swift": ("""'{"pins": ['""", f"""concat('{{"location": "https://Host.example/', {N}, '.git", "state": {{"version": "', {V}, '"}}}}')""", "','", "'], \"version\": 2}'",
              f"concat('host.example/', {N})", V, "true"),
    "pubspec": (f"concat('packages:', {NL})", f"""concat('  ', {N}, ':', {NL}, '    dependency: transitive', {NL}, '    version: "', {V}, '"')""", NL,
                f"concat({NL}, 'sdks:', {NL}, '  dart:', {NL}, '    version: \"9\"')", N, V, "true"),
    "mix": (f"concat('%{{', {NL})", f"""concat('  "', {N}, '": ', CASE WHEN p_partkey % 5 = 0 THEN '{{:git, "u"' ELSE '{{:hex, :x' END, ', "', {V}, '", "h", [:mix]}},')""",
            NL, "'}'", N, V, "p_partkey % 5 <> 0"),
    "pom": (f"concat('<project><dependencyManagement><dependency><groupId>m</groupId><artifactId>m</artifactId><version>1</version></dependency></dependencyManagement>', {NL})",
            f"""concat(CASE WHEN p_partkey % 5 = 1 THEN '<!-- ' ELSE '' END, '<dependency><groupId> g </groupId><artifactId>', {N}, '</artifactId><version>',
                CASE WHEN p_partkey % 5 = 0 THEN '${{v}}' ELSE {V} END, '</version></dependency>', CASE WHEN p_partkey % 5 = 1 THEN ' -->' ELSE '' END)""",
            NL, "'</project>'", f"concat('g:', {N})", V, "p_partkey % 5 > 1"),
    "gradle": (f"concat('# lock', {NL})", f"concat('g.h:', {N}, ':', {V}, '=compileClasspath,runtimeClasspath')", NL, f"concat({NL}, 'empty=annotationProcessor')",
               f"concat('g.h:', {N})", V, "true"),
    "gosum": ("''", f"concat('m.example/', {N}, ' v', {V}, ' h1:a=', {NL}, 'm.example/', {N}, ' v', {V}, '/go.mod h1:b=')", NL, "''",
              f"concat('m.example/', {N})", f"concat('v', {V})", "true"),
}
_FILE = {fmt: name for name, fmt in FORMATS.items()}


def lock_files(spark, sf, formats=None):
    """One lock file per brand and format."""
    part = C.table(spark, sf, "part")
    out = None
    for fmt, (head, block, sep, foot, *_rest) in LOCKS.items():
        if formats and fmt not in formats:
            continue
        text = part.select("p_brand", F.col("p_partkey").alias("ord"), F.expr(block).alias("block"))
        glue = "" if head in ("''",) or not head.startswith("'") or head.startswith("'{") else "\n"
        joined = text.groupBy("p_brand").agg(F.sort_array(F.collect_list(F.struct("ord", "block"))).alias("b"))
        one = joined.select(
            F.concat(F.lit("r/"), F.replace("p_brand", F.lit("#"), F.lit("")), F.lit(f"/{_FILE[fmt]}")).alias("path"),
            F.concat(F.expr(head), F.lit(glue), F.array_join(F.col("b.block"), "\n" if sep == NL else ","), F.expr(foot)).alias("content"))
        out = one if out is None else out.unionByName(one)
    return out


def _expected(formats=None) -> str:
    rows = []
    for fmt, (_h, _b, _s, _f, name, version, where) in LOCKS.items():
        if formats and fmt not in formats:
            continue
        rows.append(f"SELECT '{ECOSYSTEMS[fmt]}' AS ecosystem, {name} AS name, {version} AS version, "
                    f"'r/' || replace(p_brand, '#', '') || '/{_FILE[fmt]}' AS source FROM part WHERE {where}")
        if fmt == "nuget":
            rows.append("SELECT DISTINCT 'NuGet', 'Twice', '1.0.0', 'r/' || replace(p_brand, '#', '') || '/packages.lock.json' FROM part")
    return " UNION ALL ".join(rows)


@query("packages_all_formats", _expected())
def packages_all_formats(spark, sf):
    return sl.extract_packages(lock_files(spark, sf))


@query("lockfile_formats", "WITH b AS (SELECT DISTINCT p_brand FROM part) " + " UNION ALL ".join(
    f"SELECT 'r/' || replace(p_brand, '#', '') || '/{_FILE[f]}' AS path, '{f}' AS format FROM b" for f in LOCKS))
def lockfile_formats(spark, sf):
    return sl.with_format(lock_files(spark, sf)).select("path", "format")


_PY = ("requirements", "poetry", "uv", "pipfile")
_ORDER = {f: i for i, f in enumerate(FORMATS.values())}


@query("package_inventory", f"""
WITH p AS ({_expected()}), o AS (SELECT *, CASE regexp_extract(source, '([^/]*)$', 1) {' '.join(f"WHEN '{_FILE[f]}' THEN {i}" for f, i in _ORDER.items())} END AS ord FROM p)
SELECT ecosystem, name, version, arg_min(source, (ord, source)) AS source FROM o GROUP BY 1, 2, 3""")
def package_inventory(spark, sf):
    return sl.inventory(sl.extract_packages(lock_files(spark, sf)))


@query("package_urls", f"""
WITH p AS (SELECT DISTINCT ecosystem, name, version FROM ({_expected()}))
SELECT ecosystem, name, version, 'pkg:' || CASE ecosystem WHEN 'crates.io' THEN 'cargo' WHEN 'PyPI' THEN 'pypi' WHEN 'Go' THEN 'golang' WHEN 'RubyGems' THEN 'gem'
  WHEN 'Packagist' THEN 'composer' WHEN 'SwiftURL' THEN 'swift' ELSE lower(ecosystem) END || '/' || CASE WHEN ecosystem = 'Maven' THEN regexp_replace(name, ':', '/') ELSE name END
  || '@' || version AS url FROM p""")
def package_urls(spark, sf):
    p = sl.extract_packages(lock_files(spark, sf)).select("ecosystem", "name", "version").distinct()
    return p.withColumn("url", purl("ecosystem", "name", "version"))


_PINNED = _expected(("requirements",))
_KEY = "list_transform(string_split({v}, '.'), lambda x: CAST(x AS INT))"
_MATCH = f"""
WITH a AS ({C.ADVISORIES}), p AS ({_PINNED}),
m AS (SELECT p.*, a.* EXCLUDE (ecosystem, name) FROM p JOIN a ON a.ecosystem = p.ecosystem AND a.name = p.name
  WHERE {_KEY.format(v='p.version')} >= {_KEY.format(v='a.introduced')} AND {_KEY.format(v='p.version')} < {_KEY.format(v='a.fixed')})
"""


def _matches(spark, sf):
    return sl.match_advisories(sl.extract_packages(lock_files(spark, sf, ("requirements",))), C.advisories(spark, sf))


@query("advisory_matches", _MATCH + "SELECT ecosystem, name, version, source, id, rating FROM m")
def advisory_matches(spark, sf):
    return _matches(spark, sf).select("ecosystem", "name", "version", "source", "id", "rating")


# Advisories of all ecosystems: ranges open at either end, closed ones, version lists, both, and neither.
_ALL_ADVISORIES = f"""
SELECT concat('ALL-', cast(l_orderkey AS varchar(20)), '-', cast(l_linenumber AS varchar(20))) AS id, e.ecosystem,
  concat(e.prefix, 'pkg-', cast(l_partkey AS varchar(20))) AS name,
  CASE WHEN l_orderkey % 5 < 3 THEN concat(e.mark, cast(l_suppkey % 3 AS varchar(20)), '.', cast(l_linenumber AS varchar(20))) END AS introduced,
  CASE WHEN l_orderkey % 7 < 4 THEN concat(e.mark, cast(l_suppkey % 4 AS varchar(20)), '.', cast(l_suppkey % 11 AS varchar(20)), '.', cast(l_linenumber AS varchar(20))) END AS fixed,
  CASE WHEN l_orderkey % 3 = 0 THEN array(concat(e.mark, cast(l_suppkey % 3 AS varchar(20)), '.', cast(l_partkey % 10 AS varchar(20)), '.', cast(l_partkey % 10 AS varchar(20))), '9.9.9') END AS versions
FROM lineitem JOIN ecosystems e ON e.no = l_orderkey % 12"""
# What the lock files of an ecosystem put before names and versions.
_PREFIXES = [(e, p, m) for e, p, m in (
    ("crates.io", "", ""), ("npm", "", ""), ("npm", "@s/", ""), ("PyPI", "", ""), ("RubyGems", "", ""), ("Packagist", "v/", ""),
    ("NuGet", "", ""), ("SwiftURL", "host.example/", ""), ("Pub", "", ""), ("Hex", "", ""), ("Maven", "g:", ""), ("Go", "m.example/", "v"))]


def _all_advisories(spark, sf):
    names = spark.createDataFrame([(i, *row) for i, row in enumerate(_PREFIXES)], "no int, ecosystem string, prefix string, mark string")
    return C.over(spark, _ALL_ADVISORIES, lineitem=C.table(spark, sf, "lineitem"), ecosystems=names)


_NUMBERS = "list_transform(string_split(regexp_replace(regexp_replace({v}, '^v', ''), '(\\.0+)+$', ''), '.'), lambda x: CAST(x AS INT))"


@query("advisory_matches_all", f"""
WITH ecosystems(no, ecosystem, prefix, mark) AS (SELECT * FROM {C.values([(i, *row) for i, row in enumerate(_PREFIXES)])}),
a AS ({_ALL_ADVISORIES.replace('array(', 'list_value(')}), p AS ({_expected()})
SELECT p.ecosystem, p.name, p.version, p.source, a.id FROM p JOIN a ON a.ecosystem = p.ecosystem AND a.name = p.name
WHERE coalesce(list_contains(a.versions, p.version), false) OR ((a.introduced IS NOT NULL OR a.fixed IS NOT NULL)
  AND (a.introduced IS NULL OR {_NUMBERS.format(v='p.version')} >= {_NUMBERS.format(v='a.introduced')})
  AND (a.fixed IS NULL OR {_NUMBERS.format(v='p.version')} < {_NUMBERS.format(v='a.fixed')}))""")
def advisory_matches_all(spark, sf):
    return sl.match_advisories(sl.extract_packages(lock_files(spark, sf)), _all_advisories(spark, sf)).select("ecosystem", "name", "version", "source", "id")


_GRADE = """CASE WHEN score >= 9 THEN 'critical' WHEN score >= 7 THEN 'high' WHEN score >= 4 THEN 'medium' WHEN score IS NOT NULL THEN 'low'
  WHEN rating = 'CRITICAL' THEN 'critical' WHEN rating = 'HIGH' THEN 'high' WHEN rating = 'LOW' THEN 'low' ELSE 'medium' END"""
_ENTRIES = ("array(struct('OTHER' AS type, '9.9' AS score), struct('CVSS_V3' AS type, CASE WHEN score IS NULL THEN 'CVSS:3.1/AV:N' "
            "WHEN score < 5 THEN concat('CVSS:4.0/BS:', cast(score AS string)) ELSE cast(score AS string) END AS score))")


@query("advisory_grades", f"WITH a AS ({C.ADVISORIES}) SELECT id, {_GRADE} AS severity FROM a")
def advisory_grades(spark, sf):
    a = C.advisories(spark, sf).withColumn("entries", F.expr(_ENTRIES))
    return a.select("id", advisory_severity("entries", "rating").alias("severity"))


@query("advisory_findings", _MATCH + f"""
SELECT 'DEP-' || id AS code, name || ' ' || version || ' :: advisory ' || id || ' affects ' || name || ' ' || version AS message, {_GRADE} AS severity,
  CASE WHEN id LIKE 'RUSTSEC-%' THEN 'https://rustsec.org/advisories/' || id WHEN id LIKE 'GHSA-%' THEN 'https://github.com/advisories/' || id
  ELSE 'https://osv.dev/vulnerability/' || id END AS help, source AS file FROM m""")
def advisory_findings(spark, sf):
    m = _matches(spark, sf).withColumn("severity", F.expr(_ENTRIES))
    return sl.advisory_findings(m).select("code", "message", "severity", "help", "location.file")


@query("version_order", """
SELECT a.p_partkey AS left_part, b.p_partkey AS right_part, list_transform(string_split(a.v, '.'), lambda x: CAST(x AS INT)) < list_transform(string_split(b.v, '.'), lambda x: CAST(x AS INT)) AS older
FROM (SELECT p_partkey, """ + V + """ AS v FROM part) a JOIN (SELECT p_partkey, """ + V + """ AS v FROM part) b ON b.p_partkey = a.p_partkey + 1""")
def version_order(spark, sf):
    v = C.table(spark, sf, "part").select("p_partkey", version_key(F.expr(V)).alias("k"))
    a, b = v.alias("a"), v.select((F.col("p_partkey") - 1).alias("prev"), F.col("p_partkey").alias("right_part"), F.col("k").alias("kb")).alias("b")
    return a.join(b, F.col("a.p_partkey") == F.col("b.prev")).select(
        F.col("a.p_partkey").alias("left_part"), "right_part", (F.col("a.k") < F.col("kb")).alias("older"))


# Cache entries made of events: fetched when the event happened, looked up a day after the newest one.
_CACHE = f"""
SELECT concat('PyPI::', {N}, '::', {V}) AS key, o_orderdate AS fetched_at, o_orderkey AS payload
FROM orders JOIN part ON p_partkey = o_custkey"""


def _cache(spark, sf):
    return C.over(spark, _CACHE, orders=C.table(spark, sf, "orders"), part=C.table(spark, sf, "part")).withColumn("fetched_at", F.col("fetched_at").cast("timestamp"))


_NOW = "TIMESTAMP '1998-01-01 00:00:00'"


@query("cache_merge", f"""
WITH c AS ({_CACHE}) SELECT key, strftime(max(CAST(fetched_at AS TIMESTAMP)), '%Y-%m-%d') AS fetched_on FROM c GROUP BY key""")
def cache_merge(spark, sf):
    c = _cache(spark, sf)
    merged = sl.merge_cache(c.filter("payload % 2 = 0"), c.filter("payload % 2 = 1"))
    return merged.select("key", F.date_format("fetched_at", "yyyy-MM-dd").alias("fetched_on"))


@query("cache_lookups", f"""
WITH c AS ({_CACHE}), fresh AS (SELECT DISTINCT key FROM c WHERE CAST(fetched_at AS TIMESTAMP) > {_NOW} - INTERVAL 24 HOUR),
k AS (SELECT DISTINCT ecosystem || '::' || name || '::' || version AS key FROM ({_PINNED}))
SELECT key, key IN (SELECT key FROM fresh) AS cached FROM k""")
def cache_lookups(spark, sf):
    packages = sl.extract_packages(lock_files(spark, sf, ("requirements",)))
    fresh, missing = sl.split_by_freshness(packages, _cache(spark, sf), F.expr(_NOW))
    return fresh.select("key").distinct().withColumn("cached", F.lit(True)).unionByName(
        missing.select("key").withColumn("cached", F.lit(False)))


_URL = """'pkg:' || CASE ecosystem WHEN 'crates.io' THEN 'cargo' WHEN 'PyPI' THEN 'pypi' WHEN 'Go' THEN 'golang' WHEN 'RubyGems' THEN 'gem'
  WHEN 'Packagist' THEN 'composer' WHEN 'SwiftURL' THEN 'swift' ELSE lower(ecosystem) END || '/' ||
  CASE WHEN ecosystem = 'Maven' THEN regexp_replace(name, ':', '/') ELSE name END || '@' || version"""


# Every item of both documents with its place, and what stands around the items.
@query("inventory_documents", f"""
WITH p AS (SELECT DISTINCT ecosystem, name, version, regexp_extract(source, '^([^/]*)') AS unit FROM ({_expected()})),
i AS (SELECT unit, name, version, {_URL} AS url, row_number() OVER (PARTITION BY unit ORDER BY ecosystem, name, version) - 1 AS position FROM p)
SELECT 'cyclonedx' AS document, unit, 3 AS section, position, name, version, url AS purl, url AS id FROM i
UNION ALL SELECT 'spdx', unit, 3, position, name, version, url, 'SPDXRef-Package-' || position FROM i
UNION ALL SELECT d, unit, s, 0, NULL, NULL, NULL, NULL FROM (SELECT DISTINCT unit FROM p), (SELECT unnest(['cyclonedx', 'spdx']) AS d), (SELECT unnest([0, 4]) AS s)""")
def inventory_documents(spark, sf):
    # Both documents list the same packages: they are read and ordered once.
    p = sl.place_packages(sl.extract_packages(lock_files(spark, sf)))
    shapes = {"cyclonedx": "`bom-ref` string, name string, version string, purl string",
              "spdx": "SPDXID string, name string, versionInfo string, externalRefs array<struct<referenceLocator:string>>"}

    def items(records, kind):
        r = records.withColumn("i", F.when(F.col("section") == 3, F.from_json(F.regexp_replace("record", "^,", ""), shapes[kind])))
        return r.select(F.lit(kind).alias("document"), "unit", "section", "position", "i.name", F.col("i.versionInfo").alias("version"),
                        F.get("i.externalRefs", F.lit(0))["referenceLocator"].alias("purl"),
                        F.col("i.SPDXID").alias("id")) if kind == "spdx" else r.select(
            F.lit(kind).alias("document"), "unit", "section", "position", "i.name", "i.version", "i.purl", F.col("i.`bom-ref`").alias("id"))

    return items(sl.cyclonedx_records(p), "cyclonedx").unionByName(items(sl.spdx_records(p), "spdx"))

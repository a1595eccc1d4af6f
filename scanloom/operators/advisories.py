"""Advisories: matching by version, findings, and the lookup cache."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from scanloom.functions.grades import advisory_severity
from scanloom.functions.versions import version_key
from scanloom.operators.order import carried, seated
from scanloom.rules import FAMILIES
from scanloom.schema import FINDING_COLUMNS
from scanloom.sources.shared import save

TTL_HOURS = 24


#: Levels of the cells over one name's versions: 2**32 different bounds of ranges at most.
LEVELS = 32
#: A name with more distinct versions and more advisories than this meets in cells. All others are compared
#: pair by pair, which makes at most this many pairs a row of the longer side.
NARROW = 16


def match_advisories(packages: DataFrame, advisories: DataFrame) -> DataFrame:
    """Packages joined with the advisories that cover their version.

    Advisories carry ``ecosystem, name``, and a ``versions`` list and / or a half-open ``[introduced, fixed)``
    range (either end may be null). A package with no version matches nothing.

    Most names have few versions or few advisories: these are joined by name and compared. Where both are many,
    versions and ranges meet in cells, never as all pairs of a name. Distinct versions and the bounds of ranges are sorted
    together; the count of bounds up to a version is its slot, and a range is an interval of slots. An interval is cut into
    at most two dyadic cells a level, a slot lies in one cell of each level, and a cell that is equal on both sides
    is a match, found exactly once. So the joins make rows in proportion to rows and matches, whatever the
    number of versions or ranges of a name.
    """
    keys = ["ecosystem", "name", "version"]
    own = save(advisories.withColumn("_advisory", F.monotonically_increasing_id()), "advisories")
    # Used twice, and lock files are long to read.
    packages = save(packages, "packages")
    # Partial aggregation runs before the shuffle, which removes the popular keys there.
    distinct = save(packages.select(*keys).filter("version is not null").distinct(), "versions")
    wide = save(_many(distinct).join(_many(own), keys[:2]), "wide-names")
    if wide.isEmpty():
        covered = _pairs(distinct, own)
    else:
        covered = _pairs(*[side.join(wide, keys[:2], "left_anti") for side in (distinct, own)]).unionByName(
            _cells(*[side.join(wide, keys[:2], "left_semi") for side in (distinct, own)]))
    # What a popular version is covered by is joined last; adaptive execution splits the copies of such a version.
    return packages.join(covered, keys)


def _many(rows: DataFrame) -> DataFrame:
    """Names with more than ``NARROW`` rows."""
    return rows.groupBy("ecosystem", "name").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > NARROW).select("ecosystem", "name")


def _pairs(versions: DataFrame, advisories: DataFrame) -> DataFrame:
    """(ecosystem, name, version, rest of the advisory) of names joined and compared."""
    keys = ["ecosystem", "name", "version"]
    rest = [c for c in advisories.columns if c not in (*keys[:2], "_advisory")]
    version = F.col("_key")
    inside = (F.col("introduced").isNotNull() | F.col("fixed").isNotNull()) & (
        F.col("introduced").isNull() | (version >= version_key("introduced"))) & (F.col("fixed").isNull() | (version < version_key("fixed")))
    if "versions" in advisories.columns:
        inside = F.coalesce(F.array_contains("versions", F.col("version")), F.lit(False)) | inside
    return versions.withColumn("_key", version_key("version")).join(advisories, keys[:2]).filter(inside).select(*keys, *rest)


def _cells(versions: DataFrame, advisories: DataFrame) -> DataFrame:
    """The same of names whose pairs would be too many."""
    keys = ["ecosystem", "name", "version"]
    hits = _in_range(versions, advisories)
    if "versions" in advisories.columns:
        listed = advisories.select("ecosystem", "name", F.explode(F.array_distinct("versions")).alias("version"), "_advisory")
        hits = hits.unionByName(versions.join(listed, keys).select(*keys, "_advisory")).distinct()
    return hits.join(advisories.drop("ecosystem", "name"), "_advisory").drop("_advisory")


def _in_range(versions: DataFrame, advisories: DataFrame) -> DataFrame:
    """(ecosystem, name, version, _advisory) of versions inside a range."""
    name = ["ecosystem", "name"]
    ranges = advisories.filter("introduced is not null or fixed is not null").select(
        *name, "_advisory", *[F.when(F.col(c).isNotNull(), version_key(c)).alias(k) for c, k in (("introduced", "_from"), ("fixed", "_to"))])
    # Names without a range need no slots.
    asked = versions.join(ranges.select(*name).distinct(), name, "left_semi").withColumn("_key", version_key("version"))
    bounds = ranges.select(*name, F.explode(F.array_distinct(F.array("_from", "_to"))).alias("_key")).filter("_key is not null").distinct()
    none = F.lit(None).cast("string")
    both = bounds.select(*name, "_key", F.lit(0).alias("_kind"), none.alias("version")).unionByName(
        asked.select(*name, "_key", F.lit(1).alias("_kind"), "version"))
    # A bound comes before the versions that equal it: a version's slot counts it.
    # The ranges of an order are found before it is dealt: keys are made once for both.
    both = save(both, "bounds")
    slots = carried(seated(both, name, ["_key", "_kind"]), name, F.sum, (F.lit(1) - F.col("_kind")).cast("long"), lambda a, b: a + b, "slot")
    slots = save(slots, "slots")
    at = slots.filter("_kind = 0").select(*name, "_key", "slot")
    low = at.withColumnsRenamed({"_key": "_from", "slot": "low"})
    high = at.withColumnsRenamed({"_key": "_to", "slot": "high"})
    placed = ranges.join(low, [*name, "_from"], "left").join(high, [*name, "_to"], "left").select(
        *name, "_advisory", F.coalesce("low", F.lit(0)).alias("low"), F.coalesce("high", F.lit((1 << LEVELS) - 1)).alias("high"))
    ranged = placed.filter("low < high").select(*name, "_advisory", F.inline(dyadic(F.col("low"), F.col("high"))))
    # Only levels that some range of the name uses are worth a row of a version.
    used = ranged.groupBy(*name).agg(F.collect_set("level").alias("levels"))
    points = slots.filter("_kind = 1").join(used, name).select(*name, "version", "slot", F.explode("levels").alias("level")).select(
        *name, "version", "level", F.expr("shiftright(slot, level)").alias("cell"))
    return points.join(ranged, [*name, "level", "cell"]).select(*name, "version", "_advisory")


def dyadic(low: Column, high: Column) -> Column:
    """array<struct<level, cell>>: disjoint cells that fill the slots from ``low`` up to, not including, ``high``.

    Going up the levels, a cell is split off at an end that is no multiple of the next level's cells.
    """
    start = F.struct(low.cast("long").alias("low"), high.cast("long").alias("high"), F.array().cast("array<struct<level:int,cell:bigint>>").alias("cells"))

    def step(state: Column, level: Column) -> Column:
        left, right = state["low"], state["high"]
        open_ = left < right
        cell = lambda place: F.array(F.struct(level.cast("int").alias("level"), place.alias("cell")))
        at_left = F.when(open_ & (left % 2 == 1), cell(left)).otherwise(F.array().cast("array<struct<level:int,cell:bigint>>"))
        inner = F.when(open_ & (left % 2 == 1), left + 1).otherwise(left)
        at_right = F.when((inner < right) & (right % 2 == 1), cell(right - 1)).otherwise(F.array().cast("array<struct<level:int,cell:bigint>>"))
        outer = F.when((inner < right) & (right % 2 == 1), right - 1).otherwise(right)
        half = lambda c: F.shiftright(c, 1)
        return F.struct(half(inner).alias("low"), half(outer).alias("high"), F.concat(state["cells"], at_left, at_right).alias("cells"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(LEVELS)), start, step)["cells"]


def advisory_url(advisory_id) -> Column:
    i = F.col(advisory_id) if isinstance(advisory_id, str) else advisory_id
    # Public page per id family.
    return (
        F.when(F.startswith(i, F.lit("RUSTSEC-")), F.concat(F.lit("https://rustsec.org/advisories/"), i))
        .when(F.startswith(i, F.lit("GHSA-")), F.concat(F.lit("https://github.com/advisories/"), i))
        .otherwise(F.concat(F.lit("https://osv.dev/vulnerability/"), i))
    )


def advisory_findings(matches: DataFrame, prefix: str = "DEP-") -> DataFrame:
    """One finding per (package, advisory), located at the lock file without a line."""
    have = set(matches.columns)
    optional = lambda c, t="string": F.col(c) if c in have else F.lit(None).cast(t)
    summary = F.coalesce(
        optional("summary"), optional("details"),
        F.concat(F.lit("advisory "), F.col("id"), F.lit(" affects "), F.col("name"), F.lit(" "), F.col("version")),
    )
    grade = advisory_severity(optional("severity", "array<struct<type:string,score:string>>"), optional("rating"))
    return matches.select(
        F.concat(F.lit(prefix), F.col("id")).alias("code"),
        F.concat(F.col("name"), F.lit(" "), F.col("version"), F.lit(" :: "), summary).alias("message"),
        grade.alias("severity"), F.lit("high").alias("confidence"), F.lit("dependency").alias("category"),
        advisory_url("id").alias("help"),
        F.struct(
            F.col("source").alias("file"), F.lit(None).cast("long").alias("byte_offset"),
            F.lit(None).cast("long").alias("byte_length"), F.lit(None).cast("int").alias("line"),
            F.lit(None).cast("int").alias("column"),
        ).alias("location"),
        F.lit(FAMILIES["dependencies"]).alias("family_no"), F.lit(0).alias("rule_no"),
    ).select(*FINDING_COLUMNS)


# --- lookup cache -----------------------------------------------------------

def cache_key() -> Column:
    return F.concat_ws("::", "ecosystem", "name", "version")


def is_fresh(fetched_at: Column, now: Column, hours: int = TTL_HOURS) -> Column:
    return F.unix_timestamp(now) - F.unix_timestamp(fetched_at) < hours * 3600


def split_by_freshness(packages: DataFrame, cache: DataFrame, now: Column, hours: int = TTL_HOURS):
    """(cached advisories of fresh keys, keys to look up). Offline runs use the first only."""
    keys = packages.select("ecosystem", "name", "version").distinct().withColumn("key", cache_key())
    fresh = cache.filter(is_fresh(F.col("fetched_at"), now, hours))
    return fresh.join(keys.select("key"), "key", "left_semi"), keys.join(fresh.select("key"), "key", "left_anti")


def merge_cache(old: DataFrame, fetched: DataFrame) -> DataFrame:
    """Newest entry per key; of entries of one time the greatest content."""
    rest = [c for c in old.columns if c not in ("key", "fetched_at")]
    both = old.unionByName(fetched.select(*old.columns))
    newest = F.max_by(F.struct(*rest), F.struct("fetched_at", F.to_json(F.struct(*rest)))) if rest else F.lit(None)
    return both.groupBy("key").agg(F.max("fetched_at").alias("fetched_at"), newest.alias("_v")).select(
        "key", "fetched_at", *[F.col("_v")[c].alias(c) for c in rest]
    ).select(*old.columns)

"""Advisories by version ranges against comparing all pairs."""

import random

import scanloom as sl
from pyspark.sql import functions as F
from scanloom.functions.versions import version_key
from scanloom.operators import advisories as advisories_module
from scanloom.operators.advisories import dyadic

ADVISORY = "id string, ecosystem string, name string, introduced string, fixed string, versions array<string>"
PACKAGE = "ecosystem string, name string, version string, source string"


def plain(spark, packages, advisories):
    """Every pair of one name."""
    p, a = packages.alias("p"), advisories.alias("a")
    k = version_key
    pairs = p.join(a, (F.col("p.ecosystem") == F.col("a.ecosystem")) & (F.col("p.name") == F.col("a.name")))
    ranged = F.col("introduced").isNotNull() | F.col("fixed").isNotNull()
    inside = ranged & (F.col("introduced").isNull() | (k("p.version") >= k("a.introduced"))) & (F.col("fixed").isNull() | (k("p.version") < k("a.fixed")))
    listed = F.coalesce(F.array_contains("versions", F.col("p.version")), F.lit(False))
    return pairs.filter(F.col("p.version").isNotNull() & (inside | listed)).select("p.ecosystem", "p.name", "p.version", "source", "id")


def version(rng):
    text = ".".join(str(rng.choice([0, 1, 2, 10, 20240101])) for _ in range(rng.randrange(1, 4)))
    return rng.choice(["", "", "v"]) + text + rng.choice(["", "", "", "-alpha", "-alpha.1", "-rc.2", "+build"])


def test_random_ranges(spark):
    rng = random.Random(8)
    names = [("npm", "hot"), ("npm", "b"), ("PyPI", "hot"), ("Go", "c"), ("Go", None)]
    packages = [(*rng.choice(names), version(rng), f"s{i % 7}") for i in range(900)] + [("npm", "hot", None, "s"), ("npm", "hot", "1.0", "s")] * 2
    advisories = []
    for i in range(150):
        low, high = (version(rng) if rng.random() < .8 else None for _ in "ab")
        advisories.append((f"A-{i % 140}", *rng.choice(names), low, high, rng.choice([None, [], [version(rng), "1.0", "1.0"]])))
    p, a = spark.createDataFrame(packages, PACKAGE).repartition(5), spark.createDataFrame(advisories, ADVISORY)
    found, expected = sl.match_advisories(p, a).select("ecosystem", "name", "version", "source", "id"), plain(spark, p, a)
    assert expected.count() > 5000
    assert found.exceptAll(expected).count() == 0 and expected.exceptAll(found).count() == 0
    none = sl.match_advisories(p, a.limit(0))
    assert none.count() == 0 and sl.match_advisories(p.limit(0), a).count() == 0 and "id" in none.columns


def test_cells_fill_their_range_once(spark):
    rng = random.Random(9)
    cases = [(rng.randrange(0, 40), rng.randrange(0, 60)) for _ in range(300)] + [(0, (1 << 32) - 1), (5, (1 << 32) - 1), (7, 7), (9, 3)]
    rows = spark.createDataFrame(cases, "low long, high long").select("low", "high", dyadic(F.col("low"), F.col("high")).alias("cells")).collect()
    for r in rows:
        slots = {}
        for c in r.cells:
            for x in range(c.cell << c.level, min((c.cell + 1) << c.level, 70)):
                slots[x] = slots.get(x, 0) + 1
        assert slots == {x: 1 for x in range(r.low, min(r.high, 70))}
        assert len(r.cells) <= 64 and len(set(r.cells)) == len(r.cells)


def test_a_name_with_very_many_versions(spark):
    """100,000 versions and 2,000 ranges of one name: rows are made for matches, not for the 200 million pairs."""
    n, ranges = 100_000, 2000
    packages = spark.range(n).select(F.lit("npm").alias("ecosystem"), F.lit("hot").alias("name"),
                                     F.concat(F.lit("1."), F.col("id").cast("string"), F.lit(".0")).alias("version"), F.lit("lock").alias("source"))
    advisories = spark.range(ranges).select(
        F.concat(F.lit("A-"), F.col("id").cast("string")).alias("id"), F.lit("npm").alias("ecosystem"), F.lit("hot").alias("name"),
        F.concat(F.lit("1."), (F.col("id") * 50).cast("string")).alias("introduced"),
        F.concat(F.lit("1."), (F.col("id") * 50 + 60).cast("string")).alias("fixed"))
    found = sl.match_advisories(packages, advisories)
    counts = found.groupBy("id").count()
    assert found.count() == 60 * ranges - 10  # the last range passes the last version
    assert counts.filter("count = 60").count() == ranges - 1
    joins = [line for line in found._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in line]
    assert joins and not any("NestedLoop" in j or "Cartesian" in j for j in joins)


def test_names_with_few_versions_or_few_ranges_are_not_ordered(spark, monkeypatch):
    """Many names of a few versions, and one with very many versions and a few ranges: joined by name, no sort of all bounds."""
    def no_order(*_):
        raise AssertionError("an order over all bounds")

    monkeypatch.setattr(advisories_module, "seated", no_order)
    rng = random.Random(10)
    packages = [("npm", f"p{i % 300}", version(rng), f"s{i % 7}") for i in range(900)] + [("npm", "hot", f"1.{i}", "s") for i in range(2000)] + [
        ("npm", None, "1.0", "s"), (None, "p1", "1.0", "s"), ("npm", "p1", None, "s")] + [("npm", "p2", "1.0", "s")] * 2
    advisories = [(f"A-{i % 500}", "npm", rng.choice([f"p{i % 320}", "p2", None]), *(version(rng) if rng.random() < .8 else None for _ in "ab"),
                   rng.choice([None, [], [version(rng), None, "1.0", "1.0"]])) for i in range(40)]
    advisories += [(f"H-{i}", "npm", "hot", f"1.{i * 100}", f"1.{i * 100 + 150}" if i % 3 else None, None) for i in range(10)]
    p, a = spark.createDataFrame(packages, PACKAGE).repartition(5), spark.createDataFrame(advisories, ADVISORY)
    found, expected = sl.match_advisories(p, a).select("ecosystem", "name", "version", "source", "id"), plain(spark, p, a)
    assert expected.count() > 3000
    assert found.exceptAll(expected).count() == 0 and expected.exceptAll(found).count() == 0

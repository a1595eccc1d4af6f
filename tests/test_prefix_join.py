"""Roots above directories, against a plain loop."""

import random

import scanloom as sl
from pyspark.sql import functions as F
from scanloom.operators.projects import first_roots


def above(root, directory):
    return root == "" or directory == root or directory.startswith(root + "/")


def brute(directories, roots):
    out = []
    for g, d in sorted(set(directories), key=str):
        found = [r for h, r in roots if h == g and r is not None and d is not None and above(r, d)]
        if found:
            out.append((d, g, min(found, key=len)))
    return sorted(out)


def test_random_trees(spark):
    rng = random.Random(2)
    parts = ["a", "ab", "a-b", "a.b", "a b", "é", "漢", "\x01", "\x00", "z", "A", "\U0001f600"]

    def path():
        return "/".join(rng.choice(parts) for _ in range(rng.randrange(0, 6)))

    directories = [(rng.choice("xy"), path()) for _ in range(1500)] + [("x", None), ("z", "a")]
    for n in (0, 3, 60):
        roots = [(rng.choice("xy"), path()) for _ in range(n)] + [("x", None)]
        if n == 3:
            roots.append(("y", ""))
        found = first_roots(spark.createDataFrame(directories, "g string, directory string").repartition(7),
                            spark.createDataFrame(roots, "g string, root string"), "g")
        assert sorted(map(tuple, found.collect())) == brute(directories, roots)
        one = first_roots(spark.createDataFrame(directories, "g string, directory string"), spark.createDataFrame(roots, "g string, root string").filter("g = 'x'"))
        assert sorted((r.directory, r.root) for r in one.collect()) == sorted(
            (d, r) for d, _, r in brute([("x", d) for _, d in directories], [x for x in roots if x[0] == "x"]))


def test_one_root_over_very_many_directories(spark):
    """Every directory is one row: none per directory above it, and no key for the root of all."""
    files = spark.range(120_000).select(
        F.concat(F.lit("m/"), (F.col("id") % 11).cast("string"), F.lit("/a/b/c/d/e/f/g/h/"), F.col("id").cast("string"), F.lit("/x.py")).alias("path"))
    for root, size in (("", 120_000), ("m", 120_000), ("m/3", 10_909), ("m/3/a/b/c/d/e/f/g/h/3", 1)):
        roots = spark.createDataFrame([(root,), ("other",), ("m/3/a",)], "root string")
        found = first_roots(files.select(F.regexp_replace("path", "/[^/]*$", "").alias("directory")), roots)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "Generate" not in plan and "explode" not in plan
        counts = {r.root: r["count"] for r in found.groupBy("root").count().collect()}
        assert counts.get(root if root != "m/3/a/b/c/d/e/f/g/h/3" else "m/3/a") == (size if size > 1 else 10_909)
    assert sl.assign_projects(files, spark.createDataFrame([("",)], "root string")).count() == 120_000


def test_gate_and_exemption_share_the_join(spark):
    rules = [r for r in sl.builtin_rules() if r.code in ("FLASK-001", "NEST-002", "CRY-001")]
    rows = [("app/web/x.py", "import flask\napp.debug = True\nhashlib.md5(x)\n"), ("lib/x.py", "import flask\napp.debug = True\n"),
            ("app/requirements.txt", "flask"), ("lib/requirements.txt", "requests")]
    files = spark.createDataFrame(rows, "path string, content string")
    found = sl.gate_by_framework(sl.scan(files, rules), rules, sl.fingerprint(files))
    assert sorted((r.code, r.location.file) for r in found.collect()) == [("CRY-001", "app/web/x.py"), ("FLASK-001", "app/web/x.py")]

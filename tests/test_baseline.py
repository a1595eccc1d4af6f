"""Baselines in runs."""

import scanloom as sl
from pyspark.sql import functions as F


def found(spark, names):
    files = spark.createDataFrame([(n, "hashlib.md5(x)\n") for n in names], "path string, content string")
    return sl.scan(files, sl.builtin_rules())


def test_runs_are_added_and_never_rewritten(spark, tmp_path):
    path = str(tmp_path / "base")
    sl.write_baseline(found(spark, ["a.py", "b.py"]), path)
    first = {p.name: p.stat().st_mtime_ns for p in (tmp_path / "base").glob("part-*")}
    sl.merge_baseline(found(spark, ["b.py", "c.py"]), path)
    second = {p.name: p.stat().st_mtime_ns for p in (tmp_path / "base").glob("part-*")}
    assert first.items() < second.items()
    sl.merge_baseline(found(spark, ["a.py", "c.py"]), path)
    assert {p.name for p in (tmp_path / "base").glob("part-*")} == set(second)
    base = sl.read_baseline(spark, path)
    assert base.count() == base.distinct().count() == 3
    assert [r.location.file for r in sl.new_since(found(spark, ["a.py", "d.py"]), base).collect()] == ["d.py"]
    sl.compact_baseline(spark, path, str(tmp_path / "one"))
    assert sorted(sl.read_baseline(spark, str(tmp_path / "one")).collect()) == sorted(base.collect())


def test_only_keys_move(spark, tmp_path):
    sl.write_baseline(found(spark, ["a.py"]), str(tmp_path / "b"))
    plan = sl.new_since(found(spark, ["a.py"]), sl.read_baseline(spark, str(tmp_path / "b")))._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" in plan and "md5" in plan and "NestedLoop" not in plan


def test_labels_are_rows(spark):
    projects = spark.range(500).select(
        F.concat(F.lit("r"), (F.col("id") % 3).cast("string"), F.lit("/p"), F.col("id").cast("string")).alias("root"),
        F.lit("m").alias("manifest"), F.lit("go").alias("language"), F.lit("gomod").alias("ecosystem"),
        F.when(F.col("id") % 2 == 0, F.array(F.lit("gin"))).otherwise(F.array().cast("array<string>")).alias("frameworks"))
    rows = sl.project_label_rows(projects, F.substring_index("root", "/", 1)).collect()
    for unit in ("r0", "r1", "r2"):
        own = sorted((r.position, r.label) for r in rows if r.unit == unit)
        assert [p for p, _ in own] == list(range(len(own))) and [x for _, x in own] == sorted(x for _, x in own)
    assert len(rows) == 500 and rows[0].label.startswith(("gin (p", "go (p"))

"""Detectors that fail, while they are planned and while they run."""

import scanloom as sl
from pyspark.sql import functions as F
from scanloom.plans.audit import run_all
from scanloom.schema import FINDING_COLUMNS


def corpus(spark):
    rows = [(f"r/f{i}.py", "hashlib.md5(x)\n" if i % 2 else "eval(x)\n") for i in range(60)]
    return sl.with_kind(spark.createDataFrame(rows, "path string, content string").repartition(6))


def good(code):
    return sl.Detector(code, lambda df: sl.scan(df, [r for r in sl.builtin_rules() if r.code == code]))


def in_a_task(df):
    """Fails in one task of many, after others have written findings."""
    found = sl.scan(df, sl.builtin_rules())
    return found.withColumn("message", F.when(F.col("location.file") == "r/f31.py", F.raise_error(F.lit("bad row"))).otherwise(F.col("message")))


def in_python(df):
    def explode(batches):
        for batch in batches:
            if (batch["path"] == "r/f8.py").any():
                raise ValueError("no such thing")
            yield batch[["path"]]

    return sl.scan(df.select("path").mapInPandas(explode, "path string").withColumn("content", F.lit("hashlib.md5(x)")), sl.builtin_rules())


def at_plan_time(df):
    raise RuntimeError("not today")


def test_what_fails_becomes_a_finding(spark):
    detectors = [good("CRY-001"), sl.Detector("task", in_a_task), sl.Detector("python", in_python), sl.Detector("plan", at_plan_time),
                 sl.Detector("column", lambda df: df.select("no_such_column")), good("INJ-001")]
    found = run_all(corpus(spark), detectors).select(*FINDING_COLUMNS)
    rows = found.collect()
    broken = sorted(r.message for r in rows if r.code == "INT-001")
    assert [m.split("'")[1] for m in broken] == ["column", "plan", "python", "task"]
    assert "no such thing" in broken[2] and "not today" in broken[1] and "bad row" in broken[3] and "no_such_column" in broken[0]
    assert all("\n" not in m for m in broken)
    # Nothing of a failed detector counts, everything of the others does.
    assert {r.code for r in rows} <= {"CRY-001", "INJ-001", "INT-001"}
    assert sum(r.code == "CRY-001" for r in rows) == 30


def test_findings_are_written_once(spark):
    found = run_all(corpus(spark), [good("CRY-001")])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "FileScan parquet" in plan and "Generate" not in plan


def test_a_whole_audit_goes_on(spark):
    result = sl.audit(corpus(spark).withColumn("size", F.lit(1)), detectors=[sl.Detector("task", in_a_task)])
    codes = {r.code: r["count"] for r in result.findings.groupBy("code").count().collect()}
    assert codes["INT-001"] == 1 and codes["CRY-001"] == 30
    assert result.gate.count() == 1


def test_crawl_errors_and_no_detectors(spark):
    errors = spark.createDataFrame([("a", "a: denied")], "path string, error string")
    assert [r.message for r in run_all(corpus(spark), [], errors).collect()] == ["crawl warning: a: denied"]

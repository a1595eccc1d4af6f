"""The log of findings: buckets, levels, retries, batches out of order."""

import random
import re

import pytest
import scanloom as sl
from pyspark.sql import functions as F
from scanloom.streaming import live

KIND = "path string, content string, event string, version long"


def state(log, spark):
    return sorted((r.location.file, r.location.line) for r in log.findings(spark).collect())


def expected(events):
    last = {}
    for path, content, event, version in events:
        if event != "change" and version > last.get(path, (-1,))[0]:
            last[path] = version, content, event
    return sorted((p, i + 1) for p, (_, text, event) in last.items() if event != "close" for i, line in enumerate(text.split("\n")) if "md5" in line)


def events(rng, versions):
    return [(f"d{rng.randrange(12)}/f.py", "x\n" * rng.randrange(3) + ("hashlib.md5(x)" if rng.random() < .7 else "y"),
             rng.choice(["open", "save", "save", "change", "close"]), v) for v in versions]


def test_any_order_of_batches_retries_and_merges(spark, tmp_path):
    rng = random.Random(1)
    log, seen = sl.FindingLog(str(tmp_path / "log"), buckets=5), []
    batches = [events(rng, range(i * 10, i * 10 + 10)) for i in range(5)]
    for step, number in enumerate([3, 0, 4, 1, 2]):
        log.upsert(spark.createDataFrame(batches[number], KIND), number)
        seen += batches[number]
        if step in (1, 3):
            log.merge(spark)
        if step == 2:
            log.upsert(spark.createDataFrame(batches[number], KIND), number)  # a retry
        if step == 4:
            log.upsert(spark.createDataFrame(batches[0], KIND), 0)  # a retry of a batch that is merged
        assert state(log, spark) == expected(seen)
    log.merge(spark)
    log.merge(spark)
    assert state(log, spark) == expected(seen)
    assert state(log.compact(spark, str(tmp_path / "new")), spark) == expected(seen)


def test_a_read_opens_the_newest_level_of_a_bucket(spark, tmp_path):
    log = sl.FindingLog(str(tmp_path / "log"), buckets=4)
    for i in range(4):
        log.upsert(spark.createDataFrame([(f"d{j}/f.py", "hashlib.md5(x)", "save", i) for j in range(20)], KIND), i)
        log.merge(spark)
    one = [("d0/f.py", "hashlib.md5(x)\nhashlib.md5(y)", "save", 99)]
    log.upsert(spark.createDataFrame(one, KIND), 4)
    log.merge(spark)
    files = log.findings(spark).inputFiles()
    buckets = [f.split("/bucket=")[1].split("/")[0] for f in files]
    levels = {f.split("/level=")[1].split("/")[0] for f in files}
    assert "batch=" not in "".join(files) and levels == {"3", "4"} and sorted(set(buckets)) == ["0", "1", "2", "3"]
    assert sum("level=4" in f for f in files) == len({f for f in files if "level=4" in f}) >= 1
    plan = log.findings(spark)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan  # settled rows need no grouping
    assert len(state(log, spark)) == 21


def test_a_batch_without_its_commit_does_not_count(spark, tmp_path, monkeypatch):
    log = sl.FindingLog(str(tmp_path / "log"))
    log.upsert(spark.createDataFrame([("a.py", "hashlib.md5(x)", "save", 1)], KIND), 0)
    monkeypatch.setattr(sl.FindingLog, "_commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        log.upsert(spark.createDataFrame([("b.py", "hashlib.md5(x)", "save", 2)], KIND), 1)
    assert state(log, spark) == [("a.py", 1)]


def test_empty_batches(spark, tmp_path):
    log = sl.FindingLog(str(tmp_path / "log"))
    log.upsert(spark.createDataFrame([], KIND), 0)
    log.merge(spark)
    assert state(log, spark) == []
    log.upsert(spark.createDataFrame([("a.py", "hashlib.md5(x)", "change", 1)], KIND), 1)
    log.upsert(spark.createDataFrame([("a.py", "hashlib.md5(x)", "open", 1)], KIND), 2)
    assert state(log, spark) == [("a.py", 1)] and log.findings(spark).filter(F.col("code") == "CRY-001").count() == 1


def test_no_text_is_shuffled_to_learn_which_version_wins(spark, tmp_path):
    rng = random.Random(2)
    batch = spark.createDataFrame(events(rng, range(200)), KIND)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = spark._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(sl.FindingLog(str(tmp_path))._latest(batch)._jdf.queryExecution(), "formatted")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    moved = re.findall(r"\) (?:Broadcast)?Exchange\nInput \[\d+\]: \[(.*?)\]", plan)
    assert len(moved) > 2 and not [m for m in moved if "content" in m]


@pytest.mark.parametrize("marks", [1, 7, 1 << 16, live.MARKS])
def test_versions_that_share_a_mark_with_a_winner_do_not_win(spark, tmp_path, monkeypatch, marks):
    monkeypatch.setattr(live, "MARKS", marks)
    rng = random.Random(marks)
    rows = events(rng, range(60)) + [("d0/f.py", "hashlib.md5(x)", "save", None), (None, "hashlib.md5(x)", "save", 70), ("only/f.py", "hashlib.md5(x)", "open", None)]
    log = sl.FindingLog(str(tmp_path / "log"), buckets=3)
    log.upsert(spark.createDataFrame(rows, KIND), 0)
    assert state(log, spark) == expected(rows[:60])
    stored = spark.read.parquet(f"{log.path}/batch=0").select("path", "version").collect()
    last = {p: v for p, _, event, v in rows[:60] if event != "change"}
    assert sorted(map(tuple, stored)) == sorted(last.items())


def test_a_version_that_comes_twice_in_a_batch_is_read_once(spark, tmp_path):
    rows = [("a.py", "hashlib.md5(x)", "save", 1)] * 2 + [("a.py", "y", "open", 0), ("b.py", "y", "save", 2), ("b.py", "hashlib.md5(x)", "save", 2)]
    log = sl.FindingLog(str(tmp_path / "log"))
    log.upsert(spark.createDataFrame(rows, KIND), 0)
    assert spark.read.parquet(f"{log.path}/batch=0").count() == 4
    assert state(log, spark) == [("a.py", 1), ("b.py", 1)]

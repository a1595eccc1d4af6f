import time

import scanloom as sl
from workload import streams

DOCS = [("a.py", "hashlib.md5(x)\n"), ("b.js", "eval(x)\n"), ("c.md", "eval(x)\n"), ("d.py", "pickle.loads(x)\n")]


def key(df):
    return sorted((r.code, r.location.file, r.location.line) for r in df.collect())


def test_stream_equals_batch(spark, tmp_path):
    df = spark.createDataFrame(DOCS, "path string, content string")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = sl.scan_stream(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option(
        "checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert key(spark.read.parquet(str(tmp_path / "out"))) == key(sl.scan_stream(df))


def test_latest_state(spark, tmp_path):
    versions = [("a.py", "eval(x)", "open", 1), ("a.py", "ok", "change", 2), ("a.py", "\neval(x)", "save", 3), ("b.py", "eval(x)", "open", 4),
                ("b.py", "", "close", 5), ("c.py", "eval(x)", "save", 6)]
    df = spark.createDataFrame(versions, "path string, content string, event string, version long")
    log = sl.FindingLog(str(tmp_path / "log"))
    for i, v in enumerate([(1, 4), (2, 3, 5), (6,)]):
        log.upsert(df.filter(df.version.isin(*v)), i)
    expected = [("INJ-003", "a.py", 2), ("INJ-003", "c.py", 1)]
    assert key(log.findings(spark)) == expected
    log.upsert(df.filter("version = 6"), 2)  # a retried batch
    assert key(log.findings(spark)) == expected
    smaller = log.compact(spark, str(tmp_path / "log2"))
    assert key(smaller.findings(spark)) == expected
    smaller.upsert(df.filter("version = 1"), 3)  # an old version arrives late
    assert key(smaller.findings(spark)) == expected


def test_versions_arrive_in_files_of_bounded_size(spark, tmp_path, monkeypatch):
    """More text makes more files, not longer ones; batches stay three, and findings the same."""
    data = str(tmp_path / "data")
    spark.range(30).selectExpr("id as doc_id", "repeat('some prose ', 50) as text", "'en' as lang", "'s' as source").write.parquet(f"{data}/documents.parquet")
    spark.range(600).selectExpr("id as event_id", "element_at(array('signup','click','view','purchase','error'), int(id % 5) + 1) as event_type").write.parquet(
        f"{data}/events.parquet")
    found = {}
    for size in (streams.FILE_BYTES, 10_000):
        monkeypatch.setattr(streams, "FILE_BYTES", size)
        monkeypatch.setattr(streams, "_folder", lambda _, name, size=size: str(tmp_path / f"{name}-{size}"))
        found[size] = sorted(map(str, streams.stream_latest_state(spark, data).collect()))
        files = len(list((tmp_path / f"versions-in-{size}").glob("part-*")))
        batches = len(list((tmp_path / f"finding-log-{size}").glob("batch=*")))
        assert files <= 6 if size > 10_000 else files > 25
        assert batches == 3
    few, many = found.values()
    assert few == many and len(few) > 10


def test_room_grows_with_documents_not_with_versions(spark, tmp_path, monkeypatch):
    """Each document has a hundred versions; neither their texts nor the shuffles of a batch stay on disk."""
    data, local = str(tmp_path / "data"), spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    spark.range(40).selectExpr("id as doc_id", "array_join(transform(sequence(1, 400), i -> sha2(concat(id, '/', i), 256)), ' ') as text", "'en' as lang", "'s' as source").write.parquet(
        f"{data}/documents.parquet")
    spark.range(4000).selectExpr("id as event_id", "element_at(array('signup','click','view','purchase','error'), int(id % 5) + 1) as event_type").write.parquet(
        f"{data}/events.parquet")
    monkeypatch.setattr(streams, "_folder", lambda _, name: str(tmp_path / name))
    shuffled = []  # when a batch begins, what earlier ones left

    def upsert(log, batch, batch_id, real=sl.FindingLog.upsert):
        time.sleep(1)  # files are removed in the background
        shuffled.append(sum(f.length() for f in map(local.getAllFiles().apply, range(local.getAllFiles().size())) if f.getName().endswith(".data")))
        real(log, batch, batch_id)

    monkeypatch.setattr(sl.FindingLog, "upsert", upsert)
    found = streams.stream_latest_state(spark, data)
    texts = 40 * 400 * 65
    assert len(shuffled) == 3 and shuffled[2] - shuffled[0] < texts / 2
    assert sum(f.stat().st_size for name in ("versions-in", "finding-log") for f in (tmp_path / name).rglob("*") if f.is_file()) < texts
    assert found.count() > 5

"""Plans: what must not creep in."""

from pyspark.sql import functions as F

import scanloom as sl
from workload import corpora


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def corpus(spark, n=50):
    return spark.range(n).select(
        F.concat(F.lit("r/f"), F.col("id").cast("string"), F.lit(".py")).alias("path"),
        F.concat(F.lit("import flask\nhashlib.md5("), F.col("id").cast("string"), F.lit(")\n")).alias("content"))


def test_scan_is_one_narrow_pass(spark):
    plan = plan_of(sl.scan(corpus(spark), sl.builtin_rules(), honour_directives=True))
    assert "Exchange" not in plan and "Join" not in plan and "Python" not in plan
    assert plan.count("Generate") <= 2
    # The rule table is one constant, and no filter computes the findings a second time.
    assert "from_json" not in plan and "(size(flatten" not in plan


def test_packages_and_directives_are_narrow(spark):
    for df in (sl.extract_packages(corpus(spark)), sl.parse_directives(corpus(spark)), sl.scan_scoped(corpus(spark))):
        plan = plan_of(df)
        assert "Exchange" not in plan and "Python" not in plan


def test_configuration_steps_are_filters(spark):
    found = sl.scan(corpus(spark), sl.builtin_rules())
    out = sl.suppress(sl.ignore_findings(sl.override_severity(sl.apply_enabled(
        found, {"CRY-005": False}), {"CRY-001": {"severity": "low"}}), ["x/**"]), [{"path": "y/**"}])
    assert "Exchange" not in plan_of(out)


def test_counts_use_partial_aggregates(spark):
    plan = plan_of(sl.severity_counts(sl.scan(corpus(spark), sl.builtin_rules())))
    assert "partial_count" in plan


def test_one_hot_directory(spark):
    """All gated findings in one directory, most findings not gated."""
    files = corpus(spark, 300).unionByName(spark.createDataFrame([("r/requirements.txt", "flask")], "path string, content string")).unionByName(
        spark.range(200).select(F.concat(F.lit("r/g"), F.col("id").cast("string"), F.lit(".py")).alias("path"),
                                F.lit("import flask\napp.debug = True\n").alias("content")))
    rules = [r for r in sl.builtin_rules() if r.code in ("CRY-001", "FLASK-001")]
    found = sl.scan(files, rules)
    counts = {r.code: r["count"] for r in sl.gate_by_framework(found, rules, sl.fingerprint(files)).groupBy("code").count().collect()}
    assert counts == {"CRY-001": 300, "FLASK-001": 200}


def test_findings_are_kept_where_the_cluster_says(spark):
    kept = sl.materialise(sl.scan(corpus(spark, 20), sl.builtin_rules()))
    assert kept.count() == 20
    plan = plan_of(kept)
    if spark.sparkContext.getCheckpointDir():
        # Lineage is cut: the texts are not scanned again.
        assert "Generate" not in plan and "Range" not in plan
    else:
        assert kept.storageLevel.useMemory and kept.storageLevel.useDisk


def test_samples_meet_texts_where_they_lie(spark, tmp_path):
    """The sample corpora shuffle no text: each document meets its sample by a broadcast of the small table."""
    spark.range(400).selectExpr("id as doc_id", "'prose' as text", "'en' as lang", "'s' as source").write.parquet(str(tmp_path / "documents.parquet"))
    for corpus in (corpora.samples, corpora.manifests):
        df = corpus(spark, str(tmp_path))
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
        assert df.count() == 400 and [f.name for f in df.schema] == ["doc_id", "sample_code", "path", "content"]

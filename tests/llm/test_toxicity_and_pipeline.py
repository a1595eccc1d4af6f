"""Held-out accuracy of the trees, and the pipeline stage by stage."""

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

import corpus_pipeline
from scanloom.llm import common, minhash_dedup, piece_spans, private_spans, source_mix
from scanloom.llm import toxicity_trees as t
from tests.llm.conftest import ROWS

SF = "/root/testdata/sf0.01"


def test_trees_and_calibration():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0)).astype(float)
    trees = t.fit_trees(x[:2000], y[:2000])
    assert ((trees.raw(x[2000:]) > 0) == y[2000:]).mean() > 0.97
    knots, rates = t.fit_isotonic(trees.raw(x[:2000]), y[:2000])
    assert (np.diff(knots) > 0).all() and (np.diff(rates) >= 0).all() and rates[0] >= 0 and rates[-1] <= 1
    flat = t.fit_isotonic(np.zeros(4), np.array([0.0, 1, 1, 0]))
    assert flat[1].tolist() == [0.5]


def test_features_see_hidden_words():
    lexicon = t.Lexicon({b"badword": 2.0})
    at = t.FEATURES.index
    plain, hidden, clean = (lexicon.features(x) for x in ("you are an idiot, badword", "what an id1ot and l*ser", "a fine day to you"))
    assert plain[at("hit_density")] > 0 and plain[at("near_second_person")] > 0 and plain[at("learned_density")] > 0
    assert hidden[at("hidden_words")] > 0 and hidden[at("hit_density")] == 0 and not any(clean[1:6])
    assert lexicon.features("")[2:16] == [0.0] * 14


def test_scores(spark, docs, clashing, none):
    d, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = t.fit(d, labels)
    score = {r.doc_id: r.score for r in t.score(d, model).collect()}
    assert len(score) == d.count() and all(0 <= v <= 1 for v in score.values())
    held = [(score[r.doc_id], r.toxic) for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    bad, good = [v for v, y in held if y], [v for v, y in held if not y]
    assert np.mean([(a > b) + (a == b) / 2 for a in bad for b in good]) > 0.8
    for table in (docs, clashing):
        assert t.score(table, model).count() == len(ROWS) and t.keep_clean(table, model).columns == table.columns
    assert t.score(none, model).count() == 0 and t.keep_clean(none, model).count() == 0
    for few in (labels.limit(0), labels.filter("toxic = 0"), labels.selectExpr("doc_id", "cast(null as int) toxic")):
        scores = {r.score for r in t.score(docs, t.fit(d, few)).collect()}
        assert len(scores) == 1


def test_held_out_rows_are_those_of_the_rule(spark):
    from pyspark.sql import functions as F

    for r in spark.range(50).select("id", t.held_out(F.col("id")).alias("h")).collect():
        assert r.h == (zlib.crc32(str(r.id).encode()) % 4 == 2)


@pytest.mark.parametrize("which", ["docs", "clashing", "none"])
def test_stages_on_odd_rows(spark, request, which):
    rows = request.getfixturevalue(which)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        rows_ = stage(spark, rows, SF)
        assert rows_.columns == rows.columns
        rows = minhash_dedup.save(rows_, "test")
    assert corpus_pipeline.encode(spark, rows, SF).count() == rows.count()


def test_pipeline(spark):
    """Each stage against what its operator says of the stage's own input."""
    docs, seen = spark.read.parquet(f"{SF}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        docs = minhash_dedup.save(stage(spark, docs, SF), "test")
        seen.append(docs)
    clean, single, masked, mixed, encoded = seen
    before = spark.read.parquet(f"{SF}/documents.parquet")
    model = t.fit(before, spark.read.parquet(f"{SF}/labels.parquet"))
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in t.score(before, model).collect() if r.score < t.THRESHOLD}
    assert {r.doc_id for r in single.collect()} == {r.doc_id for r in minhash_dedup.link(clean).collect() if r.kept}
    assert masked.count() == single.count() and not any(any(private_spans.base_spans(r.text)) for r in masked.collect())
    assert all(r.n_chars == len(r.text) for r in masked.collect())
    assert mixed.count() == sum(r.copies for r in source_mix.mix(masked).collect())
    import public_tokenizers

    again = piece_spans.encode_digests(mixed, public_tokenizers.path("piece_bpe_32k.model"))
    key = lambda df: sorted((r.doc_id, r.n_tokens, r.ids_sha256) for r in df.collect())
    assert key(encoded) == key(again)
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, SF).collect()) == sorted(r.doc_id for r in encoded.collect())


BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_send_small_batches(spark, docs, stage):
    long = spark.range(0, 3000, 1, 1).selectExpr("id", "repeat(cast(id as string), 3000) text")

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["rows", "bytes"])

    spark.conf.unset(BATCH)
    try:
        dict(corpus_pipeline.STAGES)[stage](spark, docs, SF)
        seen = long.mapInArrow(sizes, "rows long, bytes long").collect()
    finally:
        spark.conf.unset(BATCH)
    assert sum(r.rows for r in seen) == 3000 and max(r.bytes for r in seen) < common.BATCH_BYTES + (64 << 10)


@pytest.mark.parametrize("own, then", [("1m", "1m"), ("64MB", str(4 << 20)), ("2048", "2048"), ("1g", str(4 << 20))])
def test_smaller_batches_stay(spark, own, then):
    spark.conf.set(BATCH, own)
    try:
        common.small_batches(spark)
        assert spark.conf.get(BATCH).rstrip("b") == then
    finally:
        spark.conf.unset(BATCH)


def test_workers_give_memory_back(monkeypatch):
    given = []
    monkeypatch.setattr(common, "give_back", lambda: given.append(1))
    run = common.lean(lambda batches: (b + 1 for b in batches))
    assert list(run(iter([1, 2]))) == [2, 3] and given == [1]
    part = run(iter([1, 2]))
    assert next(part) == 2 and given == [1]
    part.close()
    assert given == [1, 1]


def test_memos_end_at_their_limit():
    memo = common.Memo(lambda names: [n.encode() for n in names], 3)
    assert memo.joined([["a", "b", "c"], ["d", "a"], ["d", "e"]]) == [b"abc", b"da", b"de"]
    more = len(memo)
    assert memo.joined([["x", "y"]]) == [b"xy"] and len(memo) == more
    assert piece_spans.Encoder(public_tokenizers.path("piece_bpe_32k.model")).memo.entries == piece_spans.MEMO_ENTRIES < common.MEMO_ENTRIES

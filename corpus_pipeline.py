"""From raw documents to piece ids: toxic documents go, one of each group of near copies stays,
personal data are masked, sources are mixed to target weights, and what is left is encoded."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanloom.llm import minhash_dedup, piece_spans, private_spans, source_mix, toxicity_trees
from scanloom.llm.common import save, small_batches
from scanloom.llm.queries import found_by_workers


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that score below the threshold. Null and empty texts are scored like others; rows with equal texts go together; an
    empty table stays empty."""
    small_batches(spark)
    model = toxicity_trees.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity_trees.keep_clean(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, the one of the smallest doc_id; null and empty texts link with nothing and stay."""
    small_batches(spark)
    return minhash_dedup.keep_one(docs)


def mask_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row, its private spans replaced and its length counted anew. Null and empty texts stay as they are, repeated rows
    stay repeated, an empty table stays empty; a table without n_chars gets none."""
    small_batches(spark)
    names = private_spans.name_words(docs)
    model = private_spans.learn(save(private_spans.find(docs, names=names), "spans"))
    masked = private_spans.redact(docs, model, names=names)
    if "n_chars" not in docs.columns:
        return masked
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row as often as the mix takes it (0, 1 or 2 times). Null sources are a source; null texts have no words and do not count."""
    small_batches(spark)
    return source_mix.take(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str, model: str | None = None) -> DataFrame:
    """Piece ids and digests, a row per row; null and empty texts have no ids."""
    small_batches(spark)
    if model is None:
        import public_tokenizers

        model = public_tokenizers.path("piece_bpe_32k.model")
    return piece_spans.encode_digests(docs, model, with_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash_near_dedup", drop_near_copies),
    ("pii", mask_private),
    ("source_mix", mix_sources),
    ("sentencepiece", encode),
]

#: Trees, MinHash and piece ids have no SQL form; tests/llm/test_pipeline.py follows run() by other means.
ORACLE_SQL = None


def _run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(os.path.join(sf_dir, "documents.parquet"))
    for name, stage in STAGES:
        docs = save(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs


run = found_by_workers(_run)

"""The registered queries of this subpackage and the SQL they must agree with."""

from __future__ import annotations

import os
from collections.abc import Callable
from functools import wraps
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from scanloom.llm import (byte_pieces, cover_tree_dedup, huffman_ids, importance_resampling, minhash_dedup, phrase_collocations, piece_spans, private_spans, source_mix, suffix_dedup,
                          toxicity_trees, warc_salvage, webp_payload)
from scanloom.llm.common import small_batches
from scanloom.llm.oracles import COVER_TREE, MINHASH, PHRASES, RESAMPLING, SUFFIXES, WARC

ROOT = str(Path(__file__).resolve().parents[2])


def found_by_workers(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """Python workers find this package where the driver found it, whatever folder it runs in, and get small batches."""

    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        own = spark.sparkContext.environment
        paths = own.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep)
        if ROOT not in paths:
            own["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, paths)])
        small_batches(spark)
        return query(spark, sf_dir)

    return run


QUERIES = {name: found_by_workers(query) for name, query in {
    "op1_huffman_ids": huffman_ids.op1,
    "op2_private_spans": private_spans.op2,
    "op3_source_mix": source_mix.op3,
    "op4_webp_payload": webp_payload.op4,
    "op5_warc_salvage": warc_salvage.op5,
    "op6_minhash_dedup": minhash_dedup.op6,
    "op7_toxicity_trees": toxicity_trees.op7,
    "op8_suffix_dedup": suffix_dedup.op8,
    "op9_cover_tree_dedup": cover_tree_dedup.op9,
    "op10_piece_spans": piece_spans.op10,
    "op11_byte_pieces": byte_pieces.op11,
    "op12_importance_resampling": importance_resampling.op12,
    "op13_phrase_collocations": phrase_collocations.op13,
}.items()}
ORACLES: dict[str, str] = {
    "op5_warc_salvage": WARC, "op6_minhash_dedup": MINHASH, "op8_suffix_dedup": SUFFIXES, "op9_cover_tree_dedup": COVER_TREE,
    "op12_importance_resampling": RESAMPLING, "op13_phrase_collocations": PHRASES,
}

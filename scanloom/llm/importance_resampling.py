"""Resampling of documents towards a target distribution, by bags of hashed word runs.

Word runs (n-grams) are counted in batches: the texts of a batch are joined with a separator that is
no part of a word, one pattern pass finds all words of the batch, `searchsorted` over the
documents' offsets says whose they are, runs that cross a document's end are masked, and `bincount`
adds up buckets. Raw and target texts give two histograms of fixed size; their smoothed log ratio is
the gain of a bucket, and a document weighs the sum of the gains of its runs.
Gumbel noise from a hash of the document's id turns weights into scores; the best of them are a
sample without replacement, in which reruns agree.

Counts cover all texts. A task adds up its own histogram, so a row per bucket and task is shuffled
at most; the gains, one number per bucket, are what the driver sees and every task gets.
Ranks come from a sort by ranges with a count per range; no task holds all documents.

Null and empty texts have no words and weigh 0. A null id counts as the empty text for the noise and sorts
last among ties. Repeated rows are separate documents with equal scores; which of two equal rows gets the lower rank
is open, the set of rows is not. An empty table gives no rows; an empty target gives gains by
smoothing alone. A very long text is one row of one task; its words make a batch of their own. Columns of the input
other than key and text are not looked at, whatever their names.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scanloom.llm.common import MEMO_ENTRIES, save, slices
from scanloom.operators.order import with_positions

#: Bytes of text that are joined into one batch.
BATCH_BYTES = 2 << 20
#: Stands between the texts of a batch; no word holds it.
SENTINEL = b"\x00"
#: In UTF-8 every byte of a character beyond ASCII is 0x80 or more, so words of characters are words of bytes.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
COUNTS = "bucket int, n long"
WEIGHTS = "doc_id long, n_words long, n_features long, weight long"


class Batch:
    """The words of a batch of texts: their bytes, and the text each one is from."""

    def __init__(self, texts: list[bytes]):
        joined = SENTINEL.join(texts).translate(LOWER)
        hits = list(WORD.finditer(joined))
        self.words = [m[0] for m in hits]
        starts = np.fromiter((m.start() for m in hits), np.int64, len(hits))
        offsets = np.cumsum([0, *(len(t) + len(SENTINEL) for t in texts)])[:-1]
        self.texts = len(texts)
        self.owner = np.searchsorted(offsets, starts, "right") - 1

    def runs(self, n: int, bucket_of) -> tuple[np.ndarray, np.ndarray]:
        """(owner, bucket) of every run of n words inside one text."""
        if n == 1:
            return self.owner, np.fromiter(map(bucket_of, self.words), np.int64, len(self.words))
        inside = np.flatnonzero(self.owner[n - 1:] == self.owner[:len(self.owner) - n + 1]) if len(self.words) >= n else np.zeros(0, int)
        words = self.words
        return self.owner[inside], np.fromiter((bucket_of(b" ".join(words[i:i + n])) for i in inside.tolist()), np.int64, len(inside))


class Buckets(dict):
    """The bucket of a run: its checksum modulo their number. Frequent runs are remembered."""

    def __init__(self, buckets: int):
        super().__init__()
        self.buckets = buckets

    def __missing__(self, run: bytes) -> int:
        bucket = zlib.crc32(run) % self.buckets
        if len(self) < MEMO_ENTRIES and len(run) <= 64:
            self[run] = bucket
        return bucket


def _batches(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, Batch]]:
    for batch in slices(batches, column, BATCH_BYTES):
        yield batch, Batch([t or b"" for t in batch.column(column).cast(pa.binary()).to_pylist()])


def histogram(texts: DataFrame, text: str = "text", n: int = 1, buckets: int = 10_000) -> DataFrame:
    """(bucket, n): how often runs of 1 to n words fall into each bucket, over all whole texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket_of, total = Buckets(buckets).__getitem__, np.zeros(buckets, np.int64)
        for _, batch in _batches(batches, 0):
            for k in range(1, n + 1):
                total += np.bincount(batch.runs(k, bucket_of)[1], minlength=buckets)
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(hit.astype(np.int32)), pa.array(total[hit])], ["bucket", "n"])

    return (texts.select(F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(count, COUNTS)
            .groupBy("bucket").agg(F.sum("n").alias("n")))


@dataclass(frozen=True)
class Model:
    """Gain per bucket, in thousandths of the natural logarithm of the smoothed ratio, floored."""

    gains: tuple[int, ...]
    n: int


def fit(raw: DataFrame, target: DataFrame, text: str = "text", n: int = 1, buckets: int = 10_000) -> Model:
    """Histograms of both sides, each bucket smoothed by one. `buckets` bounds what the driver collects."""
    sides = (histogram(raw, text, n, buckets).select(F.lit(0).alias("side"), "bucket", "n")
             .unionByName(histogram(target, text, n, buckets).select(F.lit(1).alias("side"), "bucket", "n")))
    counts = np.zeros((2, buckets), np.int64)
    for side, bucket, count in sides.collect():
        counts[side, bucket] = count
    all_raw, all_target = (float(x) for x in counts.sum(1))
    return Model(tuple(
        math.floor(1000 * math.log((float(t) + 1) * (all_raw + buckets) / ((float(s) + 1) * (all_target + buckets))))
        for s, t in zip(counts[0].tolist(), counts[1].tolist(), strict=True)), n)


def weigh(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every whole text; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gains, bucket_of = np.array(model.gains, np.int64), Buckets(len(model.gains)).__getitem__
        for rows, batch in _batches(batches, 1):
            features, weight = np.zeros(batch.texts, np.int64), np.zeros(batch.texts, np.int64)
            for k in range(1, model.n + 1):
                owner, bucket = batch.runs(k, bucket_of)
                features += np.bincount(owner, minlength=batch.texts)
                np.add.at(weight, owner, gains[bucket])
            words = np.bincount(batch.owner, minlength=batch.texts)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(words), pa.array(features), pa.array(weight)],
                                             ["doc_id", "n_words", "n_features", "weight"])

    return docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(run, WEIGHTS)


def noise(key: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, floored: from the first 32 bits of the hash of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def draw(weighed: DataFrame, percent: int = 10, least_words: int = 20, seed: int = 2024) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row of `weigh`; rank is null where a document isn't drawn.

    Of the N documents with at least `least_words` words the floor(percent * N / 100) best scores are drawn.
    """
    scored = save(weighed.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "scores")
    able = F.col("n_words") >= least_words
    quota = scored.filter(able).count() * percent // 100
    shown = ["doc_id", "n_features", "weight", "score"]
    placed = with_positions(scored.filter(able).select(*shown), [F.desc("score"), F.asc_nulls_last("doc_id")], name="rank")
    ranked = placed.withColumn("rank", F.when(F.col("rank") < quota, F.col("rank") + 1))
    return ranked.unionByName(scored.filter(~able).select(*shown, F.lit(None).cast("long").alias("rank")))


def resample(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", n: int = 1, buckets: int = 10_000,
             percent: int = 10, least_words: int = 20, seed: int = 2024) -> DataFrame:
    """Fit on all of both tables, weigh every document and draw."""
    model = fit(docs, target, text, n, buckets)
    return draw(weigh(docs, model, key, text), percent, least_words, seed)


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))

"""Mixing sources to target weights, fitted exactly by subset sums over document lengths.

Targets: a share of all words is dealt to the sources by weight; no source gets more than
`most` times its size, and what it cannot take is dealt again among the others.

A source takes all its documents as often as its target holds its size. For the rest of the
target, documents are counted by their exact length. Every length first gives its even share,
rounded down. What is left is small: long documents are added while they fit, and a bounded
knapsack over the remaining counts, solved by dynamic programming over a window of `WINDOW`
words, brings the sum to the target, or as near below it as lengths allow. Then, within each
(source, length), that many documents are chosen by the order of a seeded hash.

What one task holds is a source's distinct lengths with their counts (their number grows at most
with the root of the source's words). Choosing within a length is spread over `BUCKETS` hash
buckets, so a length that very many documents share is no single task's work.

Null and empty texts have length 0 and are never taken. A null source is a source of its own, last
in order. Repeated rows are documents of their own, told apart arbitrarily where they are equal,
so results as a set do not change. Sources without words get a target of 0. An empty table gives
no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scanloom.llm.common import column_or_null, save

WEIGHTS = (5.0, 2.0, 1.0)
SHARE, MOST = 1.5, 2
#: Words of the remaining budget that dynamic programming covers.
WINDOW = 1 << 16
BUCKETS = 256
SEED = 1


def words(text: Column) -> Column:
    """Number of `[^\\x20\\x09-\\x0D]+` in a text: the places where such a run begins."""
    return F.coalesce(F.regexp_count(text, F.lit(r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D]")), F.lit(0)).cast("long")


def targets(sizes: Sequence[int], weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> list[float]:
    """Target of each source, given in order; weights repeat."""
    out = [0.0] * len(sizes)
    free = {i: weights[i % len(weights)] for i in range(len(sizes))}
    left = share * sum(sizes)
    while free:
        total = sum(free.values())
        dealt = {i: left * w / total for i, w in free.items()}
        full = [i for i in free if dealt[i] > most * sizes[i]]
        if not full:
            for i in free:
                out[i] = dealt[i]
            break
        for i in full:
            out[i] = float(most * sizes[i])
            left -= out[i]
            del free[i]
    return out


def fit_lengths(lengths: np.ndarray, counts: np.ndarray, target: float, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(whole rounds for all documents, how many of each length get one more) for ascending distinct lengths over 0."""
    total = int(lengths @ counts)
    rounds, budget = divmod(int(round(target)), total) if total else (0, 0)
    taken = counts * budget // total if total else counts * 0
    left, spare = budget - int(lengths @ taken), counts - taken
    # Long ones first, down to what the window holds.
    for i in range(len(lengths) - 1, -1, -1):
        if left <= window:
            break
        n = min(int(spare[i]), (left - window + int(lengths[i]) - 1) // int(lengths[i]), left // int(lengths[i]))
        taken[i], spare[i], left = taken[i] + n, spare[i] - n, left - n * int(lengths[i])
    left = min(left, int(lengths @ spare)) if len(lengths) else 0
    # reach[s] is the length that first made the sum s; a sum's last steps all use that length.
    span = min(left, window)
    reach = np.full(span + 1, -1, np.int64)
    used = np.zeros(span + 1, np.int64)
    reach[0] = len(lengths)
    for i, (length, n) in enumerate(zip(lengths.tolist(), spare.tolist(), strict=True)):
        if length > span or reach[span] >= 0:
            break
        base = reach >= 0
        for k in range(1, min(n, span // length) + 1):
            base = np.concatenate([np.zeros(length, bool), base[:-length]])
            new = base & (reach < 0)
            if not base.any() or reach[span] >= 0:
                break
            reach[new], used[new] = i, k
    at = int(np.flatnonzero(reach >= 0)[-1])
    while at:
        i, k = int(reach[at]), int(used[at])
        taken[i] += k
        at -= k * int(lengths[i])
    return np.int64(rounds), taken


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[float] = WEIGHTS,
        share: float = SHARE, most: float = MOST, seed: int = SEED) -> DataFrame:
    """(doc_id, text_hash, size, source, source_size, target, copies) of every row: how often the mix takes it."""
    spark = docs.sparkSession
    rows = save(docs.select(
        F.col(key).cast("long").alias("doc_id"), column_or_null(docs, source, "string").alias("source"),
        words(F.col(text).cast("string")).alias("size"), F.xxhash64(F.col(text).cast("string")).alias("text_hash"),
    ), "sizes")
    hist = save(rows.groupBy("source", "size").agg(F.count("*").alias("n")), "lengths")
    # A row per source meets the driver: the mix is configured per source there anyway.
    sums = sorted(((r.source, r.words) for r in hist.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("words")).collect()),
                  key=lambda r: (r[0] is None, r[0] or ""))
    goal = targets([n for _, n in sums], weights, share, most)
    plan = spark.createDataFrame([(s, n, t) for (s, n), t in zip(sums, goal, strict=True)],
                                 "source string, source_size long, target double")

    def fit(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("size")
        lengths, counts = own["size"].to_numpy(np.int64), own["n"].to_numpy(np.int64)
        rounds, more = fit_lengths(lengths, counts, float(own["target"].iloc[0]))
        return pd.DataFrame({"source": own["source"], "size": lengths, "rounds": rounds, "more": more})

    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    asked = hist.filter("size > 0").join(plan, same(hist, plan)).select(hist["source"], "size", "n", "target")
    fitted = save(asked.groupBy("source").applyInPandas(fit, "source string, size long, rounds long, more long"), "fitted")

    order = F.xxhash64(F.lit(seed), "doc_id", "text_hash")
    placed = rows.withColumn("order", order).withColumn("bucket", F.pmod("order", F.lit(BUCKETS)).cast("int"))
    filled = placed.filter("size > 0").groupBy("source", "size", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("source", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    ahead = filled.withColumn("ahead", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    quota = save(ahead.join(fitted, same(ahead, fitted) & (ahead["size"] == fitted["size"]))
                 .select(ahead["source"], ahead["size"], "bucket", "rounds", (F.col("more") - F.col("ahead")).alias("open")), "quota")
    own = Window.partitionBy(placed["source"], placed["size"], placed["bucket"]).orderBy("order", "doc_id")
    found = (placed.join(quota, same(placed, quota) & (placed["size"] == quota["size"]) & (placed["bucket"] == quota["bucket"]), "left")
             .select("doc_id", "text_hash", placed["source"], placed["size"], "rounds", "open", F.row_number().over(own).alias("place")))
    copies = F.coalesce(F.col("rounds") + (F.col("place") <= F.col("open")).cast("long"), F.lit(0))
    return (found.join(F.broadcast(plan), same(found, plan))
            .select("doc_id", "text_hash", "size", found["source"], "source_size", "target", copies.alias("copies")))


def take(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **settings) -> DataFrame:
    """The mix itself: every row as often as it is taken, all columns kept; rows not taken go.

    Rows with equal key, text and source share the copies taken of them evenly, so they need no other identity.
    """
    found = mix(docs, key, text, source, **settings)
    total = (found.groupBy("doc_id", "text_hash", "source").agg(F.sum("copies").alias("__copies"), F.count("*").alias("__rows"))
             .filter("__copies > 0").withColumnsRenamed({"doc_id": "__id", "text_hash": "__text", "source": "__source"}))
    own = docs.withColumns({"__hash": F.xxhash64(F.col(text).cast("string")), "__key": F.col(key).cast("long"),
                            "__from": column_or_null(docs, source, "string")})
    joined = own.join(total, F.col("__key").eqNullSafe(F.col("__id")) & (F.col("__hash") == F.col("__text"))
                      & F.col("__from").eqNullSafe(F.col("__source")))
    place = F.row_number().over(Window.partitionBy("__key", "__hash", "__from").orderBy("__key"))
    times = F.floor(F.col("__copies") / F.col("__rows")) + (place <= F.col("__copies") % F.col("__rows")).cast("long")
    return (joined.withColumn("__times", times.cast("int")).filter("__times > 0")
            .withColumn("__time", F.explode(F.sequence(F.lit(1), F.col("__times")))).select(*docs.columns))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))

"""Toxicity by gradient-boosted trees over dense features, calibrated by isotonic regression.

Features of a whole text: densities of a seed lexicon and of a learned one, hits close to a
second-person word, capitals, punctuation, symbols, digits, and words that hide a lexicon word
(`id1ot`, `l*ser`). Neither labels nor ids, languages or sources are features.

The model is fitted on at most `rows` labelled documents, taken in the order of a hash of their
id; that sample (and a feature row for each of its documents) is all that reaches the driver.
Trees are fitted on all of it, the calibration on scores across folds. Everything else reads all
documents, in one pass without a shuffle.

Null and empty texts have all densities 0 and get the score of such a text. Rows with a null
label are not learned from. With labels of one class only, or none, every score is that class's
rate (0.5 without labels). Repeated rows get repeated results; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scanloom.llm.common import lean, save, slices

#: Labelled documents that the model is fitted on, at most.
TRAIN_ROWS = 12_000
THRESHOLD = 0.3
#: Words before and after a hit that are searched for a second-person word.
NEAR = 5
KEYS = 6
FOLDS = 4

SEED_WORDS = frozenset(
    b"idiot idiots moron morons stupid dumb loser losers trash scum clown pathetic worthless disgusting "
    b"imbecile fool ugly garbage filth filthy vermin bastard jerk creep freak retard pig swine "
    b"dumm dummkopf idiotin trottel versager abschaum widerlich wertlos "
    b"imbecil idiota est\xc3\xbapido basura asqueroso perdedor escoria payaso "
    b"imb\xc3\xa9cile abruti d\xc3\xa9chet minable ordure cr\xc3\xa9tin".split())
SECOND_PERSON = frozenset(b"you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta vous votre tus ti usted".split())

FEATURES = ("log_words", "log_hits", "hit_density", "distinct_hits", "learned_weight", "learned_density",
            "second_person", "near_second_person", "capitals", "exclamations", "questions", "commas_stops",
            "symbols", "digits", "doubled_marks", "hidden_words", "non_ascii", "mean_word")

_PUNCTUATION = bytes(i for i in range(128) if not chr(i).isalnum() and not chr(i).isspace())
_BLANKED = bytes(32 if i in _PUNCTUATION else i for i in range(256))
_UPPER, _DIGITS, _SYMBOLS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"*#$%&@^~|<>=+"
_HIDDEN = re.compile(rb"(?<![a-z0-9])[a-z]{1,16}[*@$!0-9_.-]{1,4}[a-z*@$!0-9_.-]{0,16}[a-z](?![a-z])")
_LEET = bytes.maketrans(b"0134578@$!", b"oieastbasi")


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased (A-Z) words without ASCII punctuation."""
    return text.lower().translate(_BLANKED).split()


@dataclass
class Lexicon:
    weights: dict[bytes, float]

    def __post_init__(self):
        self.learned = frozenset(self.weights)
        self.bad = SEED_WORDS | self.learned
        self.gapped = frozenset(w[:i] + w[i + 1:] for w in self.bad if len(w) >= 4 for i in range(1, len(w) - 1))

    def hidden(self, text: bytes) -> int:
        """Words that read as a lexicon word once digits and symbols are taken for letters or left out."""
        found = 0
        for raw in _HIDDEN.findall(text):
            read = raw.translate(_LEET, b"*_.-")
            found += read in self.bad or raw.translate(None, b"*_.-!0123456789@$") in self.gapped and b"*" in raw
        return found

    def features(self, text: str) -> list[float]:
        raw = text.encode()
        words, size = words_of(raw), max(1, len(raw))
        n = max(1, len(words))
        hits, weight, near, learned, kinds = [], 0.0, 0, 0, 0
        if not self.bad.isdisjoint(words):
            hits = [i for i, w in enumerate(words) if w in self.bad]
            kinds = len({words[i] for i in hits})
            weight = sum(self.weights.get(words[i], 0.0) for i in hits)
            learned = sum(words[i] in self.learned for i in hits)
            near = sum(not SECOND_PERSON.isdisjoint(words[max(0, i - NEAR):i + NEAR + 1]) for i in hits)
        person = 0 if SECOND_PERSON.isdisjoint(words) else sum(w in SECOND_PERSON for w in words)
        gone = lambda chars: len(raw) - len(raw.translate(None, chars))
        return [np.log1p(len(words)), np.log1p(len(hits)), len(hits) / n, float(kinds), weight / n, learned / n,
                person / n, near / n, gone(_UPPER) / size, raw.count(b"!") / size, raw.count(b"?") / size,
                gone(b",.") / size, gone(_SYMBOLS) / size, gone(_DIGITS) / size,
                (raw.count(b"!!") + raw.count(b"??") + raw.count(b"**")) / size, self.hidden(raw.lower()) / n,
                (len(raw) - len(text)) / size, size / n]


# --- model ----------------------------------------------------------------------------------

@dataclass
class Trees:
    """Complete binary trees: feature and threshold of inner nodes in heap order, value of leaves."""

    base: float
    features: np.ndarray
    thresholds: np.ndarray
    leaves: np.ndarray

    def raw(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        depth = int(np.log2(self.leaves.shape[1])) if len(self.leaves) else 0
        for feature, threshold, leaf in zip(self.features, self.thresholds, self.leaves, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += leaf[node - (len(leaf) - 1)]
        return total


def fit_trees(x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 3, rate: float = 0.15,
              bins: int = 32, least: float = 1.0, ridge: float = 1.0) -> Trees:
    """Second-order boosting of the logistic loss on binned features."""
    p = np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3)
    base = float(np.log(p / (1 - p)))
    n, width = x.shape
    inner, leaves = (1 << depth) - 1, 1 << depth
    if not n or not rounds:
        return Trees(base, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)))
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(width)]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1)
    flat = binned + np.arange(width) * bins
    out_f, out_t, out_v, score = [], [], [], np.full(n, base)
    for _ in range(rounds):
        prob = 1 / (1 + np.exp(-score))
        g, h = prob - y, prob * (1 - prob)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, count = (1 << level) - 1, 1 << level
            key = ((node - first)[:, None] * (width * bins) + flat).ravel()
            shape = (count, width, bins)
            gs = np.cumsum(np.bincount(key, np.repeat(g, width), count * width * bins).reshape(shape), 2)
            hs = np.cumsum(np.bincount(key, np.repeat(h, width), count * width * bins).reshape(shape), 2)
            ga, ha = gs[:, :, -1:], hs[:, :, -1:]
            gain = gs**2 / (hs + ridge) + (ga - gs)**2 / (ha - hs + ridge) - ga**2 / (ha + ridge)
            gain[(hs < least) | (ha - hs < least)] = 0
            best = gain.reshape(count, -1).argmax(1)
            for k, b in enumerate(best):
                j, cut = divmod(int(b), bins)
                if gain[k, j, cut] > 1e-9 and cut < len(edges[j]):
                    feature[first + k], threshold[first + k] = j, edges[j][cut]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > threshold[node])
        leaf = node - inner
        gl, hl = np.bincount(leaf, g, leaves), np.bincount(leaf, h, leaves)
        value = -rate * gl / (hl + ridge)
        score += value[leaf]
        out_f.append(feature)
        out_t.append(threshold)
        out_v.append(value)
    shape = lambda rows, k: np.array(rows).reshape(-1, k)
    return Trees(base, shape(out_f, inner).astype(np.int64), shape(out_t, inner), shape(out_v, leaves))


def fit_isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots (mean score, rate) of the blocks; rates are read between them by interpolation."""
    blocks: list[list[float]] = []  # sum of scores, sum of labels, count
    order = np.argsort(score, kind="stable")
    for s, t in zip(score[order].tolist(), y[order].tolist(), strict=True):
        if blocks and blocks[-1][0] == s * blocks[-1][2]:
            own = blocks.pop()
            blocks.append([own[0] + s, own[1] + t, own[2] + 1])
        else:
            blocks.append([s, t, 1])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            s2, t2, c2 = blocks.pop()
            own = blocks[-1]
            own[0], own[1], own[2] = own[0] + s2, own[1] + t2, own[2] + c2
    a = np.array(blocks)
    return a[:, 0] / a[:, 2], a[:, 1] / a[:, 2]


@dataclass
class Model:
    lexicon: Lexicon
    trees: Trees
    knots: tuple[np.ndarray, np.ndarray] | None

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = self.trees.raw(x)
        if self.knots is None:
            return 1 / (1 + np.exp(-raw))
        # Interpolated rates are flat beyond the outer knots; a small share of the raw
        # probability keeps the order there.
        return 0.99 * np.interp(raw, *self.knots) + 0.01 / (1 + np.exp(-raw))


# --- learning -------------------------------------------------------------------------------

def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def training_texts(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """(doc_id, toxic, text) of at most `rows` labelled documents outside the held-out part."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    some = known.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(rows)
    # At most `rows` pairs of numbers are broadcast.
    return save(docs.join(F.broadcast(some), "doc_id").select("doc_id", "toxic", "text"), "toxic-sample")


def learned_words(sample: DataFrame, least: int = 8, share: float = 0.6, size: int = 500) -> dict[bytes, float]:
    """Words of the sample that mark toxic texts, with the logarithm of their odds.

    Near copies of a text would repeat all its words. Every text gets the least hash of its
    three-word runs under `KEYS` hash functions; near copies share one of them almost surely,
    and only the first text of each such group counts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        mixers = np.array([0x9E3779B97F4A7C15 + 2 * 0xD1B54A32D192ED03 * k & 0xFFFFFFFFFFFFFFFF for k in range(KEYS)], np.uint64)
        for batch in slices(batches, 2):
            own = [words_of((t or "").encode()) for t in batch.column(2).to_pylist()]
            runs = [np.array([xxhash.xxh64_intdigest(b" ".join(ws[i:i + 3])) for i in range(max(1, len(ws) - 2))], np.uint64)
                    for ws in own]
            keys = [((r[:, None] * mixers).min(0) >> np.uint64(1)).astype(np.int64) for r in runs]
            kinds = [sorted({w for w in ws if 2 < len(w) < 40}) for ws in own]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array(keys, pa.list_(pa.int64())),
                pa.array(kinds, pa.list_(pa.binary()))], ["doc_id", "toxic", "keys", "words"])

    texts = save(sample.mapInArrow(lean(run), "doc_id long, toxic int, keys array<long>, words array<binary>"), "toxic-words")
    one = (texts.select("doc_id", F.posexplode("keys").alias("k", "key"))
           .withColumn("first", F.min("doc_id").over(Window.partitionBy("k", "key")))
           .groupBy("doc_id").agg(F.max(F.col("first") < F.col("doc_id")).alias("later")).filter("not later").select("doc_id"))
    counts = (texts.join(one, "doc_id").select("toxic", F.explode("words").alias("word"))
              .groupBy("word").agg(F.sum("toxic").alias("bad"), F.count("*").alias("n"))
              .filter((F.col("bad") >= least) & (F.col("bad") >= share * F.col("n"))))
    rows = counts.orderBy(F.desc(F.col("bad") / F.col("n")), F.desc("n"), "word").limit(size).collect()
    return {bytes(r.word): float(np.log((r.bad + 0.5) / (r.n - r.bad + 0.5))) for r in rows}


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    sample = training_texts(docs, labels, rows)
    lexicon = Lexicon(learned_words(sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2):
            x = [lexicon.features(t or "") for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(x, pa.list_(pa.float64()))],
                                             ["doc_id", "toxic", "x"])

    found = sample.mapInArrow(lean(run), "doc_id long, toxic int, x array<double>").collect()  # at most `rows`
    found.sort(key=lambda r: (r.doc_id, r.toxic, r.x))
    x, y = np.array([r.x for r in found]).reshape(-1, len(FEATURES)), np.array([r.toxic for r in found], float)
    if len(set(y.tolist())) < 2:
        return Model(lexicon, fit_trees(x[:0], y[:1], rounds=0), None)
    # Calibration needs scores of rows that the trees have not seen: each fold is scored by trees of the others.
    fold = np.array([r.doc_id for r in found]) * 2_654_435_761 % 2**32 * FOLDS >> 32
    raw = np.zeros(len(x))
    for k in range(FOLDS):
        if (fold == k).any():
            raw[fold == k] = fit_trees(x[fold != k], y[fold != k]).raw(x[fold == k])
    return Model(lexicon, fit_trees(x, y), fit_isotonic(raw, y))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of whole texts; the model is a few hundred words and trees."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            x = np.array([model.lexicon.features(t or "") for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lean(run), "doc_id long, score double")


def keep_clean(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows, with all their columns, whose score is below the threshold."""
    schema = docs.schema
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, place):
            x = np.array([model.lexicon.features(t or "") for t in batch.column(place).to_pylist()])
            yield batch.filter(pa.array(model.score(x) < threshold))

    return docs.mapInArrow(lean(run), schema)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                                     (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))

"""Phrases whose words occur together more often than apart, from a weighted de Bruijn graph of words.

Texts are cut into pieces at punctuation and line ends, pieces into words. Nodes are runs of
LONGEST - 1 words, edges the runs of LONGEST words that join two of them, weighted by how often
they occur. Every word of a piece starts one run: an edge, or, where fewer words are left, a shorter
run that ends with the piece. Those ends are the corrections with which all shorter counts
follow from the graph: a run of k words occurs as often as all runs of k + 1 words that begin with it, plus its
own occurrences at ends of pieces. So only the longest runs and the ends are ever counted in texts.

Edges that can only follow one another (all the flow of the node between them comes from the one and goes
into the other) are compacted into paths, by pointer doubling: after each round an edge knows twice as
many of its successors. What stands in the middle of a path needs no comparison with longer
phrases: it occurs exactly as often as the edges around it.

Before runs are counted, word pairs are, by 64-bit hashes: a pair below the least count is part of no candidate,
so a run may end between its words as at the end of a piece; all counts that matter stay the same. Frequent
pairs reach the tasks as a bit map of a fixed size (`PAIR_BITS`). Pairs that share a bit by chance are kept, so a full
map costs work but no results.

Everything is per language; a null one is `und`. Null and empty texts have no words. Repeated rows count every time.
Ties are broken by the phrase, in byte order. An empty table gives no rows. A very long text is read by one task and leaves it as
counted runs. Columns of the input other than language and text are not looked at, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scanloom.llm.common import save, slices

#: Words of the longest phrase.
LONGEST = 5
#: Bits of the map of frequent pairs: 8 MB at every task.
PAIR_BITS = 1 << 26
#: Bits of one row of the map on its way to the driver.
CHUNK_BITS = 1 << 18
#: Words that a task holds before it counts them.
HELD_WORDS = 1 << 20
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
TOKEN = re.compile(rb"[.,;:!?\x0A-\x0D]|[^\x20\x09.,;:!?\x0A-\x0D]+")
MARKS = [bytes([c]) for c in b".,;:!?\x0a\x0b\x0c\x0d"]
RUNS = "lang string, k int, phrase string, n long"


class Words(dict):
    """Numbers of words from 1 on; marks are 0."""

    def __init__(self):
        super().__init__(dict.fromkeys(MARKS, 0))
        self.words = [b""]

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self.words)
        self.words.append(word)
        return number


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[bytes], dict[str, np.ndarray]]]:
    """(words, numbers of the words of all texts per language, with a mark between texts), about HELD_WORDS at once."""
    known, held, size = Words(), {}, 0
    for batch in slices(batches, 1, 1 << 20):
        texts: dict[str, list[bytes]] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
            texts.setdefault(lang, []).append(text or b"")
        for lang, own in texts.items():
            tokens = TOKEN.findall(b"\n".join([*own, b""]).translate(LOWER))
            held.setdefault(lang, []).append(np.fromiter(map(known.__getitem__, tokens), np.int64, len(tokens)))
            size += len(tokens)
        if size >= HELD_WORDS:
            yield known.words, {lang: np.concatenate(parts) for lang, parts in held.items()}
            known, held, size = Words(), {}, 0
    if held:
        yield known.words, {lang: np.concatenate(parts) for lang, parts in held.items()}


def pair_hashes(words: list[bytes], lang: str, numbers: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every two neighbouring places; those with a mark among them mean nothing."""
    single = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))[numbers]
    mixed = single[:-1] * np.uint64(0x9E3779B97F4A7C15) + (single[1:] ^ np.uint64(xxhash.xxh3_64_intdigest(lang.encode(), 1)))
    mixed ^= mixed >> np.uint64(32)
    mixed *= np.uint64(0xD6E8FEB86659FD93)
    return mixed ^ (mixed >> np.uint64(29))


def frequent_pairs(texts: DataFrame, least: int, bits: int = PAIR_BITS) -> dict[int, bytes]:
    """The map of pairs that occur at least `least` times, in chunks; `bits` bounds what the driver gets."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, langs in _held(batches):
            for lang, numbers in langs.items():
                inside = (numbers[:-1] > 0) & (numbers[1:] > 0)
                pairs, n = np.unique(pair_hashes(words, lang, numbers)[inside], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(pairs.view(np.int64)), pa.array(n)], ["pair", "n"])

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps: dict[int, np.ndarray] = {}
        for batch in batches:
            places = batch.column(0).to_numpy()
            for chunk in np.unique(places // CHUNK_BITS).tolist():
                own = maps.setdefault(chunk, np.zeros(CHUNK_BITS, bool))
                own[places[places // CHUNK_BITS == chunk] % CHUNK_BITS] = True
        if maps:
            yield pa.RecordBatch.from_arrays([pa.array(list(maps), pa.int64()), pa.array([np.packbits(m).tobytes() for m in maps.values()])],
                                             ["chunk", "map"])

    often = (texts.mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
             .select(F.pmod("pair", F.lit(bits)).alias("bit")).distinct())
    chunks = F.floor(F.col("bit") / CHUNK_BITS)
    return {r.chunk: bytes(r.map) for r in often.repartition(16, chunks).mapInArrow(draw, "chunk long, map binary").collect()}


def longest_runs(texts: DataFrame, pairs: dict[int, bytes] | None, longest: int = LONGEST, bits: int = PAIR_BITS) -> DataFrame:
    """(lang, k, phrase, n): edges (k = longest) and ends (k below), counted over all texts."""

    def linked(words: list[bytes], lang: str, numbers: np.ndarray, marked: np.ndarray | None) -> np.ndarray:
        inside = (numbers[:-1] > 0) & (numbers[1:] > 0)
        if marked is not None:
            inside &= marked[(pair_hashes(words, lang, numbers).view(np.int64) % bits)]
        return inside

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked = None
        if pairs is not None:
            packed = np.zeros(bits // 8 + CHUNK_BITS // 8, np.uint8)
            for chunk, own in pairs.items():
                packed[chunk * CHUNK_BITS // 8:(chunk + 1) * CHUNK_BITS // 8] = np.frombuffer(own, np.uint8)
            marked = _Bits(packed)
        for words, langs in _held(batches):
            spelled = pa.array(words, pa.binary()).cast(pa.string())
            for lang, numbers in langs.items():
                numbers = np.concatenate([numbers, np.zeros(longest, np.int64)])
                on = np.append(linked(words, lang, numbers, marked), False)
                length = (numbers > 0).astype(np.int64)
                going = length.astype(bool)
                for j in range(longest - 1):
                    going = going & np.concatenate([on[j:], np.zeros(j, bool)])
                    length += going
                for k in range(1, longest + 1):
                    first = np.flatnonzero(length == k)
                    if len(first):
                        yield _counted(lang, numbers, first, k, spelled)

    return texts.mapInArrow(count, RUNS).groupBy("lang", "k", "phrase").agg(F.sum("n").alias("n"))


class _Bits:
    """A packed bit map, read by places."""

    def __init__(self, packed: np.ndarray):
        self.packed = packed

    def __getitem__(self, places: np.ndarray) -> np.ndarray:
        return (self.packed[places >> 3] >> (7 - (places & 7)).astype(np.uint8) & 1).astype(bool)


def _counted(lang: str, numbers: np.ndarray, first: np.ndarray, k: int, spelled: pa.Array) -> pa.RecordBatch:
    """The distinct runs of k words from the given places, with their counts."""
    key = numbers[first]
    for j in range(1, k):
        # Equal heads get one number, so head and next word fit 64 bits.
        key = np.unique(key, return_inverse=True)[1] << 32 | numbers[first + j]
    _, at, n = np.unique(key, return_index=True, return_counts=True)
    where = first[at]
    columns = [pc.take(spelled, pa.array(numbers[where + j])) for j in range(k)]
    phrase = columns[0] if k == 1 else pc.binary_join_element_wise(*columns, " ")
    return pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(np.full(len(at), k, np.int32)), phrase, pa.array(n)],
                                      ["lang", "k", "phrase", "n"])


def head(phrase: Column, k: int) -> Column:
    """The first k words."""
    return F.substring_index(phrase, " ", k)


def tail(phrase: Column, k: int) -> Column:
    """The last k words."""
    return F.substring_index(phrase, " ", -k)


def flows(runs: DataFrame, longest: int = LONGEST) -> dict[int, DataFrame]:
    """k -> (lang, phrase, f): counts of runs of k words, each level from the one above and the ends of pieces."""
    level = runs.filter(F.col("k") == longest).select("lang", "phrase", F.col("n").alias("f"))
    found = {longest: level}
    for k in range(longest - 1, 0, -1):
        ends = runs.filter(F.col("k") == k).select("lang", "phrase", F.col("n").alias("f"))
        through = level.select("lang", head(F.col("phrase"), k).alias("phrase"), "f")
        level = save(through.unionByName(ends).groupBy("lang", "phrase").agg(F.sum("f").alias("f")), f"flow-{k}")
        found[k] = level
    return found


def compact(edges: DataFrame, nodes: DataFrame, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """Paths of edges through unary nodes, and those nodes.

    (lang, start, place, phrase, f): every edge with the first edge of its path and its place in it, and
    (lang, phrase): the nodes inside paths. A node is unary if one edge brings all its flow and one takes all of it.
    """
    k = longest - 1
    into = edges.select("lang", tail(F.col("phrase"), k).alias("node"), F.col("phrase").alias("from"), F.col("f").alias("in"))
    out = edges.select("lang", head(F.col("phrase"), k).alias("node"), F.col("phrase").alias("to"), F.col("f").alias("out"))
    full = nodes.select("lang", F.col("phrase").alias("node"), "f")
    links = save(into.join(full, ["lang", "node"]).filter("in = f").join(out, ["lang", "node"]).filter("out = f")
                 .select("lang", "node", "from", "to"), "links")
    back = links.select("lang", F.col("to").alias("phrase"), F.col("from").alias("prior"))
    state = save(edges.select("lang", "phrase").join(back, ["lang", "phrase"], "left")
                 .select("lang", "phrase", F.coalesce("prior", "phrase").alias("start"),
                         F.when(F.col("prior").isNull(), 0).otherwise(1).cast("long").alias("place")), "paths")
    reached = -1
    while True:
        # Places of a finished path add up to a sum that stays; until then every round adds to it.
        total = state.agg(F.coalesce(F.sum(F.col("place").cast("decimal(38,0)")), F.lit(0))).first()[0]
        if total == reached:
            break
        reached = total
        further = state.filter("place > 0").select("lang", F.col("phrase").alias("start"), F.col("start").alias("_start"), F.col("place").alias("_place"))
        state = save(state.join(further, ["lang", "start"], "left").select(
            "lang", "phrase", F.coalesce("_start", "start").alias("start"), (F.col("place") + F.coalesce("_place", F.lit(0))).alias("place")), "paths")
    return state.join(edges, ["lang", "phrase"]), links.select("lang", F.col("node").alias("phrase")).distinct()


def spell(paths: DataFrame, longest: int = LONGEST) -> DataFrame:
    """(lang, phrase, n_edges, f): every path as one phrase, which is no longer than the piece it is from."""
    last = F.transform(F.array_sort(F.collect_list(F.struct("place", tail(F.col("phrase"), 1).alias("word")))), lambda x: x["word"])
    rest = paths.groupBy("lang", "start").agg(last.alias("words"), F.count(F.lit(1)).alias("n_edges"), F.max("f").alias("f"))
    return rest.select("lang", F.concat_ws(" ", head(F.col("start"), longest - 1), F.array_join("words", " ")).alias("phrase"), "n_edges", "f")


def collocations(docs: DataFrame, lang: str = "lang", text: str = "text", longest: int = LONGEST, least: int = 100, absorb: int = 100,
                 bits: int = PAIR_BITS) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of every candidate that no longer one absorbs.

    Candidates are phrases of 2 to `longest` words that occur at least `least` times. One is absorbed by a longer candidate
    that holds it and occurs at least `absorb` per cent as often; as counts fall with length, it is enough to look one word further.
    """
    texts = docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"), F.col(f"`{text}`").cast("string").alias("text"))
    runs = save(longest_runs(texts, frequent_pairs(texts, least, bits), longest, bits), "runs")
    total = runs.groupBy("lang").agg(F.sum("n").alias("n"))
    counts = {k: f.filter(F.col("f") >= least) for k, f in flows(runs, longest).items()}

    paths, inner = compact(counts[longest], counts[longest - 1], longest)
    left = [save(paths.select("lang", "phrase", "f"), "edges")]
    for k in range(longest - 1, 1, -1):
        longer = counts[k + 1] if k + 1 < longest else left[0]
        around = longer.select("lang", F.explode(F.array(head(F.col("phrase"), k), tail(F.col("phrase"), k))).alias("phrase"), F.col("f").alias("more"))
        most = around.groupBy("lang", "phrase").agg(F.max("more").alias("more"))
        own = counts[k]
        if k == longest - 1 and absorb <= 100:
            own = own.join(inner, ["lang", "phrase"], "left_anti")
        left.append(own.join(most, ["lang", "phrase"], "left").filter(
            F.col("more").isNull() | (F.col("more") * 100 < F.col("f") * absorb)).select("lang", "phrase", "f"))
    kept = reduce(DataFrame.unionByName, left)

    parts = reduce(DataFrame.unionByName, [counts[k] for k in range(1, longest)])
    size = F.size(F.split("phrase", " "))
    cuts = kept.select("lang", "phrase", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), size - 1)).alias("cut")).select(
        "*", F.expr("substring_index(phrase, ' ', cut)").alias("first"),
        F.expr("substring_index(phrase, ' ', cut - size(split(phrase, ' ')))").alias("rest"))
    scored = (cuts.join(parts.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"])
              .join(parts.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
              .join(total, "lang").withColumn("score", score()))
    return (scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "cut", "l", "r")).alias("best"))
            .select("lang", "phrase", "a", "best.l", "best.r", "n", "best.score"))


def score() -> Column:
    """floor(1000 * a * n / (l * r)) of the columns of these names, in whole numbers of up to 38 digits."""
    top, bottom = (f"cast({x} as decimal(19,0)) * cast({y} as decimal(19,0))" for x, y in (("1000 * a", "n"), ("l", "r")))
    return F.expr(f"({top}) div ({bottom})")


def best(found: DataFrame, most: int = 2000) -> DataFrame:
    """The first phrases of every language with their rank; ranks are cut before rows are shuffled."""
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return (found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)
            .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best(collocations(spark.read.parquet(f"{sf_dir}/documents.parquet")))

"""Near-duplicate documents by MinHash: universal hash minima, banding, verification, components.

A document is the set of its distinct word runs (`width` words; A-Z lower-cased; a shorter text is
one run). Runs are known by 64-bit hashes. `HASHES` functions (a*x + b mod 2^64, odd a) give one
minimum each; `ROWS` minima make a band, and documents that share a band are candidates. With 40
bands of 5 rows a pair at the threshold of 0.75 is missed with a probability of 2 in 100,000.

Documents with equal sets form one class with the smallest id as its representative; only
representatives are compared. In every band bucket each member is first compared with a few members
that stand for the bucket. Components of the links so found leave few open questions: members of a
bucket outside its largest component are then compared with those of all other components. Every candidate is checked on signatures
(a wide margin below the threshold) and then on the full sets.

Null ids are left out of links. Null, empty and blank texts have empty sets and link with nothing.
Repeated ids stand for one node: equal sets or links of any of their rows join them. An empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scanloom.llm.common import lean, save, slices
from scanloom.llm.graph import components

WIDTH, SIMILARITY = 5, 0.75
HASHES, ROWS = 200, 5
#: Members that stand for a bucket in the first comparison, and members of a block in the second.
HEADS, PACK = 2, 64
#: Words whose hashes a task keeps.
KNOWN = 100_000
#: Share of equal minima that a candidate must have: 0.75 less four standard deviations.
SIGNATURE_LEAST = 0.75 - 4 * (0.75 * 0.25 / HASHES) ** 0.5

_rng = np.random.default_rng(20240229)
_A = _rng.integers(0, 1 << 63, HASHES, np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, HASHES, np.uint64)
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX[1]
    x = x ^ (x >> np.uint64(27))
    x = x * _MIX[2]
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sorted distinct hashes of a text's word runs."""

    def __init__(self, width: int = WIDTH):
        import xxhash

        self.width, self.hash, self.known = width, xxhash.xxh64_intdigest, {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = text.encode().lower().split() if text else []  # bytes: A-Z and ASCII white space only
        if not words:
            return np.empty(0, np.uint64)
        hashes = list(map(self.known.get, words))
        if None in hashes:
            if len(self.known) > KNOWN:
                self.known.clear()
            hashes = [self.known.setdefault(w, self.hash(w)) if h is None else h for w, h in zip(words, hashes, strict=True)]
        h = np.array(hashes, np.uint64)
        n = max(1, len(h) - self.width + 1)
        run = np.full(n, min(self.width, len(h)), np.uint64)
        for k in range(min(self.width, len(h))):
            run = mixed(run * _MIX[0] + h[k:k + n])
        return np.unique(run)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The least value of every hash function."""
    least = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(shingles), 1024):
        values = np.multiply.outer(_A, shingles[k:k + 1024])
        values += _B[:, None]
        np.minimum(least, values.min(1), out=least)
    return least


def sketches(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """(doc_id, n_shingles, set_id, bands, minima): set_id and the rest are null for empty sets. No shuffle.

    minima keeps 16 bits of each least value for verification.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        shingler = Shingler(width)
        for batch in slices(batches, 1):
            sets = [shingler(t) for t in batch.column(1).to_pylist()]
            signatures = [signature(s) if len(s) else None for s in sets]
            bands = [None if s is None else [xxhash.xxh64_intdigest(b.tobytes()) - (1 << 63) for b in s.reshape(-1, ROWS)]
                     for s in signatures]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([len(s) for s in sets], pa.int64()),
                pa.array([xxhash.xxh128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                pa.array(bands, pa.list_(pa.int64())),
                pa.array([None if s is None else (s >> np.uint64(48)).astype("<u2").tobytes() for s in signatures], pa.binary()),
            ], ["doc_id", "n_shingles", "set_id", "bands", "minima"])

    return docs.select(F.col(key).cast("long"), F.col(text).cast("string")).mapInArrow(
        lean(run), "doc_id long, n_shingles long, set_id binary, bands array<long>, minima binary")


def shingle_sets(texts: DataFrame, asked: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, runs) of the asked ids: the only step that moves texts. The asked grow with the input, so they are never broadcast."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(width)
        for batch in slices(batches, 1):
            found = [shingler(t).astype("<u8").tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["doc_id", "runs"])

    return texts.join(asked.hint("merge"), "doc_id", "left_semi").select("doc_id", "text").mapInArrow(
        lean(run), "doc_id long, runs binary")


def likely(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The (a, b) whose signatures agree enough and whose sizes allow the similarity."""

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), "<u2").reshape(-1, HASHES) for k in (2, 3))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(
                pa.array((x == y).mean(1) >= SIGNATURE_LEAST))

    own = nodes.select("doc_id", "minima", "n_shingles")
    sized = (pairs.join(own.select(F.col("doc_id").alias("a"), F.col("minima").alias("x"), F.col("n_shingles").alias("n")), "a")
             .join(own.select(F.col("doc_id").alias("b"), F.col("minima").alias("y"), F.col("n_shingles").alias("m")), "b")
             .filter(100 * F.least("n", "m") >= 75 * F.greatest("n", "m")))
    return sized.select("a", "b", "x", "y").mapInArrow(lean(close), "a long, b long")


def alike(p: np.ndarray, q: np.ndarray) -> bool:
    """Whether two sorted sets reach the similarity."""
    if 100 * min(len(p), len(q)) < 75 * max(len(p), len(q)):
        return False
    both = np.concatenate([p, q])
    both.sort(kind="stable")  # merges the two sorted halves
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= 75 * (len(p) + len(q) - common)


def similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The (a, b) whose full sets are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [alike(np.frombuffer(x.as_py(), "<u8"), np.frombuffer(y.as_py(), "<u8"))
                    for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return (pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("runs").alias("x")), "a")
            .join(sets.select(F.col("doc_id").alias("b"), F.col("runs").alias("y")), "b")
            .select("a", "b", "x", "y").mapInArrow(lean(run), "a long, b long"))


def across(member: DataFrame, nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b) of one bucket, in different components, whose full sets are similar.

    member: (band, value, doc_id, component). Members of a bucket are packed into blocks of about
    `PACK`. Those outside its largest component meet all others, block by block inside a task, which
    checks signatures, then sets, of pairs that share no band before this one. Only links leave it.
    """
    parts = member.groupBy("band", "value", "component").agg(F.count("*").alias("n"))
    open_ = (parts.groupBy("band", "value").agg(F.max_by("component", F.struct("n", "component")).alias("main"),
                                                F.sum("n").alias("n"), F.count("*").alias("parts"))
             .filter("parts > 1").select("band", "value", "main", F.ceil(F.col("n") / PACK).cast("int").alias("blocks")))
    full = (member.join(open_, ["band", "value"]).join(nodes.select("doc_id", "bands", "minima"), "doc_id").join(sets, "doc_id")
            .withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks"))))
    row = F.collect_list(F.struct("doc_id", "component", "minima", "bands", "runs"))
    right = save(full.groupBy("band", "value", "block").agg(row.alias("y")), "blocks", "none")
    left = save(full.filter("component <> main").groupBy("band", "value", "block").agg(row.alias("x")), "blocks", "none")
    pairs = left.select("band", "value", "x").join(right.select("band", "value", "y"), ["band", "value"]).select("band", "x", "y")

    def arrays(rows: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
        minima = np.frombuffer(b"".join(r["minima"] for r in rows), "<u2").reshape(-1, HASHES)
        return (np.array([r["doc_id"] for r in rows]), np.array([r["component"] for r in rows]), minima,
                np.array([r["bands"] for r in rows]), [np.frombuffer(r["runs"], "<u8") for r in rows])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                band = batch.column(0)[k].as_py()
                (ids, own, x, bx, p), (others, parts_, y, by, q) = (arrays(batch.column(c)[k].as_py()) for c in (1, 2))
                found: list[tuple[int, int]] = []
                for i in range(len(ids)):
                    agree = ((x[i] == y).mean(1) >= SIGNATURE_LEAST) & (own[i] != parts_)
                    agree &= ~(bx[i, :band] == by[:, :band]).any(1)
                    for j in np.flatnonzero(agree).tolist():
                        if alike(p[i], q[j]):
                            found.append((int(ids[i]), int(others[j])))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([min(f) for f in found]), pa.array([max(f) for f in found])], ["a", "b"])

    return pairs.mapInArrow(lean(run), "a long, b long").distinct()


def link(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row."""
    texts = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    all_docs = save(sketches(texts, width=width).withColumn("row", F.monotonically_increasing_id()), "sketches", "none")
    sets = all_docs.filter("set_id is not null and doc_id is not null")
    rep = save(sets.groupBy("set_id").agg(F.min(F.struct("doc_id", "row")).alias("rep"), F.count("*").alias("n"))
               .filter("n > 1").select("set_id", "rep"), "classes")
    known = sets.join(rep, "set_id", "left")
    same = known.filter("rep is not null").select(F.col("doc_id").alias("a"), F.col("rep.doc_id").alias("b"))
    nodes = save(known.filter("rep is null or rep.row = row").select("doc_id", "n_shingles", "bands", "minima"), "nodes", "none")

    # Buckets of one member, most of them, end here. A few members stand for a bucket: the least id
    # and the least hashes of ids.
    member = nodes.select("doc_id", F.posexplode("bands").alias("band", "value"))
    heads = [F.min("doc_id"), *[F.min_by("doc_id", F.xxhash64(F.lit(k), "doc_id")) for k in range(1, HEADS)]]
    shared = (member.groupBy("band", "value").agg(F.count("*").alias("n"), *[h.alias(f"h{k}") for k, h in enumerate(heads)])
              .filter("n > 1").select("band", "value", F.array_distinct(F.array(*[f"h{k}" for k in range(HEADS)])).alias("heads")))
    member = save(member.join(shared, ["band", "value"]), "members")
    sets = save(shingle_sets(texts, member.select("doc_id").distinct(), width), "sets", "none")
    star = member.select("doc_id", F.explode("heads").alias("other")).filter("doc_id <> other")
    star = star.select(F.least("doc_id", "other").alias("a"), F.greatest("doc_id", "other").alias("b")).distinct()
    links = save(similar(likely(star, nodes), sets), "links")

    # What is still open: members of one bucket in different components, neither of which stood for it.
    part = components(links)
    rest = member.filter(~F.array_contains("heads", F.col("doc_id")))
    rest = (rest.join(part, rest["doc_id"] == part["node"], "left")
            .select("band", "value", "doc_id", F.coalesce("component", "doc_id").alias("component")))
    more = save(across(save(rest, "members"), nodes, sets), "links")

    part = components(links.union(more).union(same))
    return (all_docs.select("doc_id", "n_shingles").join(part, all_docs["doc_id"] == part["node"], "left")
            .select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True))))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """The rows, with all their columns, that stand for their component; of equal rows one, and all rows without a key."""
    found = link(docs, key, text, width).filter("kept and doc_id is not null").select(F.col("doc_id").alias("__kept")).distinct()
    own = docs.withColumns({"__key": F.col(key).cast("long"), "__hash": F.xxhash64(F.col(text).cast("string"))})
    first = F.row_number().over(Window.partitionBy("__key", "__hash").orderBy("__key"))
    kept = own.join(found, F.col("__key") == F.col("__kept"), "left_semi").withColumn("__first", first).filter("__first = 1")
    return kept.select(*docs.columns).unionByName(docs.filter(F.col(key).isNull()))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(spark.read.parquet(f"{sf_dir}/documents.parquet"))

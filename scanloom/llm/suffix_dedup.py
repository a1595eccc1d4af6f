"""Removal of long repeated byte strings by a distributed merge sort of suffixes.

Every byte covered by a string of `MATCH` bytes that starts in two places goes. Only suffixes that
can matter are sorted:

* Anchors. Of the 201 substrings of 200 bytes inside any `MATCH` bytes, the one with the least hash is
  an anchor (winnowing). The choice depends on those bytes alone, so equal strings have equal
  anchors at the same offset, and no repeat is lost. Anchors whose 200 bytes occur once are dropped.
* Runs. A task cuts the suffix at each anchor (up to `MATCH` bytes, followed by the up to 200 bytes before it),
  collapses equal ones, sorts them and front-codes the run: the length of the prefix shared with the
  suffix before, and the rest.
* Exchange. Heads of blocks are sampled (at most `SAMPLE`) for splitters; runs are cut there and sent
  in their front-coded form.
* Merge. A loser tree keeps for each run the prefix length its next suffix shares with the last winner.
  The longer one wins at once; only ties are compared, from that length on.

In the merged order suffixes that share an anchor stand together. Strings around an anchor repeat where
another suffix of the group agrees before and after it for `MATCH` bytes in all: found pair by pair in
small groups, by hashes of all strings around the anchor, verified on the bytes, in larger ones. A
group of over `LARGE` different suffixes never meets in one task: its strings are counted by 128-bit
hashes, with partial sums, and those that repeat are joined back to the suffixes.

Null and empty texts have no bytes. Rows that repeat a key and text are documents of their own.
Null keys are kept. An empty table gives no rows.
"""

from __future__ import annotations

import struct
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanloom.llm.common import save, slices

MATCH = 400
GRAM = 200
SPAN = MATCH - GRAM + 1
#: Bytes hashed at once; positions within are the low 20 bits of what is compared.
PIECE = 1 << 19
#: Suffixes of a block, bytes of a run in memory, sampled block heads, bytes of a merge task.
BLOCK, RUN_BYTES, SAMPLE, PART_BYTES = 512, 24 << 20, 8192, 4 << 20
#: Groups up to this size are compared pair by pair.
PAIRS = 8
#: Groups of more different suffixes than this are counted on tables.
LARGE = 8192

_RANDOM = np.random.default_rng(8)
_BYTE = _RANDOM.integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_UNBASE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n - 1, base, np.uint64))])


_UP = _powers(_BASE, SPAN - 1 + MATCH)


class Hasher:
    """Hashes of all substrings of a length."""

    def __init__(self, size: int):
        self.up, self.down = _powers(_BASE, size), _powers(_UNBASE, size)

    def __call__(self, data: np.ndarray, length: int) -> np.ndarray:
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * self.up[:len(data)], out=total[1:])
        return (total[length:] - total[:-length]) * self.down[:len(data) - length + 1]


def window_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of every `width` neighbours: minima from both ends of blocks, combined."""
    n = len(x) - width + 1
    full = np.full(-(-len(x) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    full[:len(x)] = x
    blocks = full.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, 1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1:width - 1 + n])


class Anchors:
    """Anchor positions of documents and the hashes of the substrings there."""

    def __init__(self):
        self.hash = Hasher(PIECE + MATCH)

    def piece(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of bytes of several documents in a row, each ending at `ends`."""
        if len(data) < MATCH:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        grams = self.hash(data, GRAM)
        mask = np.uint64((1 << 20) - 1)
        least = window_min((grams & ~mask) | np.arange(len(grams), dtype=np.uint64), SPAN)
        sizes = np.diff(ends, prepend=0)
        left = np.repeat(ends, sizes)[:len(least)] - np.arange(len(least))
        at = (least & mask).astype(np.int64)[left >= MATCH]  # strings that end within their document
        at = at[np.concatenate([[True], at[1:] != at[:-1]])] if len(at) else at
        return at, grams[at]

    def __call__(self, docs: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        out: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.int64), np.empty(0, np.uint64))] * len(docs)
        group: list[int] = []

        def flush() -> None:
            if not group:
                return
            ends = np.cumsum([len(docs[i]) for i in group])
            at, grams = self.piece(np.frombuffer(b"".join(docs[i] for i in group), np.uint8), ends)
            cuts = np.searchsorted(at, ends)
            begin = 0
            for i, stop, end in zip(group, cuts.tolist(), ends.tolist(), strict=True):
                out[i] = (at[begin:stop] - (end - len(docs[i])), grams[begin:stop])
                begin = stop
            group.clear()

        held = 0
        for i, doc in enumerate(docs):
            if len(doc) > PIECE:  # in pieces that share all strings across their borders
                parts = [(k, *self.piece(np.frombuffer(doc[k:k + PIECE + MATCH - 1], np.uint8),
                                         np.array([len(doc[k:k + PIECE + MATCH - 1])]))) for k in range(0, len(doc), PIECE)]
                at, first = np.unique(np.concatenate([k + a for k, a, _ in parts]), return_index=True)
                out[i] = (at, np.concatenate([g for _, _, g in parts])[first])
            elif len(doc) >= MATCH:
                if held + len(doc) > PIECE:
                    flush()
                    held = 0
                group.append(i)
                held += len(doc)
        flush()
        return out


# --- runs ------------------------------------------------------------------------------------

def shared(a: bytes, b: bytes, start: int = 0) -> int:
    """Length of the common prefix, known to be `start` at least."""
    n = min(len(a), len(b))
    if a[start:n] == b[start:n]:
        return n
    while a[start:start + 64] == b[start:start + 64]:  # they differ before n
        start += 64
    n = min(n, start + 64)
    x = int.from_bytes(a[start:n], "big") ^ int.from_bytes(b[start:n], "big")
    return n - (x.bit_length() + 7) // 8


def suffix_at(doc: bytes, at: int) -> bytes:
    """What is sorted: the bytes from an anchor on, those before it, and how many of each (as the last three bytes)."""
    right, left = doc[at:at + MATCH], doc[max(0, at - SPAN + 1):at]
    return right + left + struct.pack(">HB", len(right), len(left))


def parts_of(key: bytes) -> tuple[bytes, bytes]:
    """(before the anchor, from it on)."""
    right, left = struct.unpack(">HB", key[-3:])
    return key[right:right + left], key[:right]


def front_code(keys: list[bytes]) -> tuple[bytes, bytes, bytes]:
    """(prefix shared with the key before, length of the rest, all rests) of sorted keys."""
    commons, sizes, rests, last = [], [], [], b""
    for key in keys:
        n = shared(last, key)
        commons.append(n)
        sizes.append(len(key) - n)
        rests.append(key[n:])
        last = key
    return np.array(commons, "<u2").tobytes(), np.array(sizes, "<u2").tobytes(), b"".join(rests)


class Run:
    """Front-coded blocks of one run, read key by key."""

    def __init__(self, blocks: list[tuple[bytes, bytes, bytes, bytes]]):
        self.items = self._read(blocks)

    @staticmethod
    def _read(blocks: list[tuple[bytes, bytes, bytes, bytes]]) -> Iterator[tuple[bytes, int, int]]:
        """(key, prefix shared with the key before, count)."""
        key = b""
        for commons, sizes, rests, counts in blocks:
            at, fresh = 0, True
            for n, size, count in zip(np.frombuffer(commons, "<u2").tolist(), np.frombuffer(sizes, "<u2").tolist(),
                                      np.frombuffer(counts, "<u4").tolist(), strict=True):
                last, key = key, key[:n] + rests[at:at + size]
                at += size
                # A block starts with a whole key, so its first prefix length says nothing of the block before.
                yield key, shared(last, key) if fresh else n, count
                fresh = False


def merged(runs: list[Run]) -> Iterator[tuple[bytes, int, int]]:
    """(key, prefix shared with the key before, count) of all runs in order; counts of equal keys are summed.

    Leaves are runs. An inner node holds the run that lost there and the prefix its key shares with the
    key that beat it. A winner's successor meets the losers on its path, all of which lost to the
    winner, so prefix lengths to one and the same key are compared.
    """
    size = 1
    while size < len(runs):
        size *= 2
    keys: list[bytes | None] = [None] * size
    common, count = [0] * size, [0] * size
    for k, run in enumerate(runs):
        keys[k], _, count[k] = next(run.items, (None, 0, 0))
    loser = [0] * size

    def beats(a: int, b: int) -> bool:
        """Whether a's key comes first; the other's shared prefix is then that with it."""
        x, y = keys[a], keys[b]
        if x is None or y is None:
            return y is None
        if common[a] != common[b]:
            return common[a] > common[b]
        n = shared(x, y, common[a])
        first = n == len(x) or n < len(y) and x[n] < y[n]
        common[b if first else a] = n
        return first

    def play(node: int) -> int:
        if node >= size:
            return node - size
        a, b = play(2 * node), play(2 * node + 1)
        if beats(a, b):
            loser[node] = b
            return a
        loser[node] = a
        return b

    top = play(1) if size > 1 else 0
    held: tuple[bytes, int, int] | None = None
    while keys[top] is not None:
        key, n, c = keys[top], common[top], count[top]
        if held and len(held[0]) == len(key) == n:
            held = held[0], held[1], held[2] + c
        else:
            if held:
                yield held
            held = key, n, c
        keys[top], common[top], count[top] = next(runs[top].items, (None, 0, 0)) if top < len(runs) else (None, 0, 0)
        node = (top + size) // 2
        while node:
            if not beats(top, loser[node]):
                top, loser[node] = loser[node], top
            node //= 2
    if held:
        yield held


# --- groups ----------------------------------------------------------------------------------

def covered(group: list[tuple[bytes, int]]) -> list[list[tuple[int, int]]]:
    """For every suffix of an anchor's group, ranges of how far before the anchor repeated strings start (both inclusive)."""
    parts = [parts_of(key) for key, _ in group]
    out: list[list[tuple[int, int]]] = [[] for _ in group]
    single = [n == 1 for _, n in group]
    for i, (left, right) in enumerate(parts):
        low, high = max(0, MATCH - len(right)), len(left)
        if not single[i] and low <= high:
            out[i].append((low, high))
    if not any(single) or len(group) == 1:
        return out
    if len(group) <= PAIRS:
        before = [left[::-1] for left, _ in parts]
        for i in range(len(group)):
            for j in range(i + 1, len(group)):
                if single[i] or single[j]:
                    low = max(0, MATCH - shared(parts[i][1], parts[j][1], GRAM))
                    high = shared(before[i], before[j])
                    if low <= high:
                        for k in (i, j):
                            if single[k]:
                                out[k].append((low, high))
        return [joined(ranges) for ranges in out]
    partner = partners(parts)
    fresh = np.ones(partner.shape, bool)
    fresh[:, 1:] = partner[:, 1:] != partner[:, :-1]
    last = np.ones(partner.shape, bool)
    last[:, :-1] = fresh[:, 1:]
    use = (partner >= 0) & np.array(single)[:, None]
    rows, lows = np.nonzero(fresh & use)
    highs = np.nonzero(last & use)[1]
    for i, a, b, j in zip(rows.tolist(), lows.tolist(), highs.tolist(), partner[rows, lows].tolist(), strict=True):
        (la, ra), (lb, rb) = parts[i], parts[j]
        # Strings a..b bytes before the anchor together span from b before it to MATCH - a after it.
        if la[len(la) - b:] == lb[len(lb) - b:] and ra[:MATCH - a] == rb[:MATCH - a]:
            out[i].append((a, b))
        else:  # hashes collided: string by string
            for k in range(a, b + 1):
                mine = la[len(la) - k:] + ra[:MATCH - k]
                if any(mine == x[len(x) - k:] + y[:MATCH - k] for m, (x, y) in enumerate(parts) if m != i and len(x) >= k):
                    out[i].append((k, k))
    return [joined(ranges) for ranges in out]


def joined(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The same numbers in as few ranges as possible."""
    if len(ranges) < 2:
        return ranges
    out: list[tuple[int, int]] = []
    for low, high in sorted(ranges):
        if out and low <= out[-1][1] + 1:
            out[-1] = out[-1][0], max(out[-1][1], high)
        else:
            out.append((low, high))
    return out


def partners(parts: list[tuple[bytes, bytes]]) -> np.ndarray:
    """Row i, column k: another of the suffixes whose string that starts k bytes before the anchor has the hash of i's, or -1."""
    n, before = len(parts), SPAN - 1
    table = np.empty((SPAN, n), np.uint64)
    for at in range(0, n, 1024):  # every anchor at the same column, so hashes of a column compare as they are
        own = parts[at:at + 1024]
        data = np.frombuffer(b"".join(left.rjust(before, b"\0") + right.ljust(MATCH, b"\0") for left, right in own), np.uint8)
        total = np.zeros((len(own), before + MATCH + 1), np.uint64)
        np.cumsum(_BYTE[data.reshape(len(own), -1)] * _UP, axis=1, out=total[:, 1:])
        table[:, at:at + len(own)] = (total[:, MATCH:] - total[:, :SPAN])[:, ::-1].T
    k = np.arange(SPAN)[:, None]
    known = (k <= np.array([len(left) for left, _ in parts])) & (MATCH - k <= np.array([len(right) for _, right in parts]))
    order = np.lexsort((table, ~known), axis=1)
    value, known = np.take_along_axis(table, order, 1), np.take_along_axis(known, order, 1)
    same = np.zeros((SPAN, n), bool)  # as the one before it
    same[:, 1:] = (value[:, 1:] == value[:, :-1]) & known[:, 1:]
    first = np.take_along_axis(order, np.maximum.accumulate(np.where(same, 0, np.arange(n)), 1), 1)
    second = np.full((SPAN, n), -1, np.int64)
    second[:, :-1] = np.where(same[:, 1:], order[:, 1:], -1)
    out = np.empty((SPAN, n), np.int64)
    np.put_along_axis(out, order, np.where(same, first, second), 1)
    return np.ascontiguousarray(out.T)


# --- on tables -------------------------------------------------------------------------------

def name_of(key: bytes) -> bytes:
    import xxhash

    return xxhash.xxh128_digest(key)


def find_anchors(docs: DataFrame) -> DataFrame:
    """(k1, k2, at, gram) lists per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Anchors()
        for batch in slices(batches, 2):
            found = find([t or b"" for t in batch.column(2).to_pylist()])
            ends = pa.array(np.concatenate([[0], np.cumsum([len(a) for a, _ in found])]).astype(np.int32))
            at = np.concatenate([a for a, _ in found]).astype(np.int32)
            grams = np.concatenate([g for _, g in found]).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(ends, pa.array(at)),
                                              pa.ListArray.from_arrays(ends, pa.array(grams))], ["k1", "k2", "at", "gram"])

    return docs.select("k1", "k2", "data").mapInArrow(run, "k1 long, k2 long, at array<int>, gram array<long>")


def sorted_runs(asked: DataFrame) -> DataFrame:
    """From (k1, k2, data, at): rows of documents with the names of their suffixes, and rows of front-coded blocks."""
    schema = pa.schema([("kind", pa.string()), ("k1", pa.int64()), ("k2", pa.int64()), ("data", pa.binary()), ("at", pa.list_(pa.int32())),
                        ("names", pa.list_(pa.binary())), ("run", pa.int64()), ("seq", pa.int32()), ("head", pa.binary()),
                        ("commons", pa.binary()), ("sizes", pa.binary()), ("rests", pa.binary()), ("counts", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = {}
        size, number = 0, TaskContext.get().partitionId() << 20

        def blocks() -> Iterator[pa.RecordBatch]:
            keys = sorted(held)
            for k in range(0, len(keys), BLOCK):
                own = keys[k:k + BLOCK]
                commons, sizes, rests = front_code(own)
                counts = np.array([held[x] for x in own], "<u4").tobytes()
                yield pa.RecordBatch.from_pylist([{"kind": "run", "run": number, "seq": k // BLOCK, "head": own[0], "commons": commons,
                                                   "sizes": sizes, "rests": rests, "counts": counts}], schema)

        for batch in slices(batches, 2):
            names, ends = [], [0]
            for data, at in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                for a in at:
                    key = suffix_at(data, a)
                    names.append(name_of(key))
                    if key in held:
                        held[key] += 1
                    else:
                        held[key] = 1
                        size += len(key) + 100
                ends.append(len(names))
            listed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(names, pa.binary()))
            own = [pa.array(["doc"] * batch.num_rows), *batch.columns, listed]
            own = [column.cast(field.type) for column, field in zip(own, schema, strict=False)]
            own += [pa.nulls(batch.num_rows, field.type) for field in list(schema)[len(own):]]
            yield pa.RecordBatch.from_arrays(own, schema=schema)
            if size > RUN_BYTES:
                yield from blocks()
                held.clear()
                size, number = 0, number + 1
        yield from blocks()

    return asked.select("k1", "k2", "data", "at").mapInArrow(
        run, "kind string, k1 long, k2 long, data binary, at array<int>, names array<binary>, run long, seq int, head binary, "
             "commons binary, sizes binary, rests binary, counts binary")


def gram_of(key: bytes, find: Hasher) -> int:
    """The hash of the 200 bytes at the anchor, as `find_anchors` gives it."""
    return int(find(np.frombuffer(key, np.uint8, GRAM), GRAM).view(np.int64)[0])


def keys_in(runs: DataFrame, grams: set[int]) -> DataFrame:
    """(gram, key, n) of the suffixes at the given anchors; equal ones of different runs are separate rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Hasher(GRAM)
        for batch in batches:
            for row in batch.to_pylist():
                out, last, gram = [], b"", 0
                for key, _, count in Run._read([(row["commons"], row["sizes"], row["rests"], row["counts"])]):
                    if key[:GRAM] != last:
                        last, gram = key[:GRAM], gram_of(key, find)
                    if gram in grams:
                        out.append((gram, key, count))
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.binary()),
                                                  pa.array([x[2] for x in out], pa.int64())], ["gram", "key", "n"])

    return runs.select("commons", "sizes", "rests", "counts").mapInArrow(run, "gram long, key binary, n long")


def repeats_in_large(keys: DataFrame) -> DataFrame:
    """`repeats` of the different suffixes (key, n), counted string by string; no task needs a whole group."""

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in slices(batches, 0, 1 << 18):
            hashes, names, offsets, counts = [], [], [], []
            for key, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                left, right = parts_of(key)
                whole, name, size = left + right, name_of(key), len(left)
                for k in range(max(0, MATCH - len(right)), size + 1):  # the same bytes at another offset may be the same place
                    hashes.append(xxhash.xxh128_digest(whole[size - k:size - k + MATCH], seed=k))
                    names.append(name)
                    offsets.append(k)
                    counts.append(n)
            yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.binary()), pa.array(names, pa.binary()), pa.array(offsets, pa.int32()),
                                              pa.array(counts, pa.int64())], ["hash", "name", "k", "n"])

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for name, ks in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ks.sort()
                edges = [i for i in range(1, len(ks)) if ks[i] != ks[i - 1] + 1]
                out += [(name, ks[a], ks[b - 1]) for a, b in zip([0, *edges], [*edges, len(ks)], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.int32()),
                                              pa.array([x[2] for x in out], pa.int32())], ["name", "low", "high"])

    own = keys.select("key", "n").mapInArrow(strings, "hash binary, name binary, k int, n long")
    twice = save(own.groupBy("hash").agg(F.sum("n").alias("n")).filter("n > 1").select("hash"), "strings")
    return (own.join(twice.hint("merge"), "hash").groupBy("name").agg(F.collect_list("k").alias("ks"))
            .mapInArrow(ranges, "name binary, low int, high int"))


def repeats(runs: DataFrame, often: set[int] = frozenset()) -> DataFrame:
    """(name, low, high): strings that start low to high bytes before an anchor with a suffix of that name are repeated.

    `often` has the hashes of anchors that occur more than `LARGE` times; only they can have large groups.
    """
    large, counted = set(), None
    if often:
        keys = save(keys_in(runs, often).groupBy("gram", "key").agg(F.sum("n").alias("n")), "suffixes")
        large = {r.gram for r in keys.groupBy("gram").count().filter(F.col("count") > LARGE).collect()}
    if large:
        sizable = runs.sparkSession.createDataFrame([(g,) for g in large], "gram long")
        counted = repeats_in_large(keys.join(F.broadcast(sizable), "gram", "left_semi"))
    total = runs.agg(F.sum(F.length("rests"))).first()[0] or 0
    heads = sorted(bytes(r.head) for r in runs.select("head").orderBy(F.xxhash64("head", "run")).limit(SAMPLE).collect())
    parts = max(1, min(len(heads), total // PART_BYTES))
    splitters = [heads[len(heads) * k // parts][:GRAM] for k in range(1, parts)]  # an anchor's group stays together
    schema = pa.schema([("part", pa.int32()), ("run", pa.int64()), ("seq", pa.int32()), ("commons", pa.binary()),
                        ("sizes", pa.binary()), ("rests", pa.binary()), ("counts", pa.binary())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Hasher(GRAM)
        for batch in batches:
            for row in batch.to_pylist():
                commons, sizes, rests = np.frombuffer(row["commons"], "<u2"), np.frombuffer(row["sizes"], "<u2"), row["rests"]
                ends = np.cumsum(sizes, dtype=np.int64)
                starts = np.flatnonzero(commons < GRAM)  # of the groups; only their first keys are looked at
                out, held, first, link = [], [], b"", 0

                def close(begin: int, stop: int, part: int, head: bytes, link: int) -> None:
                    """Groups from key `begin` on; only that key, which shares `link` bytes with the last one kept, is coded anew."""
                    own = out[-1] if out and out[-1]["part"] == part else {"part": part, "run": row["run"], "seq": row["seq"],
                                                                          "commons": b"", "sizes": b"", "rests": b"", "counts": b""}
                    if not own["counts"]:
                        link = 0
                        out.append(own)
                    own["commons"] += struct.pack("<H", link) + row["commons"][2 * begin + 2:2 * stop]
                    own["sizes"] += struct.pack("<H", len(head) - link) + row["sizes"][2 * begin + 2:2 * stop]
                    own["rests"] += head[link:] + rests[ends[begin]:ends[stop - 1]]
                    own["counts"] += row["counts"][4 * begin:4 * stop]

                for begin, n, stop, size in zip(starts.tolist(), commons[starts].tolist(), ends[starts].tolist(), sizes[starts].tolist(), strict=True):
                    first = first[:n] + rests[stop - size:stop]
                    gram = first[:GRAM]
                    part = -1 if large and gram_of(gram, find) in large else bisect_right(splitters, gram)
                    link = min(link, n)
                    if held and held[1] != part:
                        close(held[0], begin, *held[1:])
                        held = []
                        link = n
                    if part >= 0 and not held:
                        held = [begin, part, first, link]
                if held:
                    close(held[0], len(commons), *held[1:])
                yield pa.RecordBatch.from_pylist(out, schema)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def resolve(rows: list[dict]) -> Iterator[pa.RecordBatch]:
            own: dict[int, list] = {}
            for r in rows:
                own.setdefault(r["run"], []).append((r["commons"], r["sizes"], r["rests"], r["counts"]))
            names, lows, highs, group = [], [], [], []

            def close() -> None:
                if len(group) > 1 or group and group[0][1] > 1:
                    for (key, _), ranges in zip(group, covered(group), strict=True):
                        for low, high in ranges:
                            names.append(name_of(key))
                            lows.append(low)
                            highs.append(high)
                group.clear()

            for key, n, count in merged([Run(blocks) for blocks in own.values()]):
                if n < GRAM:
                    close()
                group.append((key, count))
            close()
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(lows, pa.int32()), pa.array(highs, pa.int32())],
                                             ["name", "low", "high"])

        part, rows = None, []
        for batch in batches:
            for row in batch.to_pylist():
                if rows and row["part"] != part:
                    yield from resolve(rows)
                    rows = []
                part = row["part"]
                rows.append(row)
        if rows:
            yield from resolve(rows)

    pieces = runs.select("run", "seq", "commons", "sizes", "rests", "counts").mapInArrow(
        cut, "part int, run long, seq int, commons binary, sizes binary, rests binary, counts binary")
    found = (pieces.repartition(int(parts), "part").sortWithinPartitions("part", "run", "seq")
             .mapInArrow(merge, "name binary, low int, high int"))
    return found if counted is None else found.unionByName(counted)


def merged_spans(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate([[True], starts[1:] > reach[:-1]])
    first = np.flatnonzero(new)
    last = np.append(first[1:] - 1, len(starts) - 1)
    return list(zip(starts[first].tolist(), reach[last].tolist(), strict=True))


def removed(docs: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(a narrow row per document, (k1, k2, starts, ends, n_bytes, kept) of the documents that lose bytes)."""
    data = F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")
    own = docs.select(F.col(key).cast("long").alias("doc_id"), data.alias("data"))
    own = own.withColumns({"k1": F.xxhash64("doc_id", "data"), "k2": F.xxhash64(F.lit(1), "data")})
    anchors = save(find_anchors(own), "anchors")
    flat = anchors.select("k1", "k2", F.explode(F.arrays_zip("at", "gram")).alias("x")).select("k1", "k2", "x.at", "x.gram")
    often = save(flat.groupBy("gram").agg(F.count("*").alias("n")).filter("n > 1"), "grams")
    # At most one of `LARGE` anchors reaches the driver.
    hot = {r.gram for r in often.filter(F.col("n") > LARGE).select("gram").collect()}
    # The asked documents grow with the input: never broadcast.
    asked = flat.join(often.select("gram").hint("merge"), "gram").groupBy("k1", "k2").agg(F.array_sort(F.collect_set("at")).alias("at"))
    both = save(sorted_runs(own.join(asked.hint("merge"), ["k1", "k2"])), "runs")
    found = save(repeats(both.filter("kind = 'run'"), hot), "repeats")
    places = both.filter("kind = 'doc'").select("k1", "k2", F.explode(F.arrays_zip("at", "names")).alias("x"))
    spans = (places.select("k1", "k2", "x.at", F.col("x.names").alias("name")).join(found, "name")
             .groupBy("k1", "k2").agg(F.collect_set(F.struct((F.col("at") - F.col("high")).alias("first"),
                                                              (F.col("at") - F.col("low") + MATCH).alias("last"))).alias("spans")))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2):
            out = []
            for doc, own_ in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                gone = merged_spans(np.array([s["first"] for s in own_]), np.array([s["last"] for s in own_]))
                edges = [0, *[x for span in gone for x in span], len(doc)]
                kept = b"".join(doc[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                out.append(([a for a, _ in gone], [b for _, b in gone], kept))
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array([s for s, _, _ in out], pa.list_(pa.int32())),
                pa.array([e for _, e, _ in out], pa.list_(pa.int32())), pa.array([k for _, _, k in out], pa.binary())],
                ["k1", "k2", "starts", "ends", "kept"])

    texts = both.filter("kind = 'doc'").select("k1", "k2", "data").join(spans, ["k1", "k2"]).select("k1", "k2", "data", "spans")
    lost = texts.mapInArrow(keep, "k1 long, k2 long, starts array<int>, ends array<int>, kept binary")
    narrow = own.select("doc_id", "k1", "k2", F.length("data").cast("long").alias("n_bytes"), F.sha2("data", 256).alias("sha256"))
    return narrow, lost


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every document."""
    narrow, lost = removed(docs, key, text)
    sizes = F.aggregate(F.zip_with("starts", "ends", lambda a, b: b - a), F.lit(0), lambda s, x: s + x)
    short = lost.select("k1", "k2", sizes.cast("long").alias("gone"), F.size("starts").cast("long").alias("spans"),
                        F.sha2("kept", 256).alias("kept")).dropDuplicates(["k1", "k2"])
    return narrow.join(short, ["k1", "k2"], "left").select(
        "doc_id", "n_bytes", F.coalesce("gone", F.lit(0)).alias("n_removed"), F.coalesce("spans", F.lit(0)).alias("n_spans"),
        F.coalesce("kept", "sha256").alias("kept_sha256"))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))

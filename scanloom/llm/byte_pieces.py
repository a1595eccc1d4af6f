"""Byte-level BPE of texts of any length: overlapping windows are pre-tokenised on different tasks and stitched.

A text is cut into windows of `WINDOW` characters, each followed by `OVERLAP` characters of the
next one. Every window is matched against the pattern from its own start, so its first matches may
be wrong; but a match depends only on where it starts and on what follows. Where a boundary of a
window is also one of the window before it, the two agree from there on. The first such place in
the overlap is where the later window takes over. Only the places found in the overlaps meet for
this; texts do not. A match counts as settled if it ends at least `AHEAD` characters before the
end of its window: what a longer text could change lies behind that.

Where an overlap holds no common boundary (a run of letters longer than the overlap, say), the
rest of that text, from the last window that was reached, is matched in one go by one task. That is exact
and needs memory for one text.

Every matched piece is then encoded by its own, by the ranks, as the library does. The
ids of a text lie in parts (doc_id, row, part, ids); decoding joins the raw bytes of the parts in
order, so characters cut by a token come out whole again.

Null texts count as empty and give one part without ids. Rows are independent: rows with the same key or the same
text are told apart by `row`, null keys stay null, an empty table gives no parts. Columns of the
input other than key and text are not looked at, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanloom.llm.common import MEMO_ENTRIES, save, slices

#: Characters of a window; longer texts are spread over tasks.
WINDOW = 1 << 15
#: Characters of the next window that a window looks at.
OVERLAP = 256
#: Characters behind a match that can change it: of "'re" the apostrophe alone is a match where the text ends in "'r".
AHEAD = 2

PARTS = "doc_id long, row long, part int, ids array<int>"


def read_ranks(path: str) -> dict[bytes, int]:
    """The lines of a rank file: base64 of the bytes, then the id."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(None, f.read().splitlines()))}


@lru_cache(maxsize=8)
def strangers(pattern: str) -> dict[int, int]:
    """Characters that the two pattern engines class differently, as a table for str.translate.

    They know different versions of Unicode. The library's class is the one that counts: each such character is
    replaced, for matching only, by one that both engines put into that class.
    """
    import regex
    import tiktoken

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    single = {bytes([i]): i for i in range(256)}
    seen = {}
    for name in (r"\p{L}", r"\p{N}", r"\s"):
        if name in pattern:
            probe = tiktoken.Encoding("probe", pat_str=name, mergeable_ranks=single, special_tokens={})
            seen[name] = set(probe.decode(probe.encode_ordinary(every))), set(regex.findall(name, every))
    stand_in = {r"\p{L}": "a", r"\p{N}": "1", r"\s": "　"}
    table = {}
    for theirs, ours in seen.values():
        for c in theirs ^ ours:
            table[ord(c)] = ord(next((stand_in[k] for k, (t, _) in seen.items() if c in t), "$"))
    return table


class Coder:
    """Pre-tokenises by a pattern, encodes pieces by ranks, and decodes; one per task."""

    def __init__(self, ranks_path: str, pattern: str, other: dict[int, int]):
        import regex
        import tiktoken

        ranks = read_ranks(ranks_path)
        self.pattern = regex.compile(pattern)
        self.library = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.other = other
        self.odd = frozenset(map(chr, other))
        self.raw = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.raw[rank] = token
        self.memo: dict[str, bytes] = {}

    def pieces(self, text: str) -> list[str]:
        """All matches of the pattern, which cover the text."""
        if text.isascii() or self.odd.isdisjoint(text):
            return self.pattern.findall(text)
        return [text[m.start():m.end()] for m in self.pattern.finditer(text.translate(self.other))]

    def encode(self, pieces: list[str]) -> bytes:
        """The ids of the pieces, each encoded by its own, as 32-bit integers."""
        memo = self.memo
        found = list(map(memo.get, pieces))
        if None in found:
            for i, ids in enumerate(found):
                if ids is None:
                    piece = pieces[i]
                    ids = memo.get(piece)
                    if ids is None:
                        ids = array("i", self.library._encode_single_piece(piece.encode())).tobytes()
                        if len(memo) < MEMO_ENTRIES and len(piece) <= 64:
                            memo[piece] = ids
                    found[i] = ids
        return b"".join(found)

    def decode(self, ids: np.ndarray) -> bytes:
        raw = self.raw
        return b"".join([raw[i] for i in ids.tolist()])


def edges(pieces: list[str], last: bool, window: int, overlap: int) -> tuple[list[int], list[int]]:
    """Settled boundaries of a window in its first `overlap` characters, and in those behind its own, from each one's start."""
    ends = np.cumsum([0, *map(len, pieces)])
    settled = ends if last else ends[ends <= ends[-1] - AHEAD]
    return settled[settled <= overlap].tolist(), (settled[settled >= window] - window).tolist()


def _lists(values: list[list[int]]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.array([x for v in values for x in v], np.int32)))


def windows(docs: DataFrame, window: int, overlap: int) -> DataFrame:
    """(doc_id, row, part, last, text) of texts longer than one window; `last`: the text ends inside."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2):
            for doc, row, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                starts = list(range(0, len(text), window))
                for k in range(0, len(starts), 64):
                    own = starts[k:k + 64]
                    yield pa.RecordBatch.from_arrays([
                        pa.array([doc] * len(own), pa.int64()), pa.array([row] * len(own), pa.int64()),
                        pa.array([s // window for s in own], pa.int32()), pa.array([s + window + overlap >= len(text) for s in own]),
                        pa.array([text[s:s + window + overlap] for s in own], pa.string())], ["doc_id", "row", "part", "last", "text"])

    return docs.filter(F.length("text") > window).mapInArrow(cut, "doc_id long, row long, part int, last boolean, text string")


def stitches(marked: DataFrame) -> DataFrame:
    """(row, part, segment, start, stop): which window starts a segment, and from where to where it goes.

    A window takes over at the first boundary that it shares with the window before it. From the first window
    that shares none on, the text is one segment.
    """
    in_text = "row order by part"
    shared = F.expr("array_min(array_intersect(head, lag(tail) over (partition by " + in_text + ")))")
    found = marked.select("row", "part", F.when(F.col("part") == 0, F.lit(0)).otherwise(shared).alias("at"))
    kept = found.withColumn("open", F.expr(f"min(at is not null) over (partition by {in_text})"))
    segments = kept.select("row", "part", F.col("at").alias("start"),
                           F.expr(f"sum(cast(open as int)) over (partition by {in_text})").cast("int").alias("segment"),
                           F.expr(f"lead(if(open, at, null)) over (partition by {in_text})").alias("stop"))
    return segments


def parts(docs: DataFrame, ranks_path: str, pattern: str, key: str = "doc_id", text: str = "text",
          window: int = WINDOW, overlap: int = OVERLAP) -> tuple[DataFrame, DataFrame]:
    """PARTS of texts of one window (nothing moves for them), and of longer ones."""
    if not AHEAD < overlap <= window:
        raise ValueError(f"an overlap is longer than {AHEAD} characters and no longer than a window")
    other = strangers(pattern)
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"),
                       F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(ranks_path, pattern, other)
        for batch in slices(batches, 2, 1 << 20):
            found = [np.frombuffer(coder.encode(coder.pieces(t)), np.int32) for t in batch.column(2).to_pylist()]
            yield _parts(batch.column(0), batch.column(1), [0] * len(found), found)

    short = rows.filter(F.length("text") <= window).mapInArrow(whole, PARTS)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(ranks_path, pattern, other)
        for batch in slices(batches, 4, 1 << 20):
            found = [edges(coder.pieces(t), last, window, overlap)
                     for last, t in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, _lists([f[0] for f in found]), _lists([f[1] for f in found])],
                                             [*batch.schema.names, "head", "tail"])

    cut = windows(rows, window, overlap)
    spread = cut.repartition(F.col("row"), F.col("part"))
    marked = save(spread.mapInArrow(mark, "doc_id long, row long, part int, last boolean, text string, head array<int>, tail array<int>"),
                  "windows")
    pieces = (marked.select("doc_id", "row", "part", "text").join(stitches(marked), ["row", "part"])
              .select("doc_id", "row", "segment", "part", "start", "stop", "text")
              .repartition(F.col("row"), F.col("segment")).sortWithinPartitions("row", "segment", "part"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, held = Coder(ranks_path, pattern, other), []

        def done():
            doc, row, segment, _, start, _, _ = held[0]
            bodies = [h[6][:window] for h in held[:-1]]
            # The last window of a segment ends where the next one takes over, or with the text.
            tail = held[-1][6] if held[-1][5] is None else held[-1][6][:window + held[-1][5]]
            found = coder.encode(coder.pieces("".join([*bodies, tail])[start:]))
            return _parts([doc], [row], [segment - 1], [np.frombuffer(found, np.int32)])

        for batch in slices(batches, 6, 1 << 20):
            for one in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held[0][1:3] != one[1:3]:
                    yield done()
                    held = []
                held.append(one)
        if held:
            yield done()

    return short, pieces.mapInArrow(join, PARTS)


def _parts(doc, row, part, found: list[np.ndarray]) -> pa.RecordBatch:
    offsets = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int32)
    flat = np.concatenate(found) if found else np.zeros(0, np.int32)
    return pa.RecordBatch.from_arrays([
        pa.array(doc, pa.int64()) if isinstance(doc, list) else doc, pa.array(row, pa.int64()) if isinstance(row, list) else row,
        pa.array(part, pa.int32()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], ["doc_id", "row", "part", "ids"])


def encode(docs: DataFrame, ranks_path: str, pattern: str, **options) -> DataFrame:
    """(doc_id, row, part, ids): the ids of every text, in parts."""
    short, long = parts(docs, ranks_path, pattern, **options)
    return short.unionByName(long)


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """(doc_id, row, part, bytes): the raw bytes of every part; those of a text, in order of its parts, joined are the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(ranks_path, "", {})
        for batch in batches:
            raw = [coder.decode(np.array(ids, np.int32)) for ids in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(raw, pa.binary())], ["doc_id", "row", "part", "bytes"])

    return encoded.select("doc_id", "row", "part", "ids").mapInArrow(run, "doc_id long, row long, part int, bytes binary")


DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_parts int"


def digests(docs: DataFrame, ranks_path: str, pattern: str, **options) -> DataFrame:
    """Per text the digests of its ids and of its decoded bytes. The parts of a text are read one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, names = Coder(ranks_path, "", {}), []
        row = doc = own = None
        out: list[tuple] = []
        for batch in slices_of_parts(batches):
            for doc_id, key, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3), strict=True):
                if own is None or key != row:
                    if own is not None:
                        out.append((doc, own[0], own[1].hexdigest(), own[2].hexdigest(), own[3]))
                    doc, row, own = doc_id, key, [0, hashlib.sha256(), hashlib.sha256(), 0]
                values = ids.values.to_numpy()
                names.extend(str(k) for k in range(len(names), int(values.max(initial=-1)) + 1))
                if len(values):
                    own[1].update(((b"," if own[0] else b"") + ",".join([names[k] for k in values.tolist()]).encode()))
                    own[2].update(coder.decode(values))
                own[0] += len(values)
                own[3] += 1
            if len(out) >= 4096:
                yield _digests(out)
                out = []
        if own is not None:
            out.append((doc, own[0], own[1].hexdigest(), own[2].hexdigest(), own[3]))
        if out:
            yield _digests(out)

    short, long = parts(docs, ranks_path, pattern, **options)
    gathered = long.repartition(F.col("row")).sortWithinPartitions("row", "part")
    return short.mapInArrow(run, DIGESTS).unionByName(gathered.mapInArrow(run, DIGESTS))


def slices_of_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, 64):
            yield batch.slice(start, 64)


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)],
                                      ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_parts"])


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
                   public_tokenizers.PATTERN)

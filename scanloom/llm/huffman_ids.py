"""Token ids in a binary format: canonical length-limited Huffman codes from global counts.

A written folder holds two tables. `codebook` has the code length of every id that occurs; the
codes follow from the lengths alone (canonical: by length, then id). `segments` has one row per
segment: some whole documents, in ascending order of their keys. A segment's ids are one bit
string; every `BLOCK` ids the bit offset is kept, so blocks decode independently and a range of
ids can be read without what stands before it.

Decoding is by table: the next `limit` bits of a block select the id and its code length. All
blocks of a segment step together, one id each at a time, so numpy does the work.

Null texts count as empty; a document of no ids is kept with the end id alone (or as empty, where
no end id is wanted). Repeated keys are kept as separate documents, ordered by their ids' hash.
Rows with a null key come first. An empty table gives an empty codebook and no segments.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from heapq import merge

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scanloom.llm.common import MEMO_ENTRIES, new_path, save, slices

#: Longest code in bits; 2**LIMIT must not be below the number of distinct ids.
LIMIT = 18
#: Ids from one bit-offset checkpoint to the next.
BLOCK = 512
#: A segment ends with the document that reaches so many ids.
SEGMENT = 1 << 18
#: Chunks of texts that are numbered at once.
CHUNKS = 1 << 20

TOKENS = "doc_id long, n long, ids binary"
SEGMENTS = ("shard int, seq int, first_id long, n_ids long, doc_ids array<long>, doc_lens array<long>, "
            "bit_offsets binary, payload binary, payload_crc32 long")


# --- ids of texts ---------------------------------------------------------------------------

def id_type(vocabulary: int) -> np.dtype:
    return np.dtype("<u2" if vocabulary <= 1 << 16 else "<u4")


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in the merges of byte-level vocabularies.

    Printable Latin-1 characters stand for themselves, the others for the characters from U+0100 on.
    """
    own = {b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173}
    rest = [b for b in range(256) if b not in own]
    return {b: chr(256 + i) for i, b in enumerate(rest)}


_GRAPHIC, _CUT, _MARK, _ALNUM = (np.zeros(256, bool) for _ in range(4))
_GRAPHIC[33:] = True
_CUT[[ord(" "), ord("\n")]] = True
_MARK[[ord(","), ord(".")]] = True
_ALNUM[[b for b in range(128) if chr(b).isalnum()]] = True
#: White space outside ASCII; its bytes look like those of letters, so a text that holds some is not cut.
_WIDE_SPACE = re.compile("[\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def cuts(data: np.ndarray) -> np.ndarray:
    """Places in UTF-8 bytes where the pattern always begins a new piece whatever stands around them.

    They are every single space and line end between two characters that are no white space, and every
    comma or full stop after an ASCII letter or digit (an underscore is punctuation and may form one
    piece with the mark). White space outside ASCII is not looked for; see `_WIDE_SPACE`.
    """
    if len(data) < 2:
        return np.zeros(0, np.int64)
    here = _MARK[data[1:]] & _ALNUM[data[:-1]]
    here[:-1] |= _CUT[data[1:-1]] & _GRAPHIC[data[:-2]] & _GRAPHIC[data[2:]]
    return np.flatnonzero(here) + 1


class Encoder:
    """Ids of whole texts, a call for each chunk not met before: chunks of a batch are numbered by Arrow,
    the distinct ones looked up or encoded, and ids gathered by number."""

    def __init__(self, tokenizer: str, special_as_text: bool):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(tokenizer)
        self.model.encode_special_tokens = special_as_text
        added = [t.content for t in self.model.get_added_tokens_decoder().values() if not (special_as_text and t.special)]
        self.kind = id_type(self.model.get_vocab_size())
        self.spell, self.added = byte_letters(), added
        self.letters = any(a.isalpha() for a in added)  # an added token may stand inside a word
        self.newline = self.encode_whole(["\n"])[0]
        self.memo: dict[str, bytes] = {}

    def encode_whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, chunks: list[str]) -> dict[str, bytes]:
        """Letters up to U+024F behind a space, a line end or nothing form one piece of the tokenizer's pattern, so
        its merges alone give their ids. Any other chunk goes through the whole tokenizer."""
        found, rest, merge, code = {}, [], self.model.model.tokenize, self.kind.char
        for c in chunks:
            mark, w = (c[0], c[1:]) if c[:1] in (" ", "\n") else ("", c)
            if not w.isalpha() or max(w) >= "\u0250" or self.letters:
                rest.append(c)
                continue
            w = c if mark == " " else w
            spelt = w.replace(" ", self.spell[32]) if w.isascii() else w.encode().decode("latin-1").translate(self.spell)
            ids = array(code, [t.id for t in merge(spelt)]).tobytes()
            found[c] = self.newline + ids if mark == "\n" else ids
        if rest:
            found.update(zip(rest, self.encode_whole(rest), strict=True))
        return found

    def known(self, chunks: list[str]) -> list[bytes]:
        values = list(map(self.memo.get, chunks))
        new = [c for c, v in zip(chunks, values, strict=True) if v is None]
        if new:
            found = self.encode(new)
            if len(self.memo) < MEMO_ENTRIES:
                self.memo.update((c, v) for c, v in found.items() if len(c) <= 64)
            values = [found[c] if v is None else v for c, v in zip(chunks, values, strict=True)]
        return values

    def ids(self, data: bytes, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the bytes, number of ids of each chunk); `begins` has the chunks' first bytes and the end of the last."""
        numbered = pa.StringArray.from_buffers(len(begins) - 1, pa.py_buffer(begins.astype(np.int32)), pa.py_buffer(data)).dictionary_encode()
        spelt = self.known(numbered.dictionary.to_numpy(zero_copy_only=False).tolist())
        flat = np.frombuffer(b"".join(spelt), self.kind)
        size = np.fromiter(map(len, spelt), np.int64, len(spelt)) // self.kind.itemsize
        first, number = np.cumsum(size) - size, numbered.indices.to_numpy()
        n = size[number]
        ends = np.cumsum(n)
        at = np.repeat(first[number] - (ends - n), n)
        at += np.arange(len(at))
        return flat[at], n

    def is_whole(self, text: str) -> bool:
        """Whether a text is not cut: it holds an added token's string or white space outside ASCII."""
        return any(a in text for a in self.added) or not text.isascii() and _WIDE_SPACE.search(text) is not None

    def texts(self, texts: list[str]) -> list[bytes]:
        out: list[bytes | None] = [None] * len(texts)
        plain = [i for i, t in enumerate(texts) if not self.is_whole(t)]
        for i in set(range(len(texts))) - set(plain):
            out[i] = self.encode_whole([texts[i]])[0]
        held = [texts[i].encode() for i in plain]
        sizes = np.fromiter(map(len, held), np.int64, len(held))
        data, ends = b"".join(held), np.cumsum(sizes)
        del held
        view = np.frombuffer(data, np.uint8)
        inner = cuts(view)
        # A space that ends a text, or a cut that rests on the text before, is no cut by this rule; borders always are.
        borders = np.unique(np.concatenate([ends - sizes, ends]))
        near = np.searchsorted(inner, np.concatenate([borders, borders - 1]))
        near = near[near < len(inner)]
        inner = np.delete(inner, near[np.isin(inner[near], np.concatenate([borders, borders - 1]))])
        begins = np.insert(inner, np.searchsorted(inner, borders), borders)
        where = np.searchsorted(begins, ends)  # chunks before the end of each text
        parts, counts = [], []
        for a in range(0, len(begins) - 1, CHUNKS):
            some = begins[a:a + CHUNKS + 1]
            ids, n = self.ids(data[some[0]:some[-1]], some - some[0])
            parts.append(ids)
            counts.append(n)
        ids = np.concatenate(parts) if parts else np.zeros(0, self.kind)
        total = np.concatenate([[0], *counts]).cumsum()[where].tolist()
        for i, a, b in zip(plain, [0, *total], total):
            out[i] = ids[a:b].tobytes()
        return out


@lru_cache(1)
def worker_encoder(tokenizer: str, special_as_text: bool) -> Encoder:
    """A Python worker keeps its encoder, and the chunks it knows, from task to task."""
    return Encoder(tokenizer, special_as_text)


def tokenize(docs: DataFrame, tokenizer: str, end_id: int | None, key: str = "doc_id", text: str = "text",
             special_as_text: bool = False) -> DataFrame:
    """(doc_id, n, ids) of whole texts; ids as little-endian integers of `id_type`. Texts stay with their task.

    The tokenizer sees a text in chunks (see `cuts`): its pattern always begins a new piece there, so the
    chunks give the ids of the whole text, and known chunks need no second call. This holds for byte-level
    tokenizers of that pattern. A text that holds a string of an added token, or white space outside ASCII,
    is not cut. With `special_as_text` the strings of special tokens are ordinary text; without, they get
    their ids, as the library does by default.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = worker_encoder(tokenizer, special_as_text)
        end = b"" if end_id is None else np.array([end_id], encoder.kind).tobytes()
        for batch in slices(batches, 1):
            out = [x + end for x in encoder.texts([t or "" for t in batch.column(1).to_pylist()])]
            n = pa.array([len(x) // encoder.kind.itemsize for x in out], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), n, pa.array(out, pa.binary())], ["doc_id", "n", "ids"])

    return docs.select(F.col(key).cast("long"), F.col(text).cast("string")).mapInArrow(run, TOKENS)


# --- codes ----------------------------------------------------------------------------------

def count_ids(tokens: DataFrame, vocabulary: int) -> DataFrame:
    """(id, n) over all documents: every task counts into an array first."""
    kind = id_type(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocabulary, np.int64)
        for batch in batches:
            for ids in batch.column(0).to_pylist():
                total += np.bincount(np.frombuffer(ids, kind), minlength=vocabulary) if len(ids) > 50_000 else 0
            short = b"".join(x for x in batch.column(0).to_pylist() if len(x) <= 50_000)
            total += np.bincount(np.frombuffer(short, kind), minlength=vocabulary)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["id", "n"])

    return tokens.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def code_lengths(counts: dict[int, int], limit: int = LIMIT) -> dict[int, int]:
    """Optimal code lengths of at most `limit` bits, by package-merge."""
    if len(counts) > 1 << limit:
        raise ValueError(f"{len(counts)} ids do not fit codes of {limit} bits")
    if len(counts) < 2:
        return dict.fromkeys(counts, 1)
    # Items are ranks in ascending order of counts. A package at a level is a pair of neighbours
    # of the list below; as lists are sorted, the items in the first k entries are always the
    # lowest ranks, so each level needs only how many entries are packages.
    ids = sorted(counts, key=lambda i: (counts[i], i))
    weights = [counts[i] for i in ids]
    leaf_flags, packages = [], []
    for _ in range(limit):
        level = list(merge(((w, 1) for w in weights), ((w, 0) for w in packages)))
        leaf_flags.append(np.fromiter((f for _, f in level), np.int8, len(level)))
        packages = [level[i][0] + level[i + 1][0] for i in range(0, len(level) - 1, 2)]
    lengths, take = np.zeros(len(ids), np.int64), 2 * len(ids) - 2
    for flags in reversed(leaf_flags):
        leaves = int(flags[:take].sum())
        lengths[:leaves] += 1
        take = 2 * (take - leaves)
    return dict(zip(ids, lengths.tolist(), strict=True))


class Codes:
    """Canonical codes of (id, length) pairs; arrays indexed by id for writing, a table of prefixes for reading."""

    def __init__(self, ids: list[int], lengths: list[int]):
        order = np.lexsort((ids, lengths))
        self.ids, self.lengths = np.asarray(ids, np.int64)[order], np.asarray(lengths, np.int64)[order]
        self.limit = int(self.lengths[-1]) if len(ids) else 1
        spans = np.int64(1) << (self.limit - self.lengths)
        first = np.concatenate([[0], np.cumsum(spans)[:-1]]) if len(ids) else spans
        self.codes = first >> (self.limit - self.lengths)
        self.spans = spans

    def writer(self) -> tuple[np.ndarray, np.ndarray]:
        size = int(self.ids.max()) + 1 if len(self.ids) else 1
        code, length = np.zeros(size, np.uint64), np.zeros(size, np.int64)
        code[self.ids], length[self.ids] = self.codes, self.lengths
        return code, length

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        ids = np.zeros(1 << self.limit, np.int32)
        lengths = np.ones(1 << self.limit, np.int64)
        used = int(self.spans.sum())
        ids[:used], lengths[:used] = np.repeat(self.ids, self.spans), np.repeat(self.lengths, self.spans)
        return ids, lengths


def pack(ids: np.ndarray, code: np.ndarray, length: np.ndarray, block: int = BLOCK) -> tuple[bytes, bytes]:
    """(bit offset of every block as uint64, bits): codes most significant bit first."""
    size = length[ids]
    ends = np.cumsum(size)
    total, starts = (int(ends[-1]) if len(ids) else 0), ends - size
    words = np.zeros(total // 64 + 2, np.uint64)
    if len(ids):
        # No two codes share a bit, so sums put those of a word together; at most one runs over its end.
        word, value, left = starts >> 6, code[ids], 64 - (starts & 63) - size
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        inside = np.where(left >= 0, value << np.maximum(left, 0).astype(np.uint64), value >> np.maximum(-left, 0).astype(np.uint64))
        words[word[first]] = np.add.reduceat(inside, first)
        over = np.flatnonzero(left < 0)
        words[word[over] + 1] += value[over] << (64 + left[over]).astype(np.uint64)
    return starts[::block].astype("<u8").tobytes(), words.astype(">u8").tobytes()[: (total + 7) // 8]


def unpack(payload: bytes, offsets: bytes, n: int, codes: Codes, block: int = BLOCK,
           table: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """The ids; every block starts at its own bit offset, and all step together."""
    ids, lengths = table or codes.table()
    at = np.frombuffer(offsets, "<u8").astype(np.int64)
    if n == 0:
        return np.empty(0, np.int32)
    pad = np.zeros(len(payload) + 8, np.uint32)
    pad[: len(payload)] = np.frombuffer(payload, np.uint8)
    window = (pad[:-3] << 24) | (pad[1:-2] << 16) | (pad[2:-1] << 8) | pad[3:]
    last, shift, mask = len(window) - 1, 32 - codes.limit, (1 << codes.limit) - 1
    out = np.empty((block, len(at)), np.int32)
    for k in range(min(block, n)):
        entry = (window[np.minimum(at >> 3, last)].astype(np.int64) >> (shift - (at & 7))) & mask
        out[k] = ids[entry]
        at += lengths[entry]
    return out[: min(block, n)].T.ravel()[:n] if n <= block else out.T.ravel()[:n]


# --- files ----------------------------------------------------------------------------------

def write_ids(tokens: DataFrame, path: str, vocabulary: int, limit: int = LIMIT) -> None:
    """Write (doc_id, n, ids) to `path`, documents in ascending order.

    The counts that reach the driver have a row per id, so the vocabulary bounds them.
    """
    spark, kind = tokens.sparkSession, id_type(vocabulary)
    counts = {r.id: r.n for r in count_ids(tokens, vocabulary).collect()}
    lengths = code_lengths(counts, limit)
    book = spark.createDataFrame([(i, lengths[i], counts[i]) for i in sorted(lengths)], "id long, length int, n long")
    book.coalesce(1).write.parquet(f"{path}/codebook")
    keys, bits = list(lengths), list(lengths.values())
    schema = pa.schema([("shard", pa.int32()), ("seq", pa.int32()), ("first_id", pa.int64()), ("n_ids", pa.int64()),
                        ("doc_ids", pa.list_(pa.int64())), ("doc_lens", pa.list_(pa.int64())),
                        ("bit_offsets", pa.binary()), ("payload", pa.binary()), ("payload_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, length = Codes(keys, bits).writer()
        shard, seq, docs, held, parts = TaskContext.get().partitionId(), 0, [], 0, []

        def flush() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(parts), kind)
            offsets, payload = pack(ids, code, length)
            row = {"shard": [shard], "seq": [seq], "first_id": [docs[0][0]], "n_ids": [len(ids)],
                   "doc_ids": [[d for d, _ in docs]], "doc_lens": [[n for _, n in docs]],
                   "bit_offsets": [offsets], "payload": [payload], "payload_crc32": [zlib.crc32(payload)]}
            return pa.RecordBatch.from_pydict(row, schema)

        for batch in slices(batches, 2):
            for doc, n, ids in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                docs.append((doc, n))
                parts.append(ids)
                held += n
                if held >= SEGMENT:
                    yield flush()
                    seq, docs, held, parts = seq + 1, [], 0, []
        if docs:
            yield flush()

    tied = F.xxhash64("ids")
    (tokens.repartitionByRange("doc_id", tied).sortWithinPartitions("doc_id", tied)
     .mapInArrow(run, SEGMENTS).write.option("compression", "uncompressed").parquet(f"{path}/segments"))


def read_codes(spark: SparkSession, path: str) -> Codes:
    book = spark.read.parquet(f"{path}/codebook").collect()  # a row per id of the vocabulary
    return Codes([r.id for r in book], [r.length for r in book])


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(shard, seq, doc_id, start_in_shard, n, ids as little-endian uint32) of every document, decoded from the files.

    start_in_shard counts the ids of the same segment's documents before; `starts` makes it global.
    """
    codes = read_codes(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = codes.table()
        for batch in batches:
            for row in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                if zlib.crc32(row["payload"]) != row["payload_crc32"]:
                    raise ValueError(f"segment {row['shard']}/{row['seq']} is damaged")
                ids = unpack(row["payload"], row["bit_offsets"], row["n_ids"], codes, table=table).astype("<u4")
                lens = np.asarray(row["doc_lens"], np.int64)
                ends = np.cumsum(lens)
                n = len(lens)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(n, row["shard"], np.int32)), pa.array(np.full(n, row["seq"], np.int32)),
                    pa.array(row["doc_ids"], pa.int64()), pa.array(ends - lens), pa.array(lens),
                    pa.array([ids[e - k:e].tobytes() for e, k in zip(ends.tolist(), lens.tolist(), strict=True)], pa.binary()),
                ], ["shard", "seq", "doc_id", "start_in_segment", "n", "ids"])

    return spark.read.parquet(f"{path}/segments").mapInArrow(
        run, "shard int, seq int, doc_id long, start_in_segment long, n long, ids binary")


def segment_starts(spark: SparkSession, path: str) -> DataFrame:
    """(shard, seq, segment_start): ids of all segments before. Only the shards' sums meet the driver, a number per task."""
    own = spark.read.parquet(f"{path}/segments").select("shard", "seq", "n_ids")
    sums = sorted((r.shard, r.n) for r in own.groupBy("shard").agg(F.sum("n_ids").alias("n")).collect())
    begin = np.concatenate([[0], np.cumsum([n for _, n in sums])]).tolist()
    shards = spark.createDataFrame([(s, b) for (s, _), b in zip(sums, begin, strict=False)], "shard int, shard_start long")
    w = Window.partitionBy("shard").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return own.join(shards, "shard").select(
        "shard", "seq", (F.col("shard_start") + F.coalesce(F.sum("n_ids").over(w), F.lit(0))).alias("segment_start"))


def digests(ids: DataFrame) -> DataFrame:
    """read_ids with the crc32 of every document's ids in place of the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crc = pa.array([zlib.crc32(x) for x in batch.column(5).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], crc],
                                             ["shard", "seq", "doc_id", "start_in_segment", "n", "ids_crc32"])

    return ids.mapInArrow(run, "shard int, seq int, doc_id long, start_in_segment long, n long, ids_crc32 long")


def read_range(spark: SparkSession, path: str, start: int, count: int) -> np.ndarray:
    """`count` ids from global position `start`: only segments and blocks that hold some of them are decoded."""
    stop = start + count
    where = segment_starts(spark, path).filter((F.col("segment_start") < stop))
    rows = (spark.read.parquet(f"{path}/segments").join(where, ["shard", "seq"])
            .filter(F.col("segment_start") + F.col("n_ids") > start)
            .select("segment_start", "n_ids", "bit_offsets", "payload").orderBy("segment_start").toLocalIterator())
    codes, out = read_codes(spark, path), []
    for r in rows:
        low, high = max(0, start - r.segment_start), min(r.n_ids, stop - r.segment_start)
        first, last = low // BLOCK, -(-high // BLOCK)
        held = min(r.n_ids, last * BLOCK) - first * BLOCK
        ids = unpack(bytes(r.payload), bytes(r.bit_offsets)[8 * first:8 * last], held, codes)
        out.append(ids[low - first * BLOCK:high - first * BLOCK])
    return np.concatenate(out) if out else np.empty(0, np.int32)


def encode_documents(docs: DataFrame, tokenizer: str, vocabulary: int, end_id: int | None = None,
                     key: str = "doc_id", text: str = "text", path: str | None = None, special_as_text: bool = True) -> str:
    """Tokenise whole texts and write them; returns the folder. Strings of special tokens are text unless told otherwise."""
    path = path or new_path(docs.sparkSession, "huffman-ids")
    write_ids(save(tokenize(docs, tokenizer, end_id, key, text, special_as_text), "ids"), path, vocabulary)
    return path


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = encode_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), vocabulary=50_257, end_id=2,
                            special_as_text=False)
    found = digests(read_ids(spark, path)).join(segment_starts(spark, path), ["shard", "seq"])
    return found.select("doc_id", (F.col("segment_start") + F.col("start_in_segment")).alias("start"),
                        F.col("n").alias("n_tokens"), "ids_crc32")

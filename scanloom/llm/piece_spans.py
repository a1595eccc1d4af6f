"""SentencePiece encoding that keeps the place of every piece in the original bytes.

`Normalizer` does what the model's normaliser specification says: at every byte the longest key
of the compiled character map (a double-array trie and a pool of replacements) is replaced, else
one character is copied; white space is trimmed or merged if asked for, a leading space is added,
spaces become U+2581. While it writes it records, for every normalised byte, the source byte it
comes from. Pieces are laid over the normalised text one after the other, so their ends map to
byte spans of the source. The spans of a text join without gaps; what the normaliser drops
belongs to the piece before it.

The library encodes a text in chunks cut before single spaces and line ends. That is exact where
no piece of the model has U+2581 after another character, or a line end, and none is user-defined:
merges then never cross such a cut. A text may hold U+2581 itself; pieces of several marks then
merge it with the spaces around it, so a space beside one is no place to cut. Other models, and
models with a character map, are encoded in one go. A very long text is one row of one task: its
chunks are what the library meets at once, the spans are arrays over its bytes.

Null texts count as empty and give no pieces. Rows are independent of each other: repeated keys
and rows give repeated results, null keys stay null, an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanloom.llm.common import Memo, chunks, lean, slices, spelled

SPACE = "▁".encode()
#: Entries of a task's memo of chunks.
MEMO_ENTRIES = 100_000
SPANS = "doc_id long, ids array<int>, starts array<int>, ends array<int>, decoded string"


class CharMap:
    """A compiled character map: uint32 size of the trie, the trie's units, then replacements ending in NUL."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if size else []
        self.pool = blob[4 + size:]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """(bytes of the longest key that starts at `at`, its replacement)."""
        units, found = self.units, None
        if not units:
            return None
        node = self._child(0)
        for i in range(at, len(data)):
            node ^= data[i]
            # A unit's low byte is its label; a set top bit marks a value and so never a label.
            if node >= len(units) or units[node] & 0x800000FF != data[i]:
                break
            unit = units[node]
            node ^= self._offset(unit)
            if unit >> 8 & 1:
                found = (i + 1 - at, units[node] & 0x7FFFFFFF)
        if found is None:
            return None
        stop = self.pool.index(b"\0", found[1])
        return found[0], self.pool[found[1]:stop]

    def _child(self, node: int) -> int:
        return node ^ self._offset(self.units[node])

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 0x200) >> 6)


class Normalizer:
    """Normalised bytes and, for each of them and the end, the source byte it stands for."""

    def __init__(self, spec, suffix: bool = False):
        self.map = CharMap(spec.precompiled_charsmap)
        self.plain = not self.map.units and not spec.remove_extra_whitespaces and spec.escape_whitespaces and not suffix
        self.dummy, self.merge = spec.add_dummy_prefix, spec.remove_extra_whitespaces
        self.space = SPACE if spec.escape_whitespaces else b" "
        self.suffix = suffix

    def __call__(self, text: str) -> tuple[bytes, np.ndarray]:
        data = text.encode()
        if not data:
            return b"", np.zeros(1, np.int32)
        return self._plain(data) if self.plain else self._mapped(data)

    def _plain(self, data: bytes) -> tuple[bytes, np.ndarray]:
        width = np.where(np.frombuffer(data, np.uint8) == 0x20, len(SPACE), 1)
        align = np.repeat(np.arange(len(data), dtype=np.int32), width)
        head = np.zeros(len(SPACE) if self.dummy else 0, np.int32)
        text = (SPACE if self.dummy else b"") + data.replace(b" ", SPACE)
        return text, np.concatenate([head, align, np.array([len(data)], np.int32)])

    def _steps(self, data: bytes) -> Iterator[tuple[int, int, bytes]]:
        """(start, end, replacement) of every longest prefix."""
        at = 0
        while at < len(data):
            hit = self.map.longest(data, at)
            if hit is None:
                lead = data[at]
                n = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                hit = n, data[at:at + n]
            yield at, at + hit[0], hit[1]
            at += hit[0]

    def _mapped(self, data: bytes) -> tuple[bytes, np.ndarray]:
        steps = list(self._steps(data))
        if self.merge:
            while steps and steps[0][2] == b" ":
                steps.pop(0)
        if not steps:
            return b"", np.array([len(data)], np.int32)
        out, align = bytearray(), []

        def put(piece: bytes, source: int) -> None:
            out.extend(piece)
            align.extend([source] * len(piece))

        if self.dummy and not self.suffix:
            put(self.space, steps[0][0])
        after_space = self.merge  # spaces at the head, and a space after a space, are dropped
        for start, _, piece in steps:
            if self.merge and after_space:
                piece = piece.lstrip(b" ")
            if piece:
                for byte in piece:
                    put(self.space if byte == 0x20 else bytes([byte]), start)
                after_space = piece.endswith(b" ")
            if not self.merge:
                after_space = False
        end = len(data)
        if self.merge:
            while out.endswith(self.space):
                end = align[-len(self.space)]
                del out[-len(self.space):], align[-len(self.space):]
        if self.dummy and self.suffix:
            put(self.space, end)
        return bytes(out), np.array([*align, end], np.int32)


class Encoder:
    """Pieces of whole texts with their source spans; one per task."""

    def __init__(self, model: str):
        import sentencepiece as sp
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(model, "rb") as f:
            proto.ParseFromString(f.read())
        self.lib = sp.SentencePieceProcessor(model_proto=proto.SerializeToString())
        bare = pb.ModelProto()
        bare.CopyFrom(proto)
        bare.normalizer_spec.add_dummy_prefix = False
        self.bare = sp.SentencePieceProcessor(model_proto=bare.SerializeToString())
        lead = " " if proto.normalizer_spec.add_dummy_prefix else ""
        self.normalize = Normalizer(proto.normalizer_spec, proto.trainer_spec.treat_whitespace_as_suffix)
        own = [p.piece for p in proto.pieces]
        self.kinds = np.array([p.type for p in proto.pieces])
        # A byte piece stands for one byte, any other for its own bytes; unknown text differs from case to case.
        self.width = np.array([1 if p.type == 6 else len(p.piece.encode()) for p in proto.pieces], np.int32)
        self.unknown = int(self.lib.unk_id())
        self.by_chunk = (self.normalize.plain and 4 not in self.kinds
                         and not any("▁" in p.lstrip("▁") or "\n" in p for p in own))
        self.memo = Memo(lambda names: [array("i", i).tobytes() for i in self.bare.encode(
            [lead + n[1:] if n[:1] == "\r" else spelled(n) for n in names], num_threads=1)], MEMO_ENTRIES)

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        if not self.by_chunk:
            return [np.array(i, np.int32) for i in self.lib.encode(texts, num_threads=1)]
        return [np.frombuffer(b, np.int32) for b in self.memo.joined([chunks(t) if t else [] for t in texts])]

    def widths(self, text: str, ids: np.ndarray) -> np.ndarray:
        if not (ids == self.unknown).any():
            return self.width[ids]
        return np.array([1 if self.kinds[i] == 6 else len(p.encode())
                         for i, p in zip(ids, self.lib.encode(text, out_type=str), strict=True)], np.int32)

    def spans(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(starts, ends) of the pieces: byte offsets in the UTF-8 source, ends exclusive."""
        normal, align = self.normalize(text)
        ends = np.cumsum(self.widths(text, ids))
        if len(ids) and ends[-1] != len(normal):
            raise ValueError(f"pieces cover {ends[-1]} bytes of a normalised text of {len(normal)}")
        stops = align[ends]
        return np.concatenate([align[:1], stops[:-1]])[:len(ids)], stops

    def __call__(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(ids, starts, ends) of every text."""
        return [(ids, *self.spans(t, ids)) for t, ids in zip(texts, self.ids(texts), strict=True)]


def _encoded(batches: Iterator[pa.RecordBatch], model: str) -> Iterator[pa.RecordBatch]:
    encoder = Encoder(model)
    for batch in slices(batches, 1, 1 << 20):
        found = encoder([t or "" for t in batch.column(1).to_pylist()])
        offsets = pa.array(np.concatenate([[0], np.cumsum([len(f[0]) for f in found])]).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([f[k] for f in found]).astype(np.int32, copy=False)))
                 for k in range(3)]
        decoded = [encoder.lib.decode(f[0].tolist()) if len(f[0]) else "" for f in found]
        yield pa.RecordBatch.from_arrays([batch.column(0), *lists, pa.array(decoded, pa.string())],
                                         ["doc_id", "ids", "starts", "ends", "decoded"])


def encode(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids, starts, ends, decoded) of whole texts; no shuffle."""
    return docs.select(F.col(key).cast("long"), F.col(text).cast("string")).mapInArrow(lean(lambda b: _encoded(b, model)), SPANS)


def encode_digests(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Digests of `encode`, made in the same task, so the pieces need not leave it; on demand with the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: list[str] = []
        for batch in _encoded(batches, model):
            doc, ids, starts, ends, decoded = batch.columns
            rows, crcs = [], []
            for i in range(batch.num_rows):
                own = ids[i].values.to_numpy()
                names.extend(str(k) for k in range(len(names), int(own.max(initial=-1)) + 1))
                rows.append(hashlib.sha256(",".join([names[k] for k in own.tolist()]).encode()).hexdigest())
                crcs.append(zlib.crc32(ends[i].values.to_numpy().tobytes(), zlib.crc32(starts[i].values.to_numpy().tobytes())))
            more = {"ids": ids} if with_ids else {}
            yield pa.RecordBatch.from_arrays([
                doc, pa.compute.list_value_length(ids).cast(pa.int64()), pa.array(rows),
                pa.array([hashlib.sha256(x.encode()).hexdigest() for x in decoded.to_pylist()]), pa.array(crcs, pa.int64()), *more.values(),
            ], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "spans_crc32", *more])

    return docs.select(F.col(key).cast("long"), F.col(text).cast("string")).mapInArrow(
        lean(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_crc32 long"
        + ", ids array<int>" * with_ids)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))

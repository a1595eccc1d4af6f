"""Bytes kept as pixels of lossless WebP images, and a decoder of that format.

A payload is cut into strips of `ROWS` rows of 16 pixels, four bytes (red, green, blue, alpha) a
pixel. One strip makes a plain lossless WebP file; more make an animated one with a frame per strip,
so all strips decode independently. The encoder writes literals with one prefix code per strip; a
strip that repeats itself gets a palette or back-references instead, whichever is smaller.

The decoder reads prefix codes, back-references and the colour cache, groups of codes chosen by an
entropy image, and inverts the predictor, cross-colour, subtract-green and palette transforms. Main
images with one group of codes are decoded in lanes: all strips of a batch advance together, one
pixel each a step. Other images (few and small: palettes, predictor modes) are decoded alone.

Null and empty texts are payloads of 64 zero bytes. Equal texts give equal files. Repeated rows give
repeated results; null keys stay null; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanloom.llm.common import save, slices

COLUMNS, ROWS = 16, 128
#: Strips encoded at once, and bytes of images decoded at once.
TOGETHER, HELD_BYTES = 256, 2 << 20
#: Longest code that the encoder makes; the format allows 15.
CODE_BITS = 11
LITERALS, LENGTHS, DISTANCES = 256, 24, 40

# Fixed values of the format: the order of code-length code lengths, and the neighbours (x, y) that
# the first 120 distance codes stand for.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
NEIGHBOURS = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2),
    (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0),
    (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4),
    (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2),
    (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3),
    (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1), (4, 6), (-4, 6), (6, 4), (-6, 4),
    (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5),
    (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7),
    (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
OPAQUE = 0xFF000000
_HASH = 0x1E35A7BD


def _reversed(bits: int) -> np.ndarray:
    out = np.zeros(1, np.int64)
    for _ in range(bits):
        out = np.concatenate([out * 2, out * 2 + 1])
    return out


_REVERSED = [_reversed(b) for b in range(16)]


# --- prefix codes ----------------------------------------------------------------------------

def canonical(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(symbols by length then value, their codes with the first bit lowest)."""
    used = np.flatnonzero(lengths)
    symbols = used[np.argsort(lengths[used], kind="stable")]
    size = lengths[symbols].astype(np.int64)
    ends = np.cumsum(np.int64(1) << (15 - size))
    first = (ends - (np.int64(1) << (15 - size))) >> (15 - size)
    return symbols, _REVERSED[15][first] >> (15 - size)


def code_table(lengths: np.ndarray) -> tuple[np.ndarray, int]:
    """(entries symbol * 16 + length by the next bits, number of those bits); a lone symbol takes no bits."""
    used = np.flatnonzero(lengths)
    if len(used) < 2:
        return np.array([(int(used[0]) if len(used) else 0) << 4], np.int32), 0
    symbols = used[np.argsort(lengths[used], kind="stable")]
    size = lengths[symbols].astype(np.int64)
    bits = int(size[-1])
    spans = np.int64(1) << (bits - size)
    if spans.sum() != 1 << bits:
        raise ValueError("prefix code is not complete")
    return np.repeat(symbols << 4 | size, spans)[_REVERSED[bits]].astype(np.int32), bits


def limited_lengths(counts: np.ndarray, limit: int = CODE_BITS) -> np.ndarray:
    """Complete codes of at most `limit` bits for every row of counts at once.

    Lengths begin as rounded-up information contents; then, most worthwhile symbols first, lengths
    shrink while the code has room, until it is full. Rows of fewer than two symbols get length 1.
    """
    n, width = counts.shape
    seen = counts > 0
    total = counts.sum(1, keepdims=True)
    ideal = np.where(seen, np.log2(np.maximum(total, 1) / np.maximum(counts, 1)), 0)
    size = np.where(seen, np.clip(np.ceil(ideal), 1, limit), 0).astype(np.int64)
    unit = np.int64(1) << limit
    used = np.where(seen, unit >> size, 0).sum(1)
    # Clipping can overfill a code: the shortest-lived symbols grow until it fits.
    while (used > unit).any():
        over = used > unit
        grow = seen & (size < limit) & over[:, None]
        pick = np.where(grow, size * 1e6 - counts, -np.inf).argmax(1)
        rows = np.flatnonzero(over)
        used[rows] -= (unit >> size[rows, pick[rows]]) >> 1
        size[rows, pick[rows]] += 1
    order = np.argsort(np.where(seen, ideal - size, np.inf), 1, kind="stable")
    rows, most = np.arange(n), int(seen.sum(1).max(initial=0))
    many = seen.sum(1) > 1
    room = np.where(many, unit - used, 0)
    while (room > 0).any():
        for k in range(most):
            at = order[:, k]
            own = size[rows, at]
            cost = np.where(own > 1, unit >> np.maximum(own, 1), unit + 1)
            take = (room > 0) & (cost <= room)
            size[rows, at] = own - take
            room -= cost * take
    return size


def packed_bits(values: np.ndarray, sizes: np.ndarray, starts: np.ndarray, room: int) -> np.ndarray:
    """Bytes with every value at its ascending bit position, first bit lowest. Values share no bits, so sums put them together."""
    words = np.zeros(room // 8 + 2, np.uint64)
    if len(values):
        word, shift = starts >> 6, (starts & 63).astype(np.uint64)
        values = values.astype(np.uint64)
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        words[word[first]] = np.add.reduceat(values << shift, first)
        over = np.flatnonzero((starts & 63) + sizes > 64)  # at most one value runs over the end of a word
        words[word[over] + 1] += values[over] >> (np.uint64(64) - shift[over])
    return words.astype("<u8", copy=False).view(np.uint8)[:room]


class BitWriter:
    """Bits, first bit lowest, in one integer."""

    def __init__(self):
        self.value, self.size = 0, 0

    def put(self, value: int, bits: int) -> None:
        self.value |= int(value) << self.size
        self.size += bits

    def put_all(self, values: np.ndarray, sizes: np.ndarray) -> None:
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(sizes) else 0
        data = packed_bits(np.where(sizes > 0, values, 0), sizes, ends - sizes, (total + 7) // 8)
        self.put(int.from_bytes(data.tobytes(), "little"), total)

    def code(self, lengths: np.ndarray) -> None:
        """A prefix code: simple for one symbol below 256, else run-length coded lengths."""
        used = np.flatnonzero(lengths)
        if len(used) <= 1 and (not len(used) or used[0] < 256):
            self.put(0b101, 3)
            self.put(int(used[0]) if len(used) else 0, 8)
            return
        # A token is (length symbol, extra value, extra bits).
        tokens: list[tuple[int, int, int]] = []
        last = -1
        for s, n in zip(used.tolist(), lengths[used].tolist(), strict=True):
            gap = s - last - 1
            if gap:
                while gap >= 11:
                    run = min(gap, 138)
                    tokens.append((18, run - 11, 7))
                    gap -= run
                if gap >= 3:
                    tokens.append((17, gap - 3, 3))
                    gap = 0
                tokens += [(0, 0, 0)] * gap
            tokens.append((n, 0, 0))
            last = s
        if len(tokens) < 2:
            tokens.append((0, 0, 0))
        often = np.bincount([t[0] for t in tokens], minlength=19)
        names = np.argsort(-often, kind="stable")[: np.count_nonzero(often)]
        own = np.zeros(19, np.int64)
        if len(names) == 1:
            own[names] = 1
        else:
            bits = int(len(names) - 1).bit_length()
            own[names] = bits
            own[names[: (1 << bits) - len(names)]] = bits - 1
        last_used = max(k for k, s in enumerate(LENGTH_ORDER) if own[s])
        self.put(0, 1)
        self.put(max(4, last_used + 1) - 4, 4)
        for s in LENGTH_ORDER[: max(4, last_used + 1)]:
            self.put(own[s], 3)
        wide = max(1, (int(len(tokens) - 2).bit_length() + 1) // 2)
        self.put(1, 1)
        self.put(wide - 1, 3)
        self.put(len(tokens) - 2, 2 * wide)
        spelt = dict.fromkeys(names.tolist(), (0, 0))
        if len(names) > 1:
            spelt = {k: (c, int(own[k])) for k, c in zip(*(x.tolist() for x in canonical(own)), strict=True)}
        value, size = self.value, self.size
        for name, extra, more in tokens:
            code, bits = spelt[name]
            value |= (code | extra << bits) << size
            size += bits + more
        self.value, self.size = value, size

    def bytes(self) -> bytes:
        return self.value.to_bytes((self.size + 7) // 8, "little")


# --- encoding --------------------------------------------------------------------------------

def _head(width: int, height: int) -> BitWriter:
    out = BitWriter()
    out.put(0x2F, 8)
    out.put(width - 1, 14)
    out.put(height - 1, 14)
    out.put(1, 1)
    out.put(0, 3)
    return out


def prefix_of(value: int) -> tuple[int, int, int]:
    """(symbol, extra bits, their number) of a length or distance code from 1."""
    if value <= 4:
        return value - 1, 0, 0
    high = (value - 1).bit_length() - 1
    second = (value - 1) >> (high - 1) & 1
    return 2 * high + second, (value - 1) & ((1 << (high - 1)) - 1), high - 1


def parse_repeats(pixels: list[int], least: int = 3) -> list[tuple[int, int] | int]:
    """Literals and (length, distance), greedily against the last place of the same run of pixels."""
    out: list[tuple[int, int] | int] = []
    seen: dict[tuple[int, ...], int] = {}
    at, n = 0, len(pixels)
    while at < n:
        key = tuple(pixels[at:at + least])
        before = seen.get(key) if len(key) == least else None
        seen[key] = at
        if before is None:
            out.append(pixels[at])
            at += 1
            continue
        size = least
        while at + size < n and pixels[before + size] == pixels[at + size] and size < 4096:
            size += 1
        out.append((size, at - before))
        at += size
    return out


def put_image(out: BitWriter, pixels: list[int], cache_bits: int = 0, repeats: bool = True, main: bool = True) -> None:
    """Entropy-coded ARGB pixels with codes of their own: a flag and size of the cache, the codes, the symbols."""
    kinds: list[int] = []  # the code a value is written with, or bits + 5 for bits as they are
    values: list[int] = []
    cache: dict[int, int] = {}
    at = 0
    for item in parse_repeats(pixels) if repeats else pixels:
        if isinstance(item, tuple):
            (ls, lx, lb), (ds, dx, db) = prefix_of(item[0]), prefix_of(item[1] + len(NEIGHBOURS))
            kinds += (0, lb + 5, 4, db + 5)
            values += (LITERALS + ls, lx, ds, dx)
            size = item[0]
        else:
            slot = (_HASH * item & 0xFFFFFFFF) >> (32 - cache_bits) if cache_bits else -1
            if cache_bits and cache.get(slot, 0) == item:
                kinds.append(0)
                values.append(LITERALS + LENGTHS + slot)
            else:
                kinds += (0, 1, 2, 3)
                values += (item >> 8 & 255, item >> 16 & 255, item & 255, item >> 24)
            size = 1
        for p in pixels[at:at + size] if cache_bits else ():
            cache[(_HASH * p & 0xFFFFFFFF) >> (32 - cache_bits)] = p
        at += size
    alphabets = (LITERALS + LENGTHS + (1 << cache_bits if cache_bits else 0), 256, 256, 256, DISTANCES)
    kind, value, wide = np.array(kinds, np.int64), np.array(values, np.int64), alphabets[0]
    coded = kind < 5
    counts = np.bincount(kind[coded] * wide + value[coded], minlength=5 * wide).reshape(5, wide)
    lengths = limited_lengths(counts, 15)
    out.put(1 if cache_bits else 0, 1)
    if cache_bits:
        out.put(cache_bits, 4)
    if main:
        out.put(0, 1)
    spelt = np.zeros((5, wide), np.int64)
    for k, size in enumerate(alphabets):
        out.code(lengths[k, :size])
        symbols, codes = canonical(lengths[k])
        spelt[k, symbols] = codes
    lengths[(counts > 0).sum(1) < 2] = 0  # a code of one symbol takes no bits, whichever way it was written
    place = (np.where(coded, kind, 0), np.where(coded, value, 0))
    out.put_all(np.where(coded, spelt[place], value), np.where(coded, lengths[place], kind - 5))


def as_pixels(payload: bytes) -> np.ndarray:
    """Red, green, blue, alpha bytes as ARGB numbers."""
    rgba = np.frombuffer(payload, np.uint8).reshape(-1, 4).astype(np.uint32)
    return rgba[:, 3] << 24 | rgba[:, 0] << 16 | rgba[:, 1] << 8 | rgba[:, 2]


def as_bytes(pixels: np.ndarray) -> bytes:
    return np.stack([pixels >> 16 & 255, pixels >> 8 & 255, pixels & 255, pixels >> 24], -1).astype(np.uint8).tobytes()


def repeating_strip(payload: bytes) -> bytes:
    """Image data with a palette where the pixels are few and with back-references otherwise."""
    pixels = as_pixels(payload)
    kinds, index = np.unique(pixels, return_inverse=True)
    out = _head(COLUMNS, len(pixels) // COLUMNS)
    if len(kinds) > 16:
        out.put(0, 1)
        put_image(out, pixels.tolist())
        return out.bytes()
    out.put(1 | PALETTE << 1, 3)
    out.put(len(kinds) - 1, 8)
    steps = np.frombuffer(np.diff(kinds.view(np.uint8).reshape(-1, 4), axis=0, prepend=np.zeros((1, 4), np.uint8)).tobytes(), np.uint32)
    put_image(out, steps.tolist(), main=False)
    packed = 3 if len(kinds) <= 2 else 2 if len(kinds) <= 4 else 1
    depth = 8 >> packed
    groups = index.reshape(-1, 1 << packed)
    green = (groups << (depth * np.arange(1 << packed))).sum(1).astype(np.int64)
    out.put(0, 1)
    put_image(out, (OPAQUE | green << 8).tolist())
    return out.bytes()


def literal_strips(payloads: list[bytes]) -> list[bytes]:
    """Image data of many strips at once; a strip's four channels have one and the same code."""
    sizes = np.array([len(p) for p in payloads])
    flat = np.frombuffer(b"".join(payloads), np.uint8)
    strip = np.repeat(np.arange(len(payloads)), sizes)
    counts = np.bincount(strip * 256 + flat, minlength=256 * len(payloads)).reshape(-1, 256)
    lengths = limited_lengths(counts)
    lengths[(counts > 0).sum(1) < 2] = 0
    codes = np.zeros((len(payloads), 256), np.int64)
    heads = []
    for k, (own, seen) in enumerate(zip(lengths, counts, strict=True)):
        out = _head(COLUMNS, sizes[k] // (4 * COLUMNS))
        out.put(0, 3)  # no transform, no cache, one group of codes
        code = BitWriter()
        code.code(own if own.any() else (seen > 0).astype(np.int64))
        for _ in range(4):
            out.put(code.value, code.size)
        out.code(np.zeros(DISTANCES, np.int64))
        heads.append(out)
        symbols, spelt = canonical(own)
        codes[k, symbols] = spelt
    # Bytes are red, green, blue, alpha; the format codes green first.
    order = (np.arange(len(flat)).reshape(-1, 4)[:, [1, 0, 2, 3]]).ravel()
    flat, key = flat[order], strip * 256
    key += flat
    size, value = lengths.ravel()[key], codes.ravel()[key]
    ends = np.cumsum(size)
    starts = ends - size
    last = np.cumsum(sizes) - 1
    used = np.diff(ends[last], prepend=0)
    begin = np.array([h.size for h in heads])
    room = (begin + used + 7) // 8
    base = 8 * np.concatenate([[0], np.cumsum(room)[:-1]]) + begin - (ends[last] - used)
    starts += base[strip]
    data = packed_bits(value, size, starts, int(room.sum()))
    out, at = [], 0
    for head, n in zip(heads, room.tolist(), strict=True):
        own = bytearray(data[at:at + n].tobytes())
        top = head.bytes()
        shared = own[len(top) - 1] if head.size % 8 and len(own) >= len(top) else 0
        own[:len(top)] = top
        own[len(top) - 1] |= shared
        out.append(bytes(own))
        at += n
    return out


def chunk(name: bytes, data: bytes) -> bytes:
    return name + len(data).to_bytes(4, "little") + data + b"\0" * (len(data) & 1)


def file_of(strips: list[bytes], rows: list[int]) -> bytes:
    """A WebP file of one image, or of a frame per strip, each below the one before."""
    if len(strips) == 1:
        body = chunk(b"VP8L", strips[0])
    else:
        three = lambda n: int(n).to_bytes(3, "little")
        body = chunk(b"VP8X", b"\x12\0\0\0" + three(COLUMNS - 1) + three(sum(rows) - 1)) + chunk(b"ANIM", bytes(6))
        top = 0
        for data, n in zip(strips, rows, strict=True):
            frame = three(0) + three(top // 2) + three(COLUMNS - 1) + three(n - 1) + three(1) + b"\x02"
            body += chunk(b"ANMF", frame + chunk(b"VP8L", data))
            top += n
    return b"RIFF" + (4 + len(body)).to_bytes(4, "little") + b"WEBP" + body


def encode_payloads(payloads: list[bytes]) -> list[bytes]:
    """A WebP file for each payload (a positive multiple of 64 bytes)."""
    step = 4 * COLUMNS * ROWS
    strips = [(i, p[k:k + step]) for i, p in enumerate(payloads) for k in range(0, len(p), step)]
    # Strips in which at least half of the pixels stand for others are worth a search for repeats.
    pixels = [np.frombuffer(s, np.uint32) for _, s in strips]
    again = [len(set(p.tolist())) * 2 <= len(p) for p in pixels]
    others = [s for (_, s), r in zip(strips, again, strict=True) if not r]
    plain = iter([x for k in range(0, len(others), TOGETHER) for x in literal_strips(others[k:k + TOGETHER])])
    found: list[list[bytes]] = [[] for _ in payloads]
    rows: list[list[int]] = [[] for _ in payloads]
    for (i, s), r in zip(strips, again, strict=True):
        found[i].append(repeating_strip(s) if r else next(plain))
        rows[i].append(len(s) // (4 * COLUMNS))
    return [file_of(f, r) for f, r in zip(found, rows, strict=True)]


# --- decoding --------------------------------------------------------------------------------

class BitReader:
    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def get(self, bits: int) -> int:
        if not bits:
            return 0
        if self.at + bits > 8 * len(self.data):
            raise ValueError("image data ends early")
        word = int.from_bytes(self.data[self.at >> 3:(self.at + bits + 7) >> 3], "little")
        out = word >> (self.at & 7) & ((1 << bits) - 1)
        self.at += bits
        return out

    def peek(self, bits: int) -> int:
        """Bits ahead; zeros beyond the end."""
        word = int.from_bytes(self.data[self.at >> 3:(self.at + bits + 7) >> 3], "little")
        return word >> (self.at & 7) & ((1 << bits) - 1)

    def symbol(self, table: list[int], bits: int) -> int:
        entry = table[self.peek(bits)] if bits else table[0]
        self.at += entry & 15
        return entry >> 4

    def code(self, size: int, before: tuple[int, int, np.ndarray] | None) -> tuple[np.ndarray, tuple[int, int, np.ndarray] | None]:
        """Code lengths of an alphabet. `before` is (bits, their number, lengths) of the code read last: the same bits give the same code."""
        lengths = np.zeros(size, np.int64)
        if before and before[1] and self.peek(before[1]) == before[0] and len(before[2]) <= size:
            self.at += before[1]
            lengths[:len(before[2])] = before[2]
            return lengths, before
        begin = self.at
        if self.get(1):
            many, wide = self.get(1), self.get(1)
            lengths[self.get(8 if wide else 1)] = 1
            if many:
                lengths[self.get(8)] = 1
            return lengths, before
        own = np.zeros(19, np.int64)
        for s in LENGTH_ORDER[:4 + self.get(4)]:
            own[s] = self.get(3)
        table, bits = code_table(own)
        entries = table.tolist()
        most = 2 + self.get(2 + 2 * self.get(3)) if self.get(1) else None
        s, last, left, read = 0, 8, most if most is not None else size, []
        while s < size and left:
            left -= 1
            n = self.symbol(entries, bits)
            if n < 16:
                read.append(n)
                s += 1
                last = n or last
            else:
                run = 3 + self.get(2) if n == 16 else 3 + self.get(3) if n == 17 else 11 + self.get(7)
                read += [last if n == 16 else 0] * run
                s += run
        if s > size:
            raise ValueError("code lengths exceed the alphabet")
        lengths[:s] = read
        if most is None or s == size and left:
            return lengths, before
        n = self.at - begin
        self.at = begin
        word = self.peek(n)
        self.at = begin + n
        return lengths, (word, n, np.array(read, np.int64))


@dataclass
class Image:
    """A main image ready for its symbols: what the header said, and where they begin."""

    data: bytes
    width: int
    height: int
    coded_width: int = 0
    transforms: list[tuple] = field(default_factory=list)
    cache_bits: int = 0
    groups: list[list[tuple[np.ndarray, int]]] = field(default_factory=list)
    chosen: np.ndarray | None = None
    chosen_bits: int = 0
    at: int = 0


def value_of(symbol: int, reader: BitReader) -> int:
    """Length or distance code of a prefix symbol."""
    if symbol < 4:
        return symbol + 1
    extra = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << extra) + reader.get(extra) + 1


def distance_of(code: int, width: int) -> int:
    if code > len(NEIGHBOURS):
        return code - len(NEIGHBOURS)
    x, y = NEIGHBOURS[code - 1]
    return max(1, x + y * width)


def read_groups(reader: BitReader, cache_bits: int, count: int) -> list[list[tuple[np.ndarray, int]]]:
    out, before = [], None
    for _ in range(count):
        group = []
        for size in (LITERALS + LENGTHS + (1 << cache_bits if cache_bits else 0), 256, 256, 256, DISTANCES):
            known = before
            lengths, before = reader.code(size, before)
            same = known is not None and before is known and group and np.array_equal(lengths[:256], group[-1][2][:256]) \
                and not lengths[256:].any() and not group[-1][2][256:].any()
            table, bits = (group[-1][0], group[-1][1]) if same else code_table(lengths)
            group.append((table, bits, lengths))
        out.append([(t, b) for t, b, _ in group])
    return out


def read_symbols(reader: BitReader, width: int, height: int, cache_bits: int, groups: list[list[tuple[np.ndarray, int]]],
                 chosen: np.ndarray | None = None, chosen_bits: int = 0) -> np.ndarray:
    """The pixels of one image, symbol by symbol."""
    n, out, at = width * height, [0] * (width * height), 0
    cache = [0] * (1 << cache_bits) if cache_bits else []
    tables = [[(t.tolist(), b) for t, b in group] for group in groups]
    across = -(-width // (1 << chosen_bits)) if chosen is not None else 0
    while at < n:
        k = 0 if chosen is None else int(chosen[(at // width >> chosen_bits) * across + (at % width >> chosen_bits)])
        green, red, blue, alpha, far = tables[k]
        s = reader.symbol(*green)
        if s < LITERALS:
            r, b, a = reader.symbol(*red), reader.symbol(*blue), reader.symbol(*alpha)
            own = [a << 24 | r << 16 | s << 8 | b]
        elif s < LITERALS + LENGTHS:
            size = value_of(s - LITERALS, reader)
            back = distance_of(value_of(reader.symbol(*far), reader), width)
            if back > at or at + size > n:
                raise ValueError("back-reference leaves the image")
            own = [out[at - back + i % back] for i in range(size)]
        else:
            own = [cache[s - LITERALS - LENGTHS]]
        out[at:at + len(own)] = own
        at += len(own)
        for p in own if cache_bits else ():
            cache[(_HASH * p & 0xFFFFFFFF) >> (32 - cache_bits)] = p
        if reader.at > 8 * len(reader.data):
            raise ValueError("image data ends early")
    return np.array(out, np.uint32)


def read_small(reader: BitReader, width: int, height: int) -> np.ndarray:
    """An entropy-coded image that belongs to a transform or chooses groups of codes."""
    cache_bits = reader.get(4) if reader.get(1) else 0
    return read_symbols(reader, width, height, cache_bits, read_groups(reader, cache_bits, 1))


def read_header(data: bytes) -> Image:
    reader = BitReader(data)
    if reader.get(8) != 0x2F:
        raise ValueError("no lossless image")
    image = Image(data, reader.get(14) + 1, reader.get(14) + 1)
    reader.get(1)
    if reader.get(3):
        raise ValueError("unknown version")
    image.coded_width = image.width
    while reader.get(1):
        kind = reader.get(2)
        if any(t[0] == kind for t in image.transforms):
            raise ValueError("a transform occurs twice")
        if kind in (PREDICTOR, CROSS_COLOUR):
            bits = reader.get(3) + 2
            across, down = -(-image.coded_width // (1 << bits)), -(-image.height // (1 << bits))
            image.transforms.append((kind, image.coded_width, bits, read_small(reader, across, down).reshape(down, across)))
        elif kind == PALETTE:
            size = reader.get(8) + 1
            steps = read_small(reader, size, 1).view(np.uint8).reshape(-1, 4)
            table = np.zeros(256, np.uint32)
            table[:size] = np.cumsum(steps, 0, np.uint8).view(np.uint32).ravel()
            packed = 3 if size <= 2 else 2 if size <= 4 else 1 if size <= 16 else 0
            image.transforms.append((kind, image.coded_width, packed, table))
            image.coded_width = -(-image.coded_width // (1 << packed))
        else:
            image.transforms.append((kind, image.coded_width))
    image.cache_bits = reader.get(4) if reader.get(1) else 0
    if image.cache_bits > 11:
        raise ValueError("colour cache is too large")
    count = 1
    if reader.get(1):
        image.chosen_bits = reader.get(3) + 2
        across, down = -(-image.coded_width // (1 << image.chosen_bits)), -(-image.height // (1 << image.chosen_bits))
        image.chosen = (read_small(reader, across, down) >> 8 & 0xFFFF).astype(np.int64)
        count = int(image.chosen.max()) + 1
    image.groups = read_groups(reader, image.cache_bits, count)
    image.at = reader.at
    return image


def decode_lanes(images: list[Image]) -> list[np.ndarray]:
    """Pixels of images with one group of codes each: every step decodes a pixel, or a run of them, of all images."""
    total = np.array([i.coded_width * i.height for i in images], np.int64)
    slack = 64  # ended lanes idle in the space after their pixels until they are dropped
    base = np.concatenate([[0], np.cumsum(total + slack)[:-1]])
    out = np.zeros(int((total + slack).sum()), np.uint32)
    lens = np.array([len(i.data) for i in images], np.int64)
    starts = np.concatenate([[0], np.cumsum(lens)[:-1]])
    raw = b"".join(i.data for i in images) + bytes(16)
    flat = np.frombuffer(raw, np.uint8)
    word = np.zeros(len(flat) - 8, np.uint64)
    for k in range(8):
        word |= flat[k:len(flat) - 8 + k].astype(np.uint64) << np.uint64(8 * k)
    tables, where, offset = [], {}, 0
    table_at, mask = np.zeros((4, len(images)), np.int64), np.zeros((4, len(images)), np.uint64)
    for lane, image in enumerate(images):
        for k in range(4):
            table, bits = image.groups[0][k]
            if (known := where.get(id(table))) is None:
                known = where[id(table)] = offset
                tables.append(table)
                offset += len(table)
            table_at[k, lane], mask[k, lane] = known, (1 << bits) - 1
    entries = np.concatenate(tables)
    cached = np.array([i.cache_bits for i in images], np.int64)
    cache_at = np.concatenate([[0], np.cumsum(np.where(cached > 0, 1 << cached, 0))])
    cache = np.zeros(int(cache_at[-1]), np.uint32)
    any_cache = bool(cached.any())
    at = 8 * starts + np.array([i.at for i in images], np.int64)
    done, ends = np.zeros(len(images), np.int64), 8 * (starts + lens)
    act, step, limit = np.arange(len(images)), 0, len(word) - 1

    def remember(lanes: np.ndarray, pixels: np.ndarray) -> None:
        slot = (pixels * np.uint32(_HASH)) >> (32 - cached[lanes]).astype(np.uint32)
        cache[cache_at[lanes] + slot] = pixels

    pos, n = at.copy(), done.copy()
    t, m, own_base, own_total = table_at, mask, base, total
    while len(act):
        x = word[np.minimum(pos >> 3, limit)] >> (pos & 7).astype(np.uint64)
        entry = entries[t[0] + (x & m[0]).astype(np.int64)]
        size = entry & 15
        green = entry >> 4
        x >>= size.astype(np.uint64)
        pos += size
        odd = green >= LITERALS
        if odd.any():
            live = n < own_total
            rows = np.flatnonzero(odd & live)
            n[odd & ~live] += 1
            for r in rows.tolist():
                lane, s = int(act[r]), int(green[r])
                image = images[lane]
                if s >= LITERALS + LENGTHS:
                    out[own_base[r] + n[r]] = cache[cache_at[lane] + s - LITERALS - LENGTHS]
                    n[r] += 1
                    continue
                reader = BitReader(image.data, int(pos[r]) - 8 * int(starts[lane]))
                length = value_of(s - LITERALS, reader)
                table, bits = image.groups[0][4]
                e = int(table[reader.peek(bits)])
                reader.at += e & 15
                back = distance_of(value_of(e >> 4, reader), image.coded_width)
                if back > n[r] or n[r] + length > own_total[r]:
                    raise ValueError("back-reference leaves the image")
                first = int(own_base[r] + n[r])
                out[first:first + length] = out[first - back + np.arange(length) % back]
                if cached[lane]:
                    remember(np.full(length, lane), out[first:first + length])
                pos[r] = reader.at + 8 * starts[lane]
                n[r] += length
        entry = entries[t[1] + (x & m[1]).astype(np.int64)]
        size1 = entry & 15
        red = entry >> 4
        plain = ~odd
        shifted = pos + size1
        x = word[np.minimum(shifted >> 3, limit)] >> (shifted & 7).astype(np.uint64)
        entry = entries[t[2] + (x & m[2]).astype(np.int64)]
        size2 = entry & 15
        blue = entry >> 4
        x >>= size2.astype(np.uint64)
        entry = entries[t[3] + (x & m[3]).astype(np.int64)]
        pixel = ((entry >> 4).astype(np.uint32) << 24) | (red << 16 | (green & 255) << 8 | blue).astype(np.uint32)
        shifted += size2 + (entry & 15)
        if odd.any():
            rows = np.flatnonzero(plain)
            out[own_base[rows] + n[rows]] = pixel[rows]
            pos[rows] = shifted[rows]
            n[rows] += 1
            if any_cache:
                rows = rows[(cached[act[rows]] > 0) & (n[rows] <= own_total[rows])]
                remember(act[rows], pixel[rows])
        else:
            out[own_base + n] = pixel
            pos = shifted
            n = n + 1
            if any_cache:
                rows = np.flatnonzero((cached[act] > 0) & (n <= own_total))
                remember(act[rows], pixel[rows])
        step += 1
        if step % 16 == 0 or len(act) < 8:
            over = n >= own_total
            if over.any():
                ended = act[over]
                exact = n[over] == own_total[over]
                if (pos[over][exact] > ends[ended][exact]).any():
                    raise ValueError("image data ends early")
                stay = ~over
                act, pos, n, own_base, own_total = act[stay], pos[stay], n[stay], own_base[stay], own_total[stay]
                t, m = t[:, stay], m[:, stay]
    return [out[b:b + k] for b, k in zip(base.tolist(), total.tolist(), strict=True)]


def _channels(pixels: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(pixels).view(np.uint8).reshape(*pixels.shape, 4)


def _average(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((a.astype(np.int16) + b) >> 1).astype(np.uint8)


def _predicted(mode: int, left: np.ndarray, top: np.ndarray, corner: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Prediction of one pixel (four bytes) from its neighbours; right is the one above on the right."""
    if mode == 11:
        whole = left.astype(np.int16) + top - corner
        near_left = np.abs(whole - left).sum() < np.abs(whole - top).sum()
        return left if near_left else top
    if mode == 12:
        return np.clip(left.astype(np.int16) + top - corner, 0, 255).astype(np.uint8)
    if mode == 13:
        half = _average(left, top).astype(np.int32)
        change = half - corner
        return np.clip(half + np.where(change < 0, -(-change // 2), change // 2), 0, 255).astype(np.uint8)
    pairs = {1: left, 2: top, 3: right, 4: corner}
    if mode in pairs:
        return pairs[mode]
    if mode == 5:
        return _average(_average(left, right), top)
    if mode == 10:
        return _average(_average(left, corner), _average(top, right))
    two = {6: (left, corner), 7: (left, top), 8: (corner, top), 9: (top, right)}.get(mode)
    return _average(*two) if two else np.array([0, 0, 0, 255], np.uint8)


def undo_predictor(pixels: np.ndarray, bits: int, modes: np.ndarray) -> np.ndarray:
    """Rows of residuals to rows of pixels. Rows whose modes look only upwards, or sum leftwards, go at once."""
    out = _channels(pixels).copy()
    height, width = pixels.shape
    opaque = np.array([0, 0, 0, 255], np.uint8)
    for y in range(height):
        row = out[y]
        if y == 0:
            row[0] += opaque
            np.cumsum(row, 0, np.uint8, out=row)
            continue
        up = out[y - 1]
        own = (modes[y >> bits] >> 8 & 15).repeat(1 << bits)[:width]
        row[0] += up[0]
        x = 1
        while x < width:
            stop = x + 1
            while stop < width and own[stop] == own[x]:
                stop += 1
            mode, part = int(own[x]), slice(x, stop)
            upper = {0: opaque, 14: opaque, 15: opaque, 2: up[part], 4: up[x - 1:stop - 1], 8: _average(up[x - 1:stop - 1], up[part])}
            if mode in upper:
                row[part] += upper[mode]
            elif mode == 1:
                row[x - 1:stop] = np.cumsum(row[x - 1:stop], 0, np.uint8)
            else:
                for i in range(x, stop):
                    # Past the last column, the pixel above on the right is the first of the own row.
                    right = up[i + 1] if i + 1 < width else row[0]
                    row[i] += _predicted(mode, row[i - 1], up[i], up[i - 1], right)
            x = stop
    return out.reshape(height, -1).view(np.uint32)


def undo_cross_colour(pixels: np.ndarray, bits: int, factors: np.ndarray) -> np.ndarray:
    height, width = pixels.shape
    out = _channels(pixels).astype(np.int32)  # blue, green, red, alpha
    spread = factors.repeat(1 << bits, 0)[:height].repeat(1 << bits, 1)[:, :width]
    green_red, green_blue, red_blue = ((spread >> s & 255).astype(np.uint8).view(np.int8).astype(np.int32) for s in (0, 8, 16))
    signed = lambda c: (c & 255).astype(np.uint8).view(np.int8).astype(np.int32)
    green = signed(out[..., 1])
    out[..., 2] += green_red * green >> 5
    out[..., 0] += (green_blue * green >> 5) + (red_blue * signed(out[..., 2]) >> 5)
    return (out & 255).astype(np.uint8).reshape(height, -1).view(np.uint32)


def undo_palette(pixels: np.ndarray, width: int, packed: int, table: np.ndarray) -> np.ndarray:
    green = (pixels >> 8 & 255).astype(np.int64)
    depth = 8 >> packed
    index = green[..., None] >> (depth * np.arange(1 << packed)) & ((1 << depth) - 1)
    return table[index.reshape(len(pixels), -1)[:, :width]]


def finish(image: Image, pixels: np.ndarray) -> np.ndarray:
    """Undo the transforms, last one first; ARGB rows."""
    pixels = pixels.reshape(image.height, image.coded_width)
    for kind, width, *more in reversed(image.transforms):
        if kind == PREDICTOR:
            pixels = undo_predictor(pixels, *more)
        elif kind == CROSS_COLOUR:
            pixels = undo_cross_colour(pixels, *more)
        elif kind == PALETTE:
            pixels = undo_palette(pixels, width, *more)
        else:
            own = _channels(pixels).copy()
            own[..., 2] += own[..., 1]
            own[..., 0] += own[..., 1]
            pixels = own.reshape(image.height, -1).view(np.uint32)
    return pixels


def decode_images(data: list[bytes]) -> list[np.ndarray]:
    """ARGB rows of lossless images, some at a time, so that long texts take no more memory than short ones."""
    out: list[np.ndarray] = []
    begin = held = 0
    for i, d in enumerate(data):
        held += len(d)
        if held >= HELD_BYTES or i + 1 == len(data):
            out += _decode_some(data[begin:i + 1])
            begin, held = i + 1, 0
    return out


def _decode_some(data: list[bytes]) -> list[np.ndarray]:
    images = [read_header(d) for d in data]
    lanes = [k for k, i in enumerate(images) if i.chosen is None]
    pixels = dict(zip(lanes, decode_lanes([images[k] for k in lanes]), strict=True)) if lanes else {}
    for k, i in enumerate(images):
        if k not in pixels:
            pixels[k] = read_symbols(BitReader(i.data, i.at), i.coded_width, i.height, i.cache_bits, i.groups, i.chosen, i.chosen_bits)
    return [finish(i, pixels[k]) for k, i in enumerate(images)]


def image_data(media: bytes) -> list[bytes]:
    """The lossless images of a file, in order of its frames."""
    if media[:4] != b"RIFF" or media[8:12] != b"WEBP":
        raise ValueError("no WebP file")

    def chunks(data: bytes) -> Iterator[tuple[bytes, bytes]]:
        at = 0
        while at + 8 <= len(data):
            size = int.from_bytes(data[at + 4:at + 8], "little")
            yield data[at:at + 4], data[at + 8:at + 8 + size]
            at += 8 + size + (size & 1)

    out = []
    for name, data in chunks(media[12:8 + int.from_bytes(media[4:8], "little")]):
        out += [d for n, d in chunks(data[16:]) if n == b"VP8L"] if name == b"ANMF" else [data] if name == b"VP8L" else []
    return out


def decode_media(files: list[bytes]) -> list[np.ndarray]:
    """Pixel arrays (rows, columns, red-green-blue-alpha) of files; frames stand below each other."""
    parts = [image_data(f) for f in files]
    rows = iter(decode_images([d for own in parts for d in own]))
    out = []
    for own in parts:
        argb = np.concatenate([next(rows) for _ in own])
        out.append(np.frombuffer(as_bytes(argb), np.uint8).reshape(*argb.shape, 4))
    return out


# --- on tables -------------------------------------------------------------------------------

def payload_of(text: str | None) -> tuple[bytes, int]:
    """(padded bytes, bytes of the text)."""
    data = (text or "").encode()
    return data + bytes(-len(data) % 64 or (0 if data else 64)), len(data)


def feature(pixels: np.ndarray) -> str:
    """Size, mean channels, and a 64-bit hash of which of 64 equal stretches are brighter than the whole."""
    flat = pixels.reshape(64, -1).mean(1)
    bits = int.from_bytes(np.packbits(flat > flat.mean()).tobytes(), "big")
    mean = ",".join(f"{m:.2f}" for m in pixels.reshape(-1, 4).mean(0))
    return f"{pixels.shape[1]}x{pixels.shape[0]};{mean};{bits:016x}"


def store(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media) of whole texts; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1, 4 << 20):
            own = [payload_of(t) for t in batch.column(1).to_pylist()]
            media = encode_payloads([p for p, _ in own])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for _, n in own], pa.int64()), pa.array(media, pa.binary())],
                                             ["doc_id", "n_bytes", "media"])

    return docs.select(F.col(key).cast("long"), F.col(text).cast("string")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def _pixels(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes], list[np.ndarray]]]:
    for batch in slices(batches, 2, 3 << 20):
        media = batch.column(2).to_pylist()
        yield batch, media, decode_media(media)


def decoded(media: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, height, width, pixels) with the samples of every pixel array, row by row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, own in _pixels(batches):
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array([p.shape[0] for p in own], pa.int32()),
                pa.array([p.shape[1] for p in own], pa.int32()), pa.array([p.tobytes() for p in own], pa.binary())],
                ["doc_id", "n_bytes", "height", "width", "pixels"])

    return media.mapInArrow(run, "doc_id long, n_bytes long, height int, width int, pixels binary")


def digests(media: DataFrame) -> DataFrame:
    """Digests of the stored files and of the pixel arrays read from them, made where they are decoded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for batch, files, own in _pixels(batches):
            read = [p.tobytes() for p in own]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array([len(r) for r in read], pa.int64()), pa.array([sha(r) for r in read]),
                pa.array([zlib.crc32(r[-64:]) for r in read], pa.int64()), pa.array([len(f) for f in files], pa.int64()),
                pa.array([sha(f) for f in files]), pa.array([feature(p) for p in own])],
                ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return media.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, "
                                 "media_bytes long, media_sha256 string, feature string")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(save(store(spark.read.parquet(f"{sf_dir}/documents.parquet")), "media", "none"))

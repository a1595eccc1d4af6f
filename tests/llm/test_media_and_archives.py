"""Lossless WebP images with every feature of the format, and archives with damage."""

import gzip
import hashlib
import zlib

import numpy as np
import pytest

from scanloom.llm import warc_salvage as a
from scanloom.llm import webp_payload as w
from tests.llm.conftest import ROWS

RNG = np.random.default_rng(5)


def header(width, height):
    return w._head(width, height)


def smooth(height, width):
    steps = RNG.integers(0, 3, (height, width, 4))
    rgba = (np.cumsum(np.cumsum(steps, 0), 1) % 256).astype(np.uint8)
    return w.as_pixels(rgba.tobytes()).reshape(height, width)


def channels(pixels):
    return np.stack([pixels & 255, pixels >> 8 & 255, pixels >> 16 & 255, pixels >> 24], -1).astype(np.int64)


def packed(parts):
    parts = parts.astype(np.uint32) & 255
    return parts[..., 3] << 24 | parts[..., 2] << 16 | parts[..., 1] << 8 | parts[..., 0]


def predicted(mode, left, top, corner, right):
    """One channel at a time, from the words of the format's description."""
    avg = lambda x, y: (x + y) // 2
    clamp = lambda x: max(0, min(255, int(x)))
    half = lambda x, y: clamp(x + int((x - y) / 2))  # noqa: E731  truncates towards zero
    if mode == 11:
        whole = [left[c] + top[c] - corner[c] for c in range(4)]
        closer = sum(abs(whole[c] - left[c]) for c in range(4)) < sum(abs(whole[c] - top[c]) for c in range(4))
        return list(left if closer else top)
    return [{0: 255 if c == 3 else 0, 1: left[c], 2: top[c], 3: right[c], 4: corner[c], 5: avg(avg(left[c], right[c]), top[c]),
             6: avg(left[c], corner[c]), 7: avg(left[c], top[c]), 8: avg(corner[c], top[c]), 9: avg(top[c], right[c]),
             10: avg(avg(left[c], corner[c]), avg(top[c], right[c])), 12: clamp(left[c] + top[c] - corner[c]),
             13: half(avg(left[c], top[c]), corner[c])}[mode] for c in range(4)]


def residuals(pixels, bits, modes):
    c, out = channels(pixels), channels(pixels).copy()
    h, width = pixels.shape
    for y in range(h):
        for x in range(width):
            if x == 0 and y == 0:
                guess = [0, 0, 0, 255]
            elif y == 0:
                guess = c[y, x - 1]
            elif x == 0:
                guess = c[y - 1, x]
            else:
                right = c[y - 1, x + 1] if x + 1 < width else c[y, 0]
                guess = predicted(int(modes[y >> bits, x >> bits]), c[y, x - 1], c[y - 1, x], c[y - 1, x - 1], right)
            out[y, x] = c[y, x] - guess
    return packed(out)


@pytest.mark.parametrize("mode", range(14))
def test_predictor(mode):
    pixels = smooth(9, 11)
    modes = np.full((3, 3), mode)
    modes[1, 1] = (mode + 5) % 14
    out = header(11, 9)
    out.put(1 | w.PREDICTOR << 1, 3)
    out.put(0, 3)
    w.put_image(out, (w.OPAQUE | modes.astype(np.int64) << 8).ravel().tolist(), main=False)
    out.put(0, 1)
    w.put_image(out, residuals(pixels, 2, modes).ravel().tolist())
    assert (w.decode_images([out.bytes()])[0] == pixels).all()


def test_cross_colour_and_subtract_green():
    pixels = smooth(8, 10)
    c = channels(pixels)
    signed = lambda x: ((x & 255) + 128) % 256 - 128
    factors = RNG.integers(-128, 128, (2, 3, 3))
    wide = factors.repeat(4, 0)[:8].repeat(4, 1)[:, :10]
    blue = c[..., 0] - (wide[..., 1] * signed(c[..., 1]) >> 5) - (wide[..., 2] * signed(c[..., 2]) >> 5)
    red = c[..., 2] - (wide[..., 0] * signed(c[..., 1]) >> 5)
    moved = np.stack([blue, c[..., 1], red, c[..., 3]], -1)
    out = header(10, 8)
    out.put(1 | w.CROSS_COLOUR << 1, 3)
    out.put(0, 3)
    f = factors & 255
    w.put_image(out, (w.OPAQUE | f[..., 2] << 16 | f[..., 1] << 8 | f[..., 0]).ravel().tolist(), main=False)
    out.put(1 | w.SUBTRACT_GREEN << 1, 3)
    moved[..., 0] -= moved[..., 1]
    moved[..., 2] -= moved[..., 1]
    out.put(0, 1)
    w.put_image(out, packed(moved).ravel().tolist())
    assert (w.decode_images([out.bytes()])[0] == pixels).all()


@pytest.mark.parametrize("cache_bits", [0, 1, 4, 11])
@pytest.mark.parametrize("repeats", [False, True])
def test_references_and_cache_in_lanes(cache_bits, repeats):
    images = []
    for k in range(12):
        kinds = RNG.integers(0, 1 << 32, 6, np.uint64)
        images.append(kinds[RNG.integers(0, 6, (k + 1, 13))].astype(np.uint32))
    images.append(np.tile(smooth(1, 7), (9, 3)))
    data = []
    for p in images:
        out = header(p.shape[1], p.shape[0])
        out.put(0, 1)
        w.put_image(out, p.ravel().tolist(), cache_bits, repeats)
        data.append(out.bytes())
    assert all((x == y).all() for x, y in zip(w.decode_images(data), images, strict=True))


def test_groups_of_codes():
    pixels = smooth(8, 8)
    chosen = np.array([[0, 1], [1, 0]])
    out = header(8, 8)
    out.put(0, 2)
    out.put(1, 1)
    out.put(0, 3)
    w.put_image(out, (w.OPAQUE | chosen.astype(np.int64) << 8).ravel().tolist(), main=False)
    c = channels(pixels)[..., [1, 2, 0, 3]]
    which = chosen.repeat(4, 0).repeat(4, 1)
    lengths = np.zeros((2, 4, 256), np.int64)
    for g in (0, 1):
        for k in range(4):
            lengths[g, k] = w.limited_lengths(np.bincount(c[which == g][:, k], minlength=256)[None], 15)[0]
            out.code(np.append(lengths[g, k], np.zeros(24, np.int64)) if k == 0 else lengths[g, k])
        out.code(np.zeros(40, np.int64))
    for y in range(8):
        for x in range(8):
            for k in range(4):
                own = lengths[which[y, x], k]
                if np.count_nonzero(own) > 1:
                    out.put(dict(zip(*(v.tolist() for v in w.canonical(own)), strict=True))[int(c[y, x, k])], int(own[c[y, x, k]]))
    assert (w.decode_images([out.bytes()])[0] == pixels).all()


@pytest.mark.parametrize("text", ["", "a", "ab" * 40, "x" * 70_000, "".join(map(chr, range(1, 3000))), "the cat sat " * 900, "€" * 33])
def test_texts_round_trip(text):
    data, n = w.payload_of(text)
    assert n == len(text.encode()) and len(data) % 64 == 0 and len(data) > 0 and len(data) - n < 64 or not text
    files = w.encode_payloads([data, w.payload_of("other")[0], data])
    assert files[0] == files[2] and w.encode_payloads([data])[0] == files[0]
    read = w.decode_media(files)
    assert read[0].tobytes() == data and read[0].shape[1:] == (w.COLUMNS, 4)


def test_damaged_images_are_refused():
    good = w.encode_payloads([w.payload_of("some text " * 50 + "".join(map(chr, range(33, 90))))[0]])[0]
    with pytest.raises(ValueError):
        w.decode_media([b"RIFX" + good[4:]])
    with pytest.raises(ValueError):
        w.decode_images([w.image_data(good)[0][:60]])


def test_media_of_a_table(docs, clashing, none):
    for table in (docs, clashing):
        rows = w.digests(w.store(table)).collect()
        want = sorted((str(d), hashlib.sha256(w.payload_of(t)[0]).hexdigest(), zlib.crc32(w.payload_of(t)[0][-64:])) for d, t, *_ in ROWS)
        assert sorted((str(r.doc_id), r.payload_sha256, r.tail_crc32) for r in rows) == want
    assert w.decoded(w.store(docs)).filter("length(pixels) <> height * width * 4").count() == 0
    assert w.digests(w.store(none)).count() == 0


PAGES = [(1, "http://a/x y\r\nZ", "<p>one</p>"), (2, None, None), (3, "http://b", "<p>one</p>"), (4, "c", ""), (None, "n", "<p>one</p>"),
         (5, "d", "é" * 9000), (6, "e", "WARC/1.1\r\nWARC-Type: x\r\n\r\n"), (3, "http://b", "<p>one</p>"), (None, "m", "alone"), (None, "m", "alone")]


@pytest.mark.parametrize("compress", [True, False])
def test_archives(spark, compress):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    path = a.new_path(spark, "test-warc")
    a.write_warc(a.with_revisits(pages), path, compress)
    rows = a.read_warc(spark, path).collect()
    assert {r.kind for r in rows} == {"record"} and len(rows) == len(PAGES)
    one = len("<p>one</p>")
    want = [(1, one, "response", None), (2, 0, "response", None), (3, one, "revisit", 1), (3, one, "revisit", 1), (4, 0, "revisit", 2),
            (None, one, "revisit", 1), (5, 18000, "response", None), (6, 26, "response", None), (None, 5, "response", None),
            (None, 5, "response", None)]
    assert sorted(map(str, ((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in rows))) == sorted(map(str, want))
    html = {str(p): (h or "").encode() for p, _, h in PAGES if p}
    assert all(r.payload_digest == a.digest_of(html[str(r.page_id)]) for r in rows if r.page_id)
    none = a.new_path(spark, "test-warc")
    a.write_warc(a.with_revisits(pages.limit(0)), none, compress)
    assert a.read_warc(spark, none).count() == 0


def test_short_payloads_are_no_revisits(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    assert a.with_revisits(pages, least=20).filter("refers_to is not null").count() == 0


def records(n=6):
    return [a.record(i, f"http://h/{i}", b"payload %d " % i * 40, None, a.digest_of(b"payload %d " % i * 40)) for i in range(n)]


@pytest.mark.parametrize("compress", [True, False])
def test_damage_costs_one_record(compress):
    units = [a.member(r) + a.EMPTY if compress else r for r in records()]
    whole = b"".join(units)
    assert [f.reason for f in a.salvage(whole)] == [None] * 6
    if compress:
        assert gzip.decompress(whole) == b"".join(records())
    at = [sum(map(len, units[:i])) for i in range(7)]
    for broken in (whole[:at[2] + 40] + b"\x00\xff" + whole[at[2] + 42:],      # bytes overwritten
                   whole[:at[2] + 60] + whole[at[3]:],                           # the rest of a record lost
                   whole[:at[2]] + b"\x1f\x8b\x08 noise WARC/1.1 noise" + whole[at[3]:],
                   whole[:at[2]] + whole[at[2] + 5:]):
        found = list(a.salvage(broken))
        kept = [a._number(f.headers["warc-record-id"]) for f in found if not f.reason]
        gaps = [f for f in found if f.reason]
        assert kept == [0, 1, 3, 4, 5] and len(gaps) == 1 and gaps[0].at == at[2]
        after = len(broken) - (at[6] - at[3])
        assert after - len(a.EMPTY) * compress <= gaps[0].end <= after
    assert [bool(f.reason) for f in a.salvage(whole[:at[5] + 30])] == [False] * 5 + [True]
    assert list(a.salvage(b"")) == [] and [f.end for f in a.salvage(b"nothing here")] == [12]


@pytest.mark.parametrize("compress", [True, False])
def test_urls_like_version_lines_and_long_headers(spark, compress):
    urls = ["http://h/WARC/1.1", "WARC/1.0", "data:text/html," + "x" * (3 << 20), "http://h/WARC/1.1?"]
    pages = spark.createDataFrame([(i, u, f"page {i}") for i, u in enumerate(urls)], "page_id long, url string, html string")
    path = a.new_path(spark, "test-warc")
    a.write_warc(a.with_revisits(pages), path, compress)
    rows = a.read_warc(spark, path).collect()
    assert {r.kind for r in rows} == {"record"} and sorted((r.page_id, r.url) for r in rows) == list(enumerate(urls))


def test_members_are_unpacked_without_the_rest_of_the_file(monkeypatch):
    rng = np.random.default_rng(3)
    payloads = [rng.bytes(n) for n in [2000] * 300 + [0, 1, a.STEP - 400, a.STEP, 3 * a.STEP + 1]]
    parts = [a.record(i, None, p, None, a.digest_of(p)) for i, p in enumerate(payloads)]
    whole, fed, real = b"".join(a.member(p) + a.EMPTY for p in parts), [], zlib.decompressobj

    class Counted:
        def __init__(self, *args):
            self.own = real(*args)

        def decompress(self, data):
            fed.append(len(data))
            return self.own.decompress(data)

        def __getattr__(self, name):
            return getattr(self.own, name)

    monkeypatch.setattr(a.zlib, "decompressobj", Counted)
    found = list(a.salvage(whole))
    assert [f.block.partition(b"\r\n\r\n")[2] for f in found] == payloads and not any(f.reason for f in found)
    assert sum(fed) < 8 * len(whole)


def test_header_cut_off_inside_a_value():
    one, two = records(2)
    for cut in range(12, one.index(b"\r\n\r\n")):
        found = list(a.salvage(one[:cut] + two))
        assert [(f.at, bool(f.reason)) for f in found] == [(0, True), (cut, False)]


def test_damage_in_a_member_of_several_records():
    parts = records()
    broken = [*parts[:2], parts[2].replace(b"payload 2 ", b"payload X ", 1), *parts[3:]]
    whole = a.member(b"".join(broken)) + a.EMPTY + a.member(a.record(9, None, b"nine", None, a.digest_of(b"nine")))
    found = list(a.salvage(whole))
    assert [a._number(f.headers["warc-record-id"]) for f in found if not f.reason] == [0, 1, 3, 4, 5, 9]
    low, high = len(parts[0]) + len(parts[1]), len(parts[0]) + len(parts[1]) + len(parts[2])
    assert [f.reason for f in found if f.reason] == [f"record: block digest differs (bytes {low} to {high} of the member)"]
    alone = list(a.salvage(a.member(b"no record") + a.member(parts[0])))
    assert [(f.at, bool(f.reason)) for f in alone] == [(0, True), (len(a.member(b"no record")), False)]
